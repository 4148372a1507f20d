"""Every query against its SQL in DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from tesserakt.plans import extra, graded, more, programs, registry  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _key(row):
    return tuple((v is None, "" if isinstance(v, (int, float)) else str(type(v)), 0 if v is None else v) for v in row)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(_norm(v) for v in r) for r in df.select(*columns).collect()), key=_key)
    assert rows
    if name in registry.ORACLES:
        found = duck.execute(registry.ORACLES[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert rows == sorted((tuple(_norm(r[i]) for i in at) for r in found.fetchall()), key=_key)


def test_flagship_is_registered():
    assert registry.FLAGSHIP in registry.QUERIES and set(registry.ORACLES) <= set(registry.QUERIES)
