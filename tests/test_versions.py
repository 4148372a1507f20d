"""The versioned table: updates by key, old versions, folders that stay, writers that fail."""

import os

import pytest
from pyspark.sql import functions as F

from tesserakt.sources.versions import Versions


def rows(df):
    return {r["id"]: (r["score"], r["code"]) for r in df.collect()}


def test_versions(spark, tmp_path):
    table = Versions(spark, f"file://{tmp_path}/programs", buckets=8)
    assert table.latest() == -1
    with pytest.raises(ValueError, match="no version"):
        table.read()
    first = spark.createDataFrame([(i, float(i), f"c{i}") for i in range(100)], "id long, score double, code string")
    assert table.upsert(first) == 0
    some = spark.createDataFrame([(3, 33.0, "new"), (200, 1.0, "more")], "id long, score double, code string")
    assert table.upsert(some) == 1
    want = {i: (float(i), f"c{i}") for i in range(100)}
    assert rows(table.read(0)) == want
    want1 = want | {3: (33.0, "new"), 200: (1.0, "more")}
    assert rows(Versions(spark, f"file://{tmp_path}/programs", buckets=8).read()) == want1  # opened anew
    (made,) = (x for x in os.listdir(tmp_path / "programs/data") if x.startswith("1-"))
    assert len([x for x in os.listdir(tmp_path / "programs/data" / made) if x.startswith("bucket=")]) <= 2
    assert table.update({"score": F.col("score") * 2}, F.col("id") < 5) == 2
    assert rows(table.read()) == {i: (s * 2 if i < 5 else s, c) for i, (s, c) in want1.items()} and rows(table.read(1)) == want1
    assert table.delete(spark.createDataFrame([(200,), (7,), (999,)], "id long")) == 3
    assert set(rows(table.read())) == set(range(100)) - {7} and rows(table.read(0)) == want
    assert table.delete(table.read().select("id")) == 4 and table.latest() == 4
    assert table.read().count() == 0 and table.read().columns == ["id", "score", "code"]
    assert table.upsert(some) == 5 and set(rows(table.read())) == {3, 200}


def test_writers_that_fail_or_meet(spark, tmp_path):
    path = f"file://{tmp_path}/programs"
    table = Versions(spark, path, buckets=4)
    table.save(spark.createDataFrame([(1, 1.0, "a")], "id long, score double, code string"))
    broken = spark.createDataFrame([(1, 2.0, "b")], "id long, score double, code string").withColumn("code", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        table.upsert(broken)
    assert table.latest() == 0 and rows(table.read()) == {1: (1.0, "a")}
    other = spark.createDataFrame([(2, 2.0, "b")], "id long, score double, code string")
    os.makedirs(tmp_path / "programs/versions/version=1")
    with pytest.raises(Exception, match="(?i)exists"):
        table.upsert(other)  # another writer makes that version
    assert rows(table.read()) == {1: (1.0, "a")}
    os.rmdir(tmp_path / "programs/versions/version=1")
    assert table.upsert(other) == 1 and rows(table.read()) == {1: (1.0, "a"), 2: (2.0, "b")}
