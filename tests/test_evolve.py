"""Trajectory changes and early stopping on small cases."""

import math

from pyspark.sql import functions as F

from tesserakt.functions import stopping
from tesserakt.operators import evolve


def turns(text):
    """t: think, s: search, o: observation, a: answer, each followed by its content."""
    kinds = {"t": ("agent", "think"), "s": ("agent", "search"), "o": ("obs", "info"), "a": ("agent", "answer")}
    return [(*kinds[x[0]], x) for x in text.split()]


def written(value):
    return None if value is None else " ".join(x["content"] for x in value)


def run(spark, a, b, make):
    schema = "a array<struct<role:string,kind:string,content:string>>, b array<struct<role:string,kind:string,content:string>>"
    df = spark.createDataFrame([(turns(a), turns(b))], schema)
    return written(df.select(make(F.col("a"), F.col("b")).alias("x")).first()["x"])


def test_changes(spark):
    a, b = "t1 s1 o1 t2 s2 o2 t3 s3 o3 t4 a1", "t1 s1 o1 t5 s5 o5 t6 a2"
    assert run(spark, a, b, evolve.combine) == a + " t5 s5 o5 t6 a2"
    assert run(spark, a, a, evolve.combine) is None
    assert run(spark, a, "t9 a9", evolve.combine) is None
    assert run(spark, a, b, lambda x, y: evolve.delete(x, F.lit(7))) == "t1 s1 o1 t3 s3 o3 t4 a1"
    assert run(spark, b, a, lambda x, y: evolve.delete(x, F.lit(0))) is None
    assert run(spark, a, b, lambda x, y: evolve.translocate(x, y, F.lit(1), F.lit(0))) == "t1 s1 o1 t2 s2 o2 t5 s5 o5 t4 a1"
    assert run(spark, a, "t1 s1 o1", lambda x, y: evolve.translocate(x, y, F.lit(0), F.lit(0))) is None
    assert run(spark, a, b, lambda x, y: evolve.crossover(x, y, F.lit(1), F.lit(1))) == "t1 s1 o1 t2 s2 o2 t6 a2"
    assert run(spark, a, b, lambda x, y: evolve.crossover(x, y, F.lit(3), F.lit(0))) == a + " t5 s5 o5 t6 a2"
    assert run(spark, a, b, lambda x, y: evolve.capped_searches(x, 2)) == "t1 s1 o1 t2 s2 o2"
    assert run(spark, a, b, lambda x, y: evolve.capped_searches(x, 3)) == a


def test_early_stop(spark):
    rows = [("low", 0.1), ("low", 0.12), ("low", 0.11), ("high", 0.9), ("high", 0.95), ("even", 0.5), ("even", 0.5), ("one", 0.9), ("mixed", 0.2), ("mixed", 0.9)]
    got = {r["g"]: (r["prediction"], r["chance"]) for r in stopping.decide(spark.createDataFrame(rows, "g string, s double"), ["g"], "s", 0.5).collect()}
    assert {g: p for g, (p, _) in got.items()} == {"low": "fails", "high": "beats", "even": "fails", "one": "uncertain", "mixed": "uncertain"}
    mean, se = 0.55, math.sqrt(((0.2 - 0.55) ** 2 + (0.9 - 0.55) ** 2) / 1) / math.sqrt(2)
    assert abs(got["mixed"][1] - (1 - 0.5 * (1 + math.erf((0.5 - mean) / se / math.sqrt(2))))) < 1e-6
