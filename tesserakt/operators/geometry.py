"""Checks and scores of point and circle arrangements: a solution is a few dozen rows with one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(circles: DataFrame, key: str, i: str, x: str, y: str, r: str, slack: float = 1e-6) -> DataFrame:
    """Pairs i < j of one solution whose circles overlap by more than the slack."""
    other = circles.select(F.col(key).alias("_k"), F.col(i).alias("j"), F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(r).alias("_r"))
    pairs = circles.join(other, (F.col(key) == F.col("_k")) & (F.col(i) < F.col("j")))
    distance = F.hypot(F.col(x) - F.col("_x"), F.col(y) - F.col("_y"))
    return pairs.filter(distance < F.col(r) + F.col("_r") - slack).select(key, F.col(i).alias("i"), "j", distance.alias("distance"))


def packing_report(circles: DataFrame, key: str, i: str, x: str, y: str, r: str, width: float = 1.0, height: float = 1.0, slack: float = 1e-6) -> DataFrame:
    """Sum of radii of each solution and the first rule it breaks: numbers, negative radius, outside, overlap; null if none."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c)
    outside = (F.col(x) - F.col(r) < -slack) | (F.col(x) + F.col(r) > width + slack) | (F.col(y) - F.col(r) < -slack) | (F.col(y) + F.col(r) > height + slack)
    rules = circles.groupBy(key).agg(
        F.sum(r).alias("sum_r"), F.count(F.lit(1)).alias("n"), F.max(bad(x) | bad(y) | bad(r)).alias("_nan"), F.max(F.col(r) < 0).alias("_negative"), F.max(outside).alias("_outside")
    )
    hit = overlaps(circles, key, i, x, y, r, slack).select(F.col(key).alias("_o")).distinct()
    out = rules.join(hit, F.col(key) == F.col("_o"), "left")
    rule = F.when(F.col("_nan"), "not a number").when(F.col("_negative"), "negative radius").when(F.col("_outside"), "outside").when(F.col("_o").isNotNull(), "overlap")
    return out.select(key, "n", "sum_r", rule.alias("violation"))


def area(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay)) / 2


def smallest_triangle(points: DataFrame, key: str, i: str, x: str, y: str) -> DataFrame:
    """Least area of the triangles of each solution: two equi-joins on the key with i < j < k, then a minimum taken early."""
    b = points.select(F.col(key).alias("_k1"), F.col(i).alias("_j"), F.col(x).alias("_bx"), F.col(y).alias("_by"))
    c = points.select(F.col(key).alias("_k2"), F.col(i).alias("_l"), F.col(x).alias("_cx"), F.col(y).alias("_cy"))
    three = points.join(b, (F.col(key) == F.col("_k1")) & (F.col(i) < F.col("_j"))).join(c, (F.col(key) == F.col("_k2")) & (F.col("_j") < F.col("_l")))
    return three.groupBy(key).agg(F.min(area(F.col(x), F.col(y), F.col("_bx"), F.col("_by"), F.col("_cx"), F.col("_cy"))).alias("area"))


def pair_distances(points: DataFrame, key: str, i: str, x: str, y: str) -> DataFrame:
    """Least and greatest distance of each solution's points."""
    b = points.select(F.col(key).alias("_k"), F.col(i).alias("_j"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    d = F.hypot(F.col(x) - F.col("_x"), F.col(y) - F.col("_y"))
    return points.join(b, (F.col(key) == F.col("_k")) & (F.col(i) < F.col("_j"))).groupBy(key).agg(F.min(d).alias("least"), F.max(d).alias("greatest"))
