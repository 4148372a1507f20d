"""Whether trials of a candidate can stop early, from their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of the rational Chebyshev approximation of erfc, error below 1.2e-7.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_cdf(x: Column) -> Column:
    z = F.abs(x) / 2**0.5
    t = 1 / (1 + 0.5 * z)
    poly = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        poly = poly * t + c
    tail = t * F.exp(-z * z + poly) / 2
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def decide(df: DataFrame, group: list[str], score: str, threshold: float, cutoff: float = 0.05, fewest: int = 2) -> DataFrame:
    """Chance that a group's mean beats the threshold (normal model), and beats, fails or uncertain."""
    n, mean, se = F.count(score), F.avg(score), F.stddev_samp(score) / F.sqrt(F.count(score))
    rows = df.groupBy(*group).agg(n.alias("n"), mean.alias("_m"), se.alias("_se"))
    chance = F.when(F.col("n") < fewest, 0.5).when(F.col("_se") < 1e-10, F.when(F.col("_m") > threshold, 1.0).otherwise(0.0)).otherwise(1 - normal_cdf((F.lit(threshold) - F.col("_m")) / F.col("_se")))
    rows = rows.withColumn("chance", chance)
    told = F.when(F.col("n") < fewest, "uncertain").when(F.col("chance") > 1 - cutoff, "beats").when(F.col("chance") < cutoff, "fails").otherwise("uncertain")
    return rows.select(*group, "n", "chance", told.alias("prediction"))
