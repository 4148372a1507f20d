"""Ranking, archives, sampling weights and islands of scored programs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRECISION = 0.01


def effective_scores(df: DataFrame, score: str, raw: str, weight: str, within: list[str] | None = None, out: str = "effective") -> DataFrame:
    """Scores in steps of 0.01 (half to even), plus 0.99 of the gap to the next greater step times the row's weight.

    The greatest step takes the gap below it; a single step has gap 0. If any row of the set has no raw score,
    or none has a weight, all keep `score` (none: 0).
    """
    keys = within or []
    bucket = F.bround(F.col(raw) / PRECISION, 0) * PRECISION
    steps = df.select(*keys, bucket.alias("_b")).filter("_b IS NOT NULL").distinct()
    w = Window.partitionBy(*keys).orderBy("_b") if keys else Window.orderBy("_b")
    steps = steps.withColumn("_gap", F.coalesce(F.lead("_b").over(w) - F.col("_b"), F.col("_b") - F.lag("_b").over(w), F.lit(0.0)))
    whole = df.groupBy(*keys).agg((F.count(raw) == F.count(F.lit(1))).alias("_all"), (F.count(weight) > 0).alias("_any"))
    df = df.withColumn("_b", bucket)
    df = df.join(F.broadcast(whole)) if not keys else df.join(whole, keys)
    df = df.join(steps, [*keys, "_b"], "left")
    stepped = F.col("_b") + F.coalesce(F.col(weight), F.lit(0.0)) * F.coalesce("_gap", F.lit(0.0)) * 0.99
    return df.withColumn(out, F.when(F.col("_all") & F.col("_any"), stepped).otherwise(F.coalesce(F.col(score), F.lit(0.0)))).drop("_b", "_gap", "_all", "_any")


def top_programs(df: DataFrame, n: int, score: str, tie: str, within: list[str] | None = None) -> DataFrame:
    """The n rows of greatest score (ties: least `tie`), of all or of each set; rows without a score are left out."""
    df = df.filter(F.col(score).isNotNull())
    if not within:
        return df.orderBy(F.desc(score), tie).limit(n)
    w = Window.partitionBy(*within).orderBy(F.desc(score), tie)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def archive_rank_score(df: DataFrame, metrics: dict[str, float], within: list[str], out: str = "archive_score") -> DataFrame:
    """Sum of |weight| (rank - 1) / n over metrics, higher better for positive weights; ranks are of the archive."""
    w = Window.partitionBy(*within)
    n = F.count(F.lit(1)).over(w)
    total = F.lit(0.0)
    for name, weight in metrics.items():
        order = F.col(name).asc() if weight >= 0 else F.col(name).desc()
        total = total + abs(weight) * (F.rank().over(w.orderBy(order)) - 1) / n
    return df.withColumn(out, total)


def percentile(df: DataFrame, score: str, within: list[str], variant: str = "ties", out: str = "percentile") -> DataFrame:
    """ties: (rows below + half of those equal) / n; rank: rows below / (n - 1), alone 1."""
    w = Window.partitionBy(*within)
    ranked = w.orderBy(score)
    n, below = F.count(F.lit(1)).over(w), F.rank().over(ranked) - 1
    if variant == "rank":
        return df.withColumn(out, F.when(n > 1, below / (n - 1)).otherwise(1.0))
    upto = F.count(F.lit(1)).over(ranked.rangeBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, (below + 0.5 * (upto - below)) / n)


def parent_weights(df: DataFrame, score: str, children: str, within: list[str], sharpness: float = 10.0, out: str = "weight") -> DataFrame:
    """Sigmoid of the distance to the median in median absolute deviations, over 1 + children, normalised; all 0: even."""
    middle = df.groupBy(*within).agg(F.median(score).alias("_m"))
    df = df.join(middle, within)
    spread = df.groupBy(*within).agg(F.greatest(F.median(F.abs(F.col(score) - F.col("_m"))), F.lit(1e-6)).alias("_d"))
    df = df.join(spread, within)
    x = sharpness * (F.col(score) - F.col("_m")) / F.col("_d")
    s = F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))
    df = df.withColumn("_w", s / (1 + F.col(children)))
    w = Window.partitionBy(*within)
    total = F.sum("_w").over(w)
    return df.withColumn(out, F.when(total > 0, F.col("_w") / total).otherwise(1 / F.count(F.lit(1)).over(w))).drop("_m", "_d", "_w")


def power_law(df: DataFrame, score: str, tie: str, within: list[str], alpha: float = 1.0, out: str = "weight") -> DataFrame:
    """Chance in proportion to rank to the power -alpha."""
    w = Window.partitionBy(*within)
    df = df.withColumn("_p", F.pow(F.row_number().over(w.orderBy(F.desc(score), tie)).cast("double"), F.lit(-alpha)))
    return df.withColumn(out, F.col("_p") / F.sum("_p").over(w)).drop("_p")


def softmax(df: DataFrame, score: str, within: list[str], temperature: float, shift: bool = True, out: str = "weight") -> DataFrame:
    """exp(score / temperature), normalised; temperature 0 or less: all on the first greatest."""
    w = Window.partitionBy(*within)
    if temperature <= 0:
        return df.withColumn(out, F.when(F.rank().over(w.orderBy(F.desc(score))) == 1, 1.0).otherwise(0.0))
    x = F.col(score) / temperature
    df = df.withColumn("_e", F.exp(x - F.max(x).over(w)) if shift else F.exp(x))
    return df.withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def island_weights(df: DataFrame, fitness: str, count: str, a: float = 1.0, b: float = 1.0, out: str = "weight") -> DataFrame:
    """fitness**a / count**b, normalised over all islands; sum 0: even. Islands are few: one row each."""
    df = df.withColumn("_w", F.pow(F.col(fitness), F.lit(a)) / F.pow(F.greatest(F.col(count).cast("double"), F.lit(1.0)), F.lit(b)))
    whole = df.agg(F.sum("_w").alias("_t"), F.count(F.lit(1)).alias("_n"))
    return df.join(F.broadcast(whole)).withColumn(out, F.when(F.col("_t") != 0, F.col("_w") / F.col("_t")).otherwise(1 / F.col("_n"))).drop("_w", "_t", "_n")


def migrants(df: DataFrame, island: str, score: str, generation: str, tie: str, rate: float) -> DataFrame:
    """The rows each island may send, best first: not its best, none of generation 0, max(1, n * rate) at most; islands of one send none."""
    w = Window.partitionBy(island)
    df = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc(score), tie)))
    df = df.filter((F.col("_n") > 1) & (F.col("_r") > 1) & (F.col(generation) > 0))
    df = df.withColumn("_k", F.row_number().over(w.orderBy("_r")))
    return df.filter(F.col("_k") <= F.greatest(F.lit(1), F.floor(F.col("_n") * rate))).drop("_n", "_r", "_k")


def _skyline(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a partition that no other one of it dominates."""
    front = None
    for frame in frames:
        both = frame if front is None else pd.concat([front, frame])
        left = both.to_numpy(float)
        order = np.argsort(-left.sum(axis=1), kind="stable")  # a row is dominated by one of a greater sum only
        kept: list[int] = []
        left = left[order]
        for i in range(len(left)):
            rivals = left[kept]
            if not len(rivals) or not ((rivals >= left[i]).all(axis=1) & (rivals > left[i]).any(axis=1)).any():
                kept.append(i)
        front = both.iloc[order[kept]]
    if front is not None:
        yield front


def pareto_front(df: DataFrame, goals: list[str]) -> DataFrame:
    """Rows that no row of the given candidates dominates: at least as good in all goals and better in one.

    Candidates with equal goals stand or fall together. Each partition of the distinct
    goal vectors gives its own front first, and only what is on one is compared.
    """
    points = df.select(*goals).filter(" AND ".join(f"{g} IS NOT NULL" for g in goals)).distinct()
    points = points.mapInPandas(_skyline, points.schema)
    other = points.select(*(F.col(g).alias(f"_{g}") for g in goals))
    as_good = F.lit(True)
    better = F.lit(False)
    for g in goals:
        as_good, better = as_good & (F.col(f"_{g}") >= F.col(g)), better | (F.col(f"_{g}") > F.col(g))
    front = points.join(other, as_good & better, "left_anti")
    return df.join(front, goals, "left_semi")


def upper_confidence(df: DataFrame, mean: str, n: str, scale: float = 2.0, out: str = "ucb") -> DataFrame:
    """mean + sqrt(scale ln t / n), t being all draws; an arm never drawn is infinite."""
    whole = df.agg(F.sum(n).cast("double").alias("_t"))
    bonus = F.sqrt(scale * F.log(F.greatest("_t", F.lit(1.0))) / F.col(n))
    return df.join(F.broadcast(whole)).withColumn(out, F.when(F.col(n) > 0, F.col(mean) + bonus).otherwise(float("inf"))).drop("_t")


def distinct_best(df: DataFrame, group: list[str], key: Column, score: str, tie: str) -> DataFrame:
    """The best row of each normalised answer."""
    w = Window.partitionBy(*group, key).orderBy(F.desc(score), tie)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def resample_weights(df: DataFrame, score: str, method: str, power: float = 2.0, out: str = "weight") -> DataFrame:
    """Chances of rows to be drawn again: pow |s|**power; max_min 1 for the greatest and the least score, else 0; max_random 1 for the greatest, 0.4 for the others; normalised."""
    whole = df.agg(F.max(score).alias("_hi"), F.min(score).alias("_lo"))
    df = df.join(F.broadcast(whole))
    s = F.col(score)
    raw = {"pow": F.pow(F.abs(s), F.lit(power)), "max_min": F.when(s.isin(F.col("_hi"), F.col("_lo")), 1.0).otherwise(0.0), "max_random": F.when(s == F.col("_hi"), 1.0).otherwise(0.4)}[method]
    df = df.withColumn("_w", raw)
    return df.join(F.broadcast(df.agg(F.sum("_w").alias("_t")))).withColumn(out, F.col("_w") / F.col("_t")).drop("_hi", "_lo", "_w", "_t")


def optimistic_bound(df: DataFrame, fitness: str, n: str, scale: float, fewest: int, prior: float, out: str = "bound") -> DataFrame:
    """fitness + scale sqrt(ln N / n); rows tried fewer than `fewest` times take the prior as fitness."""
    whole = df.agg(F.greatest(F.sum(n), F.lit(1)).cast("double").alias("_t"))
    base = F.when(F.col(n) < fewest, prior).otherwise(F.col(fitness))
    return df.join(F.broadcast(whole)).withColumn(out, base + scale * F.sqrt(F.log("_t") / F.greatest(F.col(n), F.lit(1)))).drop("_t")


def one_right_rest_wrong(df: DataFrame, group: list[str], right: str, score: str, tie: str, size: int) -> DataFrame:
    """`size` rows a group, best first; where more are there and any is right, the best right one and the best wrong ones."""
    w = Window.partitionBy(*group)
    df = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.desc(score), tie)))
    df = df.withColumn("_r", F.row_number().over(Window.partitionBy(*group, right).orderBy(F.desc(score), tie)))
    df = df.withColumn("_rights", F.sum(F.col(right).cast("int")).over(w))
    mixed = F.when(F.col(right), F.col("_r") == 1).otherwise(F.col("_r") <= size - 1)
    return df.filter(F.when((F.col("_n") > size) & (F.col("_rights") > 0), mixed).otherwise(F.col("_k") <= size)).drop("_n", "_k", "_r", "_rights")


def exploration_weights(df: DataFrame, children: str, score: str, temperature: float, within: list[str], out: str = "weight") -> DataFrame:
    """Softmax of 10 times the score, and 1 more for what has no children, over the temperature (0.01 at least); at 0 or less the best alone."""
    w = Window.partitionBy(*within)
    x = 10 * F.col(score) + F.when(F.coalesce(F.col(children), F.lit(0)) == 0, 1.0).otherwise(0.0)
    if temperature <= 0:
        return df.withColumn(out, F.when(x == F.max(x).over(w), 1.0).otherwise(0.0))
    df = df.withColumn("_x", x / max(temperature, 0.01))
    df = df.withColumn("_e", F.exp(F.col("_x") - F.max("_x").over(w)))
    return df.withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_x", "_e")


def annealed(used: Column, budget: float, start: float = 1.5, end: float = 0.3) -> Column:
    """A temperature that falls in proportion to the budget used."""
    return start + (end - start) * F.least(F.greatest(used / budget, F.lit(0.0)), F.lit(1.0))


def drawn(df: DataFrame, group: list[str], key: str, weight: str, u: Column) -> DataFrame:
    """One row a group: that in whose stretch of the cumulative weights u (0 to 1) times their sum falls."""
    w = Window.partitionBy(*group).orderBy(key)
    rows = df.withColumn("_c", F.sum(weight).over(w)).withColumn("_t", F.sum(weight).over(Window.partitionBy(*group)))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.when(F.col("_c") > u * F.col("_t"), 0).otherwise(1), "_c", key)))
    return rows.filter("_r = 1").drop("_c", "_t", "_r")


def nucleus(df: DataFrame, row: list[str], token: str, logit: str, temperature: float = 1.0, top_k: int | None = None, top_p: float | None = None) -> DataFrame:
    """Tokens that sampling may take: the top_k greatest logits, and of their probabilities the first that come to top_p. Adds prob, over all tokens."""
    w = Window.partitionBy(*row)
    order = w.orderBy(F.desc(logit), token)
    x = F.col(logit) / temperature
    rows = df.withColumn("_e", F.exp(x - F.max(x).over(w)))
    rows = rows.withColumn("prob", F.col("_e") / F.sum("_e").over(w)).withColumn("_r", F.row_number().over(order))
    rows = rows.withColumn("_c", F.sum("prob").over(order) - F.col("prob"))
    keep = F.lit(True)
    if top_k:
        keep &= F.col("_r") <= top_k
    if top_p is not None and top_p < 1:
        keep &= F.col("_c") < top_p
    return rows.filter(keep).drop("_e", "_r", "_c")


def new_only(nodes: DataFrame, known: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Nodes whose trajectory no known node has; of equal ones among themselves, the least key."""
    w = Window.partitionBy(*columns).orderBy(key)
    return nodes.join(known.select(*columns).distinct(), columns, "left_anti").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
