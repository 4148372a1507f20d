"""Off-policy correction of tokens in long form: importance weights, rejection masks, their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserakt.operators.grouped import all_of
from tesserakt.operators.losses import clip

BOUND = 20.0


def bounds(threshold: str | float) -> tuple[float, float]:
    """low and high of "low_high"; a single number is the high one, the low one its inverse."""
    if isinstance(threshold, bool):
        raise TypeError("a threshold is a number or low_high")
    low, _, high = str(threshold).partition("_")
    pair = (float(low), float(high)) if high else (1 / float(low), float(low))
    if not 0 < pair[0] <= pair[1]:
        raise ValueError(f"bad threshold {threshold}")
    return pair


def importance_weights(df: DataFrame, seq: str, log_ratio: str, mask: str, level: str = "token", threshold: str | float = 2.0, normalise: bool = False, out: str = "weight") -> DataFrame:
    """exp of the token's or the whole sequence's log-ratio. A single threshold cuts weights off; low_high sets those outside to 0."""
    x = F.col(log_ratio)
    if level == "sequence":
        x = F.sum(F.when(F.col(mask) == 1, x).otherwise(0.0)).over(Window.partitionBy(seq))
    elif level != "token":
        raise ValueError("level is token or sequence")
    w = F.exp(clip(x, -BOUND, BOUND))
    if "_" in str(threshold):
        low, high = bounds(threshold)
        w = F.when((w >= low) & (w <= high), w).otherwise(0.0)
    else:
        w = F.least(w, F.lit(float(threshold)))
    df = df.withColumn(out, w * F.col(mask))
    if normalise:
        kept = F.when(F.col(mask) == 1, F.col(out))
        df = df.join(F.broadcast(df.agg(F.avg(kept).alias("_m")))).withColumn(out, F.col(out) / F.greatest(F.col("_m"), F.lit(1e-8))).drop("_m")
    return df


def divergence(log_ratio: Column, kind: str) -> Column:
    """k1: minus the log-ratio; k2: half its square; k3: exp(x) - 1 - x."""
    x = clip(log_ratio, -BOUND, BOUND)
    return {"k1": -x, "k2": 0.5 * x * x, "k3": F.exp(x) - 1 - x}[kind]


def rejection_mask(df: DataFrame, seq: str, log_ratio: str, mask: str, options: dict[str, str | float], out: str = "kept") -> DataFrame:
    """The mask less what any option rejects: token_k*, seq_sum_k*, seq_mean_k*, seq_max_k*.

    k1 lies between the logs of low and high; k2 and k3 at most at the threshold.
    """
    import math

    w = Window.partitionBy(seq)
    m = F.col(mask) == 1
    tests = []
    for option, threshold in options.items():
        scope, _, kind = option.rpartition("_")
        d = divergence(F.col(log_ratio), kind)
        kept = F.when(m, d)
        if scope == "token":
            stat = d
        elif scope in ("seq_sum", "seq_mean", "seq_max"):
            stat = {"seq_sum": F.sum, "seq_mean": F.avg, "seq_max": F.max}[scope](kept).over(w)
        else:
            raise ValueError(f"no option {option}")
        if kind == "k1":
            if scope == "seq_max":
                raise ValueError("seq_max goes with k2 and k3")
            low, high = bounds(threshold)
            tests.append((stat >= math.log(low)) & (stat <= math.log(high)))
        else:
            tests.append(stat <= float(threshold))
    return df.withColumn(out, F.when(m & all_of(tests), 1).otherwise(0))


def weight_statistics(df: DataFrame, weight: str, mask: str) -> DataFrame:
    """Mean, extremes and effective sample share 1 / mean((w / mean w)**2) of masked weights."""
    w = F.when(F.col(mask) == 1, F.col(weight))
    return df.agg(F.avg(w).alias("mean"), F.max(w).alias("max"), F.min(w).alias("min"), (F.avg(w) * F.avg(w) / F.avg(w * w)).alias("ess"))


def offpolicy_statistics(df: DataFrame, seq: str, old: str, rollout: str, mask: str) -> DataFrame:
    """Perplexities, KL estimates and chi-square of two samplers over masked tokens."""
    m = F.col(mask) == 1
    x = F.when(m, F.col(old) - F.col(rollout))
    tokens = df.agg(F.avg(-x).alias("kl"), F.avg(F.exp(x) - 1 - x).alias("k3_kl"), (F.avg(F.exp(2 * clip(x, -BOUND, BOUND))) - 1).alias("chi2_token"))
    rows = df.groupBy(seq).agg(F.avg(F.when(m, F.col(old))).alias("_o"), F.avg(F.when(m, F.col(rollout))).alias("_r"), F.sum(x).alias("_x"))
    seqs = rows.agg(F.avg(F.exp(-F.col("_o"))).alias("training_ppl"), F.avg(F.exp(-F.col("_r"))).alias("rollout_ppl"), F.avg(F.exp(F.col("_o") - F.col("_r"))).alias("ppl_ratio"), (F.avg(F.exp(2 * clip(F.col("_x"), -BOUND, BOUND))) - 1).alias("chi2_seq"))
    return tokens.join(seqs)


def rejection_statistics(df: DataFrame, seq: str, value: str, mask: str, high: float, low: float | None = None, by_sequence: bool = False) -> DataFrame:
    """What a rejection statistic looks like over masked tokens and over sequences: mean, extremes, shares beyond the thresholds, deviations.

    The token deviation is that of values held within the thresholds (0 where there is
    no lower one); extremes and shares are those of sequence means where `by_sequence`.
    """
    x = F.when(F.col(mask) == 1, F.col(value))
    held = clip(x, low if low is not None else 0.0, high)
    tokens = df.agg(F.avg(x).alias("mean"), F.max(x).alias("_max"), F.min(x).alias("_min"), F.avg(F.when(x > high, 1.0).when(x.isNotNull(), 0.0)).alias("_high"), F.avg(F.when(x < low, 1.0).when(x.isNotNull(), 0.0) if low is not None else F.lit(0.0)).alias("_low"), F.sqrt(F.greatest(F.avg(held * held) - F.avg(held) * F.avg(held), F.lit(0.0))).alias("std"))
    rows = df.groupBy(seq).agg(F.avg(x).alias("_x")).filter("_x IS NOT NULL")
    s = F.col("_x")
    seqs = rows.agg(
        F.avg(s).alias("seq_mean"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("seq_std"), F.max(s).alias("seq_max"), F.min(s).alias("seq_min"), F.max(F.abs(s)).alias("seq_max_deviation"),
        F.avg(F.when(s > high, 1.0).otherwise(0.0)).alias("seq_fraction_high"), (F.avg(F.when(s < low, 1.0).otherwise(0.0)) if low is not None else F.lit(0.0)).alias("seq_fraction_low"),
    )
    pick = lambda a, b: F.col(a if by_sequence else b)
    both = tokens.join(seqs)  # one row each
    return both.select("mean", "std", pick("seq_max", "_max").alias("max"), pick("seq_min", "_min").alias("min"), pick("seq_fraction_high", "_high").alias("fraction_high"), pick("seq_fraction_low", "_low").alias("fraction_low"), *seqs.columns)
