"""Group-relative advantages of scored rollouts.

Every estimator takes one row for a rollout and adds a column; group statistics
are window aggregates over the group, so one shuffle by group key serves all.
Estimators differ in their treatment of groups of one, which is stated for each.
Two families of formulas exist for some of them; ``variant`` tells which.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-6
#: Elements of a sequence that are collected at a time.
FOLD = 128

_ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Name an estimator; a second function under one name is an error."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if _ESTIMATORS.setdefault(name, f) is not f:
            raise ValueError(f"{name} names another estimator already")
        return f

    return put


def estimator(name: str) -> Callable[..., DataFrame]:
    if name not in _ESTIMATORS:
        raise ValueError(f"no estimator {name}: {sorted(_ESTIMATORS)}")
    return _ESTIMATORS[name]


def _of(value: Column, keys: list[str]) -> tuple[Column, Column, Column]:
    """Number, mean and sample deviation of the group; a group of one has mean 0 and deviation 1."""
    w = Window.partitionBy(*keys)
    n = F.count(value).over(w)
    return n, F.when(n > 1, F.avg(value).over(w)).otherwise(0.0), F.when(n > 1, F.stddev_samp(value).over(w)).otherwise(1.0)


def normalised(value: Column, keys: list[str], by_std: bool = True, epsilon: float = EPSILON) -> Column:
    _, mean, std = _of(value, keys)
    return (value - mean) / (std + epsilon) if by_std else value - mean


@register("grpo")
def grpo(df: DataFrame, score: str, group: list[str], by_std: bool = True, epsilon: float = EPSILON, out: str = "adv") -> DataFrame:
    """(s - mean) / (sample deviation + epsilon); alone: s / (1 + epsilon)."""
    return df.withColumn(out, normalised(F.col(score), group, by_std, epsilon))


@register("grpo_vectorized")
def grpo_vectorized(df: DataFrame, score: str, group: list[str], epsilon: float = EPSILON, out: str = "adv") -> DataFrame:
    """As grpo from sums, the variance held at epsilon at least before the root."""
    w = Window.partitionBy(*group)
    s = F.col(score)
    n, total, squares = F.count(s).over(w), F.sum(s).over(w), F.sum(s * s).over(w)
    mean = F.when(n > 1, total / n).otherwise(0.0)
    std = F.when(n > 1, F.sqrt(F.greatest((squares - total * total / n) / (n - 1), F.lit(epsilon)))).otherwise(1.0)
    return df.withColumn(out, (s - mean) / (std + epsilon))


@register("grpo_weighted")
def grpo_weighted(df: DataFrame, score: str, group: list[str], temperature: float = 2.0, epsilon: float = EPSILON, out: str = "adv") -> DataFrame:
    """Positive scores weigh e**T against 1; advantages are taken from the weighted mean."""
    w = Window.partitionBy(*group)
    s = F.col(score)
    e = float(__import__("math").exp(temperature))
    n, right = F.count(s).over(w), F.sum(F.when(s > 0, 1).otherwise(0)).over(w)
    weight = F.when(s > 0, e).otherwise(1.0) / (e * F.greatest(right, F.lit(1)) + (n - right))
    df = df.withColumn("_w", weight)
    mean = F.sum(F.col("_w") * s).over(w)
    _, _, std = _of(s, group)
    return df.withColumn(out, (s - mean) * F.col("_w") * n / (std + epsilon)).drop("_w")


def tilted(value: Column, keys: list[str], beta: float) -> Column:
    w = Window.partitionBy(*keys)
    e = F.exp(beta * value - F.max(beta * value).over(w))
    return e / F.avg(e).over(w) - 1


@register("tilted")
def tilt(df: DataFrame, score: str, group: list[str], beta: float = 1.0, out: str = "adv") -> DataFrame:
    """exp(beta s) over its group mean, less 1."""
    w = Window.partitionBy(*group)
    df = df.withColumn("_e", F.exp(beta * F.col(score) - F.max(beta * F.col(score)).over(w)))
    return df.withColumn(out, F.col("_e") / F.avg("_e").over(w) - 1).drop("_e")


@register("tree_inner")
def tree_inner(df: DataFrame, score: str, group: list[str], tree: list[str], epsilon: float = EPSILON, out: str = "adv") -> DataFrame:
    """Normalised by group, then the result by tree."""
    df = grpo(df, score, group, epsilon=epsilon, out="_first")
    return grpo(df, "_first", tree, epsilon=epsilon, out=out).drop("_first")


@register("tree_inner_tilted")
def tree_inner_tilted(df: DataFrame, score: str, group: list[str], tree: list[str], beta: float = 1.0, out: str = "adv") -> DataFrame:
    return tilt(tilt(df, score, group, beta, "_first"), "_first", tree, beta, out).drop("_first")


@register("tree")
def tree_sum(df: DataFrame, score: str, group: list[str], tree: list[str], epsilon: float = EPSILON, out: str = "adv") -> DataFrame:
    """Normalised by group plus normalised by tree."""
    df = grpo(grpo(df, score, group, epsilon=epsilon, out="_a"), score, tree, epsilon=epsilon, out="_b")
    return df.withColumn(out, F.col("_a") + F.col("_b")).drop("_a", "_b")


@register("maxrl")
def maxrl(df: DataFrame, score: str, group: list[str], variant: str = "reward", epsilon: float = EPSILON, out: str = "adv") -> DataFrame:
    """grpo times G / K where 0 < K < G; K counts positive rewards or positive advantages."""
    df = grpo(df, score, group, epsilon=epsilon, out="_a")
    w = Window.partitionBy(*group)
    counted = F.col(score) if variant == "reward" else F.col("_a")
    g, k = F.count(F.lit(1)).over(w), F.sum(F.when(counted > 0, 1).otherwise(0)).over(w)
    return df.withColumn(out, F.col("_a") * F.when((k > 0) & (k < g), g / k).otherwise(1.0)).drop("_a")


@register("rloo")
def rloo(df: DataFrame, score: str, group: list[str], variant: str = "loop", out: str = "adv") -> DataFrame:
    """Against the mean of the others; alone: the score (loop) or 0 (vectorized)."""
    w = Window.partitionBy(*group)
    s, n = F.col(score), F.count(score).over(w)
    return df.withColumn(out, F.when(n > 1, (n * s - F.sum(s).over(w)) / (n - 1)).otherwise(s if variant == "loop" else F.lit(0.0)))


@register("opo")
def opo(df: DataFrame, score: str, length: str, group: list[str], out: str = "adv") -> DataFrame:
    """Against the mean weighted by length; alone: against 0."""
    w = Window.partitionBy(*group)
    base = F.sum(F.col(length) * F.col(score)).over(w) / F.sum(length).over(w)
    return df.withColumn(out, F.col(score) - F.when(F.count(score).over(w) > 1, base).otherwise(0.0))


@register("gpg")
def gpg(df: DataFrame, score: str, group: list[str], f_norm: float = 1.0, out: str = "adv") -> DataFrame:
    """alpha (s - mean) / f_norm, alpha being rows over rows with a score other than 0; alone: mean 0."""
    whole = df.agg(F.count(F.lit(1)).alias("_n"), F.greatest(F.sum(F.when(F.col(score) != 0, 1).otherwise(0)), F.lit(1)).alias("_z"))
    _, mean, _ = _of(F.col(score), group)
    return df.join(F.broadcast(whole)).withColumn(out, F.col("_n") / F.col("_z") * (F.col(score) - mean) / f_norm).drop("_n", "_z")


@register("pass_at_k")
def pass_at_k(df: DataFrame, score: str, group: list[str], order: str, by_std: bool = True, epsilon: float = EPSILON, out: str = "adv") -> DataFrame:
    """The best row (first by `order` among equals) gets best - second best; the others 0."""
    w = Window.partitionBy(*group)
    ranked = w.orderBy(F.desc(score), order)
    df = df.withColumn("_r", F.row_number().over(ranked)).withColumn("_second", F.max(F.when(F.col("_r") == 2, F.col(score))).over(w))
    gap = F.col(score) - F.col("_second")
    if by_std:
        gap = gap / (F.stddev_samp(score).over(w) + epsilon)
    return df.withColumn(out, F.when(F.col("_r") == 1, gap).otherwise(0.0)).drop("_r", "_second")


def whitened(df: DataFrame, value: str, mask: str | None = None, shift_mean: bool = True, out: str = "adv") -> DataFrame:
    """(x - mean) / sqrt(sample variance + 1e-8) over all rows, or those of the mask."""
    kept = F.col(value) if mask is None else F.when(F.col(mask) == 1, F.col(value))
    whole = df.agg(F.avg(kept).alias("_m"), F.var_samp(kept).alias("_v"))
    x = (F.col(value) - F.col("_m")) / F.sqrt(F.col("_v") + 1e-8)
    return df.join(F.broadcast(whole)).withColumn(out, x if shift_mean else x + F.col("_m")).drop("_m", "_v")


@register("reinforce_pp_baseline")
def reinforce_baseline(df: DataFrame, score: str, group: list[str], out: str = "adv") -> DataFrame:
    """s less the group mean (alone: less 0), whitened over all rows."""
    _, mean, _ = _of(F.col(score), group)
    return whitened(df.withColumn("_d", F.col(score) - mean), "_d", out=out).drop("_d")


@register("gdpo")
def gdpo(df: DataFrame, scores: list[str], weights: list[float], group: list[str], epsilon: float = EPSILON, out: str = "adv") -> DataFrame:
    """Weighted sum of each reward's grpo, whitened."""
    total = sum((w * normalised(F.col(s), group, epsilon=epsilon) for s, w in zip(scores, weights, strict=True)), F.lit(0.0))
    return whitened(df.withColumn("_d", total), "_d", out=out).drop("_d")


@register("per_token")
def per_token(df: DataFrame, reward: str, mask: str, group: list[str], epsilon: float = EPSILON, out: str = "adv") -> DataFrame:
    """Tokens of a group pooled; a group of one token has that token as mean and deviation 1."""
    w = Window.partitionBy(*group)
    kept = F.when(F.col(mask) == 1, F.col(reward))
    n = F.count(kept).over(w)
    std = F.when(n > 1, F.stddev_samp(kept).over(w)).otherwise(1.0)
    return df.withColumn(out, F.when(F.col(mask) == 1, (F.col(reward) - F.avg(kept).over(w)) / (std + epsilon)).otherwise(0.0))


@register("multi_trajectory")
def multi_trajectory(df: DataFrame, score: str, group: list[str], session: list[str], index: str, epsilon: float = EPSILON, out: str = "adv") -> DataFrame:
    """Only the last trajectory of a session is normalised within its group; its siblings get the same value."""
    last = F.row_number().over(Window.partitionBy(*group, *session).orderBy(F.desc(index))) == 1
    df = df.withColumn("_s", F.when(last, F.col(score)))
    df = df.withColumn("_a", normalised(F.col("_s"), group, epsilon=epsilon))
    return df.withColumn(out, F.max("_a").over(Window.partitionBy(*group, *session))).drop("_s", "_a")


def entropic_risk(df: DataFrame, score: str, group: list[str], beta: float) -> DataFrame:
    """(1 / beta) log mean exp(beta s) of each group; the mean where beta is 0. The greatest exponent of each group is found first."""
    if beta == 0:
        return df.groupBy(*group).agg(F.avg(score).alias("risk"))
    rows = df.withColumn("_t", F.max(beta * F.col(score)).over(Window.partitionBy(*group)))
    return rows.groupBy(*group).agg(((F.log(F.avg(F.exp(beta * F.col(score) - F.col("_t")))) + F.max("_t")) / beta).alias("risk"))


# Token sequences: arrays of one length in each row


def _reverse_fold(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Fold from the last element; `step` gives the accumulator, whose field `out` is collected in order.

    An array that grows is copied at every step, so elements are collected FOLD at a
    time, and the parts are put together at the end.
    """
    empty = F.array().cast("array<double>")

    def go(a: Column, x: Column) -> Column:
        acc = step(a["acc"], x)
        return F.struct(acc.alias("acc"), F.array_append(a["out"], acc["out"]).alias("out"))

    def part(a: Column, block: Column) -> Column:
        return F.aggregate(block, F.struct(a["acc"].alias("acc"), empty.alias("out")), go, lambda s: F.struct(s["acc"].alias("acc"), F.array_append(a["parts"], s["out"]).alias("parts")))

    back = F.reverse(values)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / FOLD).cast("int"), F.lit(0))), lambda k: F.slice(back, k * FOLD + 1, FOLD))
    zero = F.struct(start.alias("acc"), F.array().cast("array<array<double>>").alias("parts"))
    return F.aggregate(blocks, zero, part, lambda a: F.reverse(F.flatten(a["parts"])))


def discounted_returns(rewards: str, mask: str, gamma: float) -> Column:
    """Returns from the end; a masked token sets the running return to 0."""
    items = F.zip_with(rewards, mask, lambda r, m: F.struct(r.cast("double").alias("r"), m.cast("double").alias("m")))

    def step(acc: Column, x: Column) -> Column:
        run = x["r"] + gamma * acc["run"]
        return F.struct((run * x["m"]).alias("run"), run.alias("out"))

    return _reverse_fold(items, F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("out")), step)


def gae(rewards: str, values: str, mask: str, gamma: float, lam: float, variant: str = "carry") -> Column:
    """Generalised advantages before whitening. carry: masked tokens hand on what follows them; ignore: no mask in the recursion."""
    items = F.zip_with(F.arrays_zip(F.col(rewards).alias("r"), F.col(values).alias("v")), mask, lambda x, m: F.struct(x["r"].cast("double").alias("r"), x["v"].cast("double").alias("v"), m.cast("double").alias("m")))

    def step(acc: Column, x: Column) -> Column:
        now = x["r"] + gamma * acc["next"] - x["v"] + gamma * lam * acc["gae"]
        if variant == "ignore":
            return F.struct(x["v"].alias("next"), now.alias("gae"), now.alias("out"))
        kept = now * x["m"] + (1 - x["m"]) * acc["gae"]
        return F.struct((x["v"] * x["m"] + (1 - x["m"]) * acc["next"]).alias("next"), kept.alias("gae"), kept.alias("out"))

    return _reverse_fold(items, F.struct(*(F.lit(0.0).alias(c) for c in ("next", "gae", "out"))), step)


def remax(rewards: str, baseline: str, mask: str) -> Column:
    """Sums from each token to the end of reward times mask, less baseline times mask."""
    items = F.zip_with(rewards, mask, lambda r, m: F.struct((r * m).cast("double").alias("r"), m.cast("double").alias("m")))

    def step(acc: Column, x: Column) -> Column:
        run = acc["run"] + x["r"]
        return F.struct(run.alias("run"), (run - F.col(baseline) * x["m"]).alias("out"))

    return _reverse_fold(items, F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("out")), step)


def optimal_token_baseline(df: DataFrame, group: list[str], pos: str, returns: str, weight: str, mask: str, out: str = "adv") -> DataFrame:
    """Returns less, at each position of the group, the mean of returns weighted by the sequences' summed weights."""
    w = Window.partitionBy(*group, pos)
    m = F.col(mask)
    base = F.sum(F.col(returns) * F.col(weight) * m).over(w) / (F.sum(F.col(weight) * m).over(w) + 1e-8)
    return df.withColumn(out, (F.col(returns) - base) * m)


def turn_mean_ratio(df: DataFrame, seq: str, turn: str, log_ratio: str, mask: str, out: str = "ratio") -> DataFrame:
    """exp of the mean log-ratio of the masked tokens of each turn (or sequence)."""
    kept = F.when(F.col(mask) == 1, F.col(log_ratio))
    return df.withColumn(out, F.exp(F.least(F.avg(kept).over(Window.partitionBy(seq, turn)), F.lit(10.0))))


def prefix_tree(df: DataFrame, group: list[str], row: str, pos: str, token: str, score: str, beta: float, epsilon: float = EPSILON, out: str = "adv") -> DataFrame:
    """Advantages from the tree of common beginnings of a group's token sequences (long form; equal lengths, padded).

    A node is a beginning that some rollouts of the group share; its value is their
    entropic risk, (1 / beta) log mean exp(beta s). A token's advantage is its node's
    value, standardised over all nodes of the group, the root included (population
    deviation). Groups of one and groups of one score get 0. A beginning is named by 128
    bits: hashes of its tokens and their places, combined token by token, so no prefix is held.
    """
    w = Window.partitionBy(*group, row).orderBy(pos)
    named = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), pos, token)).over(w)
    rows = df.withColumn("_h", F.struct(named(0), named(1)))
    node = [*group, pos, "_h"]
    top = F.max(beta * F.col(score)).over(Window.partitionBy(*group))
    rows = rows.withColumn("_t", top)
    risk = lambda w: (F.log(F.avg(F.exp(beta * F.col(score) - F.col("_t"))).over(w)) + F.col("_t")) / beta if beta else F.avg(score).over(w)
    rows = rows.withColumn("_v", risk(Window.partitionBy(*node)))
    values = rows.groupBy(*node).agg(F.first("_v").alias("_v")).groupBy(*group).agg(F.sum("_v").alias("_s"), F.sum(F.col("_v") * F.col("_v")).alias("_q"), F.count(F.lit(1)).alias("_n"))
    each = df.groupBy(*group, row).agg(F.first(score).alias("_x"))
    if beta:
        root = each.withColumn("_t", F.max(beta * F.col("_x")).over(Window.partitionBy(*group))).groupBy(*group).agg(((F.log(F.avg(F.exp(beta * F.col("_x") - F.col("_t")))) + F.max("_t")) / beta).alias("_root"), F.stddev_samp("_x").alias("_d"))
    else:
        root = each.groupBy(*group).agg(F.avg("_x").alias("_root"), F.stddev_samp("_x").alias("_d"))
    stats = values.join(root, group)
    n = F.col("_n") + 1
    mean = (F.col("_s") + F.col("_root")) / n
    std = F.sqrt(F.greatest((F.col("_q") + F.col("_root") * F.col("_root")) / n - mean * mean, F.lit(0.0)))
    stats = stats.select(*group, mean.alias("_m"), std.alias("_std"), (F.coalesce("_d", F.lit(0.0)) < 1e-12).alias("_same"))
    rows = rows.join(stats, group).withColumn(out, F.when(F.col("_same"), 0.0).otherwise((F.col("_v") - F.col("_m")) / (F.col("_std") + epsilon)))
    return rows.drop("_h", "_t", "_v", "_m", "_std", "_same")


def kept_positions(df: DataFrame, seq: str, pos: str, mask: str, out: str = "kept_pos") -> DataFrame:
    """Numbers the kept tokens of each sequence from 1, masked ones left out of the count: what baselines over several turns align by."""
    w = Window.partitionBy(seq).orderBy(pos)
    return df.withColumn(out, F.when(F.col(mask) == 1, F.sum(F.when(F.col(mask) == 1, 1).otherwise(0)).over(w)))


def multi_turn_token_baseline(df: DataFrame, group: list[str], seq: str, pos: str, returns: str, weight: str, mask: str, out: str = "adv") -> DataFrame:
    """optimal_token_baseline over kept tokens numbered without gaps; masked tokens get 0."""
    rows = kept_positions(df, seq, pos, mask)
    on = rows.filter(F.col(mask) == 1)
    w = Window.partitionBy(*group, "kept_pos")
    base = F.sum(F.col(returns) * F.col(weight)).over(w) / (F.sum(weight).over(w) + 1e-8)
    done = on.withColumn(out, F.col(returns) - base)
    rest = rows.filter(F.col(mask) != 1).withColumn(out, F.lit(0.0))
    return done.unionByName(rest).drop("kept_pos")
