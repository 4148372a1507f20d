"""Grouped and masked statistics, metric reduction, validation reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserakt.operators.stages import numbered


def group_mean_std(df: DataFrame, value: str, group: list[str], epsilon: float = 1e-6) -> DataFrame:
    """Count, mean and sample deviation of each group, the variance held at epsilon at least; groups of one: 0 and 1."""
    n, s, q = F.count(value), F.sum(value), F.sum(F.col(value) * F.col(value))
    var = F.greatest((q - s * s / n) / (n - 1), F.lit(epsilon))
    return df.groupBy(*group).agg(n.alias("n"), F.when(n > 1, s / n).otherwise(0.0).alias("mean"), F.when(n > 1, F.sqrt(var)).otherwise(1.0).alias("std"))


def dense_index(df: DataFrame, label: str, out: str = "gidx") -> DataFrame:
    """Consecutive numbers from 0 for the distinct labels in their order. The labels are numbered once, range by range, then joined."""
    return df.join(numbered(df.select(label).distinct(), [F.col(label).asc()], out), label)


def masked(df: DataFrame, value: str, mask: str, group: list[str], variant: str = "epsilon") -> DataFrame:
    """Sum, mean and Bessel-corrected variance under a mask. epsilon: the mean divides by the mask's sum + 1e-8."""
    m, v = F.col(mask), F.col(value)
    total = F.sum(F.when(m != 0, v * m).otherwise(0.0))
    n = F.sum(m)
    mean = total / (n + 1e-8) if variant == "epsilon" else F.try_divide(total, n)
    kept = F.when(m != 0, v)
    return df.groupBy(*group).agg(total.alias("masked_sum"), mean.alias("masked_mean"), F.var_samp(kept).alias("masked_var"), n.cast("double").alias("n"))


def reduce_metrics(df: DataFrame, key: str = "key", value: str = "value", variant: str = "named") -> DataFrame:
    """One value a key: the greatest if its name has max, else the least if it has min, else the mean (variant mean: always)."""
    agg = F.avg(value)
    if variant == "named":
        k = F.first(key)
        agg = F.when(k.contains("max"), F.max(value)).when(k.contains("min"), F.min(value)).otherwise(F.avg(value))
    return df.groupBy(key).agg(agg.cast("double").alias(value))


# Parts of metrics' names and how these are aggregated.
AGGREGATION_RULES = (("timing_s/", "sum"), ("mean", "avg"), ("avg", "avg"), ("max", "max"), ("min", "min"), ("sum", "sum"), ("total", "sum"))


def metric_rule(key: Column, rules: dict[str, str] | None = None) -> Column:
    """Name of the aggregation of a metric: a rule of its own, else the first part of its name that tells, else avg."""
    out = F.lit("avg")
    for part, rule in reversed(AGGREGATION_RULES):
        out = F.when(key.contains(part), rule).otherwise(out)
    for name, rule in (rules or {}).items():
        out = F.when(key == name, rule).otherwise(out)
    return out


def aggregate_metrics(df: DataFrame, key: str, value: str, order: str, rules: dict[str, str] | None = None) -> DataFrame:
    rule = F.first(metric_rule(F.col(key), rules))
    last = F.max_by(value, order)
    agg = F.when(rule == "sum", F.sum(value)).when(rule == "max", F.max(value)).when(rule == "min", F.min(value)).when(rule == "last", last).otherwise(F.avg(value))
    return df.groupBy(key).agg(rule.alias("rule"), agg.cast("double").alias("value"))


def aggregate_ranks(df: DataFrame, rank: str, step: str, value: str, how: str) -> DataFrame:
    """Metrics of several ranks: sum and mean average over the ranks step by step first; min and max flatten."""
    if how in ("min", "max"):
        return df.agg(getattr(F, how)(value).alias("value"))
    steps = df.groupBy(step).agg(F.avg(value).alias("_v"))
    return steps.agg((F.sum if how == "sum" else F.avg)("_v").alias("value"))


def majority(df: DataFrame, group: list[str], order: str, vote: str, value: str) -> DataFrame:
    """The most frequent vote of each group (ties: the one seen first) and the first value that came with it."""
    votes = df.groupBy(*group, vote).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(order, value)).alias("_first"))
    best = F.max_by(F.struct(F.col(vote), F.col("_first")[value].alias("maj")), F.struct(F.col("_n"), -F.col("_first")[order]))
    return votes.groupBy(*group).agg(best.alias("_b")).select(*group, F.col("_b")[vote].alias("vote"), F.col("_b")["maj"].alias("maj"))


def sizes_up_to(n: int) -> list[int]:
    """2, 4, 8 ... below n, and n."""
    out, k = [], 2
    while k < n:
        out.append(k)
        k *= 2
    return [*out, n] if n > 1 else out


def expected_best(n: int, sample: int, value: Column, rank: Column, count: Column) -> Column:
    """Share of `value` in the expected best of `sample` draws with replacement: the chance that rank is the best drawn."""
    return value * (F.pow(rank / count, F.lit(sample)) - F.pow((rank - 1) / count, F.lit(sample)))


def validation_report(df: DataFrame, source: str, uid: str, score: str, samples: list[int]) -> DataFrame:
    """mean@N and std@N (population) of each prompt, and best@n and worst@n in expectation, then means over prompts by source.

    The expectation over draws with replacement is exact, where resampling would estimate it.
    """
    up, down = Window.partitionBy(source, uid).orderBy(score), Window.partitionBy(source, uid).orderBy(F.desc(score))
    all_rows = Window.partitionBy(source, uid)
    ranked = df.select(source, uid, F.col(score).alias("_s"), F.row_number().over(up).alias("_u"), F.row_number().over(down).alias("_d"), F.count(F.lit(1)).over(all_rows).alias("_n"))
    s, n = F.col("_s"), F.col("_n")
    aggs = [F.avg("_s").alias("mean"), F.stddev_pop("_s").alias("std")]
    for k in samples:
        aggs.append(F.sum(expected_best(0, k, s, F.col("_u"), n)).alias(f"best_{k}"))
        aggs.append(F.sum(expected_best(0, k, s, F.col("_d"), n)).alias(f"worst_{k}"))
    prompts = ranked.groupBy(source, uid).agg(*aggs)
    names = ["mean", "std", *(f"{a}_{k}" for k in samples for a in ("best", "worst"))]
    return prompts.groupBy(source).agg(F.count(F.lit(1)).alias("prompts"), *(F.avg(c).alias(c) for c in names))


def average_reward(df: DataFrame, source: str, row: str, score: str) -> DataFrame:
    """Mean over responses of each row, then over the rows of each source."""
    return df.groupBy(source, row).agg(F.avg(score).alias("_s")).groupBy(source).agg(F.avg("_s").alias("reward"))


def pass_share(df: DataFrame, row: str, score: str) -> DataFrame:
    """Share of rows whose best score is 1."""
    return df.groupBy(row).agg(F.max(score).alias("_s")).agg(F.avg(F.when(F.col("_s") == 1, 1.0).otherwise(0.0)).alias("pass_rate"))


def timing_summary(df: DataFrame, metric: str, value: str) -> DataFrame:
    """Of finite values: count, mean, median, nearest-rank p90 and greatest; a metric without any is absent."""
    v = F.col(value).cast("double")
    finite = df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return finite.groupBy(metric).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.percentile_disc(v, 0.9).alias("p90") if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY CAST({value} AS DOUBLE))").alias("p90"), F.max(v).alias("max"))


def percentiles(df: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Linear percentiles."""
    return df.agg(*(F.percentile(value, q).alias(f"tp{round(q * 100)}") for q in shares))


def data_metrics(df: DataFrame, score: str, advantage: str, length: str) -> DataFrame:
    """Score statistics over rows with a response, advantages and lengths over all."""
    there = F.when(F.col(length) > 0, F.col(score))
    aggs = [f(c).cast("double").alias(f"{name}_{how}") for name, c in (("score", there), ("adv", F.col(advantage)), ("length", F.col(length))) for how, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    return df.agg(*aggs, F.avg(F.when(F.col(length) == 0, 1.0).otherwise(0.0)).alias("aborted"))


def explained_variance(df: DataFrame, returns: str, values: str) -> DataFrame:
    r, v = F.col(returns), F.col(values)
    return df.agg((1 - F.var_samp(r - v) / (F.var_samp(r) + 1e-5)).alias("explained_var"))


LOSS_MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean")


def aggregate_loss(df: DataFrame, seq: str, loss: str, mask: str, mode: str, variant: str = "masked-out") -> DataFrame:
    """A loss matrix to one number. masked-out: sequences without a token don't count, and means add 1e-8; counted: they do, and nothing is added."""
    eps = 1e-8 if variant == "masked-out" else 0.0
    total, tokens = F.sum(F.when(F.col(mask) != 0, F.col(loss) * F.col(mask)).otherwise(0.0)), F.sum(mask)
    if mode == "token-mean":
        return df.agg((total / (tokens + eps)).alias("loss"))
    rows = df.groupBy(seq).agg(total.alias("_t"), tokens.alias("_n"))
    if mode == "seq-mean-token-sum":
        each = F.col("_t")
    elif mode == "seq-mean-token-mean":
        each = F.when(F.col("_n") + eps != 0, F.col("_t") / (F.col("_n") + eps))
    else:
        raise ValueError(f"mode is one of {LOSS_MODES}")
    counted = F.sum(F.when(F.col("_n") > 0, 1).otherwise(0)) if variant == "masked-out" else F.count(F.lit(1))
    return rows.agg((F.sum(each) / (counted + eps)).alias("loss"))


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def sampler_difference(df: DataFrame, a: str, b: str, mask: str) -> DataFrame:
    """Of the differences of two samplers' probabilities over masked tokens: greatest, mean, sample deviation, and Pearson's correlation of the probabilities; valid is 0 without a token."""
    m = F.col(mask) == 1
    x, y = F.when(m, F.exp(a)), F.when(m, F.exp(b))
    d = F.abs(x - y)
    return df.agg(F.when(F.count(d) > 0, 1).otherwise(0).alias("valid"), F.max(d).alias("max"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.corr(x, y).alias("pearson"))


def differing(df: DataFrame, seq: str, a: str, b: str, mask: str) -> DataFrame:
    """Masked tokens of each row in which two lists differ."""
    return df.groupBy(seq).agg(F.count_if((F.col(mask) == 1) & ~F.col(a).eqNullSafe(F.col(b))).alias("n"))


def bootstrap(df: DataFrame, group: list[str], row: str, value: str, size: int, rounds: int, seed: int = 42, how: str = "max") -> DataFrame:
    """Mean and population deviation, over resamples with replacement, of the greatest, least or mean value of `size` draws.

    Draw j of round i is the row whose number the seeded hash of (i, j) names: the same wherever it runs.
    """
    w = Window.partitionBy(*group)
    rows = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", F.row_number().over(w.orderBy(row)) - 1)
    draws = df.select(*group).distinct().withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    draws = draws.join(sizes, group).withColumn("_i", F.pmod(F.xxhash64(F.lit(seed), *group, "_round", "_draw"), F.col("_size")).cast("int"))
    each = draws.join(rows.select(*group, "_i", value), [*group, "_i"]).groupBy(*group, "_round").agg({"max": F.max, "min": F.min, "mean": F.avg}[how](value).alias("_x"))
    return each.groupBy(*group).agg(F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"))


def variance_proxy(df: DataFrame, seq: str, p: str, squares: str, mask: str, reward: str) -> DataFrame:
    """W = masked sum of 1 - 2 p + sum of squared probabilities a sequence; mean W, mean reward squared times W, and the latter less the squared mean reward times mean W, 0 at least."""
    m = F.col(mask) == 1
    rows = df.groupBy(seq).agg(F.sum(F.when(m, 1 - 2 * F.exp(p) + F.col(squares)).otherwise(0.0)).alias("_w"), F.sum(F.when(m, F.col(reward)).otherwise(0.0)).alias("_r"))
    out = rows.agg(F.avg("_w").alias("signal"), F.avg(F.col("_r") * F.col("_r") * F.col("_w")).alias("total"), F.avg("_r").alias("_m"))
    return out.select("signal", "total", F.greatest(F.col("total") - F.col("_m") * F.col("_m") * F.col("signal"), F.lit(0.0)).alias("pure_noise"))


def stage_timing(stages: DataFrame, stage: str, seconds: str, batch: DataFrame, prompt: str, response: str) -> DataFrame:
    """Seconds of each stage, and milliseconds a token: generation by response tokens, the stages that read prompts too by all."""
    tokens = batch.agg(F.sum(response).alias("_r"), (F.sum(prompt) + F.sum(response)).alias("_a"))  # one row
    by = F.when(F.col(stage) == "gen", F.col("_r")).when(F.col(stage).isin("ref", "values", "adv", "update_critic", "update_actor"), F.col("_a"))
    return stages.join(F.broadcast(tokens)).select(stage, F.col(seconds).alias("seconds"), (F.col(seconds) * 1000 / by).alias("ms_per_token"))


def throughput(batch: DataFrame, tokens: str, seconds: Column, devices: int) -> DataFrame:
    """Tokens of a batch, seconds of its step, and tokens a second and device."""
    return batch.agg(F.sum(tokens).alias("tokens"), F.max(seconds).alias("seconds")).withColumn("throughput", F.col("tokens") / (F.col("seconds") * devices))


def metric_section(source: str, variable: str, name: str, n: str, core: str) -> Column:
    """Name of a validation metric: in the core section if it is a mean, majority or best value of the core variable at the largest n."""
    largest = F.max(n).over(Window.partitionBy(source, variable))
    main = (F.col(variable) == core) & F.col(name).rlike("^(mean|maj|best)") & (F.col(n) == largest)
    return F.concat_ws("/", F.when(main, "val-core").otherwise("val-aux"), source, variable, name)


def majority_at(df: DataFrame, source: str, uid: str, answer: str, score: str, row: str, sizes: list[int], rounds: int = 1000, seed: int = 42) -> DataFrame:
    """maj@n: the score of the most frequent answer among n draws with replacement, mean and deviation over rounds, then means over prompts by source.

    Draw j of a round is the row that a seeded hash names, so every prompt can be
    resampled wherever it lies; answers as frequent tie to the one drawn first. A prompt's rows are
    shuffled once, to be numbered; its draws and votes stay in the same task. Of a prompt with more rows than draws only the drawn ones are held.
    """
    w = Window.partitionBy(source, uid)
    most = max(sizes)
    at = lambda i, j: F.pmod(F.xxhash64(F.lit(seed), source, uid, i, j), F.col("_n")).cast("int")
    rows = df.filter(F.col(source).isNotNull() & F.col(uid).isNotNull())
    rows = rows.select(source, uid, F.col(answer).alias("_a"), F.col(score).alias("_s"), (F.row_number().over(w.orderBy(row)) - 1).alias("_i"), F.count(F.lit(1)).over(w).alias("_n")).filter("_n > 1")
    drawn = F.exists(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda i: F.exists(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: at(i, j) == F.col("_i")))
    rows = rows.filter((F.col("_n") <= rounds * most) | drawn)
    prompts = rows.groupBy(source, uid).agg(F.max("_n").alias("_n"), F.sort_array(F.collect_list(F.struct("_i", "_a", "_s"))).alias("_rows"))
    draws = prompts.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    place = F.when(F.size("_rows") == F.col("_n"), at("_round", "_draw")).otherwise(F.array_position(F.col("_rows._i"), at("_round", "_draw")).cast("int") - 1)
    draws = draws.select(source, uid, "_round", "_draw", F.get("_rows", place).alias("_row"))
    draws = draws.withColumn("n", F.explode(F.array(*(F.lit(n) for n in dict.fromkeys(sizes))))).filter("_draw < n")
    votes = draws.groupBy(source, uid, "n", "_round", F.col("_row._a").alias("_a")).agg(F.count(F.lit(1)).alias("_c"), F.min("_draw").alias("_first"), F.min_by("_row._s", "_draw").alias("_s"))
    each = votes.groupBy(source, uid, "n", "_round").agg(F.max_by("_s", F.struct("_c", -F.col("_first"))).alias("_s"))
    return each.groupBy(source, uid, "n").agg(F.avg("_s").alias("_m"), F.stddev_pop("_s").alias("_d")).groupBy(source, "n").agg(F.avg("_m").alias("mean"), F.avg("_d").alias("std"))
