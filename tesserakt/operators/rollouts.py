"""Batches of rollouts: order within ranks, concatenation under a mask, collation, rounds of tree search, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _halves(rank: Column, n: Column, fall: bool) -> Column:
    """Place of each rank (from 0) if every second row goes to the other half; `fall`: the second half runs backwards, else the first."""
    even, half, first = rank % 2 == 0, F.floor(rank / 2), F.ceil(n / 2)
    if fall:
        return F.when(even, half).otherwise(first + F.floor(n / 2) - 1 - half)
    return F.when(even, first - 1 - half).otherwise(first + half)


def ends_light(df: DataFrame, group: list[str], load: str, pos: str, out: str = "place") -> DataFrame:
    """The rows of each rank with their place: light ones at both ends, heavy ones in the middle (ties by position)."""
    w = Window.partitionBy(*group)
    rank = F.row_number().over(w.orderBy(load, pos)) - 1
    return df.withColumn(out, _halves(rank, F.count(F.lit(1)).over(w), True).cast("long"))


def micro_batch_order(df: DataFrame, group: list[str], micro: str, load: str, pos: str, out: str = "place") -> DataFrame:
    """Of rows dealt to micro-batches: group, micro and the micro-batch's place, heavy ones in the middle (ties: the greater first position counts more)."""
    sums = df.groupBy(*group, micro).agg(F.sum(load).alias("_l"), F.min(pos).alias("_p"))
    w = Window.partitionBy(*group)
    rank = F.row_number().over(w.orderBy(F.desc("_l"), F.desc("_p"))) - 1
    return sums.select(*group, micro, _halves(rank, F.count(F.lit(1)).over(w), False).cast("long").alias(out))


def balanced_batch(df: DataFrame, rank: str, load: str, pos: str, out: str = "index") -> DataFrame:
    """Rows in the order in which equal ranks are handed out: rank by rank, light rows at a rank's ends. `index` counts from 0; ranks are few."""
    placed = ends_light(df, [rank], load, pos, "_place")
    sizes = df.groupBy(rank).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(sizes.select(rank, before.alias("_before")), rank).withColumn(out, F.col("_before") + F.col("_place")).drop("_before", "_place")


def restored(df: DataFrame, index: str, original: str, values: DataFrame, out: str) -> DataFrame:
    """Values that came back by `index` (index, out) beside the rows' original positions."""
    return df.select(index, original).join(values.select(index, out), index).select(original, out)


def masked_concat(prompt: Column, prompt_masked: Column, response: Column, info: Column, pad: int, pad_left: bool = True) -> tuple[Column, Column]:
    """Token ids of prompt, response and information with all padding at one end, and the same with the information masked by padding; both in one order."""
    info = F.coalesce(info, F.expr("array()").cast("array<long>"))
    whole = F.concat(*(x.cast("array<long>") for x in (prompt, response, info)))
    shown = F.concat(*(x.cast("array<long>") for x in (prompt_masked, response)), F.transform(info, lambda x: F.lit(pad).cast("long")))
    both = F.arrays_zip(whole.alias("w"), shown.alias("s"))
    here, there = F.filter(both, lambda x: x["w"] == pad), F.filter(both, lambda x: x["w"] != pad)
    ordered = F.concat(here, there) if pad_left else F.concat(there, here)
    return F.transform(ordered, lambda x: x["w"]), F.transform(ordered, lambda x: x["s"])


def collated(df: DataFrame, batch: list[str], columns: dict[str, int], multiple: int = 1) -> DataFrame:
    """Arrays padded at the right to the longest of their batch (to a multiple), each column with its fill, and `attention`: 1 where the first column has a token."""
    first = next(iter(columns))
    w = Window.partitionBy(*batch)
    longest = reduce(F.greatest, [F.max(F.size(c)).over(w) for c in columns]) if len(columns) > 1 else F.max(F.size(first)).over(w)
    df = df.withColumn("_n", (F.ceil(longest / multiple) * multiple).cast("int"))
    padded = {c: F.concat(F.col(c), F.array_repeat(F.lit(fill).cast(dict(df.dtypes)[c][6:-1]), F.col("_n") - F.size(c))) for c, fill in columns.items()}
    mask = F.concat(F.array_repeat(F.lit(1), F.size(first)), F.array_repeat(F.lit(0), F.col("_n") - F.size(first)))
    return df.withColumn("attention", mask).withColumns(padded).drop("_n")


def interleaved(rounds: list[DataFrame], pos: str, each: list[int], out: str = "index") -> DataFrame:
    """The rows of several rounds, `each` of them a prompt, prompt by prompt: its first round's rows, then the second's, and so on."""
    whole, before, parts = sum(each), 0, []
    for df, n in zip(rounds, each, strict=True):
        prompt = F.floor(F.col(pos) / n)
        parts.append(df.withColumn(out, (prompt * whole + before + F.col(pos) % n).cast("long")))
        before += n
    return reduce(DataFrame.unionByName, parts)


def action_metrics(df: DataFrame, turns: str, active: str, valid: str, searches: str) -> DataFrame:
    """Names and values: actions a rollout, the share that finished, valid actions and searches."""
    names = {
        "env/number_of_actions/mean": F.avg(turns), "env/number_of_actions/max": F.max(turns).cast("double"), "env/number_of_actions/min": F.min(turns).cast("double"),
        "env/finish_ratio": 1 - F.avg(F.col(active).cast("double")), "env/number_of_valid_action": F.avg(valid),
        "env/ratio_of_valid_action": F.avg(F.try_divide(F.col(valid), F.col(turns))), "env/number_of_valid_search": F.avg(searches),
    }
    one = df.agg(*(v.cast("double").alias(k) for k, v in names.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(f"`{k}`").alias("value")) for k in names))).alias("x")).select("x.*")


def slowest_report(df: DataFrame, generate: str, tools: str, preempted: str, prompt: str, response: str, pos: str) -> DataFrame:
    """Names and values: least, mean and greatest of times and preemptions, and those of the slowest row, the first among equals, with its lengths."""
    parts = [("num_preempted", preempted), ("generate_sequences", generate), ("tool_calls", tools)]
    stats = {f"agent_loop/{name}/{k}": f(c) for name, c in parts for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))}
    key = F.struct((F.col(generate) + F.col(tools)).alias("t"), (-F.col(pos)).alias("p"))
    slow = F.max_by(F.struct(*(F.col(c).cast("double").alias(n) for n, c in [*parts, ("prompt_length", prompt), ("response_length", response)])), key)
    one = df.agg(*(v.cast("double").alias(k) for k, v in stats.items()), slow.alias("slow"))
    named = {k: F.col(f"`{k}`") for k in stats} | {f"agent_loop/slowest/{n}": F.col(f"slow.{n}") for n in ("generate_sequences", "tool_calls", "num_preempted", "prompt_length", "response_length")}
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in named.items()))).alias("x")).select("x.*")
