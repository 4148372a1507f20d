"""Parents and inspirations for requests: weighted draws by exponential keys, one pass a draw, each step without what the steps before took.

Requests are a stated set. A draw in proportion to weights takes the row of least -ln(u) / weight, u a hash of seed, request and row; the k least are a
draw without replacement. The keys of a request's rows meet in partial minima, so neither sorted islands nor lists of programs leave a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserakt.operators.pairs import hashed, unit
from tesserakt.operators.ranking import parent_weights
from tesserakt.operators.stages import numbered, staged


def exponential(weight: Column, *keys: Column | int) -> Column:
    """The key whose least is a draw in proportion to weights; infinite for a weight of 0 or less or null."""
    return F.when(weight > 0, -F.log(unit(*keys)) / weight).otherwise(float("inf"))


def drawn_one(rows: DataFrame, by: list[str], weight: str, name: str, seed: int) -> DataFrame:
    """by and `name`: one row's name for each set of keys, in proportion to weights; where all weights are 0 the least hash decides."""
    keys = (seed, *map(F.col, by), F.col(name))
    key = F.struct(exponential(F.col(weight).cast("double"), *keys).alias("k"), hashed(*keys).alias("h"))
    return rows.groupBy(*by).agg(F.min_by(name, key).alias(name))


def least_k(rows: DataFrame, by: list[str], order: list[Column], k: Column | int) -> DataFrame:
    """The k first rows of each set of keys, with their `turn` from 0; tasks give on no more than k of a set."""
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("turn", turn).filter(F.col("turn") <= k).withColumn("turn", F.col("turn") - 1)


def islands(requests: DataFrame, programs: DataFrame, weights: str, seed: int = 0) -> DataFrame:
    """request, island: each request's island, by weight; `weights` is 'equal', 'counts' (programs) or 'fitness' (the best correct score over 1 + programs)."""
    best = F.max(F.when(F.col("correct"), F.col("score")))
    found = programs.filter(F.col("island").isNotNull()).groupBy("island").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
    weight = {"equal": F.lit(1.0), "counts": F.col("n").cast("double"), "fitness": F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(0.0)) / (1 + F.col("n"))}[weights]
    met = requests.select("request").join(found.select("island", weight.alias("weight")))  # islands are few: one row each
    return drawn_one(met, ["request"], "weight", "island", seed)


def parents(asked: DataFrame, programs: DataFrame, archive: DataFrame, sharpness: float = 10.0, seed: int = 1) -> DataFrame:
    """request, island, parent: of each request's island a correct archived program, by weights of score and of children had; null if it has none."""
    able = programs.filter("correct AND score IS NOT NULL").join(archive.select("program"), "program", "left_semi")
    weighed = parent_weights(able, "score", "children", ["island"], sharpness).select("island", "program", "weight")
    drawn = drawn_one(asked.join(weighed, "island"), ["request", "island"], "weight", "program", seed)
    return asked.join(drawn.withColumnRenamed("program", "parent"), ["request", "island"], "left").select("request", "island", "parent")


def repairs(requests: DataFrame, programs: DataFrame, seed: int = 3) -> DataFrame:
    """request, island, parent: a random incorrect program to repair, for when no program is correct."""
    wrong = programs.filter("NOT correct").select("program", "island", F.lit(1.0).alias("weight"))
    drawn = drawn_one(requests.select("request").join(wrong), ["request"], "weight", "program", seed)
    return drawn.join(programs.select("program", "island"), "program").select("request", "island", F.col("program").alias("parent"))


def around(requests: DataFrame, rows: DataFrame, many: int, seed: int) -> DataFrame:
    """The requests with `many` random programs each, and how far `after` a request's start they come: all programs lie on a ring in a seeded order, a request starts somewhere on it."""
    ring = numbered(rows.select("program", hashed(seed, 1, F.col("program")).alias("h")), [F.col("h"), F.col("program")], "position").drop("h")
    total = ring.count()
    start = F.conv(F.substring(hashed(seed, 2, F.col("request")), 1, 13), 16, 10).cast("long") % max(total, 1)
    asked = requests.withColumn("after", F.explode(F.sequence(F.lit(0), F.lit(min(many, max(total, 1)) - 1))))
    return asked.withColumn("position", (start + F.col("after")) % max(total, 1)).join(ring, "position").drop("position")


def archive_inspirations(chosen: DataFrame, programs: DataFrame, archive: DataFrame, n: int, elite_share: float, apart: bool = False, seed: int = 2) -> DataFrame:
    """request, place, program, step: up to n archived programs for each request (request, island, parent), none twice and none the parent.

    In turn: the best correct program of all (where islands are kept apart, only for requests of its island), the island's programs by score if
    the share of elites gives one place at least, random ones of the island, and random ones of all islands (``around``) unless they are kept apart.
    """
    able = programs.filter("correct").join(archive.select("program"), "program", "left_semi").select("island", "program", "score")
    top = programs.filter("correct AND score IS NOT NULL").agg(F.min(F.struct((-F.col("score")).alias("s"), "program", "island")).alias("t")).select("t.program", F.col("t.island").alias("home"))
    first = chosen.join(top).filter(~F.col("program").eqNullSafe(F.col("parent"))).filter(F.col("home") == F.col("island") if apart else F.lit(n > 0))
    taken = first.select("request", F.lit(0).alias("place"), "program", F.lit("best").alias("step"))
    steps = [("elite", F.desc_nulls_last("score"))] if int(n * elite_share) > 0 else []
    steps.append(("island", hashed(seed, 0, F.col("request"), F.col("program"))))
    for step, order in [*steps, *([] if apart else [("any", F.col("after"))])]:
        have = taken.groupBy("request").agg(F.count(F.lit(1)).alias("have"))
        left = chosen.join(have, "request", "left").fillna(0, ["have"]).filter(F.col("have") < n)
        met = left.join(able, "island") if step != "any" else around(left, able, 2 * n + 1, seed)
        free = met.filter(~F.col("program").eqNullSafe(F.col("parent"))).join(taken.select("request", "program"), ["request", "program"], "left_anti")
        more = least_k(free, ["request"], [order, F.col("program")], n).withColumn("place", (F.col("have") + F.col("turn")).cast("int"))
        taken = staged(taken.union(more.filter(F.col("place") < n).select("request", "place", "program", F.lit(step))))
    return taken


def top_inspirations(chosen: DataFrame, taken: DataFrame, programs: DataFrame, archive: DataFrame, k: int, n: int, apart: bool = False) -> DataFrame:
    """request, turn, program: the k archived programs of greatest score that are neither a request's parent nor among its up to n inspirations.

    A request leaves out n + 1 at most, so the first k + n + 1 of all (or of an island) serve every request.
    """
    able = programs.filter("correct").join(archive.select("program"), "program", "left_semi").select("island", "program", "score")
    order = [F.desc_nulls_last("score"), F.col("program")]
    first = least_k(able, ["island"], order, k + n + 1).drop("turn")
    if not apart:
        first = first.orderBy(*order).limit(k + n + 1).drop("island")
    met = chosen.join(first, "island") if apart else chosen.join(first)
    free = met.filter(~F.col("program").eqNullSafe(F.col("parent"))).join(taken.select("request", "program"), ["request", "program"], "left_anti")
    return least_k(free, ["request"], order, k).select("request", "turn", "program")


def context(parents: DataFrame, archived: DataFrame, best: DataFrame, programs: DataFrame, order: str = "ascending") -> DataFrame:
    """request, place, program: both kinds of inspirations once each, 'ascending' by score, 'chronological' by generation, or as they came ('none')."""
    every = archived.select("request", "program", F.col("place").alias("came")).union(best.select("request", "program", F.col("turn") + 1_000_000))
    every = every.groupBy("request", "program").agg(F.min("came").alias("came")).join(parents.select("request"), "request", "left_semi").join(programs.select("program", "score", "generation"), "program")
    by = {"ascending": [F.asc_nulls_first("score"), F.col("came")], "chronological": [F.col("generation"), F.col("came")], "none": [F.col("came")]}[order]
    return every.select("request", (F.row_number().over(Window.partitionBy("request").orderBy(*by)) - 1).alias("place"), "program")
