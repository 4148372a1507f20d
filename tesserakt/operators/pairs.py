"""Selection of pairs i < j of a pool by a joint score, without making all pairs.

A joint score depends on what the two nodes are worth and cover, not on which nodes they are. So nodes that are alike form one class, pairs of classes carry
the number of node pairs they stand for, and a draw takes a pair of classes (Gumbel maximum over score / temperature plus the log of that
number) and then the node of least seeded hash in each. That is exactly a draw of a node pair in proportion to exp(score / temperature). Classes are
bounded by the distinct values and coverages of a pool, not by its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Joint = Callable[[Column, Column, Column, Column], Column]


def leading(value_a: Column, cover_a: Column, value_b: Column, cover_b: Column) -> Column:
    """0.7 of the greater value, 0.3 of the share of goals that either covers before the first that none does."""
    miss = F.array_position(F.zip_with(cover_a, cover_b, lambda x, y: (x >= 0.5) | (y >= 0.5)), False)
    n = F.size(cover_a)
    lead = F.when(miss == 0, n).otherwise(miss - 1)
    return 0.7 * F.greatest(value_a, value_b) + 0.3 * F.when(n > 0, lead / n).otherwise(0.0)


def mean(value_a: Column, cover_a: Column, value_b: Column, cover_b: Column) -> Column:
    """Ten times the mean over goals of the better of both."""
    total = F.aggregate(F.zip_with(cover_a, cover_b, lambda x, y: F.greatest(x, y)), F.lit(0.0), lambda s, x: s + x)
    return 10 * total / F.size(cover_a)


def tree(parents: list[int | None]) -> Joint:
    """Ten times the score of a goal tree's root: 1 where either meets a goal, else the mean of its children. parents: each goal's, the root's None."""
    children = {i: [j for j, p in enumerate(parents) if p == i] for i in range(len(parents))}

    def score(value_a: Column, cover_a: Column, value_b: Column, cover_b: Column) -> Column:
        def of(i: int) -> Column:
            met = (F.get(cover_a, F.lit(i)) >= 0.5) | (F.get(cover_b, F.lit(i)) >= 0.5)
            below = [of(j) for j in children[i]]
            return F.when(met, 1.0).otherwise(sum(below[1:], below[0]) / len(below) if below else 0.0)

        return 10 * of(parents.index(None))

    return score


def hashed(*keys: Column | int) -> Column:
    """An MD5 of the keys, joined by colons."""
    return F.md5(F.concat_ws(":", *(F.lit(k).cast("string") if isinstance(k, int) else k.cast("string") for k in keys)))


def unit(*keys: Column | int) -> Column:
    """A number strictly between 0 and 1 from 52 bits of a hash of keys, the same in every run."""
    return (F.conv(F.substring(hashed(*keys), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _classes(nodes: DataFrame) -> DataFrame:
    """Of nodes (pool, node, place, value, cover): pool, value, cover, n, and the first two places of each class; the first names it."""
    keys = ["pool", "value", "cover"]
    one = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    two = nodes.join(one.select(*keys, "first"), keys).filter("place > first").groupBy(*keys).agg(F.min("place").alias("second"))
    return one.join(two, keys, "left")


def _class_pairs(nodes: DataFrame, joint: Joint) -> DataFrame:
    """Pairs of classes of a pool, a class with itself if it has two nodes; n: node pairs, best: the places of the first of them."""
    found = _classes(nodes)
    a = found.select("pool", *(F.col(c).alias(c + "_a") for c in ("value", "cover", "n", "first", "second")))
    b = found.select("pool", *(F.col(c).alias(c + "_b") for c in ("value", "cover", "n", "first", "second")))
    same = F.col("first_a") == F.col("first_b")
    met = a.join(b, "pool").filter((F.col("first_a") < F.col("first_b")) | (same & (F.col("n_a") > 1)))
    n = F.when(same, F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a").cast("double") * F.col("n_b"))
    best = F.struct(F.col("first_a").alias("i"), F.when(same, F.col("second_a")).otherwise(F.col("first_b")).alias("j"))
    score = joint(F.col("value_a"), F.col("cover_a"), F.col("value_b"), F.col("cover_b"))
    return met.select("pool", F.col("first_a").alias("name_a"), F.col("first_b").alias("name_b"), n.alias("n"), best.alias("best"), score.alias("score"))


def best_pair(nodes: DataFrame, joint: Joint) -> DataFrame:
    """pool, a, b, score: the pair of greatest joint score, the first in order of places among equals; pools of one node have none."""
    top = _class_pairs(nodes, joint).groupBy("pool").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("best.i").alias("i"), F.col("best.j").alias("j"))).alias("t"))
    at = top.select("pool", (-F.col("t.s")).alias("score"), F.posexplode(F.array("t.i", "t.j")).alias("side", "place"))
    found = at.join(nodes.select("pool", "place", "node"), ["pool", "place"])
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("node")))
    return found.groupBy("pool", "score").agg(side(0).alias("a"), side(1).alias("b")).select("pool", "a", "b", "score")


def drawn_pairs(nodes: DataFrame, joint: Joint, temperature: float, draws: int = 1, seed: int = 0) -> DataFrame:
    """pool, draw, a, b, score: draws of pairs, each in proportion to exp(score / temperature); a stands before b. Temperature 0: the best pair each time."""
    turns = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")
    if temperature <= 0:
        return best_pair(nodes, joint).select("pool", turns, "a", "b", "score")
    pairs = _class_pairs(nodes, joint).select("*", turns)
    noise = -F.log(-F.log(unit(seed, F.col("pool"), F.col("draw"), F.col("name_a"), F.col("name_b"))))
    key = F.col("score") / temperature + F.log("n") + noise
    won = pairs.groupBy("pool", "draw").agg(F.max_by(F.struct("name_a", "name_b", "score"), key).alias("w")).select("pool", "draw", "w.*")
    names = _classes(nodes).select("pool", "value", "cover", F.col("first").alias("name"))
    members = nodes.join(names, ["pool", "value", "cover"]).select("pool", "node", "place", "name")

    def pick(rows: DataFrame, side: str, salt: int) -> DataFrame:
        least = F.min_by(F.struct("place", "node"), hashed(seed, salt, F.col("draw"), F.col("node"))).alias(side)
        met = rows.join(members, ["pool", "name"])
        if "a" in rows.columns:
            met = met.filter(F.col("place") != F.col("a.place"))
        return met.groupBy(*(c for c in rows.columns if c != "name")).agg(least)

    first = pick(won.withColumn("name", F.col("name_a")), "a", 1)
    both = pick(first.withColumn("name", F.col("name_b")), "b", 2)
    low = F.col("a.place") < F.col("b.place")
    return both.select("pool", "draw", F.when(low, F.col("a.node")).otherwise(F.col("b.node")).alias("a"), F.when(low, F.col("b.node")).otherwise(F.col("a.node")).alias("b"), "score")
