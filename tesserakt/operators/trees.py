"""Lineage, subtrees, tree scores and goal trees over parent links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserakt.operators.stages import staged

#: Nodes of a step up a tree that are broadcast at most.
FEW = 10_000


def ancestry(df: DataFrame, node: str, parent: str, most: int = 10) -> DataFrame:
    """node, ancestor, depth (1: the parent) for up to `most` steps; from the links alone, in joins that double the reach."""
    step = df.select(F.col(node).alias("node"), F.col(parent).alias("ancestor")).filter("ancestor IS NOT NULL")
    out, reach = step.withColumn("depth", F.lit(1)), 1
    while reach < most:
        far = step.select(F.col("node").alias("_n"), F.col("ancestor").alias("_a"))  # exactly `reach` steps up
        longer = out.join(far, out["ancestor"] == far["_n"]).select("node", F.col("_a").alias("ancestor"), (F.col("depth") + reach).alias("depth"))
        out = out.union(longer.filter(F.col("depth") <= most))
        step = step.join(far, step["ancestor"] == far["_n"]).select("node", F.col("_a").alias("ancestor"))
        reach *= 2
        if 8 <= reach < most:
            out, step = staged(out), staged(step)
    return out.join(df.select(F.col(node).alias("ancestor")), "ancestor", "left_semi").select("node", "ancestor", "depth")


def lineage(df: DataFrame, node: str, parent: str, most: int = 10) -> DataFrame:
    """Each node's ancestors, oldest first."""
    path = ancestry(df, node, parent, most)
    return path.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("depth"), "ancestor"))), lambda x: x["ancestor"]).alias("path"))


def subtree(df: DataFrame, node: str, parent: str, root: Column, largest: int) -> DataFrame:
    """The nodes below a root in breadth-first order (ties by id), `largest` at most, the root among them, however deep they lie."""
    links = df.select(F.col(node).alias("_c"), F.col(parent).alias("_p"))
    level = staged(df.filter(root).select(F.col(node).alias("node"), F.lit(0).alias("depth")).orderBy("node").limit(largest))
    out, have, depth = level, level.count(), 0
    while 0 < have < largest:
        depth += 1
        below = level.join(links, level["node"] == links["_p"]).select(F.col("_c").alias("node")).distinct().join(out.select("node"), "node", "left_anti")
        level = staged(below.orderBy("node").limit(largest - have).select("node", F.lit(depth).alias("depth")))
        n = level.count()
        if not n:
            break
        out, have = out.union(level), have + n
    return out.orderBy("depth", "node")


def child_counts(df: DataFrame, node: str, parent: str) -> DataFrame:
    counts = df.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_k")).agg(F.count(F.lit(1)).alias("children"))
    return df.join(counts, F.col(node) == F.col("_k"), "left").select(node, F.coalesce("children", F.lit(0)).alias("children"))


def leaf_means(df: DataFrame, node: str, parent: str, score: str) -> DataFrame:
    """For each node the number and mean score of the leaves under it; a leaf is its own.

    Sums and counts go up one link at a time, added up by node, until no parent is left; leaves under a circle of links raise an error.
    """
    ids = df.select(F.col(node).alias("_p")).distinct().hint("merge")  # ids and links grow with the table: none are broadcast, and they are joined once
    links = staged(df.select(F.col(node).alias("_n"), F.col(parent).alias("_p")).join(ids, "_p", "left_semi"))
    inner = df.filter(F.col(parent).isNotNull()).select(F.col(parent).alias("_k")).distinct().hint("merge")
    leaves = df.join(inner, F.col(node) == F.col("_k"), "left_anti").select(F.col(node).alias("node"), F.col(score).alias("_s"))
    step = staged(leaves.groupBy("node").agg(F.sum("_s").alias("_t"), F.count("_s").alias("_c")))
    out, steps, most, n = step, 0, df.count(), step.count()
    while n:
        if steps > most:
            raise ValueError("parent links run in a circle")
        step = F.broadcast(step) if n <= FEW else step.hint("merge")
        up = step.join(links, F.col("node") == F.col("_n")).groupBy(F.col("_p").alias("node")).agg(F.sum("_t").alias("_t"), F.sum("_c").alias("_c"))
        step, steps = staged(up), steps + 1
        out, n = out.union(step), step.count()
    return out.groupBy("node").agg(F.sum("_c").alias("leaves"), F.try_divide(F.sum("_t"), F.sum("_c")).alias("mean"))


def node_scores(df: DataFrame, node: str, parent: str, score: str, margin: float = 0.0) -> DataFrame:
    """(mean of a node's leaves + what it is above its parent's mean, the margin taken off) / root of its leaves."""
    m = staged(leaf_means(df, node, parent, score))
    links = df.select(F.col(node).alias("node"), F.col(parent).alias("_p"))
    up = m.select(F.col("node").alias("_p"), F.col("mean").alias("_pm"))
    local = F.greatest(F.col("mean") - F.coalesce("_pm", "mean") - margin, F.lit(0.0))
    return m.join(links.hint("merge"), "node").join(up.hint("merge"), "_p", "left").select("node", "leaves", "mean", ((F.col("mean") + local) / F.sqrt("leaves")).alias("score"))


#: Weights of a goal's own score and of its children's mean. Three forms exist; each is named.
GOAL_FORMS = {"children": (0.0, 0.7), "own": (0.7, 0.3), "deep": (0.3, 0.7)}


def goal_scores(df: DataFrame, goal: str, parent: str, level: str, score: str, deepest: int, form: str = "deep") -> DataFrame:
    """Scores from the leaves up: 1 if satisfied, a leaf its own score, else weighted with the mean of its children. One aggregation a level."""
    own, below = GOAL_FORMS[form]
    s = F.when(F.col(score).isNull() | F.isnan(F.col(score)), 0.0).otherwise(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)))
    nodes = df.select(F.col(goal).alias("goal"), F.col(parent).alias("up"), F.col(level).alias("level"), s.alias("own"))
    done = None
    for at in range(deepest, -1, -1):
        here = nodes.filter(F.col("level") == at)
        if done is None:
            got = here.withColumn("total", F.when(F.col("own") >= 1 - 1e-6, 1.0).otherwise(F.lit(0.0) if form == "children" else F.col("own")))
            done = out = got
            continue
        kids = done.groupBy(F.col("up").alias("goal")).agg(F.avg("total").alias("_m"))
        leaf = F.lit(0.0) if form == "children" else F.col("own")
        total = F.when(F.col("own") >= 1 - 1e-6, 1.0).when(F.col("_m").isNull(), leaf).otherwise(own * F.col("own") + below * F.col("_m"))
        done = here.join(kids, "goal", "left").withColumn("total", total).drop("_m")
        out = out.union(done)
    return out.select("goal", "level", F.col("total").alias("score"))


def open_leaf(df: DataFrame, goal: str, parent: str, level: str, satisfied: str, deepest: int) -> DataFrame:
    """The shallowest leaf, by level and id, that nothing has satisfied."""
    inner = df.select(F.col(parent).alias("_k")).distinct()
    leaves = df.join(inner, F.col(goal) == F.col("_k"), "left_anti")
    return leaves.filter((F.coalesce(satisfied, F.lit(0)) == 0) & (F.col(level) < deepest)).orderBy(level, goal).limit(1).select(goal, level)


def with_ancestors(nodes: DataFrame, node: str, parent: str, leaves: DataFrame, leaf: str) -> DataFrame:
    """Chosen leaves and all their ancestors, however many: one step up at a time, from what the last step added, until nothing is new."""
    links = nodes.select(F.col(node).alias("_n"), F.col(parent).alias("_p"))
    new = staged(leaves.select(F.col(leaf).alias("_n")).distinct().join(links, "_n", "left_semi"))
    kept = new
    while not new.isEmpty():
        up = new.join(links, "_n").select(F.col("_p").alias("_n")).distinct().join(links, "_n", "left_semi")
        new = staged(up.join(kept, "_n", "left_anti"))
        kept = kept.union(new)
    return nodes.join(kept.select(F.col("_n").alias(node)), node, "left_semi")


def span_scores(tokens: DataFrame, row: str, pos: str, spans: DataFrame, start: str, end: str, score: str) -> DataFrame:
    """Each token with the score of the span [start, end) of its row that it lies in, 0 without one.

    Spans of a row don't overlap: they are laid out over their places, so that no range
    join is needed.
    """
    places = spans.select(row, F.col(score).alias("score"), F.explode(F.sequence(F.col(start), F.col(end) - 1)).alias(pos))
    return tokens.join(places, [row, pos], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def last_token_scores(tokens: DataFrame, row: str, pos: str, mask: str, score: str) -> DataFrame:
    """A row's score on its last kept token, 0 on the others."""
    last = F.max(F.when(F.col(mask) == 1, F.col(pos))).over(Window.partitionBy(row))
    return tokens.withColumn("token_score", F.when(F.col(pos) == last, F.col(score)).otherwise(0.0))


def best_by_tier(answers: DataFrame, group: list[str], text: str, complete: str, score: str, key: str, n: int) -> DataFrame:
    """n answers of each group: complete ones of different texts first, then other complete ones, then incomplete ones, each tier by score; '' fills up."""
    same = Window.partitionBy(*group, text, complete).orderBy(F.desc(score), key)
    tier = F.when(~F.col(complete), 2).when(F.row_number().over(same) == 1, 0).otherwise(1)
    rows = answers.withColumn("_tier", tier)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("_tier", F.desc(score), key))).filter(F.col("place") <= n)
    places = answers.select(*group).distinct().withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return places.join(rows.select(*group, "place", text), [*group, "place"], "left").withColumn(text, F.coalesce(text, F.lit("")))
