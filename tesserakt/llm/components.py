"""Connected components by alternating stars after union-find within each partition."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserakt.llm.common import materialise

#: Links that one union-find takes at once; longer partitions are taken in such portions, and no task gets more in the end.
PORTION = 500_000


def forest(edges: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace the links of each portion by links to the smallest id of each of its trees."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def out() -> pd.DataFrame:
        pairs = [(x, r) for x in list(parent) if (r := find(x)) != x]
        parent.clear()
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    for frame in edges:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > PORTION:
            yield out()
    yield out()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: long): component is the smallest node reachable.

    Large star and small star in turn (Kiveris et al., 2014) until nothing
    changes; each turn joins on a node and takes minima before the shuffle, so
    a node with many links is split like any skewed join key.
    """
    edges = materialise(edges.filter("a <> b").mapInPandas(forest, "a long, b long").distinct(), "links")
    while True:
        if edges.count() <= PORTION:  # one union-find can take what is left
            trees = materialise(edges.coalesce(1).mapInPandas(forest, "a long, b long"), "links")
            return _labelled(trees)
        # large star: every neighbour greater than x gets the least of x and its neighbours
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: x and its lesser neighbours get the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        small = materialise(small, "links")
        # done when every node has one link and its end has none of its own
        state = small.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        many = state.filter("n > 1").limit(1).count()
        if not many and not small.join(small.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            return _labelled(small)
        edges = small


def _labelled(stars: DataFrame) -> DataFrame:
    """Every node of the stars (a, b) with its centre, the centres too."""
    roots = stars.select(F.col("b").alias("node")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
