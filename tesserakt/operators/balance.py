"""Dealing sequences of different lengths to partitions and micro-batches.

A batch is a few thousand sequences, and each batch is dealt for itself: the
folds run by batch in ``applyInPandas``, many batches side by side.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import reduce, total_ordering

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256
RANGE_ROWS = 2000


# Fixed value: tokens whose linear cost is as great as the quadratic one.
LINEAR = 24576


def workload(length):
    """Cost of a sequence (a column or a number): linear and quadratic part."""
    return LINEAR * length + length * length


def greedy(lengths: list[int], parts: int, equal_size: bool) -> list[list[int]]:
    """Each in turn, as they come, to the lightest partition; with equal sizes a full one takes no more."""
    limit = len(lengths) // parts if equal_size else len(lengths)
    if equal_size and len(lengths) % parts:
        raise ValueError("partitions of equal size must divide the batch")
    out: list[list[int]] = [[] for _ in range(parts)]
    load = [0] * parts
    for i, n in enumerate(lengths):
        k = min((p for p in range(parts) if len(out[p]) < limit), key=lambda p: (load[p], p))
        out[k].append(i)
        load[k] += n
    return out


@total_ordering
class Dealing:
    """A state of the differencing: sets as (sum, number, items), the greatest first. The least state is the one to merge next: widest spread, then greatest first set."""

    def __init__(self, sets: list[tuple[int, int, tuple]]):
        self.sets = sorted(sets, reverse=True)
        self.spread = self.sets[0][0] - self.sets[-1][0]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Dealing) and (self.spread, self.sets[0]) == (other.spread, other.sets[0])

    def __lt__(self, other: Dealing) -> bool:
        return (self.spread, self.sets[0]) > (other.spread, other.sets[0])

    def with_(self, other: Dealing) -> Dealing:
        """Heavy sets of one with light sets of the other."""
        return Dealing([tuple(x + y for x, y in zip(a, b, strict=True)) for a, b in zip(self.sets, reversed(other.sets), strict=True)])


def largest_differencing(lengths: list[int], parts: int, equal_size: bool) -> list[list[int]]:
    """Karmarkar-Karp: the two states of greatest spread are merged, heavy sets to light ones."""
    single = [(lengths[i], 1, ((i, lengths[i]),)) for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i))]
    if equal_size:
        if len(lengths) % parts:
            raise ValueError("partitions of equal size must divide the batch")
        heap = [Dealing(single[at : at + parts]) for at in range(0, len(single), parts)]
    else:
        heap = [Dealing([x] + [(0, 0, ())] * (parts - 1)) for x in single]
    heapq.heapify(heap)
    while len(heap) > 1:
        first = heapq.heappop(heap)
        heapq.heapreplace(heap, first.with_(heap[0]))
    return [[i for i, _ in items] for _, _, items in heap[0].sets] if heap else [[] for _ in range(parts)]


METHODS: dict[str, Callable[[list[int], int, bool], list[list[int]]]] = {"greedy": greedy, "differencing": largest_differencing}


def batches(df: DataFrame, order: str, batch: str, place: str, size: int) -> DataFrame:
    """All rows with their number in the row order as `place`, cut into batches of `size` (the last may be smaller); equal keys are ordered by the other columns.

    The rows are cut into ranges of the key, each numbered for itself from the count of those before it, so no task reads them all.
    """
    n, *bounds = df.agg(F.count(F.lit(1)), F.percentile_approx(order, [k / RANGES for k in range(1, RANGES)])).first()
    bounds = sorted(set(bounds[0] or []))
    bounds = bounds[:: max(1, len(bounds) * RANGE_ROWS // max(n, 1))]

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(order) < bounds[mid], search(low, mid)).otherwise(search(mid + 1, high))

    ranged = df.withColumn("_r", F.when(F.col(order).isNull(), 0).otherwise(search(0, len(bounds))))
    counts = dict(ranged.groupBy("_r").count().collect())
    before = F.create_map(*(F.lit(x) for r in range(len(bounds) + 1) for x in (r, sum(c for k, c in counts.items() if k < r))))
    w = Window.partitionBy("_r").orderBy(order, *(c for c in df.columns if c != order))
    numbered = ranged.withColumn(place, (F.row_number().over(w) - 1 + before[F.col("_r")]).cast("long"))
    return numbered.withColumn(batch, F.floor(F.col(place) / size)).drop("_r")


def partitions(df: DataFrame, batch: str, pos: str, length: str, parts: int, equal_size: bool | None = True, method: str = "differencing") -> DataFrame:
    """batch, pos and part of every row; equal_size None: equal sizes in the batches that divide, any in the others."""
    deal = METHODS[method]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(pos).reset_index(drop=True)
        part = [0] * len(frame)
        for k, rows in enumerate(deal(frame[length].tolist(), parts, len(frame) % parts == 0 if equal_size is None else equal_size)):
            for i in rows:
                part[i] = k
        return frame[[batch, pos]].assign(part=part)

    kinds = dict(df.dtypes)
    return df.select(batch, pos, length).groupBy(batch).applyInPandas(run, f"{batch} {kinds[batch]}, {pos} {kinds[pos]}, part int")


def group_partitions(df: DataFrame, batch: str, pos: str, length: str, group: str, parts: int) -> DataFrame:
    """As partitions of equal numbers of groups: rows of one group stay together, groups are dealt by their workload.

    The parts have to divide a batch's groups; fewer groups than parts are an error.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(pos).reset_index(drop=True)
        cost = frame[length].map(workload)
        number = (frame[group] != frame[group].shift()).cumsum() - 1  # runs of one group
        loads = cost.groupby(number).sum().tolist()
        if len(loads) < parts:
            raise ValueError(f"{len(loads)} groups for {parts} parts")
        part = {}
        for k, rows in enumerate(largest_differencing(loads, parts, True)):
            part.update(dict.fromkeys(rows, k))
        return frame[[batch, pos]].assign(part=number.map(part).astype("int32"))

    kinds = dict(df.dtypes)
    return df.select(batch, pos, length, group).groupBy(batch).applyInPandas(run, f"{batch} {kinds[batch]}, {pos} {kinds[pos]}, part int")


def micro_batches(df: DataFrame, batch: str, pos: str, length: str, limit: int) -> DataFrame:
    """As many micro-batches as the tokens need, balanced by workload; the heaviest lie in the middle."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(pos).reset_index(drop=True)
        lengths = frame[length].tolist()
        count = min(len(lengths), -(-sum(lengths) // limit)) or 1
        cost = [workload(n) for n in lengths]
        dealt = [x for x in largest_differencing(cost, count, False) if x]
        dealt.sort(key=lambda rows: -sum(cost[i] for i in rows))
        dealt = dealt[::2][::-1] + dealt[1::2]
        micro = [0] * len(frame)
        for k, rows in enumerate(dealt):
            for i in rows:
                micro[i] = k
        return frame[[batch, pos]].assign(micro=micro)

    kinds = dict(df.dtypes)
    return df.select(batch, pos, length).groupBy(batch).applyInPandas(run, f"{batch} {kinds[batch]}, {pos} {kinds[pos]}, micro int")


def loads(dealt: DataFrame, df: DataFrame, batch: str, pos: str, length: str, part: str = "part") -> DataFrame:
    """Least, greatest and mean load of each batch's partitions, and their difference."""
    totals = dealt.join(df.select(batch, pos, length), [batch, pos]).groupBy(batch, part).agg(F.sum(length).alias("_t"))
    return totals.groupBy(batch).agg(F.min("_t").alias("least"), F.max("_t").alias("most"), (F.max("_t") - F.min("_t")).alias("difference"), F.avg("_t").alias("mean"))


def mini_batches(df: DataFrame, key: str, size: int, epochs: int, seed: int) -> DataFrame:
    """Every row once an epoch, in an order that a seeded hash of its key makes, dealt into mini-batches of `size`, which has to divide the rows."""
    if (n := df.count()) % size:
        raise ValueError(f"{size} doesn't divide {n} rows")
    parts = [batches(df.withColumn("_h", F.xxhash64(F.lit(seed + e), key)), "_h", "batch", "_place", size).drop("_h", "_place").withColumn("epoch", F.lit(e)) for e in range(epochs)]
    return reduce(DataFrame.unionByName, parts)
