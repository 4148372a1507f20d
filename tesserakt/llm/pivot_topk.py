"""Exact top-k by inner product over a pivot-distance index.

Components become floor(SCALE * x). One more coordinate lifts every vector to
the same length, so that the greatest inner product is the least distance. A
vector's key is its nearest pivot and the distance to it; each pivot's vectors
are cut into annuli (rings of that distance) and these into blocks of bounded
size. A query first scores the annuli nearest to it, which gives a score that
its k-th neighbour reaches at least. By the triangle inequality only annuli,
and in a block only the stretch of distances, that may hold such a score are
scored after that; the rest of the annuli is never read for that query.

Pivots come from a bounded sample, every row is indexed, results are exact.
Vectors that are null or hold null or non-finite components take no part.
Rows that share an id count once (the least of their vectors); rows without an
id take no part. Vectors are compared with those of equal length only; scores
are exact while they fit 2**53, and ties go to the smaller id. Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserakt.llm.common import materialise

SCALE = 64
#: Vectors that pivots are chosen from, about; pivots; rings of each; vectors of a block; queries of a block.
SAMPLE, PIVOTS, RINGS, BLOCK, QUERIES = 4096, 24, 12, 4096, 512


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, dim, v: the quantised vector as little-endian 64-bit floats, which hold it exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, out = [], [], []
            column = batch.column(1)
            for r in range(len(batch)):
                if not column[r].is_valid or not batch.column(0)[r].is_valid or column[r].values.null_count:
                    continue
                x = np.floor(column[r].values.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
                if len(x) and np.isfinite(x).all():
                    ids.append(batch.column(0)[r].as_py())
                    dims.append(len(x))
                    out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["id", "dim", "v"])

    rows = df.select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, "id long, dim int, v binary")
    return rows.groupBy("id").agg(F.min(F.struct("dim", "v")).alias("x")).select("id", "x.*")


class Pivots:
    """Pivots, ring borders and the common squared length for vectors of one dimension."""

    def __init__(self, sample: np.ndarray, longest: float):
        self.longest = longest
        lifted = self.lift(sample)
        rng = np.random.default_rng(7)
        at = [int(rng.integers(len(lifted)))]
        near = ((lifted - lifted[at[0]]) ** 2).sum(axis=1)
        while len(at) < min(PIVOTS, len(lifted)) and near.max() > 0:
            at.append(int(rng.choice(len(lifted), p=near / near.sum())))
            near = np.minimum(near, ((lifted - lifted[at[-1]]) ** 2).sum(axis=1))
        self.points = lifted[at]
        for _ in range(5):
            cell = self.distances(lifted).argmin(axis=1)
            self.points = np.array([lifted[cell == c].mean(axis=0) if (cell == c).any() else self.points[c] for c in range(len(self.points))])
        d = self.distances(lifted)
        cell = d.argmin(axis=1)
        own = d[np.arange(len(d)), cell]
        cuts = np.arange(1, RINGS) / RINGS
        self.borders = [np.quantile(own[cell == c], cuts) if (cell == c).any() else np.zeros(RINGS - 1) for c in range(len(self.points))]

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))
        return np.hstack((x, rest[:, None]))

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        d = (lifted * lifted).sum(axis=1)[:, None] + (self.points**2).sum(axis=1)[None] - 2 * lifted @ self.points.T
        return np.sqrt(np.maximum(d, 0))

    def query(self, x: np.ndarray) -> np.ndarray:
        """Distances of queries to the pivots; a query's last coordinate is 0."""
        return self.distances(np.hstack((x, np.zeros((len(x), 1)))))


def fit(vectors: DataFrame) -> dict[int, Pivots]:
    found = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = {}
    for dim, n in found.items():
        rows = vectors.filter(F.col("dim") == dim)
        part = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) <= int(1_000_000 * min(1.0, SAMPLE / n))).limit(2 * SAMPLE).toPandas()
        if not len(part):
            part = rows.limit(SAMPLE).toPandas()
        sample = np.array([np.frombuffer(v) for v in part.sort_values("id")["v"]])
        longest = rows.mapInArrow(_norms, "n double").agg(F.max("n")).first()[0]
        out[dim] = Pivots(sample, float(longest))
    return out


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        norms = [float((np.frombuffer(v.as_py()) ** 2).sum()) for v in batch.column("v")]
        yield pa.RecordBatch.from_arrays([pa.array([max(norms, default=0.0)])], names=["n"])


def _packed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    return ids, np.array([np.frombuffer(v.as_py()) for v in table.column("v")])


def build(vectors: DataFrame, pivots: dict[int, Pivots]) -> DataFrame:
    """The index: a row for each block of an annulus, its vectors in order of their distance to the pivot."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            cell, ring, dist = np.zeros(len(dims), np.int32), np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                p, at = shared.value[int(dim)], np.flatnonzero(dims == dim)
                d = p.distances(p.lift(np.array([np.frombuffer(batch.column(2)[int(i)].as_py()) for i in at])))
                cell[at] = d.argmin(axis=1)
                dist[at] = d[np.arange(len(at)), cell[at]]
                ring[at] = [np.searchsorted(p.borders[c], x, side="right") for c, x in zip(cell[at], dist[at], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(ring), pa.array(dist)], names=[*batch.schema.names, "cell", "ring", "dist"])

    keyed = materialise(vectors.mapInArrow(key, "id long, dim int, v binary, cell int, ring int, dist double"), "keyed")
    sizes = F.broadcast(keyed.groupBy("dim", "cell", "ring").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")))  # dims * PIVOTS * RINGS rows at most
    keyed = keyed.join(sizes, ["dim", "cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("dist", "ascending"), ("id", "ascending")])
        ids, v = _packed(table)
        d = table.column("dist").to_numpy()
        first = {c: table.column(c)[0].as_py() for c in ("dim", "cell", "ring", "part")}
        return pa.Table.from_pylist([first | {"lo": float(d[0]), "hi": float(d[-1]), "n": len(ids), "ids": ids.tobytes(), "d": d.tobytes(), "v": v.tobytes()}], schema=packed)

    packed = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("ring", pa.int32()), ("part", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int64()), ("ids", pa.binary()), ("d", pa.binary()), ("v", pa.binary())])
    columns = ["id", "dim", "v", "cell", "ring", "dist", "part"]
    return materialise(keyed.select(*columns).groupBy("dim", "cell", "ring", "part").applyInArrow(pack, "dim int, cell int, ring int, part int, lo double, hi double, n long, ids binary, d binary, v binary"), "index")


def _route(queries: DataFrame, pivots: dict[int, Pivots], annuli: dict, k: int) -> DataFrame:
    """Which annuli each query has to score, queries in blocks. Without a column `least`: those nearest to it that hold enough."""
    shared = queries.sparkSession.sparkContext.broadcast((pivots, annuli))
    bounded = "least" in queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, annuli = shared.value
        for batch in batches:
            all_dims = batch.column(1).to_numpy()
            for dim in np.unique(all_dims):
                rows = np.flatnonzero(all_dims == dim)
                for i in range(0, len(rows), QUERIES):
                    at = rows[i : i + QUERIES]
                    ids = batch.column(0).take(pa.array(at)).to_numpy()
                    q = np.array([np.frombuffer(batch.column(2)[int(r)].as_py()) for r in at])
                    p, (cell, ring, lo, hi, n) = pivots[int(dim)], annuli[int(dim)]
                    dist = p.query(q)[:, cell]
                    near = np.maximum(np.maximum(dist - hi, lo - dist), 0)
                    if bounded:
                        least = batch.column(3).take(pa.array(at)).to_numpy(zero_copy_only=False)
                        wanted = near <= reach(q, p.longest, least)[:, None]
                    else:
                        least = np.full(len(at), -np.inf)
                        order = np.argsort(near, axis=1, kind="stable")
                        enough = np.cumsum(n[order], axis=1) - n[order] < 4 * k + 1
                        wanted = np.zeros_like(near, dtype=bool)
                        np.put_along_axis(wanted, order, enough, axis=1)
                    out = {x: [] for x in ("dim", "cell", "ring", "qids", "q", "least")}
                    for a in np.flatnonzero(wanted.any(axis=0)):
                        w = wanted[:, a]
                        for x, y in zip(out, (int(dim), int(cell[a]), int(ring[a]), ids[w].tobytes(), q[w].tobytes(), least[w].tobytes()), strict=True):
                            out[x].append(y)
                    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    columns = ["id", "dim", "v"] + ["least"] * bounded
    return queries.select(*columns).mapInArrow(run, "dim int, cell int, ring int, qids binary, q binary, least binary")


def reach(q: np.ndarray, longest: float, least: np.ndarray) -> np.ndarray:
    """How far a vector may lie from the query (lifted) and still score `least`; a little more, for rounding."""
    return np.sqrt(np.maximum((q * q).sum(axis=1) + longest - 2 * least, 0) * (1 + 1e-9) + 1e-3)


def _score(pairs: DataFrame, pivots: dict[int, Pivots], k: int) -> DataFrame:
    """The k best of each block for each query sent to it, down to `least`."""
    shared = pairs.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                p, dim = shared.value[row["dim"]], row["dim"]
                ids, d, v = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["d"]), np.frombuffer(row["v"]).reshape(-1, dim)
                qids, q, least = np.frombuffer(row["qids"], np.int64), np.frombuffer(row["q"]).reshape(-1, dim), np.frombuffer(row["least"])
                dist, far = p.query(q)[:, row["cell"]], reach(q, p.longest, np.maximum(least, -1e300))
                # expand from the query's own distance both ways, until the triangle inequality says stop
                low, high = np.searchsorted(d, (dist - far).min(), "left"), np.searchsorted(d, (dist + far).max(), "right")
                ids, v = ids[low:high], v[low:high]
                if not len(ids):
                    continue
                scores = q @ v.T
                scores[qids[:, None] == ids[None]] = -np.inf
                keep = scores >= least[:, None]
                keep &= np.isfinite(scores)
                if len(ids) > k:
                    keep &= scores >= np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k][:, None]
                r, c = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(qids[r]), pa.array(ids[c]), pa.array(scores[r, c].astype(np.int64))], names=["query_id", "vec_id", "score"])

    columns = ["dim", "cell", "ids", "d", "v", "qids", "q", "least"]
    return pairs.select(*columns).mapInArrow(run, "query_id long, vec_id long, score long")


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(df: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best others of each row for which `queries` (a condition on `id`) holds."""
    spark = df.sparkSession
    vectors = materialise(_vectors(df, id_col, vector_col), "vectors")
    pivots = fit(vectors)
    if not pivots:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index = build(vectors, pivots)
    annuli = {}
    for r in index.groupBy("dim", "cell", "ring").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).collect():
        annuli.setdefault(r["dim"], []).append((r["cell"], r["ring"], r["lo"], r["hi"], r["n"]))
    annuli = {dim: tuple(np.array(x) for x in zip(*rows, strict=True)) for dim, rows in annuli.items()}
    asked = vectors.filter(queries)
    # both sides grow with the table, and blocks of vectors pack so well on disk that Spark would take them for small ones: never broadcast
    index = index.hint("merge")
    first = _score(_route(asked, pivots, annuli, k).join(index, ["dim", "cell", "ring"]), pivots, k)
    least = _best(first, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("least"))
    asked = asked.join(least, asked["id"] == least["query_id"], "left").select("id", "dim", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    scored = _score(_route(materialise(asked, "asked"), pivots, annuli, k).join(index, ["dim", "cell", "ring"]), pivots, k)
    return _best(scored, k).select("query_id", "rank", "vec_id", "score")
