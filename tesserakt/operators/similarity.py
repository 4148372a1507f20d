"""Similarity joins: a stated query set against all rows, exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserakt.operators.stages import staged

#: Queries and rows of a block, and queries and rows that a matrix product takes: a task holds the two blocks and one product.
QUERY_ROWS, BLOCK_ROWS, TILE, SLICE = 4_000, 50_000, 500, 2_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths and zero norms."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits & (na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(0.0)


def _matrix(vectors: pa.ChunkedArray, length: int, by: str) -> np.ndarray:
    """Vectors as rows, of length 1 for cosines; what is null, holds nulls or has another length is zero."""
    out, at = np.zeros((len(vectors), length)), 0
    for chunk in vectors.chunks:
        begins, sizes = chunk.offsets.to_numpy()[:-1], np.diff(chunk.offsets.to_numpy())
        fits = (sizes == length) & chunk.is_valid().to_numpy(zero_copy_only=False)
        values = chunk.values
        if values.null_count:  # sums of nulls up to each place tell which vectors hold any
            gone = np.concatenate(([0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))))
            fits &= gone[begins + sizes] == gone[begins]
            values = values.fill_null(0.0)
        rows = np.flatnonzero(fits)
        if length:
            out[at + rows] = values.to_numpy(zero_copy_only=False)[begins[rows][:, None] + np.arange(length)]
        at += len(chunk)
    if by == "cosine":
        size = np.sqrt((out * out).sum(axis=1))
        out = np.divide(out, size[:, None], out=np.zeros_like(out), where=size[:, None] > 0)
    return out


def _best(queries: pa.Table, rows: pa.Table, length: int, k: int, by: str, exclude_self: bool) -> pa.Table:
    """The k best rows of a block for each query of a block: matrix products, TILE queries by SLICE rows at a time."""
    names, ids = queries.column("id").to_numpy(), rows.column("id").to_numpy()
    wanted = _matrix(queries.column("vector"), length, by)
    kept_id, kept = [np.zeros(0, np.int64)] * len(names), [np.zeros(0)] * len(names)
    for at in range(0, len(ids), SLICE):
        own, matrix = ids[at : at + SLICE], _matrix(rows.column("vector").slice(at, SLICE), length, by).T
        for first in range(0, len(names), TILE):
            score = np.round(wanted[first : first + TILE] @ matrix, 12)  # equal vectors, equal scores
            if exclude_self:
                score[names[first : first + TILE, None] == own[None, :]] = -np.inf
            least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -np.inf)
            for i, q in enumerate(range(first, first + len(score))):
                near = np.flatnonzero((score[i] >= least[i]) & (score[i] > -np.inf))
                every, value = np.concatenate((kept_id[q], own[near])), np.concatenate((kept[q], score[i, near]))
                order = np.lexsort((every, -value))[:k]
                kept_id[q], kept[q] = every[order], value[order]
    return pa.table({"query": np.repeat(names, [len(x) for x in kept]), "id": np.concatenate(kept_id) if kept else np.zeros(0, np.int64), "score": np.concatenate(kept) if kept else np.zeros(0)})


def top_k(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, by: str = "cosine", exclude_self: bool = True) -> DataFrame:
    """query, rank, id and score of the k most similar rows of each query; ties to the smaller id.

    Blocks of QUERY_ROWS queries of one length meet blocks of BLOCK_ROWS rows, each pair of blocks in a task of its own, which keeps its k best rows
    for each query: neither pairs nor vectors go through the driver. Vectors that are null, hold nulls or have another length score 0.
    """
    read = lambda df: df.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("vector"))
    asked = read(queries).withColumn("length", F.coalesce(F.size("vector"), F.lit(0)))
    sizes = asked.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).alias("blocks"))  # a row for each length that queries have
    many = max(1, -(-rows.count() // BLOCK_ROWS))
    asked = asked.join(sizes, "length").withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")))
    asked = asked.select("id", "vector", "length", "part", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("block"))
    parts = sizes.select(F.col("length").alias("own_length"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("own_part"))
    dealt = read(rows).withColumn("own_block", F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")).join(F.broadcast(parts))  # a row for each block of queries

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _best(left, right, key[0].as_py(), k, by, exclude_self)

    found = asked.groupBy("length", "part", "block").cogroup(dealt.groupBy("own_length", "own_part", "own_block")).applyInArrow(run, "query long, id long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "rank", "id", "score")


def most_similar(queries: DataFrame, rows: DataFrame, key: str, vector: str) -> DataFrame:
    return top_k(queries, rows, key, vector, 1).select("query", "id", "score")


def bm25(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str, text: str, k: int, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """The k best documents of each query by BM25 (idf ln(1 + (N - df + 0.5) / (df + 0.5))); ties to the smaller key; no shared word: no row.

    Scores are ranked to 9 places, as sums depend on their order beyond that: documents with the same counts tie.

    Only words of queries are counted in documents: an equi-join on the word, partial counts before the shuffle.
    """

    def words(df: DataFrame, key: str, name: str) -> DataFrame:
        split = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
        return df.select(F.col(key).alias(name), split.alias("_w"))

    asked = words(queries, query_key, "query").select("query", F.explode("_w").alias("w")).groupBy("query", "w").agg(F.count(F.lit(1)).alias("qn"))
    split = words(docs, doc_key, "id").select("id", F.size("_w").alias("len"), F.explode_outer("_w").alias("_any"))
    named = asked.select(F.col("w").alias("_any"), F.col("w")).distinct()
    # the documents are read once: words that nobody asks for are counted together, under no name
    counts = staged(split.join(named, "_any", "left").groupBy("id", "len", "w").agg(F.count(F.lit(1)).alias("tf")))
    texts = counts.groupBy("id", "len").agg(F.sum("tf").alias("n")).withColumn("n", F.when(F.col("len") > 0, F.col("n") / F.col("len")).otherwise(F.col("n")))  # several, where rows share a key
    whole = texts.agg(F.sum("n").alias("_docs"), (F.sum(F.col("n") * F.col("len")) / F.sum(F.when(F.col("len").isNotNull(), F.col("n")))).alias("_avg"))
    counts = counts.filter("w IS NOT NULL")
    spread = counts.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qn") * idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("_avg")))
    scored = counts.join(spread, "w").join(asked, "w").join(F.broadcast(whole)).groupBy("query", "id").agg(F.sum(part).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "rank", "id", "score")


def passages(ranked: DataFrame, query: str, rank: str, title: str, text: str) -> DataFrame:
    """The ranked documents of each query in one text: Doc i(Title: t) text."""
    line = F.concat(F.lit("Doc "), F.col(rank).cast("string"), F.lit("(Title: "), F.col(title), F.lit(") "), F.col(text), F.lit("\n"))
    lines = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("l"))))
    return ranked.groupBy(query).agg(F.array_join(F.transform(lines, lambda x: x["l"]), "").alias("passages"))


def coverage(similarities: Column, threshold: float) -> Column:
    """Share of leading values that reach the threshold before the first that doesn't."""
    miss = F.array_position(F.transform(similarities, lambda x: x >= threshold), False)
    return F.when(miss == 0, 1.0).otherwise((miss - 1) / F.size(similarities))


def joint_score(a: Column, b: Column, cover_a: Column, cover_b: Column) -> Column:
    """0.7 of the better score and 0.3 of the leading share that either covers."""
    both = F.zip_with(cover_a, cover_b, lambda x, y: x | y)
    miss = F.array_position(both, False)
    lead = F.when(miss == 0, F.size(both)).otherwise(miss - 1)
    return 0.7 * F.greatest(a, b) + 0.3 * lead / F.size(both)
