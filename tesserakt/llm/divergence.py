"""Source divergence audit: how far the sources of a language differ in the terms they use.

Each task counts terms of its documents by (language, source) and writes the counts without a shuffle. From them a count-min
sketch of document frequencies is merged, one byte a cell that stops at the least frequency asked for: it never says less than the
truth, so a term with a smaller cell can't be kept and isn't shuffled. What is left is counted exactly. Pairs of sources are compared
through the terms that both have (joined by term, summed within tasks before the shuffle); terms that one of them has
come from sums over its own terms, and the rest are equal in all.

Nulls and odd input: null text, language and source count as ''; a text without terms still makes its group occur; repeated rows
count each time; a text of any length is taken in pieces; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserakt.llm.common import LOWER, buffers, materialise, mix, prefix_sums, range_hash
from tesserakt.llm.sketches import has, sketch_of

#: Terms are runs of ASCII letters and code points from 128 on, in lower case: each byte of UTF-8 as such a run has it, or a space.
LETTERS = bytes(int(LOWER[b]) if chr(b).isalpha() or b >= 128 else 32 for b in range(256))
NOT_TERM = re.compile(rb"[^A-Za-z\x80-\xff]")
#: Terms that a task holds before it writes their counts, and terms in a row then.
HELD, PACK = 600_000, 10_000
#: Bytes of a text taken at once.
PIECE = 1 << 22
#: Bits of the least and greatest width of the sketch: what is broadcast takes 6 MB at most (3 * 2**24 bits).
LEAST_BITS, MOST_BITS = 16, 24
#: Sources of a language that meet others at once.
BLOCK = 512
#: One in so many of the probability.
SCALE = 1_000_000_000


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists; a longer text is cut between terms."""
    start = 0
    while len(data) - start > PIECE:
        cut = NOT_TERM.search(data, start + PIECE)
        end = cut.start() if cut else len(data)
        yield data[start:end].translate(LETTERS).split()
        start = end
    yield data[start:].translate(LETTERS).split()


def _packed(values: np.ndarray) -> bytes:
    """Counts in as few bytes each as the greatest of them needs."""
    return values.astype(np.min_scalar_type(values.max())).tobytes()


def partial_counts(docs: DataFrame) -> DataFrame:
    """Of docs (lang, source, text): counts of terms of a language and source, PACK terms in a row, several times for a term where several tasks or portions have it.

    size: how many terms the row has; terms, lens: the terms one after another and their lengths; n: their occurrences. n_docs: in how many texts of the
    language a portion has the term; one of its sources says so and the others 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], Counter] = {}
        in_docs: dict[str, Counter] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in groups.items():
                terms, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
                n_docs = np.fromiter(map(in_docs[lang].pop, terms, repeat(0)), np.int64, len(terms))
                for i in range(0, len(terms), PACK):
                    some = terms[i : i + PACK]
                    lens = np.fromiter(map(len, some), np.int64, len(some))
                    row = [lang, source, len(some), b"".join(some), *map(_packed, (lens, n_docs[i : i + PACK], n[i : i + PACK]))]
                    yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=["lang", "source", "size", "terms", "lens", "n_docs", "n"])
            groups.clear()
            in_docs.clear()

        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.binary()] * 4]
        for batch in batches:
            raw, offs = buffers(batch.column(2))
            for r, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                terms = groups.setdefault(key, Counter())
                before, seen = len(terms), set()
                for found in pieces(raw[offs[r] : offs[r + 1]].tobytes()):
                    terms.update(found)
                    seen.update(found)
                in_docs.setdefault(key[0], Counter()).update(seen)
                held += len(terms) - before
                if held > HELD:
                    yield from out()
                    held = 0
        yield from out()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, size int, terms binary, lens binary, n_docs binary, n binary")


def _unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // size}").astype(np.int64)


def _hashes(lang: str, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the language and each term."""
    name = np.frombuffer(lang.encode(), np.uint8)
    own = range_hash(prefix_sums(name), np.array([0]), np.array([len(name)]))
    return mix(range_hash(prefix_sums(data), offs[:-1], offs[1:]) + own * np.uint64(0x9E3779B97F4A7C15))


def _in_texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows (lang, size, terms, lens, n_docs): hashes of terms and in how many texts they are, where any are said."""
    for lang, size, terms, lens, n_docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        n = _unpacked(n_docs, size)
        h = _hashes(lang, np.frombuffer(terms, np.uint8), np.concatenate(([0], np.cumsum(_unpacked(lens, size)))))
        yield h[n > 0], n[n > 0]


def possible(partial: DataFrame, flags: np.ndarray, bits: int) -> DataFrame:
    """lang, source, term, n_docs, n of the terms that the sketch doesn't rule out."""
    shared = partial.sparkSession.sparkContext.broadcast(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, source, size, terms, lens, n_docs, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                offs = np.concatenate(([0], np.cumsum(_unpacked(lens, size))))
                keep = has(shared.value, _hashes(lang, np.frombuffer(terms, np.uint8), offs), bits)
                names = [pa.repeat(pa.scalar(x, pa.string()), int(keep.sum())) for x in (lang, source)]
                column = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(terms)]).filter(pa.array(keep))
                counts = [pa.array(_unpacked(x, size)[keep]) for x in (n_docs, n)]
                yield pa.RecordBatch.from_arrays([*names, column, *counts], names=["lang", "source", "term", "n_docs", "n"])

    return partial.mapInArrow(run, "lang string, source string, term binary, n_docs long, n long")


def _p(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)), in decimals; null without terms."""
    over = f"CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + 5 AS DECIMAL(19,0))"
    return F.when(F.col(terms) > 0, F.expr(f"1 + ({over}) div CAST({total} + 5 * {terms} AS DECIMAL(20,0))"))


def shared_sums(cells: DataFrame) -> DataFrame:
    """Of cells (lang, term, g, p, base, blocks): lang, a, b, k (terms that both have), x (sum over these of |p_a - p_b| - |p_a - base_b| - |p_b - base_a|)."""
    block = (F.col("g") / BLOCK).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    rows = cells.select("lang", "term", "g", "p", "base", block.alias("m"), other)
    rows = rows.select("lang", "term", F.least("m", "o").alias("i"), F.greatest("m", "o").alias("j"), F.struct("g", "p", "base").alias("cell"))
    met = rows.groupBy("lang", "term", "i", "j").agg(F.collect_list("cell").alias("cells"))  # no more than two blocks in a list
    met = met.filter(F.size("cells") > 1).select("lang", "i", "j", F.col("cells.g").alias("g"), F.col("cells.p").alias("p"), F.col("cells.base").alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, i, j), table in sums.items():
                a, b = np.nonzero(table[0])
                k, x = table[0][a, b], table[1][a, b]
                a, b = a + i * BLOCK, b + j * BLOCK
                if i != j:
                    a, b, k, x = np.concatenate((a, b)), np.concatenate((b, a)), np.tile(k, 2), np.tile(x, 2)
                keep = a != b
                yield pa.RecordBatch.from_arrays([pa.array([lang] * int(keep.sum()), pa.string()), *(pa.array(v[keep]) for v in (a, b, k, x))], names=["lang", "a", "b", "k", "x"])
            sums.clear()

        for batch in batches:
            lists = [(c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (batch.column(k) for k in (3, 4, 5))]
            offs = lists[0][1]
            for r, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                g, p, base = (v[offs[r] : offs[r + 1]] for v, _ in lists)
                left, right = g // BLOCK == key[1], g // BLOCK == key[2]
                if key not in sums:
                    if len(sums) >= 32:  # 4 MB each
                        yield from out()
                    sums[key] = np.zeros((2, BLOCK, BLOCK), dtype=np.int64)
                pa_, ba, pb, bb = p[left][:, None], base[left][:, None], p[right][None, :], base[right][None, :]
                at = np.ix_(g[left] % BLOCK, g[right] % BLOCK)
                table = sums[key]
                table[0][at] += 1
                table[1][at] += np.abs(pa_ - pb) - np.abs(pa_ - bb) - np.abs(pb - ba)
        yield from out()

    found = met.mapInArrow(run, "lang string, a long, b long, k long, x long")
    return found.groupBy("lang", "a", "b").agg(F.sum("k").alias("k"), F.sum("x").alias("x"))


def _own_sums(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (lang, a, b, base_b): lang, a, b, own: the sum over the terms of a of |p_a - base_b|."""
    counts = cells.groupBy("lang", "g", "p").agg(F.count(F.lit(1)).alias("m"))  # a row for each count that occurs

    def run(counts: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        counts = counts.sort_values("p")
        p, m = counts["p"].to_numpy(np.int64), counts["m"].to_numpy(np.int64)
        terms, sums = (np.concatenate(([0], np.cumsum(x))) for x in (m, m * p))
        base = pairs["base_b"].to_numpy(np.int64)
        at = np.searchsorted(p, base)
        below = base * terms[at] - sums[at]
        return pairs[["lang", "a", "b"]].assign(own=below + (sums[-1] - sums[at]) - base * (terms[-1] - terms[at]))

    grouped = counts.withColumnRenamed("g", "a").groupBy("lang", "a")
    return grouped.cogroup(pairs.groupBy("lang", "a")).applyInPandas(run, "lang string, a long, b long, own long")


def audit(docs: DataFrame, least: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part ('pair': item is another source; 'term': item is a term that is more frequent here), item, value, rank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))
    partial = materialise(partial_counts(docs), "terms")
    occurring = materialise(docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")), "groups")
    rows = occurring.agg(F.sum("rows")).first()[0] or 0
    bits = min(max(int(16 * rows).bit_length(), LEAST_BITS), MOST_BITS)
    left = possible(partial, sketch_of(partial.select("lang", "size", "terms", "lens", "n_docs"), _in_texts, least, bits), bits)
    exact = materialise(left.groupBy("lang", "term", "source").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n")), "counts")
    kept = exact.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("all")).filter(F.col("n_docs") >= least).drop("n_docs")
    cells = materialise(exact.drop("n_docs").join(kept, ["lang", "term"]), "kept")
    langs = cells.dropDuplicates(["lang", "term"]).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own_terms"))
    groups = occurring.drop("rows").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "own_terms", "terms", "lang_total"])
    of_lang = Window.partitionBy("lang")
    groups = groups.withColumn("g", (F.row_number().over(of_lang.orderBy("source")) - 1).cast("long"))
    groups = groups.withColumn("blocks", ((F.max("g").over(of_lang) + BLOCK) / BLOCK).cast("int")).withColumn("base", _p("0", "total", "terms"))
    groups = materialise(groups, "groups")

    cells = cells.join(groups.select("lang", "source", "g", "blocks", "base", "total", "terms", "lang_total"), ["lang", "source"])
    cells = cells.withColumn("p", _p("n", "total", "terms")).withColumn("q", _p("all", "lang_total", "terms"))
    cells = materialise(cells.select("lang", "source", "term", "g", "blocks", "base", "p", "q"), "shares")

    one = groups.select("lang", "source", F.col("g").alias("a"), F.col("base").alias("base_a"), F.col("own_terms").alias("terms_a"), "terms")
    two = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("b"), F.col("base").alias("base_b"), F.col("own_terms").alias("terms_b"))
    pairs = materialise(one.join(two, "lang").filter("a <> b"), "pairs")  # as many as the result has
    own = materialise(_own_sums(cells, pairs.filter("terms > 0").select("lang", "a", "b", "base_b")), "sums")
    other = own.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("own").alias("others"))
    wide = pairs.join(own, ["lang", "a", "b"], "left").join(other, ["lang", "a", "b"], "left").join(shared_sums(cells), ["lang", "a", "b"], "left").fillna(0, ["k", "x"])
    neither = (F.col("terms") - F.col("terms_a") - F.col("terms_b") + F.col("k")) * F.abs(F.col("base_a") - F.col("base_b"))
    value = F.when(F.col("terms") > 0, neither + F.col("own") + F.col("others") + F.col("x")).otherwise(0)
    pair = wide.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    term = cells.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.decode("term", "utf-8").alias("item"), (F.col("p") - F.col("q")).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair = pair.withColumn("rank", F.row_number().over(order))
    term = term.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pair.union(term)
