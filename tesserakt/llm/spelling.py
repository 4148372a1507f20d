"""Spelling variants: words one insertion, deletion or replacement apart, found by automata of word halves.

A word within one edit of another holds one of its halves untouched: the first at its own beginning or the second at its own end. Every
word's two halves go to shards by half, each shard builds an Aho-Corasick automaton of its halves, and every word is scanned in the shards
where its own beginnings and ends may lie. A hit counts if it stands at the right offset and the lengths differ by one at most;
then the distance is checked through the other half: equal but for one place, or equal after one deletion. The words of a half are kept by
what is left of their other half without each place, so a half that many words share costs no comparison of all its words. A half of more than
HALF_WORDS words is dealt over several shards, and the scanned words stream past an automaton, so no task holds more than a bounded part.

Nulls and odd input: a null or empty text has no words; a null id counts as ''; repeated rows count each time; a text of any length is taken in
pieces; ties between forms go to the smaller word; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserakt.llm.common import buffers, materialise

RUN = re.compile("[a-zÀ-ÿ]+")
NOT_RUN = re.compile("[^a-zÀ-ÿ]")
#: Code points of a text taken at once, and words that a task holds before it writes their counts.
PIECE, HELD = 1 << 22, 400_000
#: Words of one half in a shard, and rows that a shard gets about.
HALF_WORDS, SHARD_ROWS = 20_000, 60_000


def runs_of(text: str) -> Iterator[list[str]]:
    """The runs of letters of a text in lower case, in lists; a longer text is cut between runs."""
    start = 0
    while len(text) - start > PIECE:
        cut = NOT_RUN.search(text, start + PIECE)
        end = cut.start() if cut else len(text)
        yield RUN.findall(text, start, end)
        start = end
    yield RUN.findall(text, start)


def misspelt(run: str, seed: int, every: int) -> str:
    """The run without one code point if `every` divides the checksum that seed (of the id) begins."""
    h = zlib.crc32(run.encode(), seed)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, least_length: int = 7, least_n: int = 2, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of all texts, with one in `every` run of a document misspelt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return found

        for batch in batches:
            raw, offs = buffers(batch.column(1))
            for r, name in enumerate(batch.column(0).to_pylist()):
                seed = zlib.crc32(f"{name}:".encode())
                for found in runs_of(raw[offs[r] : offs[r + 1]].tobytes().lower().decode("utf-8", "replace")):
                    for text, n in Counter(found).items():
                        if len(text) >= least_length and len(word := misspelt(text, seed, every)) >= least_length:
                            held[word] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    named = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def _halves(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (word, n, key) of the halves that words have, and of those that they may meet; key: kind, the length of the words that have the half, and the half."""
    length = F.length("word")
    half = lambda kind, of, start, size: F.concat(F.lit(kind), of.cast("string"), F.lit(":"), F.substring("word", start, size))
    size = lambda of: F.floor(of / 2).cast("int")
    first = lambda of: half("a", of, F.lit(1), size(of))
    second = lambda of: half("b", of, length - (of - size(of)) + 1, of - size(of))
    own = found.select("word", "n", F.explode(F.array(first(length), second(length))).alias("key"))
    met = F.array(*(f(length + d) for f in (first, second) for d in (-1, 0, 1)))
    return own, found.select("word", "n", F.explode(met).alias("key"))


class Shard:
    """An automaton over the halves of words."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton, self.ready = ahocorasick.Automaton(), False

    def add(self, word: str, n: int, key: str) -> None:
        kind, length = key[0], len(word)
        size = length // 2 if kind == "a" else length - length // 2
        half = word[:size] if kind == "a" else word[length - size :]
        rest = word[size:] if kind == "a" else word[: length - size]
        if half not in self.automaton:
            self.automaton.add_word(half, {})
        whole, without = self.automaton.get(half).setdefault((kind, length), ({}, {}))
        whole[rest] = (word, n)
        for i in range(len(rest)):
            without.setdefault(rest[:i] + rest[i + 1 :], []).append((i, word, n))

    def near(self, word: str) -> dict[str, int]:
        """The shard's words at a distance of one from a word, each under one half only."""
        if not self.ready:
            self.automaton.make_automaton()
            self.ready = True
        out: dict[str, int] = {}
        length = len(word)
        for end, buckets in self.automaton.iter(word):
            for (kind, other), (whole, without) in buckets.items():
                if abs(other - length) > 1:
                    continue
                size = other // 2 if kind == "a" else other - other // 2
                if end != (size if kind == "a" else length) - 1:
                    continue
                rest = word[size:] if kind == "a" else word[: length - size]
                if other == length:
                    found = ((w, n) for i in range(len(rest)) for j, w, n in without.get(rest[:i] + rest[i + 1 :], ()) if i == j and w != word)
                elif other < length:
                    found = (whole[r] for r in {rest[:i] + rest[i + 1 :] for i in range(len(rest))} if r in whole)
                else:
                    found = ((w, n) for _, w, n in without.get(rest, ()))
                first = other // 2
                out.update((w, n) for w, n in found if kind == "a" or w[:first] != word[:first])  # both halves alike: the first counts
        return out


def neighbours(found: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: of words (word, n) those that have near words, how many, and the most frequent of them."""
    own, met = _halves(found)
    crowded = own.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > HALF_WORDS).select("key", F.expr(f"cast((k - 1) div {HALF_WORDS} + 1 as int)").alias("parts"))
    crowded = materialise(crowded, "crowded")  # fewer than 2 / HALF_WORDS rows for each word
    shards = max(12, int(2 * found.count() // SHARD_ROWS))
    dealt = lambda rows: rows.join(crowded, "key", "left").fillna(1, ["parts"])
    own = dealt(own).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).withColumn("scanned", F.lit(False))
    met = dealt(met).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("scanned", F.lit(True))
    shard = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("key"), F.lit(shards))).otherwise(F.xxhash64("key", "part")).cast("long").alias("shard")  # a part of a crowded half is a shard of its own
    rows = own.select(shard, "scanned", "word", "n", "key").union(met.select(shard, "scanned", "word", "n", F.lit("").alias("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, automaton, last = None, Shard(), None
        for batch in batches:
            out = []
            for number, scanned, word, n, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != at:
                    at, automaton, last = number, Shard(), None
                if not scanned:
                    automaton.add(word, n, key)
                elif word != last:  # a word that meets several halves of a shard is scanned once
                    last = word
                    if near := automaton.near(word):
                        best = min(near.items(), key=lambda x: (-x[1], x[0]))
                        out.append((word, len(near), best[1], best[0]))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "n_near", "best_n", "best"])

    partitions = max(shards, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = rows.repartition(partitions, "shard").sortWithinPartitions("shard", "scanned", "word").mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("b")
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def variants(docs: DataFrame, least_length: int = 7, least_n: int = 2, every: int = 31, factor: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form (the most frequent near word, if it occurs `factor` times as often), root (the last of the forms), n, n_near, form_n."""
    found = materialise(words(docs, least_length, least_n, every, id_col, text_col), "words")
    near = found.join(neighbours(found), "word", "left")
    is_form = F.col("best_n") >= factor * F.col("n")
    rows = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    rows = materialise(rows, "forms")
    # every turn doubles how far a word sees; a form is `factor` times as frequent as its word, so there are few turns
    links = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = materialise(links.join(on, "root", "left"), "roots")
        if not links.filter("next IS NOT NULL").limit(1).count():
            break
        links = links.select("word", F.coalesce("next", "root").alias("root"))
    out = rows.join(links.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
