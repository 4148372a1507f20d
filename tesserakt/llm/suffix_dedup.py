"""Removal of repeated byte strings by sharded suffix arrays.

A string of `length` bytes goes to the shard named by the least hash among its
K-byte grams; neighbouring strings of one text with the same least hash form a
stretch. Equal stretches are counted before anything else: one that occurs
twice is repeated as a whole, however often it occurs, and only one copy of each
goes on. A string that two stretches share holds their least gram at the same
place, so half of the rest of it, before the gram or behind it, is equal too:
stretches that share their least hash and one of these halves, or hold the hash
twice, are laid out in a shard, whose suffix array comes from induced sorting: suffixes are
classified, leftmost-smaller substrings are sorted by inducing and, once named,
recursively, and inducing from them sorts all suffixes. Permuted common
prefixes of neighbours then tell which strings start twice.

Words are treated alike beside the bytes: passages of WORDS words or more that another
row holds too are reported as a number of words, and not removed. Their stretches go
the same way; within a shard, hashes of whole windows of words take the place of the
suffix array.

Texts are UTF-8 bytes; a null is empty. Matches never cross texts. Texts of
fewer than `length` bytes lose nothing and make others lose nothing. Rows are
told apart by their text, so repeated rows repeat their strings; equal texts get
equal results whatever their ids. Texts of any length are read whole. Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserakt.llm.common import buffers, chunks, materialise, mix, prefix_sums, range_hash, sums_of, word_spans

LENGTH = 400
#: Bytes of the grams whose least hash names the shard; bytes of a shard, about.
GRAM, SHARD = 32, 1 << 20
#: Words of a passage that is reported, at least, and of its grams; tells the grams of words from those of bytes.
WORDS, WORD_GRAM, WORD_SALT = 51, 8, 0x5BD1E995C2B2AE35


# Suffix arrays


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by induced sorting. The last symbol is 0 and occurs nowhere else."""
    k = int(symbols.max()) + 1
    induce = _induce_buckets if k <= 2048 else _induce_scan
    n = len(symbols)
    if n < 3:
        return np.arange(n)[::-1].copy()
    small = _smaller(symbols)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    counts = np.bincount(symbols, minlength=k)
    # leftmost-smaller substrings, sorted by inducing from any order of them, and named
    order = lms[np.argsort(symbols[lms], kind="stable")]
    got = induce(symbols, small, counts, order)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    got = got[is_lms[got]]
    end = np.full(n, n - 1)
    end[lms[:-1]] = lms[1:]
    sums = _sums(symbols)
    length = end[got] - got + 1
    name_hash = range_hash(sums, got, got + length)
    fresh = np.concatenate(([True], (name_hash[1:] != name_hash[:-1]) | (length[1:] != length[:-1])))
    name = np.cumsum(fresh) - 1
    if name[-1] + 1 == len(lms):
        order = got
    else:
        names = np.zeros(n, dtype=np.int64)
        names[got] = name
        order = lms[suffix_array(names[lms])]
    return induce(symbols, small, counts, order)


def _smaller(symbols: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; a run of equal symbols is as its end."""
    n = len(symbols)
    step = np.sign(np.diff(symbols.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return np.concatenate((np.append(step, 1)[at] > 0, [True]))


def _sums(symbols: np.ndarray) -> np.ndarray:
    return sums_of(mix(symbols.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


def _induce_buckets(symbols: np.ndarray, small: np.ndarray, counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Induce all suffixes from the order of the leftmost-smaller ones, a bucket at a time."""
    n, k = len(symbols), len(counts)
    sa = np.full(n, -1, dtype=np.int64)
    tails = np.cumsum(counts)
    heads = tails - counts
    own = np.bincount(symbols[order], minlength=k)
    starts = tails - own
    first = np.cumsum(own) - own
    chars = symbols[order]
    larger = np.bincount(symbols[~small], minlength=k)

    def put(found: np.ndarray, at: np.ndarray, up: bool) -> None:
        """Append suffixes to their buckets, in the order given, upwards or downwards."""
        c = symbols[found]
        by = np.argsort(c, kind="stable")
        c, found = c[by], found[by]
        begin = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        size = np.diff(np.append(begin, len(c)))
        rank = np.arange(len(c)) - np.repeat(begin, size)
        if up:
            sa[at[c] + rank] = found
            at[c[begin]] += size
        else:
            sa[at[c] - 1 - rank] = found
            at[c[begin]] -= size

    # larger suffixes, from the least bucket up
    free = heads.copy()
    for c in np.flatnonzero(counts):
        done = heads[c]
        while done < free[c]:
            got = sa[done : free[c]]
            done = free[c]
            before = got[got > 0] - 1
            before = before[~small[before]]
            if len(before):
                put(before, free, True)
        got = order[first[c] : first[c] + own[c]]
        before = got[got > 0] - 1
        before = before[~small[before]]
        if len(before):
            put(before, free, True)
    # smaller suffixes, from the greatest bucket down
    free = tails.copy()
    for c in np.flatnonzero(counts)[::-1]:
        done = tails[c]
        while done > free[c]:
            got = sa[free[c] : done][::-1]
            done = free[c]
            before = got[got > 0] - 1
            before = before[small[before]]
            if len(before):
                put(before, free, False)
        got = sa[heads[c] : heads[c] + larger[c]][::-1]
        before = got[got > 0] - 1
        before = before[small[before]]
        if len(before):
            put(before, free, False)
    sa[0] = n - 1
    del starts, chars
    return sa


def _induce_scan(symbols: np.ndarray, small: np.ndarray, counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The same for many different symbols: one suffix at a time."""
    n = len(symbols)
    s, t = symbols.tolist(), small.tolist()
    ends = np.cumsum(counts)
    sa = [-1] * n
    tail = ends.tolist()
    for i in reversed(order.tolist()):
        tail[s[i]] -= 1
        sa[tail[s[i]]] = i
    head = (ends - counts).tolist()
    for r in range(n):
        j = sa[r] - 1
        if j >= 0 and not t[j]:
            c = s[j]
            sa[head[c]] = j
            head[c] += 1
    tail = ends.tolist()
    for r in range(n - 1, -1, -1):
        j = sa[r] - 1
        if j >= 0 and t[j]:
            c = s[j]
            tail[c] -= 1
            sa[tail[c]] = j
    sa[0] = n - 1
    return np.array(sa, dtype=np.int64)


def permuted_prefixes(symbols: np.ndarray, sa: np.ndarray, cap: int, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix (or those at the places) the one before it in the array, and their common prefix in symbols, up to `cap`."""
    n = len(symbols)
    before = np.full(n, n - 1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    sums = _sums(symbols)
    here = np.arange(n) if places is None else places
    before = before[here]
    common = np.zeros(len(here), dtype=np.int64)
    step = 1 << int(cap).bit_length()
    while step:
        more = np.minimum(common + step, cap)
        fits = (np.maximum(here, before) + more <= n) & (more > common)
        at = np.flatnonzero(fits)
        same = range_hash(sums, here[at], here[at] + more[at]) == range_hash(sums, before[at], before[at] + more[at])
        common[at[same]] = more[at[same]]
        step >>= 1
    return before, common


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string whether the `length` bytes from each place on start anywhere else in the strings."""
    sizes = [len(x) for x in strings]
    data = np.zeros(sum(sizes) + len(strings) + 1, dtype=np.int64)
    at, offs = 0, []
    for x in strings:
        offs.append(at)
        data[at : at + len(x)] = np.frombuffer(x, np.uint8).astype(np.int64) + 2
        data[at + len(x)] = 1
        at += len(x) + 1
    sa = suffix_array(data)
    starts = np.concatenate([np.arange(o, o + max(n - length + 1, 0)) for o, n in zip(offs, sizes, strict=True)])
    before, common = permuted_prefixes(data, sa, length, starts)
    twice = np.zeros(len(data), dtype=bool)
    twice[starts[common >= length]] = twice[before[common >= length]] = True
    return [twice[o : o + max(n - length + 1, 0)] for o, n in zip(offs, sizes, strict=True)]


# Stretches


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def stretches(sums: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts of symbols that lie one after another, given by prefix sums over all of them and where each begins: text of each stretch, least hash, hash of all symbols, first start in its text, number of starts, whether the least gram occurs twice, hashes of what stands before and behind it (0: less than half a string)."""
    n = len(sums) - 1
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    at = np.arange(max(n - gram + 1, 0))
    grams = range_hash(sums, at, at + gram)  # those across texts are in no start's window
    start = np.arange(max(n - length + 1, 0))
    start = start[owner[start] == owner[start + length - 1]]
    if not len(start):
        return (np.zeros(0, np.int64), *(np.zeros(0, np.uint64),) * 2, *(np.zeros(0, np.int64),) * 2, np.zeros(0, bool), *(np.zeros(0, np.uint64),) * 2)
    least = sliding_least(grams, length - gram + 1)[start]
    begin = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1))))
    first, key, count = start[begin], least[begin], np.diff(np.append(begin, len(start)))
    ends = first + count + length - 1
    own = range_hash(sums, first, ends)
    # where the keys occur: a table of their low bits leaves few places to look at
    bits = np.zeros(1 << 18, dtype=bool)
    bits[(key & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    hits = np.flatnonzero(bits[(grams & np.uint64(len(bits) - 1)).astype(np.int64)])
    hits = hits[np.isin(grams[hits], key)]
    order = np.lexsort((hits, grams[hits]))
    hits, values = hits[order], grams[hits][order]
    names, base = np.unique(values, return_index=True)
    group = np.searchsorted(names, key)
    span = np.int64(len(grams) + 1)
    rank = np.repeat(np.arange(len(base)), np.diff(np.append(base, len(values)))) * span + hits
    one = np.searchsorted(rank, group * span + first, "left")
    inside = np.searchsorted(rank, group * span + ends - gram + 1, "left") - one
    where, half = hits[one], (length - gram) // 2
    before = np.where(where - half >= first, range_hash(sums, np.maximum(where - half, 0), where) >> np.uint64(33) << np.uint64(1) | np.uint64(1), np.uint64(0))
    stop = where + gram + half
    behind = np.where(stop <= ends, (range_hash(sums, np.minimum(where + gram, n), np.minimum(stop, n)) >> np.uint64(33) << np.uint64(1)) + np.uint64(2), np.uint64(0))
    text = owner[first]
    return text, key, own, first - offs[text], count, inside > 1, before, behind


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts, each text's first word, and prefix sums over all words."""
    starts, ends, first = word_spans(data, offs)
    return starts, ends, first, sums_of(range_hash(prefix_sums(data), starts, ends))


_STRETCH = "t1 long, t2 long, g long, sh long, first int, n int, twice boolean, before long, behind long, words boolean"
#: What the texts at hand tell of a stretch's least gram: only here, here and elsewhere; or that it's a row that stands for the latter.
ALONE, SHARED, SIGN = 0, 1, 2


def _stretch_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = buffers(batch.column(2))
            for i, j in chunks(offs, 1 << 19):
                data, own_offs = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                parts = [(*stretches(prefix_sums(data), own_offs, length, GRAM), False)]
                _, _, words, sums = _words(data, own_offs)
                text, key, *rest = stretches(sums, words, WORDS, WORD_GRAM)
                parts.append((text, key ^ np.uint64(WORD_SALT), *rest, True))
                sizes = [len(x[0]) for x in parts]
                text, key, own, first, count, twice, before, behind = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:8])
                words = np.repeat([x[8] for x in parts], sizes)
                _, one, where, many = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                signs = one[many > 1]
                rows = np.concatenate((np.arange(len(key)), signs))
                state = np.concatenate((np.where(many[where] > 1, SHARED, ALONE), np.full(len(signs), SIGN)))
                at = pa.array(text[rows] + i)
                longs = [pa.array(x[rows].astype(np.uint64).view(np.int64)) for x in (key, own, before, behind)]
                arrays = [batch.column(0).take(at), batch.column(1).take(at), *longs[:2], pa.array(first[rows], pa.int32()), pa.array(count[rows], pa.int32()), pa.array(twice[rows]), *longs[2:], pa.array(words[rows]), pa.array(state, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*(x.split()[0] for x in _STRETCH.split(", ")), "state"])

    return docs.select("t1", "t2", "text").mapInArrow(run, _STRETCH + ", state int")


def _meeting(found: DataFrame) -> DataFrame:
    """The stretches whose least gram occurs elsewhere too, or twice in itself.

    One shuffle by gram, in which each portion of texts has a single row of a gram, the stretch itself or a sign for several. Stretches that a
    portion already knows to be shared go anywhere. Rows stream past in order of their gram, so that no gram is held together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = None, None  # the last gram's only row so far; the last gram if it has several
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            g, state, twice = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 10, 6))
            loose = np.flatnonzero(state != SHARED)
            keep, held = state == SHARED, None
            if len(loose):
                own = g[loose]
                again = np.zeros(len(own), dtype=bool)
                same = own[1:] == own[:-1]
                again[1:] |= same
                again[:-1] |= same
                if known is not None:
                    again |= own == known
                keep[loose] = (again | twice[loose]) & (state[loose] == ALONE)
                known = own[-1] if again[-1] else None
                if known is None:
                    held = batch.slice(int(loose[-1]), 1)
                    keep[loose[-1]] = False
            yield batch.filter(pa.array(keep)).select(range(10))
        if held is not None and held.column(6)[0].as_py() and held.column(10)[0].as_py() == ALONE:
            yield held.select(range(10))

    route = F.when(F.col("state") == SHARED, F.xxhash64("t1", "first")).otherwise(F.col("g"))
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.withColumn("route", route).repartition(parts, "route").drop("route").sortWithinPartitions("g").mapInArrow(run, _STRETCH)


def _bytes_of(docs: DataFrame, length: int) -> DataFrame:
    """The bytes of the stretches listed for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = buffers(batch.column(0))
            rows = []
            for r, listed in enumerate(batch.column(1)):
                text = raw[offs[r] : offs[r + 1]]
                spans = None
                for x in listed.as_py():
                    first, n = x["first"], x["n"]
                    if x["words"]:
                        spans = word_spans(text, np.array([0, len(text)])) if spans is None else spans
                        part = text[spans[0][first] : spans[1][first + n + WORDS - 2]]
                    else:
                        part = text[first : first + n + length - 1]
                    rows.append((x["g"], x["sh"], x["words"], x["low"], x["high"], part.tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["g", "sh", "words", "low", "high", "bytes"])

    return docs.select("text", "listed").mapInArrow(run, "g long, sh long, words boolean, low long, high long, bytes binary")


def repeated_windows(strings: list[bytes], low: list[int], high: list[int], size: int) -> list[np.ndarray]:
    """For each string whether the window of `size` words at each word occurs in rows of different texts; low and high: the least and greatest text that has the string."""
    offs = np.concatenate(([0], np.cumsum([len(x) for x in strings])))
    _, _, first, sums = _words(np.frombuffer(b"".join(strings), np.uint8), offs)
    owner = np.repeat(np.arange(len(strings)), np.diff(first))
    at = np.arange(len(owner) - size + 1)
    at = at[owner[at] == owner[at + size - 1]]
    values, owner = range_hash(sums, at, at + size), owner[at]
    order = np.argsort(values, kind="stable")
    begin = np.flatnonzero(np.concatenate(([True], values[order][1:] != values[order][:-1])))
    least, most = np.minimum.reduceat(np.array(low)[owner][order], begin), np.maximum.reduceat(np.array(high)[owner][order], begin)
    twice = np.empty(len(at), dtype=bool)
    twice[order] = np.repeat(least != most, np.diff(np.append(begin, len(at))))
    return np.split(twice, np.cumsum(np.maximum(np.diff(first) - size + 1, 0))[:-1])


def _ranges(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _sorted_shards(parts: DataFrame, length: int) -> DataFrame:
    """The starts of each stretch that are repeated, as ranges."""

    def run(table: pa.Table) -> pa.Table:
        rows = []
        for words in (False, True):
            part = table.filter(pa.compute.equal(table.column("words"), words))
            if not part.num_rows:
                continue
            strings = [x.as_py() for x in part.column("bytes")]
            found = repeated_windows(strings, part.column("low").to_pylist(), part.column("high").to_pylist(), WORDS) if words else repeated_starts(strings, length)
            rows += [{"g": g, "sh": h, "a": a, "b": b} for g, h, mask in zip(part.column("g").to_pylist(), part.column("sh").to_pylist(), found, strict=True) for a, b in _ranges(mask)]
        return pa.Table.from_pylist(rows, schema=pa.schema([(c, pa.int64()) for c in ("g", "sh", "a", "b")]))

    return parts.groupBy("shard").applyInArrow(run, "g long, sh long, a long, b long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay) and n_repeated_words, one row for each of docs.

    n_repeated_words: words in passages of WORDS words or more that a row holds and another one too.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.md5(F.encode(text, "utf-8"))
    part = lambda at: F.conv(F.substring(name, at, 15), 16, 10).cast("long")
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"), part(1).alias("t1"), part(16).alias("t2"))
    some = materialise(_meeting(_stretch_rows(texts, length)), "shared")
    equal = [F.count(F.lit(1)).alias("c"), F.max("twice").alias("any"), F.max("before").alias("before"), F.max("behind").alias("behind"), F.min("t1").alias("low"), F.max("t1").alias("high")]
    kinds = materialise(some.groupBy("g", "sh", "words").agg(*equal), "kinds")
    of_gram = kinds.groupBy("g").agg((F.count(F.lit(1)) > 1).alias("several"), F.max("any").alias("any"))
    kinds = materialise(kinds.drop("any").join(of_gram, "g"), "kinds")
    meeting = kinds.filter("several OR any")
    sides = meeting.filter("NOT any").select("g", "sh", F.explode(F.array("before", "behind")).alias("side")).filter("side <> 0")
    equal = sides.groupBy("g", "side").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("g", "side")
    alike = sides.join(equal, ["g", "side"]).select("g", "sh").union(meeting.filter("any").select("g", "sh")).distinct()
    one = F.min(F.struct("t1", "t2", "first", "n")).alias("one")
    compared = some.join(alike, ["g", "sh"]).groupBy("g", "sh", "words").agg(one).join(kinds.select("g", "sh", "low", "high"), ["g", "sh"])
    compared = materialise(compared.select("g", "sh", "words", "low", "high", "one.*"), "compared")
    total = compared.agg(F.sum(F.when(F.col("words"), 6 * (F.col("n") + WORDS)).otherwise(F.col("n") + length - 1))).first()[0] or 0
    listed = compared.groupBy("t1", "t2").agg(F.collect_list(F.struct("g", "sh", "words", "low", "high", "first", "n")).alias("listed"))
    parts = _bytes_of(texts.select("t1", "t2", "text").join(listed, ["t1", "t2"]), length)
    shards = max(12, int(total // SHARD))
    parts = parts.withColumn("shard", F.pmod(F.xxhash64("g"), F.lit(shards)))
    # a text that occurs in several rows gives its stretches each time: one of each goes on
    parts = parts.groupBy("shard", "g", "sh", "words", "low", "high").agg(F.min("bytes").alias("bytes"))
    repeated = _sorted_shards(parts, length)
    again = F.when(F.col("words"), F.col("low") != F.col("high")).otherwise(F.col("c") > 1)
    whole = kinds.filter(again).select("g", "sh", F.lit(0).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    hits = materialise(repeated.union(whole), "repeated")
    covered = some.select("t1", "t2", "g", "sh", "first", "n", "words").join(hits, ["g", "sh"])
    size = F.when(F.col("words"), WORDS).otherwise(length)
    span = F.struct((F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.coalesce("b", "n") + (size - 1)).alias("b"))
    spans = lambda on: F.sort_array(F.collect_set(F.when(on, span)))
    covered = covered.groupBy("t1", "t2").agg(spans(~F.col("words")).alias("covered"), spans(F.col("words")).alias("passages"))
    rows = texts.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    covered = covered.join(rows, ["t1", "t2"], "full")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = buffers(batch.column(1))
            rows = []
            for r, (spans, passages, copies) in enumerate(zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)):
                data = raw[offs[r] : offs[r + 1]]
                keep = np.ones(len(data), dtype=bool)
                for x in spans or ():
                    keep[x["a"] : x["b"]] = False
                kept = data[keep].tobytes()
                words = 0
                if copies or passages:
                    count = len(word_spans(data, np.array([0, len(data)]))[0])
                    inside = np.full(count, bool(copies) and count >= WORDS)
                    for x in passages or ():
                        inside[x["a"] : x["b"]] = True
                    words = int(inside.sum())
                rows.append((len(data), len(data) - len(kept), len(_ranges(~keep)), hashlib.sha256(kept).hexdigest(), kept, words))
            n, removed, spans, digest, kept, words = zip(*rows, strict=True) if rows else ((),) * 6
            columns = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()), pa.array(words, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "n_repeated_words"])

    kind = dict(docs.select(id_col).dtypes)[id_col]
    out = texts.join(covered, ["t1", "t2"], "left").select("id", "text", "covered", "passages", "rows")
    return out.mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, n_repeated_words long").withColumnRenamed("id", id_col)
