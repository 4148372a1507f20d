"""Near-duplicate documents: SuperMinHash, banding, verification, components.

Words are the maximal runs without ASCII white space, A-Z in lower case; a
document's set holds its distinct shingles of k words (fewer words: the whole
sequence; none or a null text: the empty set, linked with nothing). Two
documents are linked if 100 * |A and B| >= percent * |A or B|.

Equal sets form a class first, and only its smallest id goes on. A signature
has PLACES values; a band is ROWS of them, and at a similarity of 0.8 a link
shares none of BANDS bands with a probability of 5e-6: the one thing that can
lose a link. Buckets of the same members count once. All members of a bucket are
compared with its first one, and where that leaves more than a few pairs of
different components, with its last one, then with further ones. What still lies in
different components is compared within buckets of up to CELL members, each pair in the
least of its buckets only. The members of larger buckets are alike by and large, and
comparing them all would grow with the square of their number: they meet through
shingles instead, the rarest of each (see ``rarest``), so that texts of one template, each with
words of its own, make no pairs. A shingle that many have all the same among their rarest is
dealt in blocks of CELL by CELL members over many tasks. Pairs that are no link by their sizes or their sketches (two bits a place; a link is ruled out with a
probability of 1e-9) leave the join at once. Nothing is capped. Links are confirmed on the full sets.

Rows that share an id count as one node each time they occur; a row without an
id keeps its shingle count and has neither component nor kept. Extra columns
are ignored; an empty table gives no rows. A text of any length is read whole; its
signature is made SLICE shingles at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserakt.llm.common import buffers, chunks, materialise, mix, shingle_hashes, trimmed, unused, word_hashes
from tesserakt.llm.components import components
from tesserakt.llm.sketches import among, at_most, frequencies, has
from tesserakt.llm.sketches import sketch as key_flags

BANDS, ROWS, PLACES = 40, 6, 320
_EMPTY = np.uint64(2**64 - 1)
#: Elements whose permutations are held at once; bytes of text whose sets are.
SLICE, PIECE = 10_000, 1 << 18
#: Members that one task compares with as many; star rounds at most; pairs left for each member that call for another one.
CELL, STARS, LEFT = 256, 6, 8
#: Sets of so many shingles or fewer go with the members of crowded buckets; larger ones are told apart by their sketches first.
SMALL = 512
#: Bits of the greatest width of the sketch of shingles: 12 MB are broadcast at most.
MOST_BITS = 22
#: The same of the filters of ids, sets and buckets that are shared: 6 MB are broadcast at most, enough for some 5 million of them.
MOST_ID_BITS = 24


def document_sets(data: np.ndarray, doc_offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and where each begins."""
    words, first = word_hashes(data, doc_offs)
    hashes, start = shingle_hashes(words, first, k)
    parts = [np.unique(hashes[a:b]) for a, b in zip(start[:-1], start[1:], strict=True)]
    offs = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), offs


def super_minhash(elements: np.ndarray, offs: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (Ertl, 2017) of many sets at once; a row of the greatest value for an empty set.

    In round j every element takes the j-th entry of its own random permutation
    of the m places and offers it j + a random fraction there. A set whose places
    are all taken by the end of a round needs no further one.
    """
    n = len(offs) - 1
    out = np.full((n, m), _EMPTY, dtype=np.uint64)
    i = 0
    while i < n:
        j = max(int(np.searchsorted(offs, offs[i] + SLICE, side="right")) - 1, i + 1)
        j = min(j, n)
        if j == i + 1:  # the signature of a large set is the least of those of its parts
            for at in range(offs[i], offs[j], SLICE):
                part = elements[at : min(at + SLICE, offs[j])]
                own = np.full((1, m), _EMPTY, dtype=np.uint64)
                _sign(part, np.array([len(part)]), own)
                np.minimum(out[i], own[0], out=out[i])
        else:
            _sign(elements[offs[i] : offs[j]], np.diff(offs[i : j + 1]), out[i:j])
        i = j
    return out


def _sign(elements: np.ndarray, sizes: np.ndarray, out: np.ndarray) -> None:
    m = out.shape[1]
    flat = out.reshape(-1)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    perm = None
    check = 0
    for j in range(m):
        if not len(elements):
            return
        draw = mix(elements ^ np.uint64((j + 1) * 0xA24BAED4963EE407 & (2**64 - 1)))
        pick = j + ((draw & np.uint64(0xFFFF)).astype(np.int64) * (m - j) >> 16)
        if j == 0:
            place = pick
        else:
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint16), (len(elements), 1))
                perm[rows, first] = 0  # round 0 put the first place where it picked
                rows = np.arange(len(elements))
            place = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[:, j]
        if j == 0:
            rows, first = np.arange(len(elements)), pick
        np.minimum.at(flat, doc * m + place, np.uint64(j << 48) | (draw >> np.uint64(16)))
        if j >= check:
            check = j + 1 + j // 4
            open_ = (out == _EMPTY).any(axis=1)
            keep = open_[doc]
            if not keep.all():
                elements, doc = elements[keep], doc[keep]
                if perm is not None:
                    perm = perm[keep]
                else:
                    first = first[keep]
                rows = np.arange(len(elements))


def band_places(bands: int, rows: int, places: int) -> np.ndarray:
    """Places of each band: permutations of all places, cut into bands."""
    rng = np.random.default_rng(97)
    each = places // rows
    return np.concatenate([rng.permutation(places)[: each * rows].reshape(each, rows) for _ in range(-(-bands // each))])[:bands]


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signature[:, band_places(bands, rows, signature.shape[1])]
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), parts.shape[:2]).copy()
    for r in range(rows):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + parts[:, :, r])
    return h


def sketches(signature: np.ndarray) -> np.ndarray:
    """Two bits of each place, 32 places in a number."""
    bits = mix(signature) & np.uint64(3)
    words = -(-signature.shape[1] // 32)
    out = np.zeros((len(signature), words), np.uint64)
    for p in range(signature.shape[1]):
        out[:, p // 32] |= bits[:, p] << np.uint64(2 * (p % 32))
    return out


def most_different(places: int, percent: int) -> int:
    """Places of the sketch that differ at most, but for 6 standard deviations, at a similarity of `percent`."""
    share = 0.75 * (1 - percent / 100)
    return int(places * share + 6 * (places * share * (1 - share)) ** 0.5) + 1


def _different(a: Column, b: Column, words: int) -> Column:
    """In how many places two sketches differ."""
    total = F.lit(0)
    for i in range(words):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return total


def _list(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values.view(np.int64)))


def signatures(docs: DataFrame, k: int, bands: int, rows: int, places: int) -> DataFrame:
    """id, n (size of the set), set_key (16 bytes that name the set), bands (array of keys), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = buffers(batch.column(1))
            for i, j in chunks(offs, PIECE):
                elements, starts = document_sets(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
                sizes = np.diff(starts)
                signed = super_minhash(elements, starts, places)
                keys, sketch = band_keys(signed, bands, rows), sketches(signed)
                names = np.zeros((j - i, 2), np.uint64)
                for r, salt in enumerate((0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)):
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(elements ^ np.uint64(salt)), dtype=np.uint64)))
                    names[:, r] = sums[starts[1:]] - sums[starts[:-1]] + sizes.astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(sizes), pa.array([x.tobytes() for x in names], pa.binary()), _list(keys.reshape(-1), np.arange(j - i + 1) * bands), _list(sketch.reshape(-1), np.arange(j - i + 1) * sketch.shape[1])],
                    names=["id", "n", "set_key", "bands", "sketch"],
                )

    return docs.mapInArrow(trimmed(run), "id long, n long, set_key binary, bands array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, k: int, wanted: DataFrame | None = None) -> DataFrame:
    """id and its sorted distinct shingle hashes, for all texts or for the ids of `wanted` and a few others.

    These texts are chosen by a Bloom filter of bounded size while they are read, so that none is shuffled; with more ids than it is made for more sets are made than needed.
    """
    chosen, shared, bits = wanted is not None, None, 0
    if chosen:
        bits = min(max((8 * wanted.count()).bit_length(), 16), MOST_ID_BITS)
        shared = docs.sparkSession.sparkContext.broadcast(key_flags(wanted.select(F.xxhash64("id").alias("h"), F.lit(1).alias("n")), 1, bits))
        docs = docs.filter("id IS NOT NULL").select("id", "text", F.xxhash64("id").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if chosen:
                batch = batch.filter(pa.array(has(shared.value, batch.column(2).to_numpy(), bits)))
            raw, offs = buffers(batch.column(1))
            for i, j in chunks(offs, PIECE):
                elements, starts = document_sets(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _list(elements, starts)], names=["id", "shingles"])

    return docs.mapInArrow(trimmed(run), "id long, shingles array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough. Only sets that a Bloom filter of their ids lets through are shuffled."""
    pairs = materialise(pairs, "pairs")
    asked = among(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().select(F.xxhash64("id").alias("h")), MOST_ID_BITS)
    sets = sets.filter(asked(F.xxhash64("id")))
    found = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    found = found.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    found = found.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
    return found.filter(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b")


def _one_of_each(whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) from copies to the smallest id of their set, and id, n, bands of one row of each set; bands are shuffled only for what may have copies."""
    classes = materialise(whole.groupBy("set_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("set_key", "rep"), "classes")
    copied = among(classes.select(F.xxhash64("set_key").alias("h")), MOST_ID_BITS)(F.xxhash64("set_key"))
    # An id that occurs with several texts is one node with several sets: its classes are linked through it.
    links = whole.filter(copied).select("id", "set_key").join(classes, "set_key").filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    first = whole.filter(copied).groupBy("set_key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))  # equal sets have equal bands
    return links, whole.filter(~copied).select("id", "n", "bands").union(materialise(first.select("id", "n", "bands"), "representatives"))


def _buckets(reps: DataFrame) -> DataFrame:
    """bucket, id, n of the buckets with two members or more; of buckets with the same members, one."""
    crowded = materialise(reps.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("bucket"), "crowded-buckets")
    shared = among(crowded.select(F.col("bucket").alias("h")), MOST_ID_BITS)
    members = materialise(reps.filter(shared("bucket")).join(crowded.hint("merge"), "bucket").distinct(), "crowded")  # crowded buckets grow with the documents: none are broadcast
    names = [F.xxhash64("id", "n"), F.xxhash64("n", "id")]
    halves = [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))) for h in names] + [F.sum(F.shiftrightunsigned(h, 32)) for h in names]
    named = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), *(x.alias(f"h{i}") for i, x in enumerate(halves))).filter("c > 1")
    one = named.groupBy("c", "h0", "h1", "h2", "h3").agg(F.min("bucket").alias("bucket")).select("bucket")
    return members.join(one, "bucket")


def _alike(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _divided(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that lie in several components, with their component and how many members and pairs of different components the bucket has."""
    known = members.select("bucket", "id", "n").join(labels, F.col("id") == F.col("node"), "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    known = materialise(known, "members")
    parts = known.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"))
    several = parts.groupBy("bucket").agg(F.sum("k").alias("c"), F.sum(F.col("k") * F.col("k")).alias("same"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    return known.join(several.select("bucket", "c", ((F.col("c") * F.col("c") - F.col("same")) / 2).alias("pairs")), "bucket")


def rarest(texts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """bucket, id, n, component, behind, leads, c, k: of texts (id, component) the rarest shingles, each a bucket of c texts of which k lead; behind: shingles of the set from this one on.

    Shingles are put in order by frequency, as a sketch of bounded size tells it (any order that is the same for all texts is right), then by value. Two similar sets of a and b shingles, a <= b, have percent * (a + b) / (100 + percent) of them in
    common or more, so the first that they share stands among the first b - percent * b / 100 + 1 of the larger set, and among the fewer first
    a - 2 * percent * a / (100 + percent) + 1 of the smaller one, where it leads. From it on both sets have as many shingles as they share or more (``_enough_left``).
    A pair meets where the smaller set leads; shingles that no text leads make no pairs.
    """
    own = materialise(sets.join(texts, "id").select("id", "component", F.col("shingles").alias("h")), "crowd")
    total = own.agg(F.sum(F.size("h"))).first()[0] or 0
    bits = min(max(int(4 * total).bit_length(), 16), MOST_BITS)
    shared = own.sparkSession.sparkContext.broadcast(frequencies(own, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, (i, component) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                h = batch.column(2)[r].values.to_numpy()
                n = len(h)
                often = at_most(shared.value, h, bits)
                order = np.lexsort((h, often))
                behind = n - np.arange(n)
                at = np.flatnonzero((100 * behind >= percent * n) & (often[order] > 1))  # what only one text has makes no pairs
                columns = [pa.array(h[order][at]), pa.array(np.full(len(at), i)), pa.array(np.full(len(at), n)), pa.array(np.full(len(at), component)), pa.array(behind[at]), pa.array((100 + percent) * behind[at] >= 2 * percent * n)]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "id", "n", "component", "behind", "leads"])

    first = materialise(own.mapInArrow(run, "bucket long, id long, n long, component long, behind long, leads boolean"), "rarest")
    met = first.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.count_if("leads").alias("k")).filter("c > 1 AND k > 0")
    return first.join(met, "bucket")


def _met(left: DataFrame, right: DataFrame, near: Column) -> DataFrame:
    """Pairs of rows of a bucket and of different components for which `near` holds; k and c: how many rows the bucket has left and right, dealt in blocks of CELL by CELL."""
    one = lambda rows, n, name: rows.withColumn(name, F.pmod(F.xxhash64("id"), F.ceil(F.col(n) / CELL)))
    every = lambda rows, n, name: rows.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / CELL) - 1)))
    a, b = every(one(left, "k", "x"), "c", "y").drop("c", "k").alias("a"), every(one(right, "c", "y"), "k", "x").drop("c", "k").alias("b")
    on = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
    pairs = a.join(b, on & (F.col("a.id") != F.col("b.id")) & (F.col("a.component") != F.col("b.component")) & near)
    return pairs.select(F.greatest("a.id", "b.id").alias("a"), F.least("a.id", "b.id").alias("b")).distinct()


def _enough_left(percent: int) -> Column:
    """Whether two sets that meet at a shingle can have enough in common from it on."""
    return (100 + percent) * F.least("a.behind", "b.behind") >= percent * (F.col("a.n") + F.col("b.n"))


def _near(places: int, percent: int) -> Column:
    return _alike("a.n", "b.n", percent) & (_different(F.col("a.sketch"), F.col("b.sketch"), -(-places // 32)) <= most_different(places, percent))


def _few(members: DataFrame, sketch: DataFrame, sets: DataFrame, places: int, percent: int) -> DataFrame:
    """Pairs of members of a bucket that may be links, each in one bucket."""
    # 32 bits of each shingle: with them two sets share as many as without them or more, but for those that fall together within a set
    cuts = F.array_distinct(F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int")))
    small = sets.filter(F.size("shingles") <= SMALL).select("id", F.size("shingles").cast("long").alias("n"), cuts.alias("cuts")).distinct()
    held = members.groupBy("id", "n").agg(F.collect_set("bucket").alias("held"))  # BANDS for each text at most
    rows = members.join(held, ["id", "n"]).join(sketch.join(small, ["id", "n"], "left"), ["id", "n"])
    first = F.array_min(F.array_intersect("a.held", "b.held")) == F.col("a.bucket")
    both = F.size(F.array_intersect("a.cuts", "b.cuts")) + F.col("a.n") - F.size("a.cuts")
    enough = F.coalesce(100 * both >= percent * (F.col("a.n") + F.col("b.n") - both), F.lit(True))
    rows = rows.select("bucket", "id", "n", "component", "held", "sketch", "cuts")  # the same on both sides, so that it is shuffled once
    here = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.id") > F.col("b.id")) & (F.col("a.component") != F.col("b.component"))
    return rows.alias("a").join(rows.alias("b"), here & _near(places, percent) & first & enough).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def _left_over(pending: DataFrame, sketch: DataFrame, sets: DataFrame, places: int, percent: int) -> DataFrame:
    """Pairs of texts of different components that may be links, of all that share a bucket."""
    many = pending.filter(F.col("c") > CELL).select("id", "component").distinct()
    found = _few(pending.filter(F.col("c") <= CELL), sketch, sets, places, percent)
    if many.isEmpty():
        return found
    met = rarest(materialise(many, "many"), sets, percent).join(sketch, ["id", "n"])
    return found.union(_met(met.filter("leads"), met, (F.col("a.n") <= F.col("b.n")) & _enough_left(percent) & _near(places, percent))).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, places: int = PLACES) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable), kept (the row's id is that), one row per row of docs."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialise(signatures(texts, k, bands, rows, places), "signatures")
    whole = signed.filter("n > 0 AND id IS NOT NULL")
    links, reps = _one_of_each(whole)
    reps = reps.select("id", "n", F.explode("bands").alias("bucket"))
    buckets = materialise(_buckets(reps), "buckets")
    sets = materialise(shingle_sets(texts, k, buckets), "sets")
    pending, labels = buckets.withColumn("component", F.col("id")), None
    before = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()[0] or 0
    for turn in range(STARS):
        # a star: every member of a bucket against one of them, the first, the last, then one of another component each time
        order = [F.struct("id", "n", "component"), F.struct(-F.col("id"), "id", "n", "component"), F.struct(F.xxhash64("component", F.lit(turn)), F.xxhash64("id", F.lit(turn)), "id", "n", "component")][min(turn, 2)]
        centre = pending.groupBy("bucket").agg(F.min(order).alias("c")).select(F.col("bucket").alias("at"), F.col("c.id").alias("centre"), F.col("c.n").alias("size"), F.col("c.component").alias("own"))
        pairs = pending.join(centre, (F.col("bucket") == F.col("at")) & (F.col("id") != F.col("centre")) & (F.col("component") != F.col("own")) & _alike("n", "size", percent))
        found = _linked(pairs.select(F.greatest("id", "centre").alias("a"), F.least("id", "centre").alias("b")).distinct(), sets, percent)
        known = links if labels is None else labels.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = components(known.union(found))
        pending = materialise(_divided(pending, labels), "pending")
        left = pending.select("bucket", "c", "pairs").distinct().agg(F.sum("c").alias("c"), F.sum("pairs").alias("pairs")).first()
        if (left["pairs"] or 0) <= LEFT * (left["c"] or 0) or left["pairs"] > before / 2:  # few are left, or alike without being links
            break
        before = left["pairs"]
    if left["pairs"]:
        open_ = among(pending.select("id").distinct().select(F.xxhash64("id").alias("h")), MOST_ID_BITS)(F.xxhash64("id"))
        sketch = whole.filter(open_).select("id", "n", "sketch").distinct()  # an id with several texts has several
        found = _linked(_left_over(pending, sketch, sets.filter(open_), places, percent), sets, percent)
        labels = components(labels.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))
    out = signed.select("id", "n").join(labels, signed["id"] == labels["node"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("id")).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stand for their component; rows without an id stay.

    Of rows that share a kept id, one of each text stays.
    """
    found = near_duplicates(docs, k, percent, id_col, text_col)
    gone, again, rows = (unused(docs, name) for name in ("_gone", "_again", "_rows"))
    out = found.filter("NOT kept").select(F.col(id_col).alias(gone)).distinct()
    left = docs.join(out.hint("shuffle_hash"), F.col(id_col) == F.col(gone), "left_anti")
    twice = found.filter("kept").groupBy(F.col(id_col).alias(again)).agg(F.count(F.lit(1)).alias(rows)).filter(F.col(rows) > 1).select(again)
    twice = materialise(twice, "repeated-ids")
    if twice.isEmpty():
        return left
    here = F.col(id_col) == F.col(again)
    return left.join(twice, here, "left_anti").unionByName(left.join(twice, here, "left_semi").dropDuplicates([id_col, text_col]))
