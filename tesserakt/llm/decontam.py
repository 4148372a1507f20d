"""Benchmark decontamination by template windows.

Texts become templates: words in lower case without punctuation, where numbers
(digits, number words), units after a number and names (gazetteer, or the
capitalised word after a title) turn into typed placeholders. WINDOW-word
windows of the items' templates meet those of the documents by their hash. What
fills the placeholders must agree: within one occurrence of an item (or in all of
them together) a filler of the item may stand for one filler only, and the other
way round; windows that break the rule don't count. An item is found if
min(NEED, 80 %) of its windows are in one occurrence or in all together.

Besides this plain view, texts are read in two wider ones, where numbers and units
are those of four languages, a run of numbers is one placeholder, and capitalised
words are names: all of them, or those away from the start of a sentence. There
half a window must be plain words, and an occurrence must be one by itself. An item
that the plain view finds is reported by it.

An item of MIN_WORDS to WINDOW - 1 words is one window of its own length; a
shorter one must stand there word for word, placeholders too. Null and empty texts
match nothing. Repeated rows are searched each for itself; repeated items are
found each; extra columns pass through or are ignored; an empty table on either
side gives no match.

One pass over the documents, whatever the benchmark's size: a Bloom filter of the items' windows (6 MB at most) leaves
windows out of the shuffle, the rest meet the items' in a hash join, and matches are grouped by text and item. Equal texts are one
text, by a hash of 120 bits.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserakt.llm.common import LOWER, buffers, chunks, materialise, mix, prefix_sums, range_hash, trimmed, unused, word_spans
from tesserakt.llm.sketches import has, sketch

WINDOW = 8
MIN_WORDS = 5
NEED = 6
#: Bits of the least and greatest width of the filter of the items' windows.
LEAST_BITS, MOST_BITS = 16, 24
#: Bytes of text whose templates are made at once; matched groups that are Python objects at once.
PIECE, GROUPS = 1 << 18, 64

NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half quarter".split()
UNITS = "mm cm km m mg kg g lb lbs oz ml l s ms min h hr hrs kb mb gb tb w kw v kwh hz mph kmh ft inch inches feet foot yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters gram grams kilogram kilograms pound pounds ounce ounces ton tons litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees".split()
NAMES = "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah christopher karen charles nancy daniel lisa matthew betty anthony margaret sandra steven ashley andrew emily joshua donna kenneth michelle kevin carol brian amanda george melissa edward deborah ronald stephanie timothy rebecca jason laura jeffrey sharon ryan cynthia jacob kathleen alice bob carlos maria pierre hans ahmed fatima natalia olivia sophia tom jerry peter paul anna janet jack jill kate mike".split()
WIDE_NUMBERS = """null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend million millionen milliarde milliarden dutzend
zéro deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize vingt vingts trente quarante cinquante soixante cent cents mille millions milliard milliards douzaine
cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos mil millón millones docena""".split()
WIDE_NUMBERS += [a + "und" + b for a in "ein zwei drei vier fünf sechs sieben acht neun".split() for b in "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split()]
WIDE_NUMBERS += [a + "hundert" for a in "ein zwei drei vier fünf sechs sieben acht neun".split()] + [a + "tausend" for a in "ein zwei drei vier fünf sechs sieben acht neun zehn".split()]
WIDE_UNITS = """gramm kilogramm pfund unze unzen tonne tonnen zoll fuß meile meilen sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad
mètre mètres kilomètre kilomètres centimètre centimètres gramme grammes kilogramme kilogrammes livre livres tonnes pouce pouces pied pieds mille seconde secondes heure heures jour jours semaine semaines mois an ans année années pourcent degré degrés
metro metros kilómetro kilómetros centímetro centímetros gramo gramos kilogramo kilogramos kilo kilos libra libras onza onzas tonelada toneladas pulgada pulgadas pie pies milla millas litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años dólar dólares euros céntimo céntimos grado grados""".split()
LINKS = "and und et y".split()  # within a number of several words: hundred and five, treinta y uno
LINKED = "hundred thousand million hundert tausend vingt trente quarante cinquante soixante treinta cuarenta cincuenta sesenta setenta ochenta noventa".split()
TITLES = "mr mrs ms dr prof".split()
_NUM, _UNIT, _NAME = (np.uint64(x) for x in (0x51ED270B0A4B1F35, 0x6A09E667F3BCC909, 0x3C6EF372FE94F82B))

_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_WORD |= _DIGIT
_WORD[ord("a") : ord("z") + 1] = True
_WORD[ord("A") : ord("Z") + 1] = True


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return np.sort(range_hash(prefix_sums(data), starts, ends))


def _in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


_LISTS = [_hashes(x) for x in (NUMBER_WORDS, UNITS, NAMES, TITLES)]
_WIDE_LISTS = [_hashes(x) for x in (NUMBER_WORDS + WIDE_NUMBERS, UNITS + WIDE_UNITS, LINKS, LINKED)]
VIEWS = ("plain", "capitals", "inner capitals", "exact")
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?:\n"]] = True


def template(data: np.ndarray, doc_offs: np.ndarray, view: str = "plain") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template words, what each placeholder stands for (0 for a plain word), and each text's first word."""
    n = len(data)
    digit = _DIGIT[data]
    inside = _WORD[data].copy()
    if n > 2:  # a point or comma between digits belongs to the number
        inner = (data[1:-1] == ord(".")) | (data[1:-1] == ord(","))
        inside[1:-1] |= inner & digit[:-2] & digit[2:]
    text = np.where(inside, LOWER[data], np.uint8(32))
    starts, ends, first = word_spans(text, doc_offs)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), first
    own = range_hash(prefix_sums(text), starts, ends)
    if view == "exact":
        return own, np.zeros(len(own), np.uint64), first
    wide = view != "plain"
    numbers, units = (_WIDE_LISTS if wide else _LISTS)[:2]
    number = digit[starts] | _in(own, numbers)
    doc = np.repeat(np.arange(len(doc_offs) - 1), np.diff(first))
    follows = np.concatenate(([False], doc[1:] == doc[:-1]))
    if wide:
        after = np.concatenate((number[1:] & follows[1:], [False]))
        number |= _in(own, _WIDE_LISTS[2]) & after & follows & np.concatenate(([False], _in(own, _WIDE_LISTS[3])[:-1]))
    unit = _in(own, units) & follows & np.concatenate(([False], number[:-1]))
    upper = (data[starts] >= 65) & (data[starts] <= 90)
    name = _in(own, _LISTS[2]) | (upper & follows & np.concatenate(([False], _in(own, _LISTS[3])[:-1])))
    if wide:
        second = data[np.minimum(starts + 1, n - 1)]
        upper |= (data[starts] == 0xC3) & (second >= 0x80) & (second <= 0x9E)  # capitals with accents
        if view == "inner capitals":
            ended = np.concatenate(([0], np.cumsum(_END[data])))
            upper &= follows & (ended[starts] == ended[np.concatenate(([0], ends[:-1]))])
        name |= upper
        unit &= ~number
    filler = np.where(number | unit | name, own | np.uint64(1), np.uint64(0))
    words = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, own)))
    if wide:  # a run of numbers is one
        keep = ~(number & follows & np.concatenate(([False], number[:-1])))
        at = np.flatnonzero(keep)
        run = np.arange(len(own)) - at[np.cumsum(keep) - 1]
        filler = np.add.reduceat(np.where(run > 0, mix(own + run.astype(np.uint64)), filler), at)
        filler = np.where(words[at] == _NUM, filler | np.uint64(1), filler)
        words, first = words[at], np.concatenate(([0], np.cumsum(keep)))[first]
    return words, filler, first


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the window of `size` words that begins at each word, texts disregarded."""
    n = max(len(words) - size + 1, 0)
    h = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n])
    return h


def chosen(words: np.ndarray, filler: np.ndarray, view: str) -> tuple[np.ndarray, int]:
    """Places of an item at which its windows begin, and how many words a window has."""
    n = len(words)
    size = min(n, WINDOW)
    count = n - size + 1 if (0 < n < MIN_WORDS if view == "exact" else n >= MIN_WORDS) else 0
    place = np.arange(count)
    if view in VIEWS[1:3] and count:  # windows of too few plain words say nothing
        plain = np.concatenate(([0], np.cumsum(filler == 0)))
        place = place[2 * (plain[place + size] - plain[place]) >= size]
        if len(place) < needed(count):
            place = place[:0]
    return place, size


def needed(count: int) -> int:
    """Windows of an item that must be found."""
    return min(NEED, max(1, math.ceil(0.8 * count)))


def _keys(hashes: np.ndarray, view: int) -> np.ndarray:
    return mix(hashes + np.uint64(view + 1) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _around(filler: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
    """The fillers of the windows that begin at some places."""
    flat = filler[at[:, None] + np.arange(size)[None, :]].reshape(-1) if len(at) else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * size), pa.array(flat.view(np.int64)))


def item_windows(items: DataFrame) -> DataFrame:
    """Of items (no, text): h, no, view, place, size, need, total (of the item's words in the view, in windows), own (the fillers); a row for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "no", "view", "place", "size", "need", "total", "own"]
        for batch in batches:
            raw, offs = buffers(batch.column(1))
            for v, (i, j) in product(range(len(VIEWS)), chunks(offs, PIECE)):
                words, filler, first = template(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], VIEWS[v])
                for r, no in enumerate(batch.column(0).slice(i, j - i).to_pylist()):
                    own, fill = words[first[r] : first[r + 1]], filler[first[r] : first[r + 1]]
                    place, size = chosen(own, fill, VIEWS[v])
                    count, many = len(own) - size + 1, len(place)
                    if many:
                        whole = [pa.array(np.full(many, x, np.int32)) for x in (size, needed(count), count)]
                        yield pa.RecordBatch.from_arrays([pa.array(_keys(windows(own, size)[place], v)), pa.array(np.full(many, no)), pa.array(np.full(many, v, np.int32)), pa.array(place.astype(np.int32)), *whole, _around(fill, place, size)], names=names)

    return items.select("no", "text").mapInArrow(trimmed(run), "h long, no long, view int, place int, size int, need int, total int, own array<long>")


def hits(texts: DataFrame, flags: np.ndarray, bits: int, sizes: list[tuple[int, int]]) -> DataFrame:
    """Of texts (t1, t2, text): t1, t2, h, at (the word), there (the fillers): their windows of the sizes (by view) whose hash may be an item's."""
    shared = texts.sparkSession.sparkContext.broadcast(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = buffers(batch.column(2))
            for i, j in chunks(offs, PIECE):
                data, own = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                read = {}
                for v, size in sizes:
                    if v not in read:
                        read = {v: template(data, own, VIEWS[v])}
                    words, filler, first = read[v]
                    h = _keys(windows(words, size), v)
                    at = np.flatnonzero(has(shared.value, h, bits))
                    doc = np.searchsorted(first, at, side="right") - 1
                    inside = at + size <= first[doc + 1]
                    at, doc = at[inside], doc[inside]
                    if len(at):
                        row = pa.array(doc + i)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(h[at]), pa.array((at - first[doc]).astype(np.int32)), _around(filler, at, size)], names=["t1", "t2", "h", "at", "there"])

    return texts.select("t1", "t2", "text").mapInArrow(trimmed(run), "t1 long, t2 long, h long, at int, there array<long>")


def occurrences(pairs: list[tuple[int, int]], view: str, total: int, size: int) -> Iterator[list[int]]:
    """Numbers of matches (place in the item, place in the text): all together, then by alignment (text less item): each by itself, and close ones joined, as words may be put in or left out."""
    alone = len({p - b for b, p in pairs}) == 1
    if alone or view == "plain":
        yield list(range(len(pairs)))
    if alone:
        return
    near = max(1, (total + size - 1) // 4)
    for width, shift in ((1, 0), (2 * near, 0), (2 * near, near)):  # alignments up to `near` apart share a block of one of the shifts
        groups: dict[int, list[int]] = {}
        for k, (b, p) in enumerate(pairs):
            groups.setdefault((p - b + shift) // width, []).append(k)
        yield from groups.values()


def consistent(matches: list[tuple[int, list[tuple[int, int]]]]) -> tuple[set[int], bool]:
    """Of matches (place, fillers of item and text): the places whose windows agree on the fillers, and whether these are the item's own."""
    votes = Counter(slot for _, slots in matches for slot in slots)
    there: dict[int, int] = {}
    back: dict[int, int] = {}
    for (x, y), _ in sorted(votes.items(), key=lambda v: (-v[1], v[0][0] != v[0][1], v[0])):
        if x not in there and y not in back:
            there[x], back[y] = y, x
    kept = [(b, slots) for b, slots in matches if all(there.get(x) == y for x, y in slots)]
    return {b for b, _ in kept}, all(x == y for _, slots in kept for x, y in slots)


def found_in(view: int, need: int, total: int, size: int, matches: list[dict]) -> tuple[int, bool] | None:
    """Windows found of an item in a text and whether with its own fillers, if one occurrence has enough of them."""
    matches = sorted(matches, key=lambda m: (m["at"], m["place"]))
    pairs = [(m["place"], m["at"]) for m in matches]
    slots = [[(x & (2**64 - 1), y & (2**64 - 1)) for x, y in zip(m["own"], m["there"], strict=True) if x] for m in matches]
    best = None
    for group in occurrences(pairs, VIEWS[view], total, size):
        if len({pairs[k][0] for k in group}) >= need:
            kept, same = consistent([(pairs[k][0], slots[k]) for k in group])
            if len(kept) >= need:
                best = max(best or (False, 0), (same, len(kept)))
    return None if best is None else (best[1], best[0])


def matched(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Of texts (t1, t2, text) and items (no, text): t1, t2, no, n_found, n_windows, same; what the first view that finds an item in a text says."""
    own = materialise(item_windows(items), "item-windows")
    sizes = sorted((r["view"], r["size"]) for r in own.select("view", "size").distinct().collect())  # views times WINDOW at most
    rows = own.count()
    bits = min(max(int(16 * rows).bit_length(), LEAST_BITS), MOST_BITS)
    flags = sketch(own.select("h", F.lit(1).cast("long").alias("n")), 1, bits)
    seen = hits(texts, flags, bits, sizes)
    met = seen.join(own, "h")
    keys = ["t1", "t2", "no", "view", "need", "total", "size"]
    groups = met.groupBy(*keys).agg(F.collect_list(F.struct("place", "at", "own", "there")).alias("matches"))  # of one text and item
    groups = groups.filter(F.size(F.array_distinct(F.col("matches.place"))) >= F.col("need"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in (row for i in range(0, batch.num_rows, GROUPS) for row in batch.slice(i, GROUPS).to_pylist()):
                got = found_in(row["view"], row["need"], row["total"], row["size"], row["matches"])
                if got:
                    out.append({k: row[k] for k in ("t1", "t2", "no", "view")} | {"n_found": got[0], "n_windows": row["total"], "same": got[1]})
            yield from pa.Table.from_pylist(out, schema=pa.schema([(k, pa.int64()) for k in ("t1", "t2", "no")] + [("view", pa.int32()), ("n_found", pa.int64()), ("n_windows", pa.int64()), ("same", pa.bool_())])).to_batches()

    checked = groups.mapInArrow(trimmed(run), "t1 long, t2 long, no long, view int, n_found long, n_windows long, same boolean")
    return checked.groupBy("t1", "t2", "no").agg(F.min(F.struct("view", "n_found", "n_windows", "same")).alias("x")).select("t1", "t2", "no", "x.n_found", "x.n_windows", "x.same")


def _named(text: Column) -> list[Column]:
    """Two numbers that name a text."""
    name = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return [F.conv(F.substring(name, at, 15), 16, 10).cast("long") for at in (1, 16)]


def _matches(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """What matched() finds, and the items (no, item)."""
    items = benchmark.select(F.monotonically_increasing_id().alias("no"), F.col(item_col).alias("item"), F.col(item_text).alias("text"))
    items = materialise(items, "items")
    t1, t2 = _named(F.col(text_col))
    texts = docs.select(t1.alias("t1"), t2.alias("t2"), F.col(text_col).alias("text"))
    return materialise(matched(texts, items), "matches"), items.select("no", "item")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc id, item id, windows found, windows of the item, kind (verbatim or reparameterised)."""
    found, items = _matches(docs, benchmark, text_col, item_col, item_text)
    t1, t2 = _named(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc"), t1.alias("t1"), t2.alias("t2")).join(found, ["t1", "t2"]).join(items, "no")
    kind = F.when(F.col("same"), "verbatim").otherwise("reparameterised")
    return rows.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_found", "n_windows", kind.alias("kind"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents in which no item is found, all their columns as they were."""
    found, _ = _matches(docs, benchmark, text_col, item_col, item_text)
    one, two = unused(docs, "_t1"), unused(docs, "_t2")
    t1, t2 = _named(F.col(text_col))
    gone = found.select(F.col("t1").alias(one), F.col("t2").alias(two)).distinct()
    return docs.withColumns({one: t1, two: t2}).join(gone, [one, two], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
