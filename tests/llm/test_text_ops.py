"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tesserakt.llm import bpe, components, decontam, langid, minhash, pii, queries, sketches, suffix_dedup, toxicity
from tesserakt.llm.common import fold, read_table


def frame(spark, rows):
    """Documents with an extra column whose name clashes with one of the operators' own."""
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("n", F.lit(1))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", "text").limit(120).collect()


ODD = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n"), (10**6 + 3, "one"), (10**6 + 4, "one"), (10**6 + 5, "a b c d " * 5000), (10**6 + 6, "ÉÀ 中文 😀 x\x0by"), (None, "no id at all here"), (10**6 + 3, "one")]


# Byte-pair encoding


def test_bpe_as_tiktoken(spark, docs):
    path, pattern = queries.vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rows = [tuple(r) for r in docs] + ODD
    out = bpe.encode_documents(frame(spark, rows), path, pattern)
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect()]
    want = []
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(out, path, pattern).collect()}
    assert all(back[i] == (t or "") for i, t in rows)
    assert bpe.encode_documents(frame(spark, []), path, pattern).count() == 0


def test_bpe_append_and_edit():
    """Random edits and appends against the library, and a long piece where only entries near the edit are computed."""
    path, pattern = queries.vocabulary()
    ranks = bpe.load_ranks(path)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    model = bpe.PrefixBPE(ranks)
    rng = np.random.default_rng(3)
    bits = ["the ", "quick", " ", "  ", "\n", "\n\n ", "1", "2345", "é", "中", "'s", "'", "ll", "!?", "ABC", "a", "\t", "😀", "internationalisation"]
    for _ in range(60):
        text = "".join(rng.choice(bits, rng.integers(0, 25)))
        held = bpe.Encoded(model, pattern, text)
        assert held.ids() == own.encode_ordinary(text)
        for _ in range(25):
            a, b = sorted(rng.integers(0, len(text) + 1, 2).tolist())
            b = min(b, a + 3) if rng.random() < 0.7 else b
            new = "".join(rng.choice(bits, rng.integers(0, 3)))
            if rng.random() < 0.3:
                a = b = len(text)
                held.append(new)
            else:
                held.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert held.text == text and held.ids() == own.encode_ordinary(text)
    whole = lambda data: model.read(model.extend(data, [-1]))
    data = bytes(rng.integers(97, 101, 300_000).astype(np.uint8))
    piece = bpe.Piece(model, data)
    for a, b, new in ((150_000, 150_003, b"xyzq"), (300_001, 300_001, b"abc"), (0, 5, b""), (299_000, 299_500, b"q" * 700)):
        data = data[:a] + new + data[b:]
        before = model.entries
        assert piece.replace(a, b, new).ids() == whole(data)
        model.entries -= len(data)  # those of the whole string just computed
        assert model.entries - before < 20 * model.longest + len(new)


# Near-duplicates


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.setdefault(i, []).append({tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, many in sets.items() for s in many if s]
    for n, (i, a) in enumerate(flat):
        for j, b in flat[:n]:
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: sorted(len(s) for s in many) for i, many in sets.items()}


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"w{rng.integers(1e9)}" for w in words)


def test_near_duplicates(spark, docs):
    rng = np.random.default_rng(4)
    base = [f"v{x}" for x in rng.integers(0, 500, 160)]
    rows = [tuple(r) for r in docs] + [r for r in ODD if r[0] is not None] + [(2 * 10**6 + i, edited(rng, base, i % 7 / 60)) for i in range(60)]
    out = minhash.near_duplicates(frame(spark, rows + [(None, "no id")]), k=4).collect()
    want, sizes = brute_components(rows, 4, 80)
    assert len(out) == len(rows) + 1
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"] is None and r["n_shingles"] == 1
        else:
            assert (r["component_id"], r["kept"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
            assert r["n_shingles"] in sizes[r["doc_id"]]
    left = minhash.keep_one(frame(spark, rows), k=4)
    assert left.columns == ["doc_id", "text", "id", "n"]
    assert {r["doc_id"] for r in left.collect()} == {i for i, c in want.items() if i == c}
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Crowded buckets cut into blocks, few stars, large sets by their sketches: the same components as brute force."""
    monkeypatch.setattr(minhash, "CELL", 4)
    monkeypatch.setattr(minhash, "LEFT", 0)
    rng = np.random.default_rng(12)
    base = [f"v{x}" for x in rng.integers(0, 10**6, 300)]
    rows = [(i, edited(rng, base, 0.02 + (i % 9) / 300)) for i in range(90)]
    for stars, small in ((1, 10**6), (1, 0), (3, 10**6)):
        monkeypatch.setattr(minhash, "STARS", stars)
        monkeypatch.setattr(minhash, "SMALL", small)
        want, _ = brute_components(rows, 4, 80)
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows), k=4).collect()}
        assert got == want and len(set(want.values())) > 3


def test_crowded_buckets_without_links_make_no_pairs(spark):
    """Texts of one template at a similarity of 0.76: what is compared doesn't grow with the square of their number."""
    pairs = {}
    for many in (500, 1000, 2000):
        shared = [f"t{i}" for i in range(190)]
        texts = [(i, " ".join(shared + [f"o{i}x{j}" for j in range(30)])) for i in range(many)]
        docs = spark.createDataFrame(texts, "id long, text string")
        sets = minhash.shingle_sets(docs, 1)
        found = minhash.rarest(docs.select("id", F.col("id").alias("component")), sets, 80)
        pairs[many] = found.select("bucket", "c", "k").distinct().agg(F.coalesce(F.sum(F.col("c") * F.col("k")), F.lit(0))).first()[0]
    assert max(pairs.values()) == 0
    # with a tenth of them each other's near copies, these meet, and only they
    texts += [(i + 10_000, t.rsplit(" ", 1)[0]) for i, t in texts[:200]]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, texts), k=1).collect()}
    assert all(got[i] == (i - 10_000 if i >= 10_000 else i) for i in got)


def test_similarity_limit(spark):
    """Pairs of sets with exactly 79, 80 and 81 % in common: linked from 80 on."""
    rows, want = [], {}
    for n in range(60):
        for percent in (79, 80, 81):
            # one-word shingles: n_both of n_all words
            both = [f"w{n}x{percent}x{i}" for i in range(percent)]
            a, b = 1000 * n + 10 * percent, 1000 * n + 10 * percent + 1
            left = (100 - percent) // 2
            rows += [(a, " ".join(both + [f"a{a}x{i}" for i in range(left)])), (b, " ".join(both + [f"b{b}x{i}" for i in range(100 - percent - left)]))]
            want[a], want[b] = a, a if percent >= 80 else b
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows), k=1).collect()}
    assert got == want


def test_rows_under_one_id(spark):
    """Of rows that share a kept id, one of each text stays."""
    long = " ".join(f"z{i}" for i in range(40))
    rows = [(1, long), (1, long), (1, "another text altogether here"), (2, long), (None, long), (None, long)]
    left = sorted(((r["doc_id"], r["text"]) for r in minhash.keep_one(frame(spark, rows)).collect()), key=str)
    assert left == sorted([(1, long), (1, "another text altogether here"), (None, long), (None, long)], key=str)


def test_signature_of_a_long_text(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [rng.integers(1, 2**63, n, dtype=np.uint64) for n in (500, 3, 120, 0)]
    flat, offs = np.concatenate(sets), np.cumsum([0] + [len(x) for x in sets])
    want = minhash.super_minhash(flat, offs, 64)
    monkeypatch.setattr(minhash, "SLICE", 37)
    assert (minhash.super_minhash(flat, offs, 64) == want).all()


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (4, 40, 900):
        pool = rng.integers(1, 2**63, 2 * n, dtype=np.uint64)
        a, b = pool[: n + n // 2], pool[n // 2 :]
        signed = minhash.super_minhash(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), 320)
        assert abs((signed[0] == signed[1]).mean() - len(set(a.tolist()) & set(b.tolist())) / (2 * n)) < 0.15
    empty = minhash.super_minhash(np.zeros(0, np.uint64), np.array([0, 0]), 8)
    assert (empty == minhash._EMPTY).all()


def test_components_by_stars_and_by_union_find(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200), (7, 3)] + [(300, 301 + i) for i in range(20)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    want = {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100} | {300 + i: 300 for i in range(21)}
    assert {r["node"]: r["component"] for r in components.components(df).collect()} == want
    monkeypatch.setattr(components, "PORTION", 3)
    assert {r["node"]: r["component"] for r in components.components(df).collect()} == want


# Repeated strings


def brute_repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(v for v, g in zip(x, gone, strict=True) if not g)
        out.append((len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def brute_passages(rows, size):
    """Words of each text in windows of `size` words that another row has too."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    rows_with: dict = {}
    for r, w in enumerate(words):
        for i in range(len(w) - size + 1):
            rows_with.setdefault(tuple(w[i : i + size]), set()).add(r)
    out = []
    for w in words:
        inside = set()
        for i in range(len(w) - size + 1):
            if len(rows_with[tuple(w[i : i + size])]) > 1:
                inside |= set(range(i, i + size))
        out.append(len(inside))
    return out


def test_suffix_dedup(spark, docs):
    rng = np.random.default_rng(6)
    passage = [f"p{x}" for x in rng.integers(0, 10**6, 60)]
    mixed = [(5 * 10**6 + i, " ".join([f"q{x}" for x in rng.integers(0, 10**6, 40)] + passage[i % 3 : 52 + i % 7] + [f"r{x}" for x in rng.integers(0, 10**6, 30)])) for i in range(40)]
    gram = "the gram of thirty-two letters!!"
    hot = [(6 * 10**6 + i, "".join(rng.choice(list("abcdef"), 300)) + gram + "".join(rng.choice(list("abcdef"), 300)) + "x" * (i % 3) * 200) for i in range(300)]
    marks = "ab"
    while len(marks) < 1024:  # Thue-Morse
        marks += marks.translate(str.maketrans("ab", "ba"))
    odd = [(7 * 10**6, marks), (7 * 10**6 + 1, marks.translate(str.maketrans("ab", "ba"))), (7 * 10**6 + 2, "same line here " * 60)]
    rows = [tuple(r) for r in docs[:60]] + ODD + [(3 * 10**6, "é" * 200), (3 * 10**6 + 1, "é" * 300), (3 * 10**6 + 2, "x" * 399), (3 * 10**6 + 3, "y" * 400)] + mixed + hot + odd
    out = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["n_repeated_words"]) for r in out]
    want = [(i, *w, p) for (i, _), w, p in zip(rows, brute_repeats(rows, 400), brute_passages(rows, 51), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_hashes_of_structured_strings():
    from tesserakt.llm.common import prefix_sums, range_hash

    marks = b"ab"
    while len(marks) < 4096:
        marks += marks.translate(bytes.maketrans(b"ab", b"ba"))
    both = np.frombuffer(marks + marks.translate(bytes.maketrans(b"ab", b"ba")), np.uint8)
    sums = prefix_sums(both)
    for n in (512, 1024, 2048, 4096):
        a, b = range_hash(sums, np.array([0, len(marks)]), np.array([n, len(marks) + n]))
        assert a != b
    same = np.frombuffer(b"xyz" * 700 + b"xyz" * 700, np.uint8)
    a, b = range_hash(prefix_sums(same), np.array([0, 2100]), np.array([2100, 4200]))
    assert a == b


@pytest.mark.parametrize("scan", [False, True])
def test_suffix_array(scan, monkeypatch):
    if scan:
        monkeypatch.setattr(suffix_dedup, "_induce_buckets", suffix_dedup._induce_scan)
    rng = np.random.default_rng(8)
    for n in [1, 2, 3, 5, 9, 40, 300]:
        for symbols in (1, 2, 3, 60):
            s = [*rng.integers(1, symbols + 1, n).tolist(), 0]
            assert suffix_dedup.suffix_array(np.array(s)).tolist() == sorted(range(n + 1), key=lambda i: s[i:])


# Personal data


def brute_base(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, name in enumerate(pii.KINDS[:4]):
        for m in re.finditer(pii.PLAIN[name], text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[name]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_pii(spark, docs):
    rng = np.random.default_rng(5)
    bits = ["1", "12", "999", "4111111111111111", " ", "-", "--", ".", "@", "a", "b.c", "+1", "(", ")", "é", "😀", "x@y.z", "_", "5555 5555 5555 4444 ", "1.2.3.4", "\n", 'token = "', "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", '"', "+1 (017) 555-7713 "]
    rows = [tuple(r) for r in docs] + ODD + [(4 * 10**6 + i, "".join(rng.choice(bits, rng.integers(0, 40)))) for i in range(250)]
    rows += [(5 * 10**6, "1" * 5000 + "."), (5 * 10**6 + 1, "a@b" + ".c" * 3000), (5 * 10**6 + 2, "+1" + " 2" * 3000), (5 * 10**6 + 3, "12-" * 3000 + "1.1")]
    rows += [(5 * 10**6 + 4, "token = '" + "0123456789abcdef" * 12 + "01234567" + "'"), (5 * 10**6 + 5, "key=ghp_Ab3dE5fG7hJ9kL1mN2pQ4rS6tU8vW0xYz123 ."), (5 * 10**6 + 6, " ".join(f"a{i}@x.org" for i in range(300)))]
    out = pii.report(frame(spark, rows)).collect()
    got = sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in out)
    want = []
    for i, t in rows:
        base = brute_base(t or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        want.append((str(i), *(sum(k == n for _, k, _ in base) for n in range(4)), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    by_id = {r["doc_id"]: set(r["spans"].split(",")) for r in out}
    for i, t in rows:  # base spans stay
        assert {f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute_base(t or "")} <= by_id[i]
    assert any("secret:" in x for s in by_id.values() for x in s)
    assert all(r["n_spans"] == len(r["spans"].split(",")) if r["spans"] else r["n_spans"] == 0 for r in out)
    assert "secret:9:209" in by_id[5 * 10**6 + 4] and "secret:4:44" in by_id[5 * 10**6 + 5]
    assert pii.report(frame(spark, [])).count() == 0


def test_redaction(spark):
    rows = [(1, "mail to ann@x.org or +1 (017) 555-7713 now"), (2, None), (3, "nothing 12"), (4, "é ann@x.org")]
    got = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, rows)).collect()}
    assert got == {1: "mail to [EMAIL] or [PHONE] now", 2: None, 3: "nothing 12", 4: "é [EMAIL]"}


# Decontamination


def test_decontamination(spark, sf, docs):
    items = read_table(spark, sf, "benchmark")
    texts = {r["item_id"]: r["text"] for r in items.collect()}
    some = sorted(texts)[:3]
    rows = [(1, "before it " + texts[some[0]].upper() + " after it"), (2, " ".join(w + "%%%" for w in texts[some[1]].split())), (3, "clean words only here and nothing else at all"), (4, None), (5, ""), (6, " ".join(texts[some[2]].split()[:6])), (1, texts[some[0]])]
    got = sorted((r["doc_id"], r["item_id"], r["kind"]) for r in decontam.contaminated(frame(spark, rows), items).collect())
    assert got == [(1, some[0], "verbatim"), (1, some[0], "verbatim"), (2, some[1], "verbatim")]
    left = decontam.drop_contaminated(frame(spark, rows), items)
    assert left.columns == ["doc_id", "text", "id", "n"] and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 6]
    assert decontam.contaminated(frame(spark, []), items).count() == 0
    assert decontam.contaminated(frame(spark, rows), items.limit(0)).count() == 0


def test_reparameterised_question(spark, monkeypatch):
    item = "If Alice has 12 apples and Bob has 7 apples then how many apples do Alice and Bob have in 3 days"
    items = spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, text string")
    rows = [(1, item.replace("Alice", "Mary").replace("Bob", "Tom").replace("12", "5").replace("7", "9").replace("3", "4")), (2, "If Paul has many apples and Anna sells them all again then the market is closed for some time"), (3, item)]
    want = {1: "reparameterised", 3: "verbatim"}
    assert {r["doc_id"]: r["kind"] for r in decontam.contaminated(frame(spark, rows), items).collect()} == want
    monkeypatch.setattr(decontam, "MOST_BITS", 3)  # a filter that lets everything through
    monkeypatch.setattr(decontam, "LEAST_BITS", 3)
    assert {r["doc_id"]: r["kind"] for r in decontam.contaminated(frame(spark, rows), items).collect()} == want


def test_reparameterised_variants_in_one_document(spark):
    """Each variant by itself is the item, whatever the others put into the same places."""
    item = "If Alice has 12 apples and Bob has 7 apples then how many apples do Alice and Bob have in 3 days"
    names = ["Mary", "Tom", "Paul", "Anna", "Jack", "Jill", "Kate", "Mike", "Emily", "Kevin", "Laura", "Jason"]

    def variant(k, number=None):
        a, b = names[2 * k % 12], names[(2 * k + 1 + k // 6) % 12]
        x, y, z = number or 20 + (7 * k) % 5, 40 + (3 * k) % 4, 60 + (5 * k) % 3
        return item.replace("Alice", a).replace("Bob", b).replace("12", str(x)).replace("7", str(y)).replace(" 3 ", f" {z} ")

    rows = [(n, " ".join(variant(k) for k in range(n))) for n in range(1, 7)]
    rows += [(7, " ".join([variant(k, 99) for k in range(3)] + [item] + [variant(k, 99) for k in range(3, 6)]))]
    rows += [(8, " ".join(variant(k).replace(" then", ", well, then") for k in range(4)))]
    got = decontam.contaminated(frame(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r["doc_id"]: r["kind"] for r in got} == {n: "reparameterised" for n in (1, 2, 3, 4, 5, 6, 8)} | {7: "verbatim"}


def test_reparameterised_names_numbers_and_short_items(spark):
    item = "If Alice has 12 apples and Bob has 7 apples then how many apples do Alice and Bob have in 3 days"
    german = "Wenn acht Züge nach zwei Stunden noch da sind fährt Lena mit drei Kindern nach Köln und isst vier Äpfel"
    start = "Alice buys 21 red apples from Bob. Carla eats 4 of them with Dora. How many apples has Erin left?"
    items = spark.createDataFrame([(1, item), (2, german), (3, start), (4, "Rivers run north"), (5, "x 17")], "item_id long, text string")
    rows = [
        (1, item.replace("Alice", "Priya").replace("Bob", "Kofi").replace("12", "twenty one")),
        (2, german.replace("acht", "neun").replace("zwei Stunden", "einundzwanzig Minuten").replace("Lena", "Mia").replace("drei", "fünf").replace("Köln", "Bonn").replace("vier", "sieben")),
        (3, start.replace("Alice", "Priya").replace("Bob", "Kofi").replace("21", "one hundred and five").replace("Carla", "Wanjiru").replace("4", "9").replace("Dora", "Ayo").replace("Erin", "Chidi")),
        (4, "they say: rivers run NORTH, x 18 of them"),
        (5, "Rivers run to the north and x is 17"),
        (6, "WHEN ALL THE WORDS OF A TEXT ARE IN CAPITAL LETTERS NOTHING CAN BE SAID OF THE NAMES IN IT AT ALL"),
        (7, item),
    ]
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in decontam.contaminated(frame(spark, rows), items).collect()}
    assert got == {(1, 1, "reparameterised"), (2, 2, "reparameterised"), (3, 3, "reparameterised"), (4, 4, "verbatim"), (7, 1, "verbatim")}


def test_decontamination_windows_by_brute_force(spark, sf, docs):
    """Verbatim items (few placeholders in these texts): found where 80 % of, or 6, eight-word windows occur."""
    items = [(r["item_id"], r["text"]) for r in read_table(spark, sf, "benchmark").collect()]
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    grams = lambda w: {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
    want = set()
    for d in docs:
        have = grams(words(d["text"]))
        for i, t in items:
            w = words(t)
            own = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
            found = sum(g in have for g in own)
            if own and found >= min(6, max(1, -(-8 * len(own) // 10))):
                want.add((d["doc_id"], i))
    got = decontam.contaminated(spark.createDataFrame([tuple(d) for d in docs], "doc_id long, text string"), read_table(spark, sf, "benchmark"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


# Language and toxicity


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    docs = read_table(spark, sf, "documents")
    out = queries.op3_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == docs.count() and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    model = langid.fit(docs.filter(fold("doc_id", 5) != 0))
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(frame(spark, ODD), model).collect()}
    assert odd[10**6] == odd[10**6 + 1] == odd[10**6 + 2] == ("und", 0.0)
    assert odd[10**6 + 3][0] in model[0] and 0 <= odd[10**6 + 3][1] <= 1
    none = langid.fit(docs.limit(0))
    assert none[0] == [] and {r["lang_pred"] for r in langid.predict(frame(spark, ODD), none).collect()} == {"und"}


def test_language_by_plain_naive_bayes(spark, docs):
    """Counts, log-probabilities and scores recomputed character by character."""
    import math

    def bucket(chars):
        h = len(chars)
        for c in chars:
            raw = c.encode()
            raw = bytes([raw[0] + 32]) if "A" <= c <= "Z" else raw
            h = (h * 0x100000001B3 + int.from_bytes(raw, "little")) % 2**64
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            h = ((h ^ h >> shift) * factor) % 2**64
        return h % langid.BUCKETS

    grams = lambda t: [bucket(t[i : i + n]) for n in range(1, langid.MAX_N + 1) for i in range(len(t) - n + 1)]
    rows = [(i, t[:400], "de" if "ch" in t[:200] else "en") for i, t in docs[:40]]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts: dict = {}
    for _, t, lang in rows:
        counts.setdefault(lang, Counter()).update(grams(t))
    langs = sorted(counts)
    assert model[0] == langs
    logs = [lambda b, c=counts[x]: math.log((c[b] + langid.SMOOTHING) / (sum(c.values()) + langid.SMOOTHING * langid.BUCKETS)) for x in langs]
    for r in langid.predict(spark.createDataFrame([(i, t[400:900]) for i, t in docs[:60]], "doc_id long, text string"), model).collect():
        text = dict((i, t[400:900]) for i, t in docs[:60])[r["doc_id"]]
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        total = [sum(f(b) for b in grams(text)) for f in logs]
        best = max(range(len(langs)), key=lambda k: total[k])
        assert r["lang_pred"] == langs[best] and abs(r["score"] - 1 / sum(math.exp(x - total[best]) for x in total)) < 1e-3


def test_ngram_counts_by_brute_force():
    texts = ["Aé b", "", "x", "中文中文"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0] + [len(t.encode()) for t in texts])
    for n, (h, starts) in enumerate(langid.ngram_buckets(raw, offs), 1):
        assert np.diff(starts).tolist() == [max(len(t) - n + 1, 0) for t in texts]
        if n == 2:  # equal n-grams, equal buckets
            assert h[starts[3]] == h[starts[3] + 2]


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op1_toxicity(spark, sf).join(read_table(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in out if r["toxic"] == 1], [r for r in out if r["toxic"] == 0]
    assert np.mean([r["predicted"] for r in toxic]) > 0.8 and np.mean([r["predicted"] for r in clean]) < 0.02
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(99, None), (98, 1)], "doc_id long, toxic int")
    rows = [(i, f"plain words {'awful' if i % 2 else 'nice'} more words {i}") for i in range(40)]
    model = toxicity.fit(frame(spark, rows), labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, rows + ODD), model).collect()}
    assert min(got[i] for i in range(1, 40, 2)) > max(got[i] for i in range(0, 40, 2))
    assert got[10**6] == got[10**6 + 1]
    kept = toxicity.reject(frame(spark, rows + ODD[:2]), model, threshold=0.5)
    assert kept.columns == ["doc_id", "text", "id", "n"] and not any(r["doc_id"] in range(1, 40, 2) for r in kept.collect())
    only = toxicity.fit(frame(spark, rows), labels.filter("toxic = 1"))
    assert {r["score"] > 0.99 for r in toxicity.score(frame(spark, rows), only).collect()} == {True}
    assert toxicity.score(frame(spark, []), model).count() == 0


def test_toxicity_scores_by_plain_code(spark, docs):
    """Features, score and rejection recomputed word by word."""
    from tesserakt.llm.common import prefix_sums, range_hash

    rows = [(i, f"plain words {'awful awful' if i % 2 else 'nice'} more words {i % 3}") for i in range(60)]
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))
    weights = dict(zip(model[0].tolist(), model[1].tolist(), strict=True))

    def number(word, p):
        data = np.frombuffer(word, np.uint8)
        h = int(range_hash(prefix_sums(data), np.array([0]), np.array([len(data)]))[0]) ^ (p * 0x9E3779B9)
        return h % (toxicity.SPACE // 4) * 4

    some = [(i, t) for i, t in docs[:30]] + [(10**7 + i, t) for i, t in rows[:6]] + [(10**6, None), (10**6 + 1, "Awful, AWFUL!")]
    for r in toxicity.score(frame(spark, some), model).collect():
        text = dict(some)[r["doc_id"]]
        words = re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        seen: set = set()
        for p in toxicity.PREFIXES:
            count = Counter(number(w[:p] if p else w, p) for w in words if len(w) >= p)
            seen |= {b + k for b, n in count.items() for k, least in enumerate(toxicity.RECURS) if n >= least}
        z = model[2] + sum(weights.get(f, 0.0) for f in seen)
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-5


def test_label_model_by_plain_code(monkeypatch):
    """Expectation-maximisation with one voter that depends on another, loop by loop."""
    rng = np.random.default_rng(7)
    y = rng.random(300) < 0.4
    votes = np.column_stack([rng.random(300) < np.where(y, 0.8, 0.2), rng.random(300) < np.where(y, 0.6, 0.1), rng.random(300) < np.where(y, 0.7, 0.3)]).astype(float)
    votes[:, 2] = np.where(rng.random(300) < 0.6, votes[:, 0], votes[:, 2])
    gold = np.where(rng.random(300) < 0.9, y, ~y).astype(int)
    parent = np.array([-1, -1, 0])
    monkeypatch.setattr(toxicity, "dependencies", lambda *_: parent)
    got = toxicity.label_model(votes, gold, np.ones(300), rounds=8)
    post, up = [toxicity.TRUST if g else 1 - toxicity.TRUST for g in gold], [-1, -1, -1]
    for turn in range(8):
        up = parent.tolist() if turn >= 1 else up
        odds = [0.0] * 300
        for sign, w in ((1, post), (-1, [1 - p for p in post])):
            mass = sum(w)
            right = min(max((sum(x for x, g in zip(w, gold, strict=True) if g) + 1) / (mass + 2), 0.005), 0.995)
            for r in range(300):
                odds[r] += sign * (np.log(max(mass / 300, 1e-9)) + np.log(right if gold[r] else 1 - right))
            for j in range(3):
                plain = (sum(w[r] for r in range(300) if votes[r, j]) + 0.5) / (mass + 1)
                rates = {}
                for on in (0, 1):
                    rows = [r for r in range(300) if (up[j] >= 0 and votes[r, up[j]] > 0) == bool(on)]
                    rates[on] = (sum(w[r] for r in rows if votes[r, j]) + 2 * plain) / (sum(w[r] for r in rows) + 2)
                for r in range(300):
                    rate = rates[int(up[j] >= 0 and votes[r, up[j]] > 0)]
                    odds[r] += sign * np.log(rate if votes[r, j] else 1 - rate)
        post = [1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in odds]
    assert np.allclose(got, post, atol=1e-6)
    assert ((got > 0.5) == y).mean() > 0.85


def test_dependent_voters_are_found():
    rng = np.random.default_rng(1)
    y = rng.random(3000) < 0.3
    one = rng.random(3000) < np.where(y, 0.7, 0.2)
    votes = np.column_stack([one, rng.random(3000) < np.where(y, 0.6, 0.1), one ^ (rng.random(3000) < 0.05)]).astype(float)
    parent = toxicity.dependencies(votes, y.astype(float), np.ones(3000))
    assert sorted(parent.tolist()) == [-1, -1, max(parent)] and {int(parent.argmax()), int(parent.max())} == {0, 2}


def test_patterns_need_no_labels():
    texts = ["You IDIOT and moron", "a a b b c c", "WHY ARE YOU SHOUTING", "no! no! no!", "", "nothing here at all"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    got = toxicity.patterns(raw, np.cumsum([0] + [len(t) for t in texts]))
    assert got.astype(int).tolist() == [[1, 1, 1, 0, 0], [0, 0, 0, 0, 1], [0, 0, 1, 0, 0], [0, 0, 0, 1, 1], [0, 0, 0, 0, 0], [0, 0, 0, 0, 0]]


def test_samples_are_never_empty(spark):
    from tesserakt.llm.common import portion

    rows = spark.range(2000)
    assert 700 < rows.filter(portion("id", 1000, 2000)).count() < 1300 and rows.filter(portion("id", 5, 2)).count() == 2000
    assert str(portion("id", 20_000, 10**13)).count("< 0") == 0


def test_label_model_separates_and_discounts_copies():
    rng = np.random.default_rng(2)
    y = rng.random(2000) < 0.3
    fire = lambda a, b: np.where(y, rng.random(2000) < a, rng.random(2000) < b).astype(float)
    one = fire(0.8, 0.1)
    votes = np.column_stack([one, one, one, fire(0.7, 0.05), fire(0.6, 0.1)])
    posterior = toxicity.label_model(votes, y.astype(int), np.ones(2000))
    assert ((posterior > 0.5) == y).mean() > 0.95


def test_columns_of_the_users_keep_their_names(spark):
    rows = [(1, "one two three four five six mail a@b.org"), (2, "one two three four five six mail a@b.org"), (3, None), (3, "x y"), (3, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("_gone", "_again", "_rows", "_cands", "_CANDS_"):
        docs = docs.withColumn(name, F.lit(7))
    left = minhash.keep_one(docs, k=2)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 3, 3]
    done = pii.redact(docs)
    assert done.columns == docs.columns and {r["_cands"] for r in done.collect()} == {7} and done.filter("text LIKE '%EMAIL%'").count() == 2


def test_near_duplicates_shuffle_no_texts(spark, monkeypatch):
    plans, materialise = {}, minhash.materialise

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return materialise(df, name)

    monkeypatch.setattr(minhash, "materialise", seen)
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    docs = spark.createDataFrame([(i, texts[i % 20]) for i in range(30)] + [(50, texts[3] + " more"), (None, texts[3])], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect() if r["doc_id"] is not None}
    assert found == {i: i % 20 for i in range(30)} | {50: 3}
    assert "Exchange" not in plans["sets"]


def test_near_duplicates_shuffle_bands_of_copies_only(spark, monkeypatch):
    rows, materialise = {}, minhash.materialise

    def seen(df, name):
        out = materialise(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(minhash, "materialise", seen)
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(300)]
    docs = spark.createDataFrame([(i, texts[i % 290]) for i in range(300)] + [(500, texts[20] + " more")], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert found == {i: i % 290 for i in range(300)} | {500: 20}
    assert 10 <= rows["representatives"] < 30 and rows["pairs"] == 1


def test_filter_of_keys(spark):
    keys = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("h"))
    left = {r["id"] for r in spark.range(3000).filter(sketches.among(keys, 24)(F.xxhash64("id"))).collect()}
    assert left >= set(range(0, 3000, 3)) and len(left) < 1100
    assert spark.range(100).filter(sketches.among(keys.limit(0), 24)(F.xxhash64("id"))).count() == 0


def test_signatures_hold_little_memory():
    elements = np.unique(np.random.default_rng(1).integers(0, 2**63, 60_000).astype(np.uint64))
    offs = np.arange(0, len(elements) + 1, 600)
    minhash.super_minhash(elements[:600], offs[:2], 320)
    tracemalloc.start()
    minhash.super_minhash(elements, offs, 320)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 25e6  # permutations of 40,000 elements alone are 26 MB


def test_toxic_rows_leave_a_task_in_small_batches(spark):
    class Docs:  # what reject() asks of a frame
        columns, schema = ["doc_id", "text"], None
        sparkSession = spark

        def mapInArrow(self, run, schema):
            return run

    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(6_000)), "text": ["some words " * 100] * 6_000})
    run = toxicity.reject(Docs(), (np.zeros(0, np.int64), np.zeros(0, np.float32), -40.0))
    got = list(run(iter([docs])))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([docs]))
    assert max(b.nbytes for b in got) < 2e6


class Tasks:
    """What an operator asks of a frame, so that the function that it runs in tasks can be called by itself."""

    dtypes = [("doc_id", "bigint")]

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_templates_hold_little_memory(spark):
    text = "one sample of words, with 12 metres and names like Mary in it, that goes on and on. " * 25
    rows = 1_000  # 2 MB
    texts = pa.RecordBatch.from_pydict({"t1": list(range(rows)), "t2": [0] * rows, "text": [text] * rows})
    run = decontam.hits(Tasks(spark), np.zeros((sketches.DEPTH, 1 << 13), np.uint8), 16, [(0, 8), (1, 8), (2, 8)])
    assert not list(run(iter([texts.slice(0, 10)])))
    tracemalloc.start()
    assert not list(run(iter([texts])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30e6  # a quarter of a MB at once; 1 MB at once takes twice as much as that


def test_token_ids_leave_a_task_in_small_batches_and_its_memory_is_bounded(spark, monkeypatch):
    path, pattern = queries.vocabulary()
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(3_000)), "text": [None, "", *(f"word{i} and {i * 7919} more, " * 40 for i in range(2_998))]})
    got = list(bpe.encode_documents(Tasks(spark), path, pattern)(iter([docs])))
    assert len(got) > 1 and max(b.num_rows for b in got) < 2_000
    got = pa.Table.from_batches(got).to_pydict()
    assert got["doc_id"] == docs.column(0).to_pylist()
    assert got["ids"] == [bpe.encode_text(t, path, pattern) for t in docs.column(1).to_pylist()]
    monkeypatch.setattr(bpe, "IDLE_ENTRIES", 10)
    list(bpe.encode_documents(Tasks(spark), path, pattern)(iter([docs.slice(0, 100)])))
    pieces = bpe._encoder(path, pattern)[0]
    assert len(pieces) <= 10 and len(pieces.bpe.pairs) <= 10


def test_counts_of_long_lists_hold_little_memory(spark):
    class Keys(Tasks):
        def mapInArrow(self, run, schema):
            tracemalloc.start()
            self.cells = list(run(iter([keys])))
            self.most = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            return self

        def repartition(self, *how):
            return spark.createDataFrame([(i, bytes(c)) for b in self.cells for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], "part int, cells binary")

    h = np.arange(1_000_000, dtype=np.int64) % 300_007
    keys = pa.RecordBatch.from_pydict({"h": [h]})
    counts = sketches.frequencies(frame := Keys(spark), 22)
    assert frame.most < 50e6  # all keys at once take more
    exact = np.bincount(h)
    most = sketches.at_most(counts, np.arange(300_007), 22)
    assert (most >= exact).all() and (most == exact).mean() > 0.99
