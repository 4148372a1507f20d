"""Mixing, source audit and spelling variants against plain code, on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserakt.llm import divergence, mixture, sketches, spelling

SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    out = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "s", "key", "size", "n", "h", "word", "term", "part", "total", "g", "p", "rank", "taken", "limit", "shard"):
        out = out.withColumn(name, F.lit("x"))
    return out


def filled(totals, weights, share, epochs):
    """Targets by pouring until nothing is above its cap."""
    full, wanted = set(), share * sum(totals)
    while True:
        free = sum(w for i, w in enumerate(weights) if i not in full)  # none if more is wanted than all may give
        rest = wanted - sum(epochs * totals[i] for i in full)
        if not free:
            return [epochs * t for t in totals]
        over = {i for i, w in enumerate(weights) if i not in full and w * rest > epochs * totals[i] * free}
        if not over:
            return [epochs * t if i in full else Fraction(weights[i]) * rest / free for i, t in enumerate(totals)]
        full |= over


def plain_mix(rows, weights=(5, 2, 1), share=Fraction(3, 2), epochs=Fraction(2), seed=7):
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _, s in rows]
    names = sorted({s for _, s, _ in sized if s is not None}) + ([None] if any(s is None for _, s, _ in sized) else [])
    totals = [sum(n for _, s, n in sized if s == name) for name in names]
    targets = filled(totals, [weights[k % len(weights)] for k in range(len(names))], share, epochs)
    out = []
    for name, total, target in zip(names, totals, targets, strict=True):
        whole = int(target // total) if total else 0
        rest = int(float(target) + 0.5) - whole * total
        own = Counter((int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:15], 16), i is not None, i or 0, n) for i, s, n in sized if s == name)
        for (_, known, i, n), m in sorted(own.items()):
            each = n if rest >= m * n else rest // m
            rest -= min(rest, m * n)
            out += [(i if known else None, n, total, float(target), whole * n + each)] * m
    return out


def mixed_rows(k=400):
    rng = np.random.default_rng(4)
    rows = [(int(i), " ".join(["w"] * int(rng.integers(0, 30))), "en", f"s{int(rng.integers(0, 3)) if rng.random() < 0.6 else 9}") for i in range(k)]
    rows += [(5, " a\tb\x0bc d ", "en", "s0")] * 3 + [(k, None, None, None), (k + 1, "x " * 50, None, None), (None, "p q", "de", "Ä"), (k + 2, "", "de", ""), (k + 3, "long " * 30_000, "fr", "\U0001f600"), (k + 4, "one", "fr", "￮")]
    return rows


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("kind", [{}, {"share": Fraction(1, 10)}, {"weights": (1, 9), "share": Fraction(5, 2), "epochs": Fraction(3), "seed": 3}, {"share": Fraction(2)}, {"share": Fraction(9)}])
def test_mix(spark, kind, monkeypatch):
    monkeypatch.setattr(mixture, "ORDERED", 3)
    monkeypatch.setattr(mixture, "PASS_BITS", 4)
    rows = mixed_rows()
    got = [tuple(r) for r in mixture.mix(frame(spark, rows), **kind).collect()]
    assert order(got) == order(plain_mix(rows, **kind))
    epochs = kind.get("epochs", 2)
    assert all(t <= epochs * n for _, n, _, _, t in got)
    again = [tuple(r) for r in mixture.mix(frame(spark, rows[::-1]).repartition(5), **kind).collect()]
    assert order(again) == order(got)


def test_mix_of_nothing(spark):
    assert mixture.mix(frame(spark, [])).count() == 0 and mixture.draw(frame(spark, [])).count() == 0
    assert [tuple(r) for r in mixture.mix(frame(spark, [(1, None, None, None), (1, "", None, "a")])).collect()] == [(1, 0, 0, 0.0, 0)] * 2


def test_drawn_words_are_those_taken(spark):
    rows = mixed_rows(120)
    taken, drawn = Counter(), Counter()
    for r in mixture.mix(frame(spark, rows)).collect():
        taken[r["doc_id"]] += r["taken"]
    for r in mixture.draw(frame(spark, rows)).collect():
        drawn[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert {k: v for k, v in taken.items() if v} == dict(drawn)


def plain_audit(rows, least, top):
    term = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    docs = [(lang or "", source or "", Counter(term(text))) for _, text, lang, source in rows]
    out = []
    for lang in {x for x, _, _ in docs}:
        df, by = Counter(), defaultdict(Counter)
        for x, s, c in docs:
            if x == lang:
                df.update(c.keys())
                by[s].update(c)
        kept = [t for t, n in df.items() if n >= least]
        v, every = len(kept), sum(by.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * v) for t in kept}
        p, q = {s: share(c) for s, c in by.items()}, share(every)
        for s in by:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in by if o != s)
            more = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if by[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, o, -n, k) for part, found in (("pair", pair), ("term", more)) for k, (n, _, o) in enumerate(found, 1)]
    return out


def audit_rows():
    rng = np.random.default_rng(8)
    names = ["the", "Of", "über", "ÄB", "naïve", "x1y", "日本", "rare"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = [(i, " ".join(rng.choice(names[: 5 + i % 30], int(rng.integers(0, 40)))), "en" if i % 3 else None, f"s{i % 7}" if i % 11 else None) for i in range(300)]
    return rows + [(1, "only here", "xx", "a"), (2, None, "xx", "b"), (3, "", "zz", "a"), (4, "The THE " * 5000, "en", "long"), (4, "The THE " * 5000, "en", "long"), (None, "x" * 50_000, "en", "long")]


@pytest.mark.parametrize("small", [False, True])
def test_audit(spark, small, monkeypatch):
    if small:  # portions, pieces, blocks of sources and a sketch of few cells
        for name, value in (("HELD", 10), ("PIECE", 20), ("BLOCK", 3), ("LEAST_BITS", 3), ("MOST_BITS", 3)):
            monkeypatch.setattr(divergence, name, value)
    rows = audit_rows()
    got = [tuple(r) for r in divergence.audit(frame(spark, rows).repartition(4), least=12, top=5).collect()]
    assert order(got) == order(plain_audit(rows, 12, 5))


def test_counts_leave_a_task_many_terms_in_a_row(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PACK", 8)
    rows = audit_rows()
    docs = frame(spark, rows).selectExpr("coalesce(lang, '') lang", "coalesce(source, '') source", "coalesce(text, '') text").coalesce(1)
    partial = divergence.partial_counts(docs)
    terms = divergence.possible(partial, np.full((3, 1 << 13), 255, np.uint8), 16).collect()
    assert partial.count() < len(terms) / 3
    n, n_docs = Counter(), Counter()
    for t in terms:
        n[t["lang"], t["source"], bytes(t["term"]).decode()] += t["n"]
        n_docs[t["lang"], bytes(t["term"]).decode()] += t["n_docs"]
    want_n, want_docs = Counter(), Counter()
    for r in docs.collect():
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in r["text"]))
        want_n.update((r["lang"], r["source"], t) for t in found)
        want_docs.update((r["lang"], t) for t in set(found))
    assert n == want_n and n_docs == want_docs


def test_audit_of_nothing(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
    got = divergence.audit(frame(spark, [(1, None, None, "a"), (2, "a b", None, "b")])).collect()
    assert order(tuple(r) for r in got) == [("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)]


def test_sketch_never_underestimates(spark):
    rng = np.random.default_rng(3)
    h, n = rng.integers(-(2**63), 2**63 - 1, 3000), rng.integers(1, 9, 3000)
    h = np.concatenate((h, h[:1500]))
    n = np.concatenate((n, n[1500:]))
    total = defaultdict(int)
    for a, b in zip(h.tolist(), n.tolist(), strict=True):
        total[a] += b
    table = spark.createDataFrame(list(zip(h.tolist(), n.tolist(), strict=True)), "h long, n long").repartition(5)
    keys = np.array(list(total))
    said = sketches.has(sketches.sketch(table, 10, 12), keys, 12)
    true = np.array([total[k] >= 10 for k in keys.tolist()])
    assert said[true].all() and said[~true].mean() < 0.5


def plain_words(rows, least_length=7, least_n=2, every=31):
    found = Counter()
    for i, text, _, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if n >= least_n and len(w) >= least_length}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words, factor=10):
    form, out = {}, []
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= factor * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def spelling_rows():
    rng = np.random.default_rng(6)
    base = ["abcdefgh", "Überraschung", "aaaaaaaa", "×÷×÷×÷×", "abababab", "zzabcdefgh"]
    pool = [b for b in base for _ in range(400)]
    for b in base:
        for _ in range(40):
            i, kind, c = int(rng.integers(0, len(b) + 1)), int(rng.integers(0, 3)), "abÀÿz"[int(rng.integers(0, 5))]
            v = b[:i] + (c if kind else "") + b[i + (kind != 1) :]
            pool += [v] * int(rng.integers(1, 30))
            if rng.random() < 0.5:
                j = int(rng.integers(0, len(v)))
                pool += [v[:j] + c + v[j:]] * 2
    rng.shuffle(pool)
    rows = [(i, "1".join(pool[k : k + 40]), None, None) for i, k in enumerate(range(0, len(pool), 40))]
    return rows + [(None, "NullName nullname", None, None), (7, None, None, None), (8, "", None, None), (9, "kurz a b", None, None), (10, "q" * 5000 + " " + "q" * 5000, None, None)] + rows[:3]


@pytest.mark.parametrize("small", [False, True])
def test_variants(spark, small, monkeypatch):
    if small:  # portions, pieces, parts of crowded halves
        for name, value in (("HELD", 5), ("PIECE", 30), ("HALF_WORDS", 4), ("SHARD_ROWS", 50)):
            monkeypatch.setattr(spelling, name, value)
    rows = spelling_rows()
    words = plain_words(rows)
    got = [tuple(r) for r in spelling.variants(frame(spark, rows).repartition(3)).collect()]
    assert len(words) > 150 and order(got) == order(plain_variants(words))
    assert any(r[1] and r[1] != r[2] for r in got)  # some forms have forms


def test_variants_of_nothing(spark):
    assert spelling.variants(frame(spark, [])).count() == 0 and spelling.variants(frame(spark, [(1, None, None, None)])).count() == 0
