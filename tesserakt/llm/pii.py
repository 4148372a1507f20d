"""Personal data by weak supervision, in DataFrame functions only.

Base spans (email, ip, card, phone) are what the patterns below match and the
checks let pass; they always stay. Further candidates are what the patterns
match but the checks reject, and long strings of letters and digits that look like
access keys (secret). On every candidate four labelers vote (+1, -1 or not at all):
shape, gazetteer (mail endings, dial codes, issuers, key prefixes and lengths),
context, and the characters around it. Expectation-maximisation over the counts of
all vote patterns of the corpus estimates the labelers' reliabilities; its posteriors
train a logistic span classifier over the votes and over what the span itself looks
like (length, share of digits, changes between letters and digits), which decides on
the candidates that aren't base spans.

Only counts reach the driver, those of vote patterns and classes of spans: 3**4 times
LENGTHS * SHARES * CHANGES for each of 5 kinds at most.
Patterns are written so that Java's matcher neither recurses nor backtracks
over long runs; they match as the plain forms in ``PLAIN`` do.

A null text counts as empty and has no spans; offsets count code points, ends
exclusive. Repeated rows are searched each for itself; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserakt.llm.common import materialise, unused

KINDS = ("email", "ip", "card", "phone", "secret")
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,}",
}
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]{20})(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]++"
#: What lies between stretches of digits that single spaces or hyphens join.
BETWEEN_DIGITS = r"[^0-9]{2,}+|[^0-9\x20-]"
FOUND = "array<struct<start:int,end:int,text:string,before:string,after:string>>"
SPANS = "array<struct<start:int,kind:int,end:int,base:boolean,v:array<int>,f:array<int>>>"
THRESHOLD = 0.5
#: Classes of a span's length (by the power of two), of its share of digits, and of its changes between letters and digits.
LENGTHS, SHARES, CHANGES = 8, 5, 5
#: Characters before a span in which the context labeler looks for its words; items of a text that one fold takes.
CONTEXT_CHARS, FOLD = 24, 64

MAIL_DOMAINS = r"\.(com|org|net|edu|gov|io|info|eu|de|fr|es|uk|it|nl|at|ch|us|ca|au)$"
DIAL_CODES = r"^\+(1|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
CONTEXT = {
    "email": r"(mail|contact|write|reach|address|from|to|cc)\W*$",
    "ip": r"(ip|addr|address|host|server|from|client|login|peer)\W*$",
    "card": r"(card|visa|mastercard|amex|credit|debit|account|pay|iban)\W*(no|number|nr)?\W*$",
    "phone": r"(tel|phone|call|mobile|cell|fax|whatsapp|dial)\W*$",
    "secret": r"(token|key|secret|password|passwd|pwd|bearer|auth|api)\W*$",
}
KEY_FORMS = r"^(sk|pk|rk|ghp|gho|ghs|glpat|xox[abpr]|AKIA|ASIA|AIza|ya29|hf|npm|pypi|eyJ)[A-Za-z0-9_-]"
AGAINST = r"(version|release|isbn|issn|order|invoice|ref|section|chapter|commit|sha1?|md5|checksum|hash|v)\W*$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _folded(items: Column, least: int) -> Column:
    """Where a few items (gap before, text, before, after, rest) end, and their spans from 0; shorter texts are passed over."""

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["text"])
        span = F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text"), x["before"].alias("before"), x["after"].alias("after"))
        out = F.array_append(acc["out"], span)
        return F.struct((end + x["rest"]).alias("at"), (F.when(F.length(x["text"]) >= least, out).otherwise(acc["out"]) if least else out).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out"))
    return F.aggregate(items, zero, step)


def _walk(items: Column, least: int = 0) -> Column:
    """Offsets for all items: FOLD of them at a time, as an array that grows is copied at every step, then each part moved to its place."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / FOLD).cast("int")), lambda k: _folded(F.slice(items, k * FOLD + 1, FOLD), least))

    def shifted(found: Column) -> Column:
        begins = F.aggregate(found, F.array(F.lit(0)), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + p["at"]))
        moved = lambda s, by: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["text"].alias("text"), s["before"].alias("before"), s["after"].alias("after"))
        return let(begins, lambda by: F.flatten(F.transform(found, lambda p, i: F.transform(p["out"], lambda s: moved(s, F.get(by, i))))))

    return F.when(F.size(items) <= FOLD, F.get(F.array(_folded(items, least)), F.lit(0))["out"]).otherwise(let(parts, shifted))


def _matches(text: Column, pattern: str) -> Column:
    """All matches, from left to right, none overlapping, with their offsets."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def items(s: Column) -> Column:
        return F.transform(
            s["m"],
            lambda m, i: F.struct(F.length(F.get(s["p"], i)).alias("gap"), m.alias("text"), F.substring(F.get(s["p"], i), -CONTEXT_CHARS, CONTEXT_CHARS).alias("before"), F.substring(F.get(s["p"], i + 1), 1, 1).alias("after"), F.lit(0).alias("rest")),
        )

    return let(parts, lambda s: _walk(items(s)))


def _digit_groups(text: Column) -> Column:
    """Stretches of digits joined by single spaces or hyphens, of 14 characters or more."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(BETWEEN_DIGITS), F.lit(0)).alias("d"), F.split(text, BETWEEN_DIGITS, -1).alias("p"))

    def items(s: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            left = F.length(p) - F.length(F.regexp_replace(p, r"^[\x20-]", ""))
            body = F.regexp_replace(p, r"^[\x20-]|[\x20-]$", "")
            rest = F.length(p) - left - F.length(body) + F.coalesce(F.length(F.get(s["d"], i)), F.lit(0))
            before = F.when(i > 0, F.substring(F.get(s["d"], i - 1), -CONTEXT_CHARS, CONTEXT_CHARS)).otherwise(F.lit(""))
            return F.struct(left.alias("gap"), body.alias("text"), before.alias("before"), F.coalesce(F.substring(F.get(s["d"], i), 1, 1), F.lit("")).alias("after"), rest.alias("rest"))

        return F.transform(s["p"], one)

    return let(parts, lambda s: _walk(items(s), 14))


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _looks(text: Column, digits: Column) -> Column:
    """Classes of a span: of its length, its share of digits, its changes between letters and digits."""
    size = F.length(text)
    changes = F.regexp_count(text, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]"))
    return F.array(F.least(F.floor(F.log2(size)), F.lit(LENGTHS - 1)).cast("int"), F.least(F.floor(SHARES * F.length(digits) / size), F.lit(SHARES - 1)).cast("int"), F.least(F.ceil(changes / 3), F.lit(CHANGES - 1)).cast("int"))


def _labelled(found: Column, kind: str) -> Column:
    """Spans of one kind: whether a base span, and the votes of the four labelers."""

    def one(s: Column) -> Column:
        text, before = s["text"], F.lower(s["before"])
        digits = F.regexp_replace(text, "[^0-9]", "")
        if kind == "email":
            base, shape, gazetteer = F.lit(True), _vote(text.rlike(r"^[A-Za-z0-9][^@]*@.*\.[A-Za-z]{2,}$"), text.rlike(r"\.\.|^[.%+-]|[0-9]$")), _vote(F.lower(text).rlike(MAIL_DOMAINS), F.lit(False))
        elif kind == "ip":
            base = F.forall(F.split(text, r"\."), lambda x: let(F.regexp_replace(x, "^0+", ""), lambda y: (F.length(y) <= 3) & (F.coalesce(F.when(F.length(y) <= 3, y.try_cast("int")), F.lit(0)) <= 255)))
            shape, gazetteer = _vote(base & ~text.rlike(r"(^|\.)0[0-9]"), ~base), _vote(F.lit(False), text.rlike(r"^(0|127|255)\."))
        elif kind == "card":
            base = F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
            shape, gazetteer = _vote(base, ~base), _vote(digits.rlike("^(4|5[1-5]|3[47]|6011|2[2-7]|35|36|65)"), digits.rlike("^0"))
        elif kind == "phone":
            base = F.length(digits).between(10, 15)
            shape, gazetteer = _vote(base, ~base), _vote(text.rlike(DIAL_CODES), ~text.rlike(DIAL_CODES))
        else:
            share = F.length(digits) / F.length(text)
            base, shape = F.lit(False), _vote((share >= 0.15) & (share <= 0.9) & text.rlike(r"^([A-Za-z]{1,8}[_-])?[A-Za-z0-9]+$"), (share < 0.1) | text.rlike("[A-Za-z]{12}|[_-].*[_-].*[_-]"))
            gazetteer = _vote(text.rlike(KEY_FORMS) | ((F.length(text) >= 32) & (F.length(text) % 8 == 0) & text.rlike("^([0-9a-f]+|[0-9A-F]+)$")), F.lit(False))
        context = _vote(before.rlike(CONTEXT[kind]), before.rlike(AGAINST))
        edge = _vote(s["before"].rlike(r"(^|[\s\"'(<\[:=,;])$") & s["after"].rlike(r"^($|[\s\"')>\],;.!?])"), s["before"].rlike(r"[A-Za-z0-9_.]$") | s["after"].rlike(r"^[A-Za-z0-9_]"))
        return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), base.alias("base"), F.array(shape, gazetteer, context, edge).alias("v"), _looks(text, digits).alias("f"))

    return F.transform(found, one)


def candidates(text: Column) -> Column:
    """All candidates of a text in order of (start, kind). Texts without a trace of a kind are not searched for it."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(FOUND)
    found = {
        "email": F.when(F.contains(text, F.lit("@")), _matches(text, EMAIL)),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), _matches(text, IP)),
        "card": F.when(text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), _digit_groups(text)),
        "phone": F.when(F.contains(text, F.lit("+")), _matches(text, PHONE)),
        "secret": F.when(text.rlike(r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]{20})[A-Za-z_-]*+[0-9]"), _matches(text, SECRET)),
    }
    return F.sort_array(F.concat(*(_labelled(F.coalesce(found[k], none), k) for k in KINDS))).cast(SPANS)


def label_model(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50, labelers: int = 4) -> dict[tuple[int, tuple[int, ...]], float]:
    """Posterior probability that a candidate of (kind, votes) is personal data, from (kind, votes, number) by expectation-maximisation.

    Each labeler votes +1, 0 or -1 with one set of probabilities on personal data and
    another on other strings; every kind has its own share of personal data.
    """
    rate = [[{1: 0.6, 0: 0.3, -1: 0.1}, {1: 0.2, 0: 0.4, -1: 0.4}] for _ in range(labelers)]
    prior = {k: 0.5 for k in range(len(KINDS))}
    post: dict[tuple[int, tuple[int, ...]], float] = {}
    for _ in range(rounds if patterns else 0):
        for k, v, _n in patterns:
            odds = math.log(prior[k] / (1 - prior[k])) + sum(math.log(rate[j][0][x] / rate[j][1][x]) for j, x in enumerate(v))
            post[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for k in prior:
            mass = [(post[kk, v] * n, n) for kk, v, n in patterns if kk == k]
            prior[k] = (sum(m for m, _ in mass) + 1) / (sum(n for _, n in mass) + 2)
        for j in range(labelers):
            for side in (0, 1):
                mass = {x: 1.0 for x in (1, 0, -1)}
                for k, v, n in patterns:
                    mass[v[j]] += n * (post[k, v] if side == 0 else 1 - post[k, v])
                total = sum(mass.values())
                rate[j][side] = {x: m / total for x, m in mass.items()}
    return post


def fit(spans: DataFrame, column: str = "cands") -> list[list[float]]:
    """Weights of the span classifier for each kind: the votes', the classes' of length, digits and changes, and an intercept."""
    rows = spans.select(F.explode(column).alias("s")).groupBy(F.col("s.kind").alias("kind"), F.col("s.v").alias("v"), F.col("s.f").alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sorted((r["kind"], tuple(r["v"]), tuple(r["f"]), r["n"]) for r in rows)
    counts: dict[tuple[int, tuple[int, ...]], int] = {}
    for k, v, _f, n in rows:
        counts[k, v] = counts.get((k, v), 0) + n
    post = label_model([(k, v, n) for (k, v), n in counts.items()])
    weights = []
    for kind in range(len(KINDS)):
        own = [(v, f, n, post[k, v]) for k, v, f, n in rows if k == kind]
        x = np.zeros((len(own), 4 + LENGTHS + SHARES + CHANGES + 1))
        for i, (v, f, _n, _p) in enumerate(own):
            x[i, :4], x[i, -1] = v, 1
            for at, base in zip(f, (4, 4 + LENGTHS, 4 + LENGTHS + SHARES), strict=True):
                x[i, base + at] = 1
        target = np.array([p for *_, p in own])
        share = np.array([n for _, _, n, _ in own], float)
        share /= share.sum() or 1
        w = np.zeros(x.shape[1])
        w[:4] = 0.5
        for _ in range(400):
            err = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - target) * share
            g = x.T @ err + 0.02 * w
            g[-1] -= 0.02 * w[-1]
            w -= 0.8 * g
        weights.append([round(float(a), 6) for a in w])
    return weights


def kept(cands: Column, weights: list[list[float]]) -> Column:
    """Base spans, and of the other candidates those that the classifier takes for personal data."""
    table = F.array(*(F.array(*map(F.lit, w)) for w in weights))

    def keep(s: Column) -> Column:
        w = lambda j: F.get(F.get(table, s["kind"]), j if isinstance(j, Column) else F.lit(j))
        f = lambda j: F.get(s["f"], F.lit(j))
        z = w(len(weights[0]) - 1) + w(f(0) + 4) + w(f(1) + 4 + LENGTHS) + w(f(2) + 4 + LENGTHS + SHARES)
        for j in range(4):
            z = z + w(j) * F.get(s["v"], F.lit(j))
        return s["base"] | (1 / (1 + F.exp(-z)) >= THRESHOLD)

    return F.filter(cands, keep)


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, counts of base spans by kind, digest of base spans, all spans and their number."""
    found = materialise(docs.select(id_col, candidates(F.col(text_col)).alias("cands")), "spans")
    spans = kept(F.col("cands"), fit(found))
    base = F.filter("cands", lambda s: s["base"])
    number = lambda kind: F.size(F.filter("cands", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias("n_" + KINDS[kind])
    counts = [number(kind) for kind in range(4)]
    return found.select(id_col, *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows with every span replaced by its kind in brackets; of overlapping spans the first names them all."""
    cands = unused(docs, "_cands")
    found = materialise(docs.withColumn(cands, candidates(F.col(text_col))), "candidates")
    spans = kept(F.col(cands), fit(found, cands))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def replaced(text: Column, found: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            gap = F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            name = F.when(s["start"] >= acc["at"], F.get(names, s["kind"])).otherwise(F.lit(""))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.array_append(acc["out"], F.concat(gap, name)).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(found, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.length(text))))

    text = F.col(text_col)
    out = let(spans, lambda found: F.when(F.size(found) > 0, replaced(text, found)).otherwise(text))
    return found.withColumn(text_col, out).drop(cands)
