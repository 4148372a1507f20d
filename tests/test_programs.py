"""Patches, answers, claims, pairs and samples against plain code."""

import itertools
import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserakt.functions import propositions, symbolic
from tesserakt.operators import inspiration, pairs, patches

# Patches


def plain_regions(text):
    """(start, end) by character scan: a mark opens behind its word and closes before its sign and blanks."""
    opened, out = [], []
    for i in range(len(text)):
        if text.startswith("EVOLVE-BLOCK-START", i):
            opened.append(i + len("EVOLVE-BLOCK-START"))
        if text.startswith("EVOLVE-BLOCK-END", i) and opened:
            j = i
            while j and text[j - 1].isspace():
                j -= 1
            k = next((len(c) for c in ("//", "#") if text[:j].endswith(c)), 0)
            out.append((opened.pop(), j - k))
    return out


def plain_apply(program, blocks):
    """Line by line: blocks are (search lines, replace lines)."""
    text, n = "\n".join(x.rstrip() for x in program.splitlines()), 0
    start = text
    for search, replace in blocks:
        s, r = "\n".join(search), "\n".join(replace)
        spans = plain_regions(text)
        if not s.strip():
            if not spans:
                return start, 0, patches.NO_REGION
            at = spans[-1][1]
            text, n = text[:at] + r + text[at:], n + 1
            continue
        found = None
        if s in text:
            found = (text.index(s), s, r)
        else:
            for line in text.split("\n"):
                if line.strip() and line.strip() == search[0].strip():
                    pad = line[: len(line) - len(line.lstrip())]
                    move = lambda x, pad=pad: pad + " " * (len(x) - len(x.lstrip())) + x.strip() if x.strip() else ""
                    t = "\n".join([pad + search[0].strip(), *map(move, search[1:])])
                    if t in text:
                        found = (text.index(t), t, "\n".join(map(move, replace)) if r.strip() else r)
                        break
        if not found:
            return start, 0, patches.NOT_FOUND
        at, t, r = found
        if not any(a <= at and at + len(t) <= b for a, b in spans):
            return start, 0, patches.OUTSIDE
        text, n = text[:at] + r + text[at + len(t) :], n + 1
    return text, n, None


def bare(lines):
    """Lines without blank ones at either end."""
    while lines and not lines[0].strip():
        lines = lines[1:]
    while lines and not lines[-1].strip():
        lines = lines[:-1]
    return lines


def random_edit(rng):
    words = ["a = 1", "b = 2", "for x in y:", "    c(x)", "", "  d", "return z"]
    lines = [rng.choice(words) for _ in range(rng.randrange(1, 9))]
    cut = sorted(rng.randrange(len(lines) + 1) for _ in range(2))
    pad = rng.choice(["", "    ", "\t"])
    sign = rng.choice(["# ", "// ", "", "#"])
    body = [*lines[: cut[0]], *([sign + "EVOLVE-BLOCK-START"] if rng.random() < 0.9 else []), *(pad + x for x in lines[cut[0] : cut[1]]), *([sign + "EVOLVE-BLOCK-END"] if rng.random() < 0.95 else []), *lines[cut[1] :]]
    blocks, many = [], rng.randrange(0, 4)
    for k in range(many):  # the form takes blank lines at the edges of a part for space around it, and a blank search for one only in the last block
        i = rng.randrange(len(lines))
        search = bare(lines[i : i + rng.randrange(1, 4)]) if rng.random() < 0.8 else []
        search = search or [rng.choice(["", "nowhere"]) if k == many - 1 else "nowhere"]
        blocks.append((search, bare([rng.choice([*words, "new"]) for _ in range(rng.randrange(1, 4))]) or ["new"]))
    patch = "".join("<<<<<<< SEARCH\n" + "\n".join(s) + "\n=======\n" + "\n".join(r) + "\n>>>>>>> REPLACE\n" for s, r in blocks)
    return "\n".join(body), patch, blocks


def test_random_edits(spark):
    rng = random.Random(5)
    edits = [random_edit(rng) for _ in range(1500)]
    programs = spark.createDataFrame([(i, e[0], "python") for i, e in enumerate(edits)], "program_id int, text string, language string")
    made = spark.createDataFrame([(i, i, "diff", e[1]) for i, e in enumerate(edits)], "patch_id int, program_id int, kind string, patch string")
    got = {r["patch_id"]: (r["text"], r["applied"], r["reason"]) for r in patches.children(programs, made).collect()}
    reasons = Counter()
    for i, (program, _, blocks) in enumerate(edits):
        want = plain_apply(program, blocks)
        assert got[i] == want, (program, blocks)
        reasons[want[2]] += want[1] > 0 or want[2] is not None
    assert all(reasons[x] > 5 for x in (None, patches.NOT_FOUND, patches.OUTSIDE, patches.NO_REGION))


PROGRAM = "import x\n# EVOLVE-BLOCK-START\na = 1\n# EVOLVE-BLOCK-END\nrun()\n"
TWO = PROGRAM + PROGRAM


@pytest.mark.parametrize(
    ("program", "code", "want"),
    [
        (PROGRAM, "b = 2", PROGRAM.replace("a = 1", "b = 2")),
        (PROGRAM, "import x\nb = 2\nrun()", "import x\n# EVOLVE-BLOCK-START\n\n# EVOLVE-BLOCK-END\nrun()\n".replace("START\n\n", "START\nb = 2\n")),
        (PROGRAM, PROGRAM.replace("a = 1", "b = 2").replace("import x", "import y"), PROGRAM.replace("a = 1", "b = 2")),
        (PROGRAM, "# EVOLVE-BLOCK-START\nb = 2\nrun()", PROGRAM.replace("a = 1", "b = 2\n").replace("2\n\n", "2\n")),
        (PROGRAM, "import x\nb = 2\n# EVOLVE-BLOCK-END", PROGRAM.replace("a = 1", "b = 2")),
        (TWO, TWO.replace("a = 1", "c"), TWO.replace("a = 1", "c")),
        (TWO, PROGRAM.replace("a = 1", "c"), PROGRAM.replace("a = 1", "c") + PROGRAM),
        (TWO, "b = 2", patches.UNCLEAR),
        ("a = 1", "b = 2", patches.NO_REGION),
    ],
)
def test_whole_rewrites(spark, program, code, want):
    row = spark.createDataFrame([("full", program, f"so:\n```py\n{code}\n```", "python")], "k string, p string, c string, l string")
    got = row.select(patches.child(F.col("k"), F.col("p"), F.col("c"), F.col("l")).alias("r")).first()["r"]
    assert (got["reason"] or got["text"]) == want and got["applied"] == (want not in (patches.UNCLEAR, patches.NO_REGION))


def test_odd_patches(spark):
    rows = spark.createDataFrame([("diff", None, "x", "python"), ("diff", PROGRAM, None, "python"), ("full", PROGRAM, "no code", "python"), ("diff", PROGRAM, "", "python")], "k string, p string, c string, l string")
    got = [tuple(r["r"]) for r in rows.select(patches.child(*map(F.col, "kpcl")).alias("r")).collect()]
    assert got == [(None, 0, None), (PROGRAM, 0, None), (PROGRAM, 0, patches.NO_CODE), (PROGRAM.rstrip("\n"), 0, None)]
    assert rows.select(patches.redacted(F.col("p"))).collect()[1][0] == patches.GAP + "\na = 1\n" + patches.TAIL
    loose = rows.limit(1).select(patches.child(F.lit("diff"), F.lit(PROGRAM), F.lit("<<<<<<< SEARCH\nno\n=======\nx\n>>>>>>> REPLACE\n<<<<<<< SEARCH\na = 1\n=======\nb\n>>>>>>> REPLACE"), F.lit("python"), strict=False).alias("r")).first()["r"]
    assert loose["applied"] == 1 and "\nb\n" in loose["text"]


def test_marks_are_those_of_their_pattern():
    pattern, rng = re.compile(r"(?:#|//|)?\s*EVOLVE-BLOCK-(START|END)"), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["#", "/", "//", " ", "\n", "x", "EVOLVE-BLOCK-START", "EVOLVE-BLOCK-END"]) for _ in range(rng.randint(0, 9)))
        assert patches.marks(text) == [(m.start(), m.end(), m[1]) for m in pattern.finditer(text)]


def test_diff_summary(spark):
    diff = "--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,4 @@\n a\n-b\n-c\n+d\n+e\n+f\n g\n@@ -9 +9 @@\n-h\n--- a/y\n+++ b/y\n@@ -1 +1 @@\n+n\n"
    got = spark.range(1).select(patches.diff_summary(F.lit(diff)).alias("s")).first()["s"]
    assert [tuple(x) for x in got] == [("x.py", 1, 1, 2), ("y", 1, 0, 0)]


# Answers


def random_tree(rng, depth):
    if not depth or rng.random() < 0.2:
        return ("n", rng.randrange(1, 9)) if rng.random() < 0.5 else ("v", rng.choice("xyk"))
    return (rng.choice("+-*/^"), random_tree(rng, depth - 1), random_tree(rng, depth - 1))


def plain_value(tree, point):
    kind, *of = tree
    if kind == "n":
        return complex(of[0])
    if kind == "v":
        return point[of[0]]
    a, b = plain_value(of[0], point), (plain_value(of[1], point) if kind != "^" else 2)
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "^": lambda: a**2}[kind]()


def written(tree, rng):
    """One of several spellings of a tree."""
    kind, *of = tree
    if kind in "nv":
        return str(of[0]) if kind == "v" or rng.random() < 0.7 else f"\\frac{{{2 * of[0]}}}2"
    a, b = (written(x, rng) for x in of)
    if kind == "+" and rng.random() < 0.5:
        a, b = b, a
    if kind == "^":
        return rng.choice([f"({a})^2", f"\\left({a}\\right)^{{2}}", f"({a})**2", f"({a})({a})"])
    return {"+": f"({a}+{b})", "-": f"({a} - {b})", "*": rng.choice([f"({a})({b})", f"({a})*({b})", f"({a}) \\cdot ({b})"]), "/": rng.choice([f"\\frac{{{a}}}{{{b}}}", f"(({a})/({b}))"])}[kind]


def test_five_hundred_pairs(spark):
    rng, rows = random.Random(3), []
    points = [{v: complex(rng.uniform(-2, 2), rng.uniform(-2, 2)) for v in "xyk"} for _ in range(6)]
    while len(rows) < 500:
        a = random_tree(rng, 3)
        b = a if len(rows) % 2 else random_tree(rng, 3)
        try:
            want = all(abs(plain_value(a, p) - plain_value(b, p)) <= 1e-9 * max(1, abs(plain_value(a, p))) for p in points)
            free = any(isinstance(x, str) and x in "xyk" for x in json.dumps([a, b]).replace('"', " ").split())
            if not want and not free:  # numbers may be a hundredfold or within the tolerance
                continue
            rows.append((written(a, rng), written(b, rng), want))
        except ZeroDivisionError:
            continue
    table = spark.createDataFrame(rows, "a string, b string, want boolean")
    wrong = table.filter(symbolic.answers_equal(F.col("a"), F.col("b")) != F.col("want")).collect()
    assert not wrong, wrong[:5]
    assert sum(r[2] for r in rows) >= 230


SAME = [("\\frac{1}{2}", "1/2"), ("0.5", "\\frac12"), ("2\\sqrt{2}", "\\sqrt8"), ("7 3/4", "31/4"), ("3\\frac{1}{2}", "7/2"), ("(1,2)", "(1, 4/2)"), ("[1,2)", "Interval.Ropen(1,2)"), ("50%", "0.5"), ("2\\pi", "6.2832"), ("\\sin^2 x+\\cos^2 x", "1"), ("e^{i\\pi}", "-1"), ("1,000", "1000"), ("\\sqrt[3]{27}", "3"), ("|-3|", "3"), ("5 cm", "5"), ("\\text{East}", "east"), ("$12", "12"), ("3 million", "3000000"), ("\\begin{pmatrix}1 & 2\\\\3&4\\end{pmatrix}", "[[1,2],[3,8/2]]"), ("x_1+x_2", "x_2+x_1"), ("45^\\circ", "45")]
OTHER = [("x", "y"), ("\\sqrt{x^2}", "x"), ("(1,2)", "(2,1)"), ("[1,2)", "(1,2)"), ("x+1", "x"), ("1/3", "0.3"), ("", "1"), ("foo bar", "1"), ("((((", "1"), ("1/0", "1/0+1"), ("(" * 3000 + "1", "1"), ("x" * 5000, "y"), (None, "1"), ("1", None), ("x^{x^{99999999999}}", "1"), ("9^9^9^9^9", "8^9^9^9^9")]


def test_known_answers(spark):
    table = spark.createDataFrame([(*p, True) for p in SAME] + [(*p, False) for p in OTHER], "a string, b string, want boolean")
    assert table.filter(symbolic.answers_equal(F.col("a"), F.col("b")) != F.col("want")).collect() == []


# Claims


def plain_truth(s, t):
    k = s[0]
    if k in ("telling-truth", "lying"):
        return t[s[1]] == (k == "telling-truth")
    v = [plain_truth(x, t) for x in s[1:]]
    return {"not": lambda: not v[0], "and": lambda: all(v), "or": lambda: any(v), "->": lambda: not v[0] or v[1], "<=>": lambda: v[0] == v[1]}[k]()


def random_statement(rng, n, depth):
    if not depth or rng.random() < 0.3:
        return [rng.choice(["telling-truth", "lying"]), rng.randrange(n)]
    k = rng.choice(["not", "and", "or", "->", "<=>"])
    return [k, *(random_statement(rng, n, depth - 1) for _ in range({"not": 1, "->": 2, "<=>": 2}.get(k, rng.randrange(1, 4))))]


def test_puzzles(spark):
    rng, rows = random.Random(9), []
    for i in range(150):
        n = rng.randrange(1, 6)
        said = [random_statement(rng, n, 3) for _ in range(n)]
        roles = [rng.choice([True, False, None]) for _ in range(n)]
        holds = [t for t in itertools.product([True, False], repeat=n) if all(plain_truth(s, t) == t[p] for p, s in enumerate(said))]
        can = all(any(plain_truth(said[p], t) == r for t in itertools.product([True, False], repeat=n) if all(q is None or q == u for q, u in zip(roles, t, strict=True))) for p, r in enumerate(roles) if r is not None)
        text = json.dumps(said) if i % 2 else str(tuple(said)).replace("[", "(").replace("]", ")")
        rows.append((text, roles, len(holds), can))
    rows.append((None, None, None, None))
    table = spark.createDataFrame(rows, "s string, r array<boolean>, n long, can boolean")
    got = table.select("n", "can", "s", propositions.solutions(F.col("s")).alias("x"), propositions.consistent(F.col("s"), F.col("r")).alias("c")).collect()
    for r in got:
        assert (r["x"]["n"], r["c"]) == (r["n"], r["can"])
        if r["n"]:
            said = propositions._statements(r["s"])
            assert all(plain_truth(s, r["x"]["first"]) == r["x"]["first"][p] for p, s in enumerate(said))


# Pairs


NODES = [("p", i, i, float(i % 3 == 0), [float(b) for b in (i & 1, i >> 1 & 1, i >> 2 & 1)]) for i in range(7)] + [("alone", 9, 9, 1.0, [1.0, 1.0, 1.0])] + [("twins", i, i, 0.0, [1.0, 0.0, 0.0]) for i in (20, 21, 22)]


def plain_lead(a, b):
    run = 0
    for x, y in zip(a[4], b[4], strict=True):
        if x < 0.5 and y < 0.5:
            break
        run += 1
    return 0.7 * max(a[3], b[3]) + 0.3 * run / 3


def test_drawn_pairs_follow_their_chances(spark):
    nodes = spark.createDataFrame(NODES, "pool string, node long, place long, value double, cover array<double>")
    draws, t = 4000, 0.3
    got = Counter((r["pool"], r["a"], r["b"]) for r in pairs.drawn_pairs(nodes, pairs.leading, t, draws, seed=2).collect())
    for pool in ("p", "twins"):
        own = [n for n in NODES if n[0] == pool]
        weight = {(a[1], b[1]): math.exp(plain_lead(a, b) / t) for a, b in itertools.combinations(own, 2)}
        total = sum(weight.values())
        assert sum(n for k, n in got.items() if k[0] == pool) == draws
        for (a, b), w in weight.items():
            p = w / total
            assert abs(got[pool, a, b] - draws * p) < 5 * math.sqrt(draws * p * (1 - p)) + 1
    best = {r["pool"]: (r["a"], r["b"]) for r in pairs.drawn_pairs(nodes, pairs.leading, 0.0).collect()}
    own = [n for n in NODES if n[0] == "p"]
    assert best == {"p": max(((a[1], b[1]) for a, b in itertools.combinations(own, 2)), key=lambda k: (round(plain_lead(NODES[k[0]], NODES[k[1]]), 9), -k[0], -k[1])), "twins": (20, 21)}


# Samples


def test_draws_follow_weights_and_leave_out_what_is_taken(spark):
    programs = spark.createDataFrame([(i, "a" if i < 6 else "b", float(i), True, i % 3, i) for i in range(12)] + [(99, "a", 50.0, False, 0, 1)], "program int, island string, score double, correct boolean, children int, generation int")
    archive = programs.select("program")
    requests = spark.range(3000).select(F.col("id").alias("request"))
    asked = inspiration.islands(requests, programs, "counts")
    shares = {r["island"]: r["n"] for r in asked.groupBy("island").agg(F.count("*").alias("n")).collect()}
    assert abs(shares["a"] - 3000 * 7 / 13) < 5 * math.sqrt(750) and shares["a"] + shares["b"] == 3000
    from tesserakt.operators.ranking import parent_weights

    weights = {r["program"]: r["weight"] for r in parent_weights(programs.filter("correct"), "score", "children", ["island"]).collect()}
    chosen = inspiration.parents(asked, programs, archive)
    got = Counter(r["parent"] for r in chosen.collect())
    for p, w in weights.items():
        n = shares["a" if p < 6 else "b"]
        assert abs(got[p] - n * w) < 5 * math.sqrt(n * w * (1 - w)) + 1 and got[99] == 0
    few = chosen.filter("request < 40")
    taken = inspiration.archive_inspirations(few, programs, archive, 5, 0.0)
    rows = taken.join(few, "request").collect()
    of = {}
    for r in rows:
        of.setdefault(r["request"], []).append(r)
    for own in of.values():
        ids = [r["program"] for r in own]
        assert len(ids) == len(set(ids)) == 5 and own[0]["parent"] not in ids and 99 not in ids and sorted(r["place"] for r in own) == list(range(5))
        assert {r["step"] for r in own} <= {"best", "island"} or sum(r["step"] == "island" for r in own) >= 4
    top = inspiration.top_inspirations(few, taken, programs, archive, 2, 5).collect()
    for r in few.collect():
        left = sorted(set(range(12)) - {r["parent"]} - {x["program"] for x in of[r["request"]]}, reverse=True)[:2]
        assert [x["program"] for x in sorted((t for t in top if t["request"] == r["request"]), key=lambda x: x["turn"])] == left
    apart = inspiration.archive_inspirations(few, programs, archive, 9, 0.2, apart=True)
    assert apart.join(few.select("request", "island"), "request").join(programs.select("program", F.col("island").alias("home")), "program").filter("home <> island").count() == 0
    assert {r["parent"] for r in inspiration.repairs(requests.limit(5), programs).collect()} == {99}
