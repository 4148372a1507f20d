"""Table functions, the data source of result folders, and code metrics."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tesserakt.functions import code_metrics, propositions, symbolic, tool_calls
from tesserakt.operators import trees
from tesserakt.plans import registry
from tesserakt.sources.results import ResultFolders

TYPES = json.dumps({"f": {"a": "integer", "b": "float", "c": "boolean", "d": "object", "e": "list", "s": "string"}})
XML = "so<tool_call>\n<function=f>\n<parameter=a>\n7\n</parameter><parameter=b>2.0</parameter><parameter=c>True</parameter><parameter=d>{\"x\": 1}</parameter><parameter=e>[1, 2]</parameter><parameter=s>null</parameter><parameter=z>1</parameter></function></tool_call>"


@pytest.mark.parametrize(
    ("grammar", "text", "want"),
    [
        ("hermes", 'a<tool_call>{"name": "f", "arguments": {"x": "é"}}</tool_call>b<tool_call>[</tool_call><tool_call>{"name": 1}</tool_call>', [("ab", 0, "f", '{"x": "é"}', None), ("ab", 1, None, None, "not JSON"), ("ab", 2, None, None, "no name or no arguments")]),
        ("hermes", "a<tool_call>{}", [("a<tool_call>{}", None, None, None, None)]),
        ("hermes", "", [("", None, None, None, None)]),
        ("gpt-oss", "<|channel|>analysis<|message|>hm<|end|>x<|start|>assistant<|channel|>commentary to=functions.f <|constrain|>json<|message|>{\"a\": 1}<|call|>y", [("xy", 0, "f", '{"a": 1}', None)]),
        ("qwen3_coder", XML, [("so", 0, "f", '{"a": 7, "b": 2, "c": true, "d": {"x": 1}, "e": [1, 2], "s": null, "z": "1"}', None)]),
        ("qwen3_coder", "<tool_call><function=f><parameter=a>x\n</parameter><parameter=e>(", [("", 0, "f", '{"a": "x", "e": "("}', None)]),
        ("qwen3_coder", "a<tool_call><function=f", [("a<tool_call><function=f", 0, None, None, "function without a name")]),
        ("hermes", None, []),
    ],
)
def test_tool_calls(spark, grammar, text, want):
    row = spark.createDataFrame([(text, grammar)], "text string, grammar string")
    got = row.lateralJoin(tool_calls.tool_calls(F.col("text").outer(), F.col("grammar").outer(), F.lit(TYPES))).select("content", "place", "name", "arguments", "reason").collect()
    assert [tuple(r) for r in got] == want


RUNS = "run string, correct boolean, error string, metrics string, stdout_log string, stderr_log string"


def test_result_folders_round_trip(spark, tmp_path):
    spark.dataSource.register(ResultFolders)
    rows = [(f"r{i}", i % 2 == 0, None if i % 2 == 0 else "bad", json.dumps({"score": i}), "out\n" * i, "") for i in range(450)]
    path = str(tmp_path / "runs")
    df = spark.createDataFrame(rows, RUNS).repartition(4)
    df.write.format("results").mode("append").save(path)
    back = lambda: sorted(tuple(r) for r in spark.read.format("results").load(path).collect())
    assert back() == sorted(rows)
    df.filter("run = 'r3'").withColumn("metrics", F.lit('{"score": 99}')).write.format("results").mode("append").save(path)
    assert [r for r in back() if r[0] == "r3"] == [("r3", False, "bad", '{"score": 99}', "out\n" * 3, "")] and len(back()) == 450
    (tmp_path / "runs" / "r5" / "metrics.json").write_text("{broken")
    (tmp_path / "runs" / "r6" / "correct.json").unlink()
    (tmp_path / "runs" / "stray.txt").write_text("x")
    odd = {r[0]: r for r in back()}
    assert odd["r5"][3] == "{}" and odd["r6"][1] is False and len(odd) == 450
    df.filter("run = 'r1'").write.format("results").mode("overwrite").save(path)
    assert [r[0] for r in back()] == ["r1"]


def test_a_failed_task_leaves_no_runs(spark, tmp_path):
    spark.dataSource.register(ResultFolders)
    path = str(tmp_path / "runs")
    good = [(f"r{i}", True, None, "{}", "", "") for i in range(40)]
    spark.createDataFrame(good[:3], RUNS).write.format("results").mode("append").save(path)
    with pytest.raises(Exception, match="not a name of a run"):
        spark.createDataFrame([*good[3:], ("a/b", True, None, "{}", "", "")], RUNS).repartition(6).write.format("results").mode("append").save(path)
    with pytest.raises(Exception, match="occurs twice"):
        spark.createDataFrame([good[5], good[5]], RUNS).repartition(2).write.format("results").mode("append").save(path)
    assert sorted(r["run"] for r in spark.read.format("results").load(path).collect()) == ["r0", "r1", "r2"]
    assert sorted(x.name for x in (tmp_path / "runs").iterdir()) == ["r0", "r1", "r2"]


def plain_c(code):
    lines = [x.strip() for x in code.split("\n")]
    comment = [x.startswith(("//", "/*")) or x.endswith("*/") for x in lines]
    cc = 1 + sum(len(re.findall(p, code, re.IGNORECASE)) for p in code_metrics.DECISIONS)
    here = most = 0
    for c in code:
        here = max(0, here + (c == "{") - (c == "}"))
        most = max(most, here)
    return cc, len(lines), sum(bool(x) and not k for x, k in zip(lines, comment, strict=True)), sum(k and bool(x) for x, k in zip(lines, comment, strict=True)), most


def test_hundred_c_programs(spark):
    rng = random.Random(2)
    words = ["if (a) {", "}", "else", "for (;;) {", "// note", "/* x */", "", "  x = a ? b : c;", "IF", "switch", "case 1:", "while (1) {", "iffy", "catch"]
    codes = ["\n".join(rng.choice(words) for _ in range(rng.randrange(0, 20))) for _ in range(100)] + ["", "def broken(:"]
    table = spark.createDataFrame([(i, c, "rust" if i % 2 else "python" if i == 101 or c.startswith("if") else "cpp") for i, c in enumerate(codes)], "i int, code string, language string")
    for r in code_metrics.code_metrics(table, "code", "language").collect():
        m = r["metrics"]
        if r["language"] != "python" or code_metrics.measured(r["code"]) is None:
            assert (m["cyclomatic_complexity"], m["lines_of_code"], m["logical_lines_of_code"], m["comments"], m["max_nesting_depth"]) == plain_c(r["code"])


PYTHON = '''import os  # the system


class A:
    """A class."""

    def one(self, x):
        if x and self.y or x > 2:
            return [i for i in x if i if i > 1]
        elif x:
            return 1
        return x + 1

    def two(self):
        for i in self:
            while i:
                i -= 1
            else:
                break
        assert i


def three(a):
    def inner(b):
        return b if b else a
    try:
        with a:
            pass
    except ValueError:
        pass
    else:
        return -a
    return inner
'''


def test_python_programs(spark):
    rows = [(1, PYTHON, "python"), (2, None, "python"), (3, "", "python"), (4, "x\n\n y", "cobol"), (5, "a = b + b * 2\nc = a < b", "Python"), (6, " ", None)]
    got = {r["i"]: r["metrics"] for r in code_metrics.code_metrics(spark.createDataFrame(rows, "i int, code string, language string"), "code", "language").collect()}
    # one: 1 + if, elif + and, or + comprehension with two ifs; two: 1 + for + while with else + assert; three: 1 + handler + else; the class: (body 1 + methods 13) / 2 + 1
    one, two, three = 8, 5, 3
    cls = int((1 + one + two) / 2) + 1
    assert got[1]["cyclomatic_complexity"] == one + two + three + cls and got[1]["max_nesting_depth"] == 3 and got[1]["comments"] == 1
    assert got[2] is None and got[3]["lines_of_code"] == 0 and got[4]["lines_of_code"] == 2 and got[6]["halstead_volume"] == 1
    # b + (b * 2), a < b: operators Add, Mult, Lt; operands b, the product, b, 2, b, a, four of them distinct
    assert got[5]["halstead_volume"] == pytest.approx(9 * math.log2(7)) and got[5]["halstead_difficulty"] == pytest.approx(3 * 6 / (2 * 4)) and got[5]["lines_of_code"] == 2


def test_bandit_query_equals_a_plain_loop(spark, sf):
    import tests.test_bandits as plain

    from tesserakt.plans.programs import _pulls

    rows = [tuple(r) for r in _pulls(spark, sf).orderBy("event_id").collect()]
    want, scores = plain.plain(rows, plain.Bandit())
    got = {r["step"]: r for r in registry.QUERIES["bandit_states"](spark, sf).collect()}
    assert len(got) == len(want)
    for step, arm, n, total, weight, top, gain, *_ in want:
        r = got[step]
        assert [r["arm"], r["n"]] == [arm, n] and [r["total"], r["weight"], r["greatest"], r["gain"]] == pytest.approx([total, weight, top, gain], rel=1e-6, abs=1e-9)
    assert {r["arm"]: r["score"] for r in registry.QUERIES["bandit_bounds"](spark, sf).collect()} == pytest.approx(scores, rel=1e-6)
    betas = {r["step"]: (r["alpha"], r["beta"]) for r in registry.QUERIES["bandit_betas"](spark, sf).collect()}
    assert all(betas[w[0]] == pytest.approx(w[7:], rel=1e-6) for w in want)


def test_steps_up_a_tree_broadcast_no_table(spark, monkeypatch):
    plans, staged = [], trees.staged

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df)

    monkeypatch.setattr(trees, "staged", seen)
    monkeypatch.setattr(trees, "FEW", 0, raising=False)
    df = spark.createDataFrame([(0, None, 9.0), (1, 0, 1.0), (2, 0, 9.0), (3, 2, 3.0), (4, 2, 5.0)], "id long, up long, s double")
    out = trees.node_scores(df, "id", "up", "s")
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "Broadcast" in p]
    assert {r["node"]: (r["leaves"], r["mean"]) for r in out.collect()} == {0: (3, 3.0), 1: (1, 1.0), 2: (2, 4.0), 3: (1, 3.0), 4: (1, 5.0)}


def test_workers_remember_answers_and_puzzles():
    symbolic.alike.cache_clear()
    assert [symbolic.alike("2x + x", "3x") for _ in range(5)] == [True] * 5
    assert symbolic.alike.cache_info().hits >= 4
    said = '[["lying", 1], ["telling-truth", 0]]'
    assert [propositions._consistent(said, [True, None]) for _ in range(3)] == [True] * 3 and propositions._can_all.cache_info().hits >= 2
