"""Grading, prefix-tree advantages, crowding archives and other folds against plain Python."""

import math
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserakt.functions import grading
from tesserakt.operators import advantage as ad
from tesserakt.operators import balance, batch, grouped, policy, similarity, store
from tesserakt.streaming import replay


def test_losses_are_registered_once():
    assert policy.policy_loss("gspo") is policy.sequence_ratio
    with pytest.raises(ValueError):
        policy.policy_loss("none")
    with pytest.raises(ValueError):
        policy.register("gspo")(lambda df: df)


def test_arithmetic():
    assert grading.arithmetic("(3 + 4) * 5") == 35 and grading.arithmetic("-2 / 4") == -0.5
    for bad in ("", "2 ** 9", "__import__('os')", "1 / 0", "a + 1", "(1", "1 if 1 else 2"):
        assert grading.arithmetic(bad) is None


def test_latex_spellings(spark):
    rows = [("a\nb", "ab"), ("1 2", "12"), ("k=7", "7"), ("abc=7", "abc=7"), ("x=y=7", "x=y=7"), ("3/4/5", "3/4/5"), ("-3/4", "\\frac{-3}{4}"), ("03/4", "03/4"), ("\\frac1{72}", "\\frac{1}{72}"), ("", ""), (None, None)]
    got = spark.createDataFrame(rows, "a string, b string").select(grading.canonical_latex(F.col("a")).alias("x"), "b").collect()
    assert [r["x"] for r in got] == [r["b"] for r in got]
    same = spark.createDataFrame([("1/2", "0.5", True), (None, None, True), (None, "1", False)], "a string, b string, c boolean").select(grading.same_latex(F.col("a"), F.col("b")).alias("x"), "c").collect()
    assert all(r["x"] == r["c"] for r in same)


def test_unknown_source_is_an_error(spark):
    with pytest.raises(Exception, match="no scorer"):
        spark.createDataFrame([("nowhere", "x", "y")], "a string, b string, c string").select(grading.routed_score(F.col("a"), F.col("b"), F.col("c"))).collect()


def brute_prefix_tree(rows, beta):
    """rows: (group, row, tokens, score)."""
    risk = lambda xs: math.log(np.mean([math.exp(beta * x) for x in xs])) / beta
    out = {}
    for g, members in groupby(sorted(rows), key=lambda r: r[0]):
        members = list(members)
        scores = [m[3] for m in members]
        if len(members) == 1 or np.std(scores, ddof=1) < 1e-12:
            out |= {(g, m[1], t): 0.0 for m in members for t in range(len(m[2]))}
            continue
        nodes = {}
        for m in members:
            for t in range(len(m[2]) + 1):
                nodes.setdefault(tuple(m[2][:t]), []).append(m[3])
        values = {k: risk(v) for k, v in nodes.items()}
        mean, std = np.mean(list(values.values())), np.std(list(values.values()))
        out |= {(g, m[1], t): (values[tuple(m[2][: t + 1])] - mean) / (std + 1e-6) for m in members for t in range(len(m[2]))}
    return out


def test_prefix_tree(spark):
    rng = np.random.default_rng(4)
    rows = [(g, 10 * g + i, rng.integers(0, 2, 5).tolist(), float(rng.integers(0, 3))) for g in range(6) for i in range(g + 1)]
    flat = [(g, r, t, tok, s) for g, r, toks, s in rows for t, tok in enumerate(toks)]
    df = spark.createDataFrame(flat, "g long, r long, t int, tok long, s double")
    got = {(r["g"], r["r"], r["t"]): r["adv"] for r in ad.prefix_tree(df, ["g"], "r", "t", "tok", "s", 0.7).collect()}
    want = brute_prefix_tree(rows, 0.7)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_crowding_archive(spark):
    rows = [("a", 1, 5.0, [1.0, 0.0]), ("a", 2, 1.0, [0.0, 1.0]), ("a", 3, 4.0, [0.9, 0.1]), ("a", 4, 2.0, [0.1, 0.9]), ("a", 5, 9.0, None), ("b", 6, 1.0, None)]
    df = spark.createDataFrame(rows, "g string, id long, s double, e array<double>")
    got = sorted((r["g"], r["id"]) for r in store.crowding_archive(df, ["g"], "id", "id", "s", "e", 2).collect())
    # 3 is like 1 and worse; 4 is like 2 and better; 5 has no embedding and takes the place of the worst, 4
    assert got == [("a", 1), ("a", 5), ("b", 6)]


def test_majority(spark):
    rows = [("s", "u", i, "x" if i < 3 else "y", 1.0 if i < 3 else 0.0) for i in range(4)] + [("s", "alone", 9, "x", 1.0)]
    df = spark.createDataFrame(rows, "s string, u string, i long, a string, v double")
    (r,) = grouped.majority_at(df, "s", "u", "a", "v", "i", [3], rounds=400).collect()
    exact = 0.75**3 + 3 * 0.75**2 * 0.25
    assert abs(r["mean"] - exact) < 0.06 and grouped.sizes_up_to(10) == [2, 4, 8, 10] and grouped.sizes_up_to(1) == []


def brute_differencing(lengths, parts):
    """The method with plain sets, one state an item, and a search for the next two states."""
    key = lambda x: (sum(v for _, v in x), len(x), x)
    states = [sorted([[(i, n)]] + [[] for _ in range(parts - 1)], key=key, reverse=True) for i, n in enumerate(lengths)]
    rank = lambda s: (key(s[0])[0] - key(s[-1])[0], key(s[0]))
    while len(states) > 1:
        states.sort(key=rank, reverse=True)
        a, b, *rest = states
        states = [*rest, sorted([x + y for x, y in zip(a, reversed(b), strict=True)], key=key, reverse=True)]
    return [[i for i, _ in x] for x in states[0]]


def test_differencing():
    rng = np.random.default_rng(5)
    for _ in range(40):
        lengths = rng.integers(1, 9, rng.integers(1, 14)).tolist()  # many ties
        assert balance.largest_differencing(lengths, 3, False) == brute_differencing(lengths, 3)
    even = balance.largest_differencing([4, 4, 5, 6, 7, 8], 2, True)
    assert sorted(map(len, even)) == [3, 3] and {sum([4, 4, 5, 6, 7, 8][i] for i in x) for x in even} == {17}
    with pytest.raises(ValueError):
        balance.largest_differencing([1, 2, 3], 2, True)


def test_groups_that_do_not_divide(spark):
    df = spark.createDataFrame([(0, i, 10, i // 2) for i in range(6)], "b long, p long, n long, g long")
    with pytest.raises(Exception, match="must divide"):
        balance.group_partitions(df, "b", "p", "n", "g", 2).collect()
    with pytest.raises(Exception, match="3 groups for 5 parts"):
        balance.group_partitions(df, "b", "p", "n", "g", 5).collect()


def test_mini_batches(spark):
    rows = balance.mini_batches(spark.range(60), "id", 6, 2, 3).collect()
    for e in (0, 1):
        own = [r for r in rows if r["epoch"] == e]
        assert sorted(r["id"] for r in own) == list(range(60)) and all(sum(r["batch"] == b for r in own) == 6 for b in range(10))
    assert [r["id"] for r in rows if r["epoch"] == 0 and r["batch"] == 0] != list(range(6))
    with pytest.raises(ValueError):
        balance.mini_batches(spark.range(7), "id", 6, 1, 3)


def test_renaming_and_choosing(spark):
    df = spark.range(3).withColumn("x", F.col("id"))
    with pytest.raises(ValueError):
        batch.renamed(df, ["id"], ["a", "b"])
    with pytest.raises(KeyError):
        batch.chosen(df, ["nothing"])
    assert batch.chosen(df, None).columns == ["id", "x"] and batch.popped(df, ["x"])[1].columns == ["id"]


def test_event_windows_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    for i, rows in enumerate([[("2024-01-01 00:00:01", 1.0), ("2024-01-01 00:00:09", 2.0)], [("2024-01-01 01:00:00", 4.0), ("2024-01-01 00:00:03", 8.0)]]):
        spark.createDataFrame(rows, "t string, v double").select(F.to_timestamp("t").alias("t"), "v", F.lit("k").alias("k")).coalesce(1).write.mode("append").json(source)
    out = []
    stream = spark.readStream.schema("t timestamp, v double, k string").option("maxFilesPerTrigger", 1).json(source)
    query = replay.event_windows(stream, "t", "10 seconds", ["k"], "v", late="1 minute").writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    last = {r["start"].isoformat(): (r["n"], r["total"]) for r in out}
    assert last["2024-01-01T01:00:00"] == (1, 4.0) and last["2024-01-01T00:00:00"] in ((2, 3.0), (3, 11.0))
    batches = spark.read.schema("t timestamp, v double, k string").json(source)
    assert sorted(r["n"] for r in replay.sessions(batches, "t", "30 seconds", ["k"]).collect()) == [1, 3]


def test_similar_rows_in_blocks(spark, monkeypatch):
    """Blocks of few queries and rows, ties, nulls and other lengths: as by comparing all."""
    import numpy as np

    from tesserakt.operators import similarity

    for name, value in (("QUERY_ROWS", 3), ("BLOCK_ROWS", 7), ("SLICE", 4)):
        monkeypatch.setattr(similarity, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(40)] + [(40, None), (41, [1.0, None, 2.0]), (42, [1.0, 2.0]), (43, []), (44, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b:
            return 0.0
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(np.dot(a, b) / size), 12) if size else 0.0

    got = {}
    for r in similarity.top_k(df.filter("id % 4 = 0 OR id > 40"), df, "id", "v", 4).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"], round(r["score"], 9)))
    for q, v in rows:
        if q % 4 == 0 or q > 40:
            best = sorted(((-cosine(v, w), i) for i, w in rows if i != q))[:4]
            assert sorted(got[q]) == [(k, i, round(-s, 9)) for k, (s, i) in enumerate(best, 1)]


def test_bm25_ranks_scores_that_differ_by_rounding_only_by_key(spark):
    docs = spark.createDataFrame([(1, "fox of the woods and of the hills"), (2, "fox"), (3, "hen"), (3, "hen")], "d long, t string")
    asked = spark.createDataFrame([(7, "fox")], "q long, t string")
    rows = similarity.bm25(asked, docs, "q", "d", "t", 2, k1=1e-12).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [1, 2]
    assert rows[0]["score"] == pytest.approx(math.log(1 + (4 - 2 + 0.5) / 2.5))  # four documents, though two of them share a key and a length


def test_majority_shuffles_no_draws(spark):
    """Prompts with fewer and with more rows than draws against plain Python; no join in the plan."""
    rows = [("s", u, i, f"a{i % 3}", float(i % 7)) for u, n in (("few", 4), ("many", 90)) for i in range(n)] + [("s", None, 1, "x", 5.0), ("s", None, 2, "x", 5.0)]
    df = spark.createDataFrame(rows, "s string, u string, i long, a string, v double")
    out = grouped.majority_at(df, "s", "u", "a", "v", "i", [2, 4], rounds=5)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    draws = spark.range(5).selectExpr("int(id) AS r").crossJoin(spark.range(4).selectExpr("int(id) AS d")).crossJoin(spark.createDataFrame([("few", 4), ("many", 90)], "u string, n long"))
    at = {(r["u"], r["r"], r["d"]): r["at"] for r in draws.select("u", "r", "d", F.expr("int(pmod(xxhash64(42, 's', u, r, d), n))").alias("at")).collect()}
    for r in out.collect():
        means = []
        for u in ("few", "many"):
            scores = []
            for k in range(5):
                got = [at[u, k, d] for d in range(r["n"])]
                answers = [i % 3 for i in got]
                best = max(answers, key=lambda a: (answers.count(a), -answers.index(a)))
                scores.append(float(got[answers.index(best)] % 7))
            means.append(np.mean(scores))
        assert abs(r["mean"] - np.mean(means)) < 1e-9


def test_greatest_covariances_meet_in_no_single_task(spark):
    df = spark.range(400).selectExpr("id % 40 AS seq", "int(id / 40) AS pos", "double(hash(id) % 9) AS adv", "double(hash(id, 1) % 7) AS logp", "0.0D AS old", "int(id % 5 > 0) AS m")
    names = policy.Tokens(seq="seq", pos="pos", logp="logp", old="old", adv="adv", mask="m")
    out = policy.policy_loss("kl_cov")(df, names, share=0.1, coefficient=1e6)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan
    rows = [r.asDict() for r in df.collect() if r["m"]]
    a, b = np.mean([r["adv"] for r in rows]), np.mean([r["logp"] for r in rows])
    rows.sort(key=lambda r: (-(r["adv"] - a) * (r["logp"] - b), r["seq"], r["pos"]))
    want = {(r["seq"], r["pos"]) for r in rows[:32] if r["logp"] != 0}
    got = {(r["seq"], r["pos"]) for r in out.collect() if abs(r["loss"]) > 1e5}
    assert got == want and len(want) > 20
