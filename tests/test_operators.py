"""Operators on small fixtures whose results can be worked out by hand."""

import math
import time

import pytest
from pyspark.sql import functions as F

from tesserakt.functions import text as tx
from tesserakt.operators import advantage as ad
from tesserakt.operators import balance, batch, correction, grouped, losses, ranking, similarity, trees
from tesserakt.plans import more, registry  # noqa: F401
from tesserakt.streaming import replay


def values(df, *columns):
    return [tuple(r) if len(columns) != 1 else r[0] for r in df.select(*columns).collect()]


def test_group_stats(spark):
    df = spark.createDataFrame([(0, 1.0, 0), (1, 2.0, 1), (2, 3.0, 0)], "pos int, score double, g int")
    got = {r["g"]: (r["n"], r["mean"], round(r["std"], 6)) for r in grouped.group_mean_std(df, "score", ["g"]).collect()}
    assert got == {0: (2, 2.0, round(math.sqrt(2), 6)), 1: (1, 0.0, 1.0)}
    assert grouped.group_mean_std(df.limit(0), "score", ["g"]).count() == 0


def test_majority_tie_takes_the_first(spark):
    df = spark.createDataFrame([(0, "A", 0.9), (1, "B", 0.8), (2, "B", 0.7), (3, "A", 0.6)], "pos int, pred string, val double").withColumn("g", F.lit(1))
    assert values(grouped.majority(df, ["g"], "pos", "pred", "val"), "vote", "maj") == [("A", 0.9)]


def test_singletons(spark):
    df = spark.createDataFrame([(1, 2.0)], "g int, s double")
    assert values(ad.rloo(df, "s", ["g"]), "adv") == [2.0]
    assert values(ad.rloo(df, "s", ["g"], "vectorized"), "adv") == [0.0]
    assert values(ad.opo(df.withColumn("len", F.lit(5)), "s", "len", ["g"]), "adv") == [2.0]
    assert values(ad.grpo(df, "s", ["g"]), "adv")[0] == pytest.approx(2 / (1 + 1e-6))


def test_estimators_are_registered():
    assert ad.estimator("grpo") is ad.grpo
    with pytest.raises(ValueError):
        ad.estimator("none")
    with pytest.raises(ValueError):
        ad.register("grpo")(lambda df: df)


def test_masked_token_carries_what_follows(spark):
    df = spark.createDataFrame([([1.0, 5.0, 2.0], [0.5, 9.0, 0.5], [1, 0, 1])], "r array<double>, v array<double>, m array<int>")
    last = 2.0 - 0.5
    assert values(df.select(ad.gae("r", "v", "m", 0.9, 0.95).alias("x")), "x")[0] == pytest.approx([1.0 + 0.9 * 0.5 - 0.5 + 0.9 * 0.95 * last, last, last])
    assert values(df.select(ad.discounted_returns("r", "m", 0.5).alias("x")), "x")[0] == pytest.approx([1.0, 6.0, 2.0])


def test_thresholds():
    assert correction.bounds("0.5_2") == (0.5, 2.0)
    assert correction.bounds(4.0) == (0.25, 4.0)
    with pytest.raises(TypeError):
        correction.bounds(True)


def test_kl_controller():
    assert losses.next_kl_coefficient(0.1, 10.0, 1.0, 100, 1000) == pytest.approx(0.1 * 1.02)
    with pytest.raises(NotImplementedError):
        losses.kl_penalty(F.lit(0.0), F.lit(0.0), "full")


def test_union_columns_refuses_a_clash(spark):
    a = spark.createDataFrame([(0, 1.0), (1, float("nan"))], "pos int, x double")
    assert batch.union_columns(a, a.withColumn("y", F.lit(1)), "pos").count() == 2
    with pytest.raises(Exception, match="differ"):
        batch.union_columns(a, a.withColumn("x", F.lit(3.0)), "pos").collect()


def test_pad_and_chunks(spark):
    df = spark.range(5).withColumnRenamed("id", "pos")
    assert sorted(values(batch.pad_to_multiple(df, "pos", 5, 4), "pos")) == list(range(8))
    with pytest.raises(ValueError):
        batch.chunks(df, "pos", 2, 5)
    one = spark.createDataFrame([([1, 2, 3, 4, 5],)], "x array<int>")
    assert values(one.select(batch.pad_array(F.col("x"), 3, truncation="middle").alias("x")), "x") == [[1, 4, 5]]
    assert values(one.select(batch.pad_array(F.col("x"), 7, left=True).alias("x")), "x") == [[0, 0, 1, 2, 3, 4, 5]]


def test_effective_score_of_one_step(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5, 0.3), (2, 0.7, 0.5, 0.9)], "id int, score double, raw double, w double")
    assert values(ranking.effective_scores(df, "score", "raw", "w"), "effective") == [0.5, 0.5]
    missing = df.withColumn("raw", F.when(F.col("id") == 1, F.col("raw")))
    assert sorted(values(ranking.effective_scores(missing, "score", "raw", "w"), "effective")) == [0.5, 0.7]


def test_cosine_guards(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([], []), ([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert values(df.select(similarity.cosine(F.col("a"), F.col("b")).alias("c")), "c") == [0.0, 0.0, 0.0, 1.0]


def test_goal_scores(spark):
    df = spark.createDataFrame([(1, None, 0, 0.5), (2, 1, 1, 1.0), (3, 1, 1, 0.2)], "goal int, up int, lv int, s double")
    got = {r["goal"]: r["score"] for r in trees.goal_scores(df, "goal", "up", "lv", "s", 1).collect()}
    assert got == {1: pytest.approx(0.3 * 0.5 + 0.7 * 0.6), 2: 1.0, 3: pytest.approx(0.2)}


def test_answers(spark):
    df = spark.createDataFrame([("<answer>a</answer> x <answer> The  Cat! </answer>", "cat"), ("<answer>cat</answer>", "dog")], "t string, gold string")
    last = tx.last_answer(F.col("t"), 2)
    assert values(df.select(last.alias("a"), tx.exact_match(last, F.array("gold")).alias("em")), "a", "em") == [("The  Cat!", 1), (None, 0)]
    f1 = spark.createDataFrame([("a red big cat", "red cat"), ("yes", "yes it is")], "p string, g string")
    assert values(f1.select(tx.token_f1(F.col("p"), F.col("g")).alias("f")), "f") == [pytest.approx(0.8), 0.0]
    seq = spark.createDataFrame([("<|im_start|>assistant <think>x</think><search>y</search><information>z</information><think>x</think><answer>a</answer>",), ("<|im_start|>assistant <think>x</think> oops <answer>a</answer>",)], "t string")
    assert values(seq.select(tx.valid_sequence(F.col("t")).alias("v")), "v") == [True, False]
    some = spark.createDataFrame([(["who", "is", "x"],)], "w array<string>").select(tx.abstractions(F.col("w"), 2, ("is",)).alias("x"))
    assert values(some, "x") == [["who is x", "[X] is x", "who is [X]", "[X] x", "who [X]"]]


def test_bounded_queue(spark):
    log = [(1, i, "put", i) for i in range(3)] + [(1, 3, "get", None), (1, 4, "get", None), (1, 5, "get", None)]
    df = spark.createDataFrame(log, "k int, seq int, kind string, item int")
    got = [(r["got"], r["dropped"], r["size"]) for r in replay.bounded_queue(df, "k", "seq", "kind", "item", 2).orderBy("seq").collect()]
    assert [tuple(None if v is None or v != v else int(v) for v in r) for r in got] == [(None, None, 1), (None, None, 2), (None, 0, 2), (1, None, 1), (2, None, 0), (None, None, 0)]


def test_token_bucket_and_micro_batches(spark):
    df = spark.createDataFrame([(1, 0.0, 8.0), (1, 0.0, 9.0), (1, 1.0, 1.0)], "k int, t double, n double")
    assert values(replay.token_bucket(df, "k", "t", "n", 10.0, 10.0).orderBy("t", "n"), "ready") == pytest.approx([0.0, 0.7, 1.0])
    times = spark.createDataFrame([(1, x) for x in (0.0, 0.1, 0.2, 0.9, 1.0)], "k int, t double")
    assert values(replay.micro_batches(times, "k", "t", 2, 0.5).orderBy("t"), "batch") == [0, 0, 1, 2, 2]


# Whole tables


@pytest.mark.parametrize("name", ["balance_differencing", "balance_greedy", "balance_groups", "balance_micro_batches"])
def test_balance_deals_every_document(spark, tmp_path, name):
    """450 documents, ids with gaps: batches of 200, 200 and 50, which four partitions don't divide."""
    spark.createDataFrame([(3 * i, 1 + 37 * i % 500) for i in range(450)], "doc_id long, n_chars long").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted((r["pos"], r["batch"]) for r in rows) == [(3 * i, i // 200) for i in range(450)]
    if name in ("balance_differencing", "balance_greedy"):
        assert all(sum(r["batch"] == b and r["part"] == k for r in rows) == 50 for b in (0, 1) for k in range(4))


def test_batches_number_rows_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(balance, "RANGE_ROWS", 10)
    rows = [(i // 2 if i else None, i) for i in range(997)]
    got = balance.batches(spark.createDataFrame(rows, "k int, v int").repartition(5), "k", "batch", "place", 100).collect()
    assert sorted((r["place"], r["v"], r["batch"]) for r in got) == [(i, i, i // 100) for i in range(997)]
    assert balance.batches(spark.createDataFrame([], "k int, v int"), "k", "batch", "place", 100).count() == 0


def test_balance_loads_of_every_batch(spark, tmp_path):
    spark.createDataFrame([(i, 10) for i in range(450)], "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.QUERIES["balance_loads"](spark, str(tmp_path)).collect()
    assert sorted((r["batch"], r["least"], r["most"], r["mean"]) for r in rows) == [(0, 500, 500, 500.0), (1, 500, 500, 500.0), (2, 120, 130, 125.0)]


def test_leaf_means_of_a_deep_tree(spark):
    """A chain of 26 nodes with a second leaf below node 3 counts up to the root."""
    df = spark.createDataFrame([(i, i - 1 if i else None, float(i)) for i in range(26)] + [(99, 3, 5.0)], "id int, up int, s double")
    got = {r["node"]: (r["leaves"], r["mean"]) for r in trees.leaf_means(df, "id", "up", "s").collect()}
    assert got == {i: (2, 15.0) if i <= 3 else (1, 25.0) for i in range(26)} | {99: (1, 5.0)}


def test_tree_node_scores_of_every_program(spark, tmp_path):
    parts = [(i, 0.0, i % 50, "b") for i in range(600)]
    spark.createDataFrame(parts, "p_partkey long, p_retailprice double, p_size int, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    rows = {r["node"]: r["leaves"] for r in registry.QUERIES["tree_node_scores"](spark, str(tmp_path)).collect()}
    assert rows == {i: 1 if i >= 300 else sum(_under(j, i) for j in range(300, 600)) for i in range(600)}


def _under(leaf, node):
    while leaf != node and leaf:
        leaf //= 2
    return leaf == node


def test_leaf_means_in_a_circle(spark):
    df = spark.createDataFrame([(1, 2, 0.0), (2, 1, 0.0), (3, 1, 1.0)], "id int, up int, s double")
    with pytest.raises(ValueError):
        trees.leaf_means(df, "id", "up", "s")


def test_no_depth_is_too_great(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "id long, up long")
    got = trees.subtree(chain, "id", "up", F.col("id") == 0, 100).collect()
    assert [(r["node"], r["depth"]) for r in got] == [(i, i) for i in range(40)]
    assert trees.subtree(chain, "id", "up", F.col("id") == 0, 7).count() == 7 and trees.subtree(chain, "id", "up", F.col("id") == -1, 7).count() == 0
    circle = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "id long, up long")
    assert trees.subtree(circle, "id", "up", F.col("id") == 0, 100).count() == 3
    kept = trees.with_ancestors(chain, "id", "up", spark.createDataFrame([(35,), (12,), (99,)], "leaf long"), "leaf")
    assert sorted(r["id"] for r in kept.collect()) == list(range(36))


def test_plans_without_growing_lists_or_single_tasks(spark):
    tokens = spark.createDataFrame([(0, r, t, (r * t) % 3, float(r)) for r in range(6) for t in range(20)], "g int, r int, t int, tok int, s double")
    plan = ad.prefix_tree(tokens, ["g"], "r", "t", "tok", "s", 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    labels = spark.createDataFrame([(x,) for x in "dbca" * 5], "label string")
    out = grouped.dense_index(labels, "label")
    assert sorted({(r["label"], r["gidx"]) for r in out.collect()}) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_position_ids(spark):
    rows = spark.createDataFrame([([1, 1, 0, 1],), ([0, 0],), ([],), ([0, 1, 1],)], "m array<int>")
    assert [list(r[0]) for r in rows.select(batch.position_ids(F.col("m"))).collect()] == [[0, 1, 0, 2], [0, 0], [], [0, 0, 1]]


def test_token_f1_of_long_texts_takes_no_square_time(spark):
    words = [f"w{i % 9000}" for i in range(20_000)]
    row = spark.createDataFrame([(" ".join(words), " ".join(words[:11_000]), None)], "p string, g string, none string")
    began = time.perf_counter()
    found = row.select(F.round(tx.token_f1(F.col("p"), F.col("g")), 6).alias("f"), tx.token_f1(F.col("p"), F.col("none")).alias("n")).first()
    assert found["f"] == round(2 * 11_000 / 31_000, 6) and found["n"] is None and time.perf_counter() - began < 60
