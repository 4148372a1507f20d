"""Further queries: dealing, geometry, goal trees, training rows, conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserakt.functions import text as tx
from tesserakt.operators import advantage as ad
from tesserakt.operators import balance, batch, geometry, grouped, losses, ranking, similarity, trees
from tesserakt.plans.registry import T, R, programs, query, r6, rollouts, table, tokens
from tesserakt.sources import readers
from tesserakt.streaming import replay


def _lengths(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("n_chars").alias("n"))
    return balance.batches(d, "pos", "batch", "place", 200)


def _loads(spark, sf):
    d = _lengths(spark, sf)
    return balance.loads(balance.partitions(d, "batch", "pos", "n", 4, None), d, "batch", "pos", "n")


query("balance_differencing")(lambda spark, sf: balance.partitions(_lengths(spark, sf), "batch", "pos", "n", 4, None))
query("balance_greedy", None)(lambda spark, sf: balance.partitions(_lengths(spark, sf), "batch", "pos", "n", 4, None, method="greedy"))
query("balance_groups")(  # ten groups a batch
    lambda spark, sf: balance.group_partitions(_lengths(spark, sf).withColumn("g", F.floor(F.col("place") % 200 * 10 / F.count(F.lit(1)).over(Window.partitionBy("batch")))), "batch", "pos", "n", "g", 2)
)
query("balance_micro_batches")(lambda spark, sf: balance.micro_batches(_lengths(spark, sf), "batch", "pos", "n", 20000))
query("balance_loads")(lambda spark, sf: _loads(spark, sf).select("batch", "least", "most", "difference", r6("mean")))
query("workload", "SELECT doc_id, 24576 * n_chars + n_chars * n_chars AS workload FROM documents")(lambda spark, sf: table(spark, sf, "documents").select("doc_id", balance.workload(F.col("n_chars")).alias("workload")))

# Solutions: 16 consecutive vectors each, points from their first coordinates


def _points(spark, sf):
    coordinate = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("label"), (F.col("vec_id") % 16).cast("int").alias("i"), coordinate(0).alias("x"), coordinate(1).alias("y"), (F.abs(F.get("embedding", F.lit(2))).cast("double") / 10).alias("r"))


PTS = "WITH p AS (SELECT vec_id // 16 AS label, (vec_id % 16)::INT AS i, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, abs(embedding[3])::DOUBLE / 10 AS r FROM embeddings)"
query(
    "packing_report",
    PTS + ", o AS (SELECT DISTINCT a.label FROM p a JOIN p b ON a.label = b.label AND a.i < b.i WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < a.r + b.r - 1e-6) "
    "SELECT label, count(*) AS n, round(sum(r), 6) AS sum_r, CASE WHEN bool_or(x - r < -1e-6 OR x + r > 1 + 1e-6 OR y - r < -1e-6 OR y + r > 1 + 1e-6) THEN 'outside' WHEN label IN (SELECT label FROM o) THEN 'overlap' END AS violation FROM p GROUP BY label",
)(lambda spark, sf: geometry.packing_report(_points(spark, sf), "label", "i", "x", "y", "r").select("label", "n", r6("sum_r"), "violation"))
query(
    "circle_overlaps",
    PTS + " SELECT a.label, a.i::INT AS i, b.i::INT AS j FROM p a JOIN p b ON a.label = b.label AND a.i < b.i WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < a.r + b.r - 1e-6",
)(lambda spark, sf: geometry.overlaps(_points(spark, sf), "label", "i", "x", "y", "r").select("label", "i", "j"))
query("smallest_triangle", PTS + " SELECT a.label, round(min(abs((b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y)) / 2), 9) AS area FROM p a JOIN p b ON a.label = b.label AND a.i < b.i JOIN p c ON c.label = b.label AND b.i < c.i GROUP BY a.label")(
    lambda spark, sf: geometry.smallest_triangle(_points(spark, sf), "label", "i", "x", "y").select("label", F.round("area", 9).alias("area"))
)
query("pair_distances", PTS + ", d AS (SELECT a.label, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.label = b.label AND a.i < b.i) SELECT label, round(min(d), 6) AS least, round(max(d), 6) AS greatest FROM d GROUP BY label")(
    lambda spark, sf: geometry.pair_distances(_points(spark, sf), "label", "i", "x", "y").select("label", r6("least"), r6("greatest"))
)

# Goals: parts as trees of 15 goals on four levels

G = "WITH RECURSIVE j AS (SELECT p_partkey AS goal, p_partkey % 15 + 1 AS j, p_size / 50 AS s FROM part), g AS (SELECT goal, CASE WHEN j > 1 THEN goal - j + j // 2 END AS up, floor(log2(j))::INT AS lv, s FROM j)"


def _goals(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("goal"), (F.col("p_partkey") % 15 + 1).alias("j"), (F.col("p_size") / 50).alias("s"))
    return p.select("goal", F.when(F.col("j") > 1, F.col("goal") - F.col("j") + F.floor(F.col("j") / 2)).alias("up"), F.floor(F.log2("j")).cast("int").alias("lv"), "s")


for _form, (_own, _below) in trees.GOAL_FORMS.items():
    _leaf = "0.0::DOUBLE" if _form == "children" else "s"
    _up = lambda lower, lv, own=_own, below=_below, leaf=_leaf: f"SELECT g.goal, g.up, g.lv, CASE WHEN s >= 1 - 1e-6 THEN 1.0::DOUBLE WHEN NOT EXISTS (SELECT 1 FROM {lower} c WHERE c.up = g.goal) THEN {leaf} ELSE {own} * s + {below} * (SELECT avg(t) FROM {lower} c WHERE c.up = g.goal) END AS t FROM g WHERE lv = {lv}"
    query(
        f"goal_scores_{_form}",
        f"{G}, l3 AS (SELECT goal, up, lv, CASE WHEN s >= 1 - 1e-6 THEN 1.0::DOUBLE ELSE {_leaf} END AS t FROM g WHERE lv = 3), l2 AS ({_up('l3', 2)}), l1 AS ({_up('l2', 1)}), l0 AS ({_up('l1', 0)}), "
        "a AS (SELECT * FROM l3 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l0) SELECT goal, lv AS level, round(t, 10) AS score FROM a",
    )(lambda spark, sf, form=_form: trees.goal_scores(_goals(spark, sf), "goal", "up", "lv", "s", 3, form).select("goal", "level", F.round("score", 10).alias("score")))
query("open_leaf", G + " SELECT goal, lv FROM g WHERE goal NOT IN (SELECT up FROM g WHERE up IS NOT NULL) AND goal % 3 <> 2 AND lv < 9 ORDER BY lv, goal LIMIT 1")(
    lambda spark, sf: trees.open_leaf(_goals(spark, sf).withColumn("hits", F.when(F.col("goal") % 3 == 2, 1)), "goal", "up", "lv", "hits", 9)
)
query("tree_node_scores")(lambda spark, sf: trees.node_scores(programs(spark, sf), "id", "parent", "raw").select("node", "leaves", r6("mean"), r6("score")))
query("lineage", "WITH RECURSIVE u AS (SELECT p_partkey AS node, p_partkey // 2 AS a, 1 AS d FROM part WHERE p_partkey > 0 UNION ALL SELECT node, a // 2, d + 1 FROM u WHERE a > 0 AND d < 4) SELECT node, array_to_string(list(a ORDER BY d DESC), '>') AS path FROM u GROUP BY node")(
    lambda spark, sf: trees.lineage(programs(spark, sf), "id", "parent", 4).select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))
)

# Training rows and conversations

query("training_rows", "SELECT 'bench' AS data_source, trim(text) || CASE WHEN trim(text) LIKE '%?' THEN '' ELSE '?' END AS content, 'rule' AS style, item_id AS index FROM benchmark")(
    lambda spark, sf: table(spark, sf, "benchmark").select(*readers.training_row(F.lit("bench"), tx.with_question_mark(F.col("text")), F.lit("x"), "train", F.col("item_id"))).select("data_source", F.col("prompt")[0]["content"].alias("content"), F.col("reward_model")["style"].alias("style"), F.col("extra_info")["index"].alias("index"))
)
query("long_prompts", "SELECT doc_id FROM documents WHERE n_chars <= 1500")(lambda spark, sf: readers.without_long_prompts(table(spark, sf, "documents"), F.col("n_chars"), 1500).select("doc_id"))
query("extra_info", "SELECT event_id, (props->>'$.k') AS k FROM events")(lambda spark, sf: table(spark, sf, "events").select("event_id", readers.extra_info(F.col("props"))["k"].alias("k")))
query("conversation_turns", "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS answers, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")(
    lambda spark, sf: table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "assistant").alias("answers"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("roles"))
)
query("distinct_best_answer", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1")(
    lambda spark, sf: ranking.distinct_best(table(spark, sf, "events"), ["user_id"], F.col("event_type"), "value", "event_id").select("user_id", "event_id")
)
query("passages", "WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents QUALIFY k <= 3) SELECT lang, string_agg('Doc ' || k || '(Title: ' || doc_id || ') x' || chr(10), '' ORDER BY k) AS passages FROM r GROUP BY lang")(
    lambda spark, sf: similarity.passages(ranking.top_programs(table(spark, sf, "documents").select("lang", "doc_id", (-F.col("doc_id")).alias("s")), 3, "s", "doc_id", ["lang"]).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).withColumn("t", F.col("doc_id").cast("string")).withColumn("x", F.lit("x")), "lang", "k", "t", "x")
)
query("most_similar", "WITH s AS (SELECT q.vec_id AS query, c.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS x FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0) SELECT query, id, round(x, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY x DESC, id) = 1")(
    lambda spark, sf: similarity.most_similar(table(spark, sf, "embeddings").filter("vec_id % 20 = 0"), table(spark, sf, "embeddings"), "vec_id", "embedding").select("query", "id", r6("score"))
)
query("pause_gate", "SELECT event_id, event_id % 100 >= 90 OR event_id % 57 >= 8 * (1.5 + 1) * 2 AS pause FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", replay.should_pause(F.col("event_id") % 100, 90, F.col("event_id") % 57, 8, 1.5, 2).alias("pause"))
)
query("stable_sigmoid", "SELECT vec_id, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 6) AS y FROM embeddings")(lambda spark, sf: table(spark, sf, "embeddings").select("vec_id", r6(losses.sigmoid(F.get("embedding", F.lit(0)).cast("double")), "y")))
query("finite_values", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", tx.finite(F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value"))).alias("v"))
)
query("masked_mean_plain", "SELECT l_orderkey, round(sum(l_quantity * (l_linenumber % 2)) / nullif(sum(l_linenumber % 2), 0), 6) AS masked_mean FROM lineitem GROUP BY 1")(
    lambda spark, sf: grouped.masked(table(spark, sf, "lineitem").withColumn("m", F.col("l_linenumber") % 2), "l_quantity", "m", ["l_orderkey"], "plain").select("l_orderkey", r6("masked_mean"))
)
query("sampled_rows", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")(lambda spark, sf: readers.sample_rows(table(spark, sf, "documents"), 50, "doc_id").select("doc_id"))
query("token_bucket")(lambda spark, sf: replay.token_bucket(table(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"), "value"), "user_id", "t", "value", 1e-6, 100.0))
query("micro_batch_windows")(lambda spark, sf: replay.micro_batches(table(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t")), "user_id", "t", 8, 3.6e9))

query("base_prompt")(lambda spark, sf: table(spark, sf, "benchmark").select("item_id", tx.base_prompt(F.col("text")).alias("prompt")))
query("last_boxed", r"SELECT event_id, 'a{' || event_type || '}b' AS answer FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", tx.last_boxed(F.concat(F.lit("x \\boxed{1} so \\boxed{a{"), "event_type", F.lit("}b} end}"))).alias("answer"))
)
query("same_mapping", "SELECT event_id, event_id % 2 = 0 AS same FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", tx.same_mapping(F.concat(F.lit("{' A': "), (F.col("event_id") - F.col("event_id") % 2).cast("string"), F.lit(", 'b': 2,}")), F.concat(F.lit('{"b": 2, "a": '), F.col("event_id").cast("string"), F.lit("}"))).alias("same"))
)
query(
    "sampler_difference",
    f"{T}, d AS (SELECT exp(old) AS x, exp(new) AS y FROM t WHERE m = 1) SELECT 1 AS valid, round(max(abs(x - y)), 6) AS max, round(avg(abs(x - y)), 6) AS mean, round(stddev_samp(abs(x - y)), 6) AS std, round(corr(x, y), 6) AS pearson FROM d",
)(lambda spark, sf: grouped.sampler_difference(tokens(spark, sf), "old", "new", "m").select("valid", r6("max"), r6("mean"), r6("std"), r6("pearson")))
query("differing_tokens", f"{T} SELECT seq, count(*) FILTER (m = 1 AND old <> new) AS n FROM t GROUP BY seq")(lambda spark, sf: grouped.differing(tokens(spark, sf), "seq", "old", "new", "m"))
query("bootstrap_best")(lambda spark, sf: grouped.bootstrap(table(spark, sf, "events"), ["event_type"], "event_id", "value", 4, 50).select("event_type", r6("mean"), r6("std")))
query(
    "variance_proxy",
    f"{T}, s AS (SELECT seq, sum(CASE WHEN m = 1 THEN 1 - 2 * exp(old) + 0.3 ELSE 0 END) AS w, sum(CASE WHEN m = 1 THEN r ELSE 0 END) AS r FROM t GROUP BY seq), a AS (SELECT avg(w) AS signal, avg(r * r * w) AS total, avg(r) AS mr FROM s) SELECT round(signal, 6) AS signal, round(total, 6) AS total, round(greatest(total - mr * mr * signal, 0), 6) AS pure_noise FROM a",
)(lambda spark, sf: grouped.variance_proxy(tokens(spark, sf).withColumn("q", F.lit(0.3)), "seq", "old", "q", "m", "r").select(r6("signal"), r6("total"), r6("pure_noise")))
query("optimal_token_baseline", f"{T} SELECT seq, pos::INT AS pos, round((r - sum(r * v * m) OVER p / (sum(v * m) OVER p + 1e-8)) * m, 6) AS adv FROM t WINDOW p AS (PARTITION BY seq % 50, pos)")(
    lambda spark, sf: ad.optimal_token_baseline(tokens(spark, sf).withColumn("g", F.col("seq") % 50), ["g"], "pos", "r", "v", "m").select("seq", "pos", r6("adv"))
)
query("sequence_ratio", f"{T} SELECT seq, pos::INT AS pos, round(exp(least(avg(CASE WHEN m = 1 THEN new - old END) OVER (PARTITION BY seq), 10)), 6) AS ratio FROM t WHERE seq IN (SELECT seq FROM t GROUP BY seq HAVING sum(m) > 0)")(
    lambda spark, sf: ad.turn_mean_ratio(tokens(spark, sf).withColumn("x", F.expr("new - old")).withColumn("k", F.lit(0)).join(tokens(spark, sf).groupBy("seq").agg(F.sum("m").alias("s")).filter("s > 0").select("seq"), "seq", "left_semi"), "seq", "k", "x", "m").select("seq", "pos", r6("ratio"))
)
query("resample_weights", f"{R} SELECT event_id, round(s * s / sum(s * s) OVER (), 9) AS weight FROM r")(lambda spark, sf: ranking.resample_weights(rollouts(spark, sf), "s", "pow").select("event_id", F.round("weight", 9).alias("weight")))
query("prompt_bound", "WITH a AS (SELECT event_type, avg(value) AS f, count(*) AS n FROM events GROUP BY 1) SELECT event_type, round(f + 1.4 * sqrt(ln(sum(n) OVER ()) / n), 6) AS bound FROM a")(
    lambda spark, sf: ranking.optimistic_bound(table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("f"), F.count(F.lit(1)).alias("n")), "f", "n", 1.4, 2, 100.0).select("event_type", r6("bound"))
)
query(
    "training_group",
    f"{R}, k AS (SELECT *, s > 40 AS ok, count(*) OVER w AS n, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id) AS k, row_number() OVER (PARTITION BY user_id, s > 40 ORDER BY s DESC, event_id) AS j, sum((s > 40)::INT) OVER w AS rights FROM r WINDOW w AS (PARTITION BY user_id)) "
    "SELECT user_id, event_id FROM k WHERE CASE WHEN n > 4 AND rights > 0 THEN (CASE WHEN ok THEN j = 1 ELSE j <= 3 END) ELSE k <= 4 END",
)(lambda spark, sf: ranking.one_right_rest_wrong(rollouts(spark, sf).withColumn("ok", F.col("s") > 40), ["user_id"], "ok", "s", "event_id", 4).select("user_id", "event_id"))
query("run_positions", "WITH o AS (SELECT event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY event_id // 1000 ORDER BY event_id) THEN 0 ELSE 1 END AS c FROM events), s AS (SELECT *, sum(c) OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS g FROM o) SELECT event_id, (row_number() OVER (PARTITION BY event_id // 1000, g ORDER BY event_id) - 1)::INT AS place FROM s")(
    lambda spark, sf: batch.run_positions(table(spark, sf, "events").withColumn("part", F.floor(F.col("event_id") / 1000)), "event_id", "event_type", ["part"]).select("event_id", "place")
)
