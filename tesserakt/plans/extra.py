"""Queries of policy losses, grading, the program store, validation and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserakt.functions import grading
from tesserakt.functions import text as tx
from tesserakt.operators import advantage as ad
from tesserakt.operators import balance, batch, correction, embedding, grouped, losses, policy, ranking, similarity, store, trees
from tesserakt.plans.registry import P, T, programs, query, r6, table, tokens
from tesserakt.sources import readers
from tesserakt.streaming import replay

# Policy losses of tokens (adv: r, logp: new)

NAMES = policy.Tokens(seq="seq", pos="pos", logp="new", old="old", adv="r", mask="m")
RATIO = "exp(greatest(least(new - old, 20), -20))"


def _loss(name: str, sql: str, which: str, **options) -> None:
    query(name, f"{T} SELECT seq, pos::INT AS pos, round({sql}, 6) AS loss FROM t")(lambda spark, sf: policy.policy_loss(which)(tokens(spark, sf), NAMES, **options).select("seq", "pos", r6("loss")))


_loss("loss_within_variation", f"CASE WHEN CASE WHEN r > 0 THEN exp(new) - exp(old) <= 0.2 ELSE exp(new) - exp(old) >= -0.2 END THEN -r * least({RATIO}, 20) * new ELSE 0 END", "dppo_tv")
_KL = "(exp(old) * (old - new) + (1 - exp(old)) * ln((1 - exp(old) + 1e-8) / (1 - exp(new) + 1e-8)))"
_loss("loss_within_divergence", f"CASE WHEN CASE WHEN r > 0 THEN {_KL} <= 0.05 OR exp(new) <= exp(old) ELSE {_KL} <= 0.05 OR exp(new) >= exp(old) END THEN -r * least({RATIO}, 20) * new ELSE 0 END", "dppo_kl", low=0.05, high=0.05)
_S = "exp(least(sum(CASE WHEN m = 1 THEN new - old ELSE 0 END) OVER (PARTITION BY seq) / greatest(sum(m) OVER (PARTITION BY seq), 1), 10))"
_loss("loss_sequence_ratio", f"greatest(-r * {_S}, -r * least(greatest({_S}, 0.8), 1.2))", "gspo")
query(
    "loss_geometric_mean",
    f"{T}, x AS (SELECT *, sign(r) * least(sign(r) * (new - old), sign(r) * least(greatest(new - old, -0.2), 0.2)) AS h FROM t) SELECT seq, round(-(sum(r * m) / (sum(m) + 1e-8)) * exp(sum(h * m) / (sum(m) + 1e-8)), 6) AS loss FROM x GROUP BY seq",
)(lambda spark, sf: policy.policy_loss("geo_mean")(tokens(spark, sf), NAMES).select("seq", r6("loss")))
COV = f"{T}, a AS (SELECT avg(r) AS ra, avg(new) AS na, count(*) AS n FROM t WHERE m = 1), c AS (SELECT t.*, round((r - ra) * (new - na), 9) AS cov, n FROM t, a)"
query(
    "loss_without_covariance",
    f"""{T}, a AS (SELECT avg(r) AS ra, avg(new) AS na, count(*) AS n FROM t WHERE m = 1),
    c AS (SELECT t.*, (r - ra) * (new - na) AS cov, n, exp(new - old) AS q FROM t, a), l AS (SELECT *, -r * q AS l1, -r * least(greatest(q, 0.8), 1.2) AS l2 FROM c),
    k AS (SELECT seq, pos FROM l WHERE m = 1 AND NOT l2 > l1 AND cov > 0.2 AND cov < 5 ORDER BY md5('0:' || seq || ':' || pos), seq, pos LIMIT (SELECT greatest((n * 0.01)::INT, 1) FROM a))
    SELECT seq, pos::INT AS pos, round(CASE WHEN k.seq IS NOT NULL THEN 0 ELSE greatest(l1, l2) END, 6) AS loss FROM l LEFT JOIN k USING (seq, pos)""".replace("(n * 0.01)::INT", "floor(n * 0.01)::INT"),
)(lambda spark, sf: policy.policy_loss("clip_cov")(tokens(spark, sf), NAMES, share=0.01, least=0.2).select("seq", "pos", r6("loss")))
query(
    "loss_penalised_covariance",
    f"{T} SELECT count(*) AS n, count(*) FILTER (m = 1) AS kept, greatest(floor(count(*) FILTER (m = 1) * 0.02)::BIGINT, 1) AS penalised FROM t",
)(
    lambda spark, sf: policy.policy_loss("kl_cov")(tokens(spark, sf), NAMES, share=0.02, coefficient=1e6)
    .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("m") == 1).alias("kept"), F.count_if(F.abs(F.col("loss") + F.col("r") * F.exp(F.expr("new - old"))) >= 1e3 * F.abs(F.expr("new - old")) - 1e-9).alias("_p"), F.count_if((F.col("new") == F.col("old"))).alias("_z"))
    .select("n", "kept", F.greatest(F.floor(F.col("kept") * 0.02), F.lit(1)).alias("penalised"))
)
query(
    "loss_bypass",
    f"{T} SELECT seq, pos::INT AS pos, CASE WHEN m = 1 AND abs(new - old) <= ln(2) THEN 1 ELSE 0 END AS kept, round(-least(exp(greatest(least(new - old, 20), -20)), 2) * m * r * new, 6) AS loss FROM t",
)(lambda spark, sf: policy.policy_loss("bypass_mode")(tokens(spark, sf), NAMES, kind="reinforce", level="token", threshold=2.0, options={"token_k1": 2.0}).select("seq", "pos", "kept", r6("loss")))
query("rejection_statistics", f"""{T}, x AS (SELECT seq, CASE WHEN m = 1 THEN 0.5 * (new - old) * (new - old) END AS x FROM t), s AS (SELECT avg(x) AS s FROM x WHERE x IS NOT NULL GROUP BY seq),
    a AS (SELECT avg(x) AS mean, sqrt(greatest(avg(least(greatest(x, 0), 2) * least(greatest(x, 0), 2)) - avg(least(greatest(x, 0), 2)) * avg(least(greatest(x, 0), 2)), 0)) AS std, max(x) AS max, min(x) AS min, avg((x > 2)::INT) AS fraction_high FROM x WHERE x IS NOT NULL),
    b AS (SELECT avg(s) AS seq_mean, stddev_samp(s) AS seq_std, max(s) AS seq_max, avg((s > 2)::INT) AS seq_fraction_high FROM s)
    SELECT round(mean, 6) AS mean, round(std, 6) AS std, round(max, 6) AS max, round(min, 6) AS min, round(fraction_high, 6) AS fraction_high, round(seq_mean, 6) AS seq_mean, round(seq_std, 6) AS seq_std, round(seq_max, 6) AS seq_max, round(seq_fraction_high, 6) AS seq_fraction_high FROM a, b""")(
    lambda spark, sf: correction.rejection_statistics(tokens(spark, sf).withColumn("x", 0.5 * F.expr("(new - old) * (new - old)")), "seq", "x", "m", 2.0).select(*(r6(c) for c in ("mean", "std", "max", "min", "fraction_high", "seq_mean", "seq_std", "seq_max", "seq_fraction_high")))
)
query("distillation_kl", "SELECT vec_id, round(greatest(list_sum(list_transform(range(1, 9), lambda i: exp(-abs(embedding[i]::DOUBLE)) * (-abs(embedding[i]::DOUBLE) + abs(embedding[i + 8]::DOUBLE)))), 0), 6) AS kl FROM embeddings")(
    lambda spark, sf: table(spark, sf, "embeddings").select("vec_id", r6(policy.forward_kl_top_k(F.transform(F.slice("embedding", 1, 8), lambda x: -F.abs(x.cast("double"))), F.transform(F.slice("embedding", 9, 8), lambda x: -F.abs(x.cast("double")))), "kl"))
)

# Lines of code

query("code_lines", r"SELECT doc_id, len(string_split(text, chr(10)))::INT AS loc, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::INT AS lloc, round(least(log2(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) + 1) / 10, 1), 3) AS complexity FROM documents")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", grading.generic_code_metrics(F.col("text")).alias("m")).select("doc_id", "m.*")
)

# Store of programs: an archive of every third, correct unless the number ends in 7

PS = P.replace("FROM part)", "FROM part), q AS (SELECT *, id % 10 <> 7 AS correct FROM p), arch AS (SELECT id FROM q WHERE id % 3 = 0)")


def _programs(spark, sf):
    return programs(spark, sf).withColumn("correct", F.col("id") % 10 != 7)


def _archive(spark, sf):
    return programs(spark, sf).filter("id % 3 = 0").select("id")


query("archive_flags", PS + " SELECT q.id, arch.id IS NOT NULL AS in_archive FROM q LEFT JOIN arch USING (id)")(lambda spark, sf: store.with_archive_flag(_programs(spark, sf), _archive(spark, sf), "id").select("id", "in_archive"))
query("archived", PS + " SELECT id, score FROM q WHERE id IN (SELECT id FROM arch)")(lambda spark, sf: store.archived(_programs(spark, sf), _archive(spark, sf), "id").select("id", "score"))
query("island_elites", PS + " SELECT island, id, row_number() OVER (PARTITION BY island ORDER BY score DESC, id)::INT AS place FROM q WHERE correct AND id IN (SELECT id FROM arch) QUALIFY place <= 4")(
    lambda spark, sf: store.elites(_programs(spark, sf), _archive(spark, sf), "id", ["island"], "correct", "score", 4).select("island", "id", "place")
)
query("best_without", PS + " SELECT id, score FROM q WHERE id NOT IN (SELECT id FROM arch) ORDER BY score DESC, id LIMIT 10")(lambda spark, sf: store.best_without(_programs(spark, sf), _archive(spark, sf), "id", "score", 10).select("id", "score"))
query("correct_children", PS + " SELECT parent, id, row_number() OVER (PARTITION BY parent ORDER BY score DESC, id)::INT AS place FROM q WHERE correct AND parent IS NOT NULL QUALIFY place <= 1")(
    lambda spark, sf: store.correct_children(_programs(spark, sf), "id", "parent", "correct", "score", 1).select("parent", "id", "place")
)
query("satisfied_goals", PS + " SELECT 'g' || id % 5 AS goal, count(*) AS n FROM q WHERE correct AND w >= 0.5 GROUP BY 1")(
    lambda spark, sf: store.satisfied_goals(_programs(spark, sf).withColumn("goals", F.to_json(F.create_map(F.concat(F.lit("g"), F.col("id") % 5), F.col("w").cast("double").cast("string"), F.lit("other"), F.lit("no number")))), "goals", "correct", 0.5)
)
query("greatest_generation", PS + " SELECT max(generation) FILTER (correct) AS generation FROM q")(lambda spark, sf: store.greatest_generation(_programs(spark, sf), "generation", "correct"))
query("prompt_fitness", PS + " SELECT id % 20 AS prompt, round(avg(w) FILTER (correct), 6) AS fitness, count(*) FILTER (correct) AS n FROM q GROUP BY 1")(
    lambda spark, sf: store.prompt_fitness(_programs(spark, sf).withColumn("prompt", F.col("id") % 20), "prompt", "w", "correct").select("prompt", r6("fitness"), "n")
)
query("fitness_of_listed", PS + " SELECT a.id AS prompt, round(avg(b.score), 6) AS fitness, count(*) AS n FROM q a JOIN q b ON b.id IN (a.id, a.id + 1, a.id + 7) GROUP BY 1")(
    lambda spark, sf: store.fitness_of_listed(_programs(spark, sf).select(F.col("id").alias("prompt"), F.array(F.col("id"), F.col("id") + 1, F.col("id") + 7).alias("ids")), "prompt", "ids", _programs(spark, sf), "id", "score").select("prompt", r6("fitness"), "n")
)
query("total_cost", "SELECT round(sum(value) FILTER (event_id % 3 <> 0), 4) AS cost FROM events")(
    lambda spark, sf: store.total_cost(table(spark, sf, "events").select(F.when(F.col("event_id") % 3 != 0, F.concat(F.lit('{"llm": {"cost": '), F.col("value").cast("string"), F.lit("}}"))).otherwise(F.lit('{"llm": {}}')).alias("meta")), "meta", "$.llm.cost").select(F.round("cost", 4).alias("cost"))
)
query("kept_archive", PS + " SELECT id FROM q ORDER BY correct DESC, score DESC, raw DESC, id DESC LIMIT 25")(
    lambda spark, sf: store.kept_archive(_programs(spark, sf).filter("id % 2 = 0"), _programs(spark, sf).filter("id % 2 = 1"), store.better_first(F.col("correct"), F.col("score"), F.col("raw"), F.col("id")), 25).select("id")
)
query("kept_prompts", PS + ", f AS (SELECT id % 20 AS prompt, avg(w) FILTER (correct) AS fitness, count(*) FILTER (correct) AS n FROM q GROUP BY 1) SELECT prompt FROM f ORDER BY n >= 5 DESC, round(fitness, 9) DESC NULLS LAST, prompt LIMIT 6")(
    lambda spark, sf: store.kept_prompts(store.prompt_fitness(_programs(spark, sf).withColumn("prompt", F.col("id") % 20), "prompt", "w", "correct").withColumn("fitness", F.round("fitness", 9)), "n", 5, "fitness", "prompt", 6).select("prompt")
)
query("crowding_archive")(lambda spark, sf: store.crowding_archive(table(spark, sf, "embeddings").withColumn("score", F.col("vec_id") % 97), ["label"], "vec_id", "vec_id", "score", "embedding", 12))
query("first_and_last", PS + " SELECT island, arg_min(id, generation * 100000000 + id) AS first, arg_max(id, generation * 100000000 + id) AS last FROM q GROUP BY island")(lambda spark, sf: store.first_and_last(_programs(spark, sf), ["island"], "generation", "id"))
query("beam_parent", PS + ", c AS (SELECT parent AS id, count(*) AS children FROM q WHERE parent IS NOT NULL GROUP BY 1) SELECT island, id, coalesce(children, 0) AS children FROM q LEFT JOIN c USING (id) WHERE coalesce(children, 0) < 2 QUALIFY row_number() OVER (PARTITION BY island ORDER BY score DESC, id) = 1")(
    lambda spark, sf: store.beam_parent(_programs(spark, sf), ["island"], "id", "parent", "score", 2).select("island", "id", "children")
)
query("emptiest_islands", PS + ", n AS (SELECT island, count(*) AS n FROM q GROUP BY 1) SELECT island, n FROM n WHERE n = (SELECT min(n) FROM n)")(lambda spark, sf: store.emptiest_islands(_programs(spark, sf), "island"))
query("empty_island", "SELECT min(i)::INT AS island FROM range(40) t(i) WHERE i NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0)")(lambda spark, sf: store.empty_island(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("island"), (F.col("s_suppkey") % 2 == 0).alias("correct")), "island", "correct", 40))
query("assigned_island", PS + " SELECT a.id, coalesce(CASE WHEN a.id % 11 = 0 THEN 99 END, b.id % 8, 3)::INT AS assigned FROM q a LEFT JOIN q b ON a.parent = b.id")(
    lambda spark, sf: store.assigned_island(programs(spark, sf).select("id", "parent", (F.col("id") % 8).cast("int").alias("island")), "id", "parent", "island", F.when(F.col("id") % 11 == 0, 99), F.lit(3)).select("id", "assigned")
)
query("copied_to_islands", "SELECT s_suppkey || '@' || i AS id, i::INT AS island, s_suppkey AS copied_from FROM supplier, range(4) t(i) WHERE i <> s_suppkey % 4")(
    lambda spark, sf: store.copied_to_islands(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 4).cast("int").alias("island")), "id", "island", 4)
)
query("spawned_island", PS + " SELECT id || '#' || 9 AS id, CASE WHEN id > 1 THEN (id // 2) || '#' || 9 END AS parent, 9 AS island FROM q WHERE id BETWEEN 1 AND 7")(
    lambda spark, sf: store.spawned_island(programs(spark, sf).select("id", "parent", (F.col("id") % 9).cast("int").alias("island")), programs(spark, sf).filter("id BETWEEN 1 AND 7").select("id"), "id", "parent", "island", 4)
)
query("migrated", PS + " SELECT id, CASE WHEN id % 4 = 0 THEN 'new' ELSE island END AS island, CASE WHEN id % 4 = 0 THEN generation || ':' || island END AS moved FROM q")(
    lambda spark, sf: store.migrated(programs(spark, sf).withColumn("history", F.array().cast("array<struct<generation:int,from:string,to:string>>")), programs(spark, sf).filter("id % 4 = 0").select("id", F.lit("new").alias("to")), "id", "island", "history", F.col("generation")).select(
        "id", "island", F.when(F.size("history") > 0, F.concat_ws(":", F.col("history")[0]["generation"].cast("string"), F.col("history")[0]["from"])).alias("moved")
    )
)
query("migration_due", PS + " SELECT id, generation > 0 AND generation % 3 = 0 AS due FROM q")(lambda spark, sf: programs(spark, sf).select("id", store.migration_due(F.col("generation"), 3).alias("due")))
query("running_best", PS + ", o AS (SELECT *, max(CASE WHEN correct THEN score END) OVER (PARTITION BY island ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM q) SELECT id, CASE WHEN correct THEN greatest(e, score) ELSE e END AS best, correct AND (e IS NULL OR score > e) AS raised FROM o")(
    lambda spark, sf: store.running_best(_programs(spark, sf), ["island"], ["id"], "correct", "score").select("id", "best", "raised")
)
query("criteria", PS + " SELECT id, score AS a, CASE WHEN id % 2 = 0 THEN id ELSE 1 END::DOUBLE AS b, 100.0::DOUBLE AS c, 0.0::DOUBLE AS d FROM q")(
    lambda spark, sf: programs(spark, sf).withColumn("meta", F.when(F.col("id") % 2 == 0, F.concat(F.lit('{"loc": '), F.col("id").cast("string"), F.lit("}")))).select("id", *(store.criterion(F.col("meta"), F.col("score"), k).alias(n) for k, n in (("score", "a"), ("loc", "b"), ("maintainability", "c"), ("other", "d"))))
)
query("parsed_metrics", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS n FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", F.size(store.metrics_of(F.when(F.col("event_id") % 2 == 0, F.lit('{"a": 1.5}')).otherwise(F.lit("{bad")))).alias("n"))
)

# Validation and timing

query("stage_timing", "WITH t AS (SELECT sum(n_chars) AS r, sum(n_chars) + 3 * count(*) AS a FROM documents) SELECT r_name AS stage, round(r_regionkey + 0.5, 6) AS seconds, round((r_regionkey + 0.5) * 1000 / CASE r_regionkey WHEN 0 THEN r WHEN 1 THEN a END, 9) AS ms_per_token FROM region, t".replace("r_name AS stage", "CASE r_regionkey WHEN 0 THEN 'gen' WHEN 1 THEN 'ref' ELSE r_name END AS stage"))(
    lambda spark, sf: grouped.stage_timing(
        table(spark, sf, "region").select(F.when(F.col("r_regionkey") == 0, "gen").when(F.col("r_regionkey") == 1, "ref").otherwise(F.col("r_name")).alias("stage"), (F.col("r_regionkey") + 0.5).alias("s")), "stage", "s", table(spark, sf, "documents").select(F.lit(3).alias("p"), "n_chars"), "p", "n_chars"
    ).select("stage", F.round(F.col("seconds").cast("double"), 6).alias("seconds"), F.round(F.col("ms_per_token").cast("double"), 9).alias("ms_per_token"))
)
query("throughput", "SELECT sum(n_chars) AS tokens, round(sum(n_chars) / (12.5::DOUBLE * 8), 4) AS throughput FROM documents")(lambda spark, sf: grouped.throughput(table(spark, sf, "documents"), "n_chars", F.lit(12.5), 8).select("tokens", F.round("throughput", 4).alias("throughput")))
query(
    "metric_sections",
    "SELECT event_id, CASE WHEN event_type = 'click' AND event_id % 3 <> 2 AND event_id % 8 = max(event_id % 8) OVER (PARTITION BY user_id, event_type) THEN 'val-core' ELSE 'val-aux' END || '/' || user_id || '/' || event_type || '/' || CASE event_id % 3 WHEN 0 THEN 'mean@8' WHEN 1 THEN 'best@8/mean' ELSE 'std@8' END AS name FROM events",
)(
    lambda spark, sf: table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("source"), "event_type", (F.col("event_id") % 8).alias("n"), F.element_at(F.array(F.lit("mean@8"), F.lit("best@8/mean"), F.lit("std@8")), (F.col("event_id") % 3 + 1).cast("int")).alias("metric"))
    .select("event_id", grouped.metric_section("source", "event_type", "metric", "n", "click").alias("name"))
)
query("majority_at")(lambda spark, sf: grouped.majority_at(table(spark, sf, "events").withColumn("answer", F.col("event_id") % 3), "event_type", "user_id", "answer", "value", "event_id", [2, 4], rounds=20).select("event_type", "n", r6("mean"), r6("std")))

# Trees

query(
    "prefix_tree",
    f"""{T}, x AS (SELECT seq, pos, seq // 4 AS g, seq % 5 AS s, string_agg((m + floor(v))::VARCHAR, ',') OVER (PARTITION BY seq ORDER BY pos) AS h FROM t), n AS (SELECT g, pos, h, ln(avg(exp(0.5 * s))) / 0.5 AS v FROM x GROUP BY ALL),
    root AS (SELECT g, ln(avg(exp(0.5 * s))) / 0.5 AS v, stddev_samp(s) AS d FROM (SELECT DISTINCT seq, g, s FROM x) GROUP BY g), st AS (SELECT g, avg(v) AS mean, stddev_pop(v) AS dev FROM (SELECT g, v FROM n UNION ALL SELECT g, v FROM root) GROUP BY g)
    SELECT seq, pos::INT AS pos, round(CASE WHEN coalesce(d, 0) < 1e-12 THEN 0 ELSE (n.v - mean) / (dev + 1e-6) END, 6) AS adv FROM x JOIN n USING (g, pos, h) JOIN root USING (g) JOIN st USING (g)""",
)(
    lambda spark, sf: ad.prefix_tree(tokens(spark, sf).withColumn("g", F.floor(F.col("seq") / 4)).withColumn("s", F.col("seq") % 5).withColumn("tok", F.col("m") + F.floor(F.col("v"))), ["g"], "seq", "pos", "tok", "s", 0.5).select("seq", "pos", r6("adv"))
)
query("multi_turn_baseline", f"{T}, k AS (SELECT *, sum(m) OVER (PARTITION BY seq ORDER BY pos) AS kp FROM t), b AS (SELECT *, sum(r * v) OVER w / (sum(v) OVER w + 1e-8) AS b FROM k WHERE m = 1 WINDOW w AS (PARTITION BY seq % 50, kp)) SELECT seq, pos::INT AS pos, round(r - b, 6) AS adv FROM b UNION ALL SELECT seq, pos::INT, 0 FROM k WHERE m = 0")(
    lambda spark, sf: ad.multi_turn_token_baseline(tokens(spark, sf).withColumn("g", F.col("seq") % 50), ["g"], "seq", "pos", "r", "v", "m").select("seq", "pos", r6("adv"))
)
query("with_ancestors", PS + ", u AS (SELECT id AS node, id AS a FROM q WHERE id % 7 = 3 UNION ALL SELECT node, a // 2 FROM u WHERE a > 0) SELECT DISTINCT a AS id FROM u")(
    lambda spark, sf: trees.with_ancestors(programs(spark, sf).select("id", "parent"), "id", "parent", programs(spark, sf).filter("id % 7 = 3").select(F.col("id").alias("leaf")), "leaf").select("id")
)
query("span_scores", f"{T} SELECT seq, pos::INT AS pos, CASE WHEN pos IN (1, 2) THEN seq % 10 WHEN pos = 4 THEN 5 ELSE 0 END::DOUBLE AS score FROM t")(
    lambda spark, sf: trees.span_scores(tokens(spark, sf).select("seq", "pos"), "seq", "pos", tokens(spark, sf).select("seq").distinct().select("seq", F.explode(F.array(F.struct(F.lit(1).alias("a"), F.lit(3).alias("b"), (F.col("seq") % 10).cast("double").alias("s")), F.struct(F.lit(4).alias("a"), F.lit(5).alias("b"), F.lit(5.0).alias("s")))).alias("x")).select("seq", "x.*"), "a", "b", "s").select("seq", "pos", "score")
)
query("last_token_scores", f"{T} SELECT seq, pos::INT AS pos, CASE WHEN pos = max(CASE WHEN m = 1 THEN pos END) OVER (PARTITION BY seq) THEN r ELSE 0 END AS token_score FROM t")(lambda spark, sf: trees.last_token_scores(tokens(spark, sf), "seq", "pos", "m", "r").select("seq", "pos", "token_score"))
query(
    "best_by_tier",
    """WITH e AS (SELECT user_id, event_id, event_type AS t, event_id % 2 = 0 AS c, value FROM events), x AS (SELECT *, CASE WHEN NOT c THEN 2 WHEN row_number() OVER (PARTITION BY user_id, t, c ORDER BY value DESC, event_id) = 1 THEN 0 ELSE 1 END AS tier FROM e),
    p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tier, value DESC, event_id) AS place FROM x)
    SELECT u.user_id, i::INT AS place, coalesce(t, '') AS t FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN range(1, 9) r(i) LEFT JOIN p ON p.user_id = u.user_id AND p.place = i""",
)(lambda spark, sf: trees.best_by_tier(table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("t"), (F.col("event_id") % 2 == 0).alias("c"), "value"), ["user_id"], "t", "c", "value", "event_id", 8).select("user_id", "place", "t"))

# Batches

query("folded", "SELECT o_orderkey // 4 AS pos, count(*)::INT AS n, round(sum(o_totalprice), 2) AS total, arg_min(o_custkey, o_orderkey) AS first FROM orders GROUP BY 1")(
    lambda spark, sf: batch.folded(table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), "o_custkey", "o_totalprice"), "pos", 4, ["o_custkey", "o_totalprice"]).select("pos", F.size("o_custkey").alias("n"), F.round(F.aggregate("o_totalprice", F.lit(0.0), lambda a, x: a + x), 2).alias("total"), F.col("o_custkey")[0].alias("first"))
)
query("unfolded", "SELECT vec_id * 64 + i AS pos, embedding[i + 1] AS embedding FROM embeddings, range(64) t(i)")(lambda spark, sf: batch.unfolded(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "pos"), "pos", 64, ["embedding"]))
query("renamed", "SELECT o_orderkey AS k, o_custkey AS c FROM orders")(lambda spark, sf: batch.chosen(batch.renamed(table(spark, sf, "orders"), ["o_orderkey", "o_custkey"], ["k", "c"]), ["k", "c"]))
query("popped", "SELECT o_orderkey FROM orders")(lambda spark, sf: batch.popped(table(spark, sf, "orders"), ["o_orderkey"])[0])
query("last_columns", "SELECT vec_id, list_sum(embedding[62:64]::DOUBLE[]).round(5) AS total FROM embeddings")(lambda spark, sf: table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(batch.last_columns(F.col("embedding"), 3), F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total")))
query("loss_mask", f"{T} SELECT seq, sum(m * (pos % 2))::BIGINT AS n FROM t GROUP BY seq")(
    lambda spark, sf: tokens(spark, sf).groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("x")).select("seq", F.aggregate(batch.loss_mask(F.transform("x", lambda x: x["m"]), F.transform("x", lambda x: x["pos"] % 2)), F.lit(0), lambda a, x: a + x).cast("long").alias("n"))
)
query("mini_batches", "SELECT e::INT AS epoch, count(*) AS batches, 5 AS least, 5 AS most FROM range(2) t(e), (SELECT DISTINCT n_nationkey // 5 AS b FROM nation) GROUP BY 1")(
    lambda spark, sf: balance.mini_batches(table(spark, sf, "nation"), "n_nationkey", 5, 2, 7).groupBy("epoch", "batch").agg(F.count(F.lit(1)).alias("n")).groupBy("epoch").agg(F.count(F.lit(1)).alias("batches"), F.min("n").cast("int").alias("least"), F.max("n").cast("int").alias("most"))
)
query("merged_results", "SELECT o_orderkey AS k, o_custkey AS a, NULL::BIGINT AS b FROM orders UNION ALL SELECT o_orderkey, NULL, o_custkey FROM orders")(
    lambda spark, sf: table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("a")).unionByName(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("b")), allowMissingColumns=True)
)

# Functions that had no query

query("event_windows", "SELECT floor(epoch(ts) / 3600)::BIGINT AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(
    lambda spark, sf: replay.event_windows(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["event_type"], "value").select(F.floor(F.unix_timestamp("start") / 3600).alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))
)
query("position_sums", f"{T} SELECT seq, sum(CASE WHEN m = 1 THEN c - 1 ELSE 0 END)::BIGINT AS total FROM (SELECT seq, m, sum(m) OVER (PARTITION BY seq ORDER BY pos) AS c FROM t) GROUP BY seq")(
    lambda spark, sf: tokens(spark, sf).groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("x")).select("seq", F.aggregate(batch.position_ids(F.transform("x", lambda x: x["m"])), F.lit(0), lambda a, x: a + x).cast("long").alias("total"))
)
query("logit_squares", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: exp(2 * x::DOUBLE))) / pow(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE))), 2), 6) AS squares FROM embeddings")(
    lambda spark, sf: table(spark, sf, "embeddings").select("vec_id", r6(losses.sum_of_squares(F.transform("embedding", lambda x: x.cast("double"))), "squares"))
)


def _among(values: list[str], by: str = "event_id"):
    """One of some texts, by a number."""
    return F.get(F.array(*map(F.lit, values)), (F.col(by) % len(values)).cast("int"))


_TIERS = "CASE WHEN f >= 1 THEN CASE WHEN v THEN 1.0 ELSE 0.8 END WHEN v THEN CASE WHEN r THEN 0.3 ELSE 0.2 END ELSE 0.1 END"
_SOFT = "CASE WHEN f > 0 THEN CASE WHEN v THEN f ELSE f - 0.2 END WHEN v THEN CASE WHEN r THEN 0.3 ELSE 0.2 END ELSE 0.0 END"
query("score_tiers", f"WITH t AS (SELECT event_id, (event_id % 3) / 2 AS f, event_id % 5 < 2 AS v, event_id % 7 < 3 AS r FROM events) SELECT event_id, round({_TIERS}, 6)::DOUBLE AS em, round({_SOFT}, 6)::DOUBLE AS f1 FROM t")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", (F.col("event_id") % 3 / 2).alias("f"), (F.col("event_id") % 5 < 2).alias("v"), (F.col("event_id") % 7 < 3).alias("r"))
    .select("event_id", r6(tx.score_tiers(F.col("f"), F.col("v"), F.col("r"), variant="em"), "em"), r6(tx.score_tiers(F.col("f"), F.col("v"), F.col("r")), "f1"))
)
query("abstractions", "SELECT event_id, array_to_string(['a b' || event_id || ' c', '[X] b' || event_id || ' c', 'a [X] c', 'a b' || event_id || ' [X]', '[X] c', 'a [X]', '[X]'], '|') AS forms FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", F.array_join(tx.abstractions(F.array(F.lit("a"), F.concat(F.lit("b"), F.col("event_id").cast("string")), F.lit("c"))), "|").alias("forms"))
)
query("question_reference", "SELECT event_id, 'who is [X] of [X] at # x' AS question FROM events")(lambda spark, sf: table(spark, sf, "events").select("event_id", tx.question_reference(F.concat(F.lit("who is #"), F.col("event_id").cast("string"), F.lit(" of #2 at # x"))).alias("question")))
query("clock_seconds", "SELECT event_id, (event_id % 24) * 3600 + (event_id % 60) * 60 + event_id % 59 AS seconds FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", tx.clock_seconds(F.format_string("%02d:%02d:%02d", F.col("event_id") % 24, F.col("event_id") % 60, F.col("event_id") % 59)).alias("seconds"))
)
query("pattern_counts", r"SELECT doc_id, len(regexp_extract_all(text, '\n'))::INT AS lines, len(regexp_extract_all(text, '[0-9]+'))::INT AS numbers FROM documents")(lambda spark, sf: table(spark, sf, "documents").select("doc_id", *tx.pattern_counts(F.col("text"), {"lines": r"\n", "numbers": "[0-9]+"})))
query("hops", "SELECT event_id, (event_id % 5)::INT AS hops FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", readers.hops(F.when(F.col("event_id") % 5 > 0, F.struct(F.array_repeat(F.lit("q"), (F.col("event_id") % 5).cast("int")).alias("question_decomposition")))).alias("hops"))
)
query("flattened", 'SELECT o_orderkey AS k, o_custkey AS "a/b/c", o_orderstatus AS "a/d" FROM orders')(
    lambda spark, sf: readers.flatten(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.struct(F.struct(F.col("o_custkey").alias("c")).alias("b"), F.col("o_orderstatus").alias("d")).alias("a")))
)
query("call_costs", "SELECT o_orderkey, round(o_custkey * CASE WHEN o_orderstatus = 'F' THEN 2.0 WHEN o_orderstatus = 'O' THEN CASE WHEN o_custkey > 50 THEN 6.0 ELSE 3.0 END END / 1e6, 9) AS cost FROM orders")(
    lambda spark, sf: readers.price(
        spark.createDataFrame([("F", None, 2.0, 9.0), ("O", 50, 3.0, 6.0)], "o_orderstatus string, beyond long, low double, high double"), table(spark, sf, "orders"), "o_orderstatus", "o_custkey", "beyond", "low", "high"
    ).select("o_orderkey", F.round("cost", 9).alias("cost"))
)
query("read_files", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")(lambda spark, sf: readers.read_files(spark, [f"{sf}/nation.parquet", f"{sf}/nation.parquet"]).select("n_nationkey", "n_name"))
query("padded_arrays", f"{T} SELECT seq, count(*)::INT AS n, array_to_string(list_concat(list(pos ORDER BY pos)[1:4], list_transform(range(greatest(4 - count(*), 0)), lambda i: 9)), ',') AS padded FROM t GROUP BY seq")(
    lambda spark, sf: tokens(spark, sf).groupBy("seq").agg(F.sort_array(F.collect_list("pos")).alias("x")).select("seq", F.size("x").alias("n"), F.array_join(F.transform(batch.pad_array(F.col("x"), 4, 9), lambda x: x.cast("string")), ",").alias("padded"))
)
query("without_pads", f"{T} SELECT seq, array_to_string(coalesce(list(pos ORDER BY pos) FILTER (m = 1), []), ',') AS kept FROM t GROUP BY seq")(
    lambda spark, sf: tokens(spark, sf).groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("x")).select("seq", F.array_join(F.transform(batch.without_pads(F.transform("x", lambda x: x["pos"]), F.transform("x", lambda x: x["m"])), lambda x: x.cast("string")), ",").alias("kept"))
)
query("padded_batch", "SELECT n_nationkey AS pos, n_name FROM nation UNION ALL SELECT n_nationkey + 25, n_name FROM nation WHERE n_nationkey < 7")(lambda spark, sf: batch.pad_to_multiple(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), "n_name"), "pos", 25, 8))
query("chunks", "SELECT n_nationkey AS pos, (n_nationkey // 5)::INT AS chunk FROM nation")(lambda spark, sf: batch.chunks(table(spark, sf, "nation").select(F.col("n_nationkey").alias("pos")), "pos", 5, 25))
query("inverse_order", "SELECT 24 - n_nationkey AS i, n_nationkey AS new FROM nation")(lambda spark, sf: batch.inverse(table(spark, sf, "nation").select(F.col("n_nationkey").alias("i"), (24 - F.col("n_nationkey")).alias("new")), "i", "new"))
query("leading_coverage", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1.0 ELSE (event_id % 4 - 1) / 3 END::DOUBLE AS share FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", similarity.coverage(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.when(i == F.col("event_id") % 4, 0.1).otherwise(0.9)), 0.5).alias("share"))
)
query("joint_score", "SELECT event_id, round(0.7 * greatest(event_id % 10, 4) / 10 + 0.3 * CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2.0 / 3 END, 6)::DOUBLE AS score FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", r6(similarity.joint_score(F.col("event_id") % 10 / 10, F.lit(0.4), F.array(F.lit(True), F.lit(False), F.lit(False)), F.array(F.lit(False), F.lit(True), F.col("event_id") % 2 == 0)), "score"))
)
query("log_probabilities", "SELECT vec_id, round(embedding[1]::DOUBLE - ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))), 6) AS first FROM embeddings")(lambda spark, sf: table(spark, sf, "embeddings").select("vec_id", F.round(F.get(losses.log_softmax(F.transform("embedding", lambda x: x.cast("double"))), F.lit(0)), 6).alias("first")))
query("bounded_queue")(
    lambda spark, sf: replay.bounded_queue(table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, "get").otherwise("put").alias("action"), F.col("event_id").alias("item")), "user_id", "event_id", "action", "item", 3)
    .groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("size") > 3) | (F.col("size") < 0)).alias("zero"))
)
query("stagnant", P + " SELECT id, generation - 2 >= 3 AS stagnant FROM p")(lambda spark, sf: programs(spark, sf).select("id", replay.stagnant(F.col("generation"), F.lit(2), 3).alias("stagnant")))
query("assistant_mask", "SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS kept, sum(length(text))::BIGINT AS whole FROM conversations GROUP BY 1")(
    lambda spark, sf: table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    .select("conv_id", readers.action_spans(F.transform("x", lambda x: F.array_repeat(F.lit(1), F.length(x["text"]))), F.transform("x", lambda x: x["role"] == "assistant")).alias("m"))
    .select("conv_id", F.size(F.filter("m", lambda v: v == 1)).cast("long").alias("kept"), F.size("m").cast("long").alias("whole"))
)


query("preference_rows", "SELECT 'q' || n_nationkey AS prompt, kind, 'q' || n_nationkey || ' ' || CASE kind WHEN 'chosen' THEN n_name ELSE 'no' END AS text FROM nation, (VALUES ('chosen'), ('rejected')) t(kind)")(
    lambda spark, sf: readers.preference_rows(table(spark, sf, "nation").select(F.concat(F.lit("q"), F.col("n_nationkey").cast("string")).alias("q"), "n_name", F.lit("no").alias("bad")), "q", "n_name", "bad")
)
query("preference_variants", "SELECT n_name AS prompt, n_nationkey AS index FROM nation")(
    lambda spark, sf: readers.preference_variants(table(spark, sf, "nation"), "n_name", "n_name", "n_name", "hh", "train", "n_nationkey")["rl"].select(F.col("prompt")[0]["content"].alias("prompt"), F.col("extra_info.index").alias("index"))
)
query("by_ordinal", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")(lambda spark, sf: readers.by_ordinal(table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k")), table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), "k").select("s_suppkey", "n_name"))
query("metric_rows", "SELECT o_orderkey AS step, 'total_at_1' AS key, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'odd_key', o_custkey::DOUBLE FROM orders WHERE o_custkey % 2 = 1")(
    lambda spark, sf: readers.metric_rows(table(spark, sf, "orders").select(F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("total@1"), F.when(F.col("o_custkey") % 2 == 1, F.col("o_custkey")).alias("odd:key")), "step", ["total@1", "odd:key"])
)
query("message_parts", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'text:look;image:;text: here' ELSE 'video:;image:;text:x' END AS parts FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", F.array_join(F.transform(readers.message_parts(_among(["look<image> here", "<video><image>x"])), lambda x: F.concat(x["type"], F.lit(":"), x["text"])), ";").alias("parts"))
)
query("gathered", "SELECT event_id, c_custkey, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")(
    lambda spark, sf: batch.gathered(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), table(spark, sf, "events").select("event_id", F.col("user_id").alias("c_custkey")), "c_custkey")
)
query("as_lists", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")(lambda spark, sf: batch.as_lists(table(spark, sf, "nation"), "n_nationkey", ["n_name"], ["n_regionkey"]).select("n_regionkey", F.array_join("n_name", ",").alias("names")))
query("uneven_rows", "SELECT event_id FROM events WHERE event_id % 5 = 3")(lambda spark, sf: batch.uneven(table(spark, sf, "events").select("event_id", F.array_repeat(F.lit(1), 3).alias("a"), F.array_repeat(F.lit(1), (3 + (F.col("event_id") % 5 == 3).cast("int"))).alias("b")), ["a", "b"]).select("event_id"))
query("fixed_kl_reward", f"{T} SELECT seq, pos::INT AS pos, round(r - 0.05 * (exp(least(greatest(old - new, -20), 20)) - least(greatest(old - new, -20), 20) - 1) * m, 6) AS reward FROM t")(
    lambda spark, sf: tokens(spark, sf).select("seq", "pos", r6(losses.reward_with_kl(F.col("r"), F.col("new"), F.col("old"), F.col("m"), 0.05, "k3+"), "reward"))
)
query("exploration_weights", PS + ", c AS (SELECT parent AS id, count(*) AS n FROM q WHERE parent IS NOT NULL GROUP BY 1), x AS (SELECT q.id, island, exp((10 * w + CASE WHEN n IS NULL THEN 1 ELSE 0 END) / 0.5 - max((10 * w + CASE WHEN n IS NULL THEN 1 ELSE 0 END) / 0.5) OVER (PARTITION BY island)) AS e FROM q LEFT JOIN c USING (id)) SELECT id, round(e / sum(e) OVER (PARTITION BY island), 9) AS weight FROM x")(
    lambda spark, sf: ranking.exploration_weights(programs(spark, sf).join(programs(spark, sf).filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id", "left"), "n", "w", 0.5, ["island"]).select("id", F.round("weight", 9).alias("weight"))
)
query("annealed", "SELECT event_id, round(1.5 - 1.2 * least(event_id % 130 / 100, 1), 6)::DOUBLE AS temperature FROM events")(lambda spark, sf: table(spark, sf, "events").select("event_id", r6(ranking.annealed(F.col("event_id") % 130, 100.0), "temperature")))
query("drawn", PS + ", c AS (SELECT *, sum(w + 0.1) OVER (PARTITION BY island ORDER BY id) AS c, sum(w + 0.1) OVER (PARTITION BY island) AS t FROM q) SELECT island, min(id) AS id FROM c WHERE c > 0.371 * t GROUP BY island")(
    lambda spark, sf: ranking.drawn(programs(spark, sf).withColumn("w", F.expr("w + 0.1")), ["island"], "id", "w", F.lit(0.371)).select("island", "id")
)
query("nucleus", "WITH e AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE / 0.7 AS x FROM embeddings, range(64) t(i)), p AS (SELECT *, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM e), c AS (SELECT *, row_number() OVER o AS r, sum(p) OVER o - p AS c FROM p WINDOW o AS (PARTITION BY vec_id ORDER BY x DESC, i)) SELECT vec_id, count(*) AS n, min(i)::INT AS least, round(sum(p), 6) AS mass FROM c WHERE r <= 20 AND round(c, 9) < 0.25 GROUP BY 1")(
    lambda spark, sf: ranking.nucleus(table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double")), ["vec_id"], "i", "x", 0.7, 20, 0.25).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("least"), r6(F.sum("prob"), "mass"))
)
query("new_only", "SELECT min(event_id) AS event_id FROM events WHERE event_type <> 'click' GROUP BY event_type, user_id")(
    lambda spark, sf: ranking.new_only(table(spark, sf, "events").select("event_id", "event_type", "user_id"), table(spark, sf, "events").filter("event_type = 'click'").select("event_type", "user_id"), ["event_type", "user_id"], "event_id").select("event_id")
)
query("common_rows", "SELECT DISTINCT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")(lambda spark, sf: table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select("s_nationkey")))
query("distinct_messages", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY 1")(lambda spark, sf: table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("types")))
query("initialised_islands", PS + " SELECT DISTINCT island FROM q WHERE correct")(lambda spark, sf: _programs(spark, sf).filter("correct").select("island").distinct())
query("goal_values", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE least(greatest(value / 50 - 0.5, 0), 1) END::DOUBLE AS v FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", grading.goal_value(F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.col("value") / 50 - 0.5)).alias("v"))
)
query("principal_components")(lambda spark, sf: embedding.principal(table(spark, sf, "embeddings"), "embedding", 2).select("vec_id", F.round(F.abs(F.col("reduced")[0]), 4).alias("x"), F.round(F.abs(F.col("reduced")[1]), 4).alias("y")))
query("embedding_clusters")(lambda spark, sf: embedding.clusters(table(spark, sf, "embeddings"), "embedding", 4, components=2).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")))
