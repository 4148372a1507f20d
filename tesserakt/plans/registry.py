"""All queries of the engine by name, and their SQL.

Tables play the roles of a training run: `events` are scored rollouts (group:
user and day, tree: kind of event), `lineitem` tokens of sequences (order),
`part` programs (parent: half the key), `customer` and `supplier` programs on
islands (nation), `documents`, `benchmark` and `conversations` texts.
Floating-point results are rounded, as sums depend on order: to 6 places, or to 10
where exact ties at the seventh place are common.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserakt.functions import text as tx
from tesserakt.operators import advantage as ad
from tesserakt.operators import batch, correction, grouped, losses, ranking, similarity, trees
from tesserakt.streaming import replay

FLAGSHIP = "grpo"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col, 6)
    return out.alias(name or c) if name or isinstance(c, str) else out


# Advantages of rollouts


def rollouts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", (F.col("value") - 50).alias("s"), F.length("props").alias("len"))


GROUP = ["user_id", "day"]
R = "WITH r AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, value - 50 AS s, length(props) AS len FROM events)"
STATS = R + ", g AS (SELECT *, count(*) OVER w AS n, avg(s) OVER w AS m, stddev_samp(s) OVER w AS d, sum(s) OVER w AS t, sum(s * s) OVER w AS q FROM r WINDOW w AS (PARTITION BY user_id, day))"
GRPO = "CASE WHEN n > 1 THEN (s - m) / (d + 1e-6) ELSE s / (1 + 1e-6) END"


def _advantage(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql)(lambda spark, sf: f(rollouts(spark, sf)).select("event_id", r6("adv")))


_advantage("grpo", f"{STATS} SELECT event_id, round({GRPO}, 6) AS adv FROM g", lambda r: ad.grpo(r, "s", GROUP))
_advantage("grpo_mean_only", f"{STATS} SELECT event_id, round(CASE WHEN n > 1 THEN s - m ELSE s END, 6) AS adv FROM g", lambda r: ad.grpo(r, "s", GROUP, by_std=False))
_advantage("grpo_vectorized", f"{STATS} SELECT event_id, round(CASE WHEN n > 1 THEN (s - t / n) / (sqrt(greatest((q - t * t / n) / (n - 1), 1e-6)) + 1e-6) ELSE s / (1 + 1e-6) END, 6) AS adv FROM g", lambda r: ad.grpo_vectorized(r, "s", GROUP))
_advantage(
    "grpo_weighted",
    f"""{STATS}, w AS (SELECT *, (CASE WHEN s > 0 THEN exp(2) ELSE 1 END) / (exp(2) * greatest(sum((s > 0)::INT) OVER p, 1) + n - sum((s > 0)::INT) OVER p) AS w FROM g WINDOW p AS (PARTITION BY user_id, day)),
    c AS (SELECT *, sum(w * s) OVER (PARTITION BY user_id, day) AS wm FROM w)
    SELECT event_id, round((s - wm) * w * n / (CASE WHEN n > 1 THEN d ELSE 1 END + 1e-6), 6) AS adv FROM c""",
    lambda r: ad.grpo_weighted(r, "s", GROUP),
)
_advantage(
    "tilted",
    f"{R}, e AS (SELECT *, exp(0.01 * s - max(0.01 * s) OVER w) AS e FROM r WINDOW w AS (PARTITION BY user_id, day)) SELECT event_id, round(e / avg(e) OVER (PARTITION BY user_id, day) - 1, 6) AS adv FROM e",
    lambda r: ad.tilt(r, "s", GROUP, 0.01),
)
_advantage(
    "tree_inner",
    f"""{STATS}, a AS (SELECT *, {GRPO} AS a FROM g), b AS (SELECT *, count(*) OVER w AS n2, avg(a) OVER w AS m2, stddev_samp(a) OVER w AS d2 FROM a WINDOW w AS (PARTITION BY user_id, event_type))
    SELECT event_id, round(CASE WHEN n2 > 1 THEN (a - m2) / (d2 + 1e-6) ELSE a / (1 + 1e-6) END, 6) AS adv FROM b""",
    lambda r: ad.tree_inner(r, "s", GROUP, ["user_id", "event_type"]),
)
_advantage(
    "tree_inner_tilted",
    f"""{R}, e AS (SELECT *, exp(0.01 * s - max(0.01 * s) OVER w) AS e FROM r WINDOW w AS (PARTITION BY user_id, day)), f AS (SELECT *, e / avg(e) OVER (PARTITION BY user_id, day) - 1 AS a FROM e),
    h AS (SELECT *, exp(0.01 * a - max(0.01 * a) OVER w) AS e2 FROM f WINDOW w AS (PARTITION BY user_id, event_type)) SELECT event_id, round(e2 / avg(e2) OVER (PARTITION BY user_id, event_type) - 1, 6) AS adv FROM h""",
    lambda r: ad.tree_inner_tilted(r, "s", GROUP, ["user_id", "event_type"], 0.01),
)
_advantage(
    "tree_sum",
    f"""{STATS}, b AS (SELECT *, {GRPO} AS a, count(*) OVER w AS n2, avg(s) OVER w AS m2, stddev_samp(s) OVER w AS d2 FROM g WINDOW w AS (PARTITION BY user_id, event_type))
    SELECT event_id, round(a + CASE WHEN n2 > 1 THEN (s - m2) / (d2 + 1e-6) ELSE s / (1 + 1e-6) END, 6) AS adv FROM b""",
    lambda r: ad.tree_sum(r, "s", GROUP, ["user_id", "event_type"]),
)
for _v, _c in (("reward", "s"), ("advantage", "a")):
    _advantage(
        f"maxrl_{_v}",
        f"""{STATS}, a AS (SELECT *, {GRPO} AS a FROM g), k AS (SELECT *, sum(({_c} > 0)::INT) OVER (PARTITION BY user_id, day) AS k FROM a)
        SELECT event_id, round(a * CASE WHEN k > 0 AND k < n THEN n / k ELSE 1 END, 6) AS adv FROM k""",
        lambda r, v=_v: ad.maxrl(r, "s", GROUP, v),
    )
_advantage("rloo", f"{STATS} SELECT event_id, round(CASE WHEN n > 1 THEN (n * s - t) / (n - 1) ELSE s END, 6) AS adv FROM g", lambda r: ad.rloo(r, "s", GROUP))
_advantage("rloo_vectorized", f"{STATS} SELECT event_id, round(CASE WHEN n > 1 THEN (n * s - t) / (n - 1) ELSE 0 END, 6) AS adv FROM g", lambda r: ad.rloo(r, "s", GROUP, "vectorized"))
_advantage("opo", f"{STATS} SELECT event_id, round(s - CASE WHEN n > 1 THEN sum(len * s) OVER p / sum(len) OVER p ELSE 0 END, 6) AS adv FROM g WINDOW p AS (PARTITION BY user_id, day)", lambda r: ad.opo(r, "s", "len", GROUP))
_advantage("gpg", f"{STATS} SELECT event_id, round((SELECT count(*) / greatest(sum((s <> 0)::INT), 1) FROM r) * (s - CASE WHEN n > 1 THEN m ELSE 0 END), 6) AS adv FROM g", lambda r: ad.gpg(r, "s", GROUP))
_advantage(
    "pass_at_k",
    f"""{R}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id) AS k, stddev_samp(s) OVER (PARTITION BY user_id) AS d FROM r),
    q AS (SELECT *, max(CASE WHEN k = 2 THEN s END) OVER (PARTITION BY user_id) AS second FROM p) SELECT event_id, round(CASE WHEN k = 1 THEN (s - second) / (d + 1e-6) ELSE 0 END, 6) AS adv FROM q""",
    lambda r: ad.pass_at_k(r, "s", ["user_id"], "event_id"),
)
_advantage(
    "reinforce_pp_baseline",
    f"{STATS}, b AS (SELECT event_id, s - CASE WHEN n > 1 THEN m ELSE 0 END AS x FROM g) SELECT event_id, round((x - avg(x) OVER ()) / sqrt(var_samp(x) OVER () + 1e-8), 6) AS adv FROM b",
    lambda r: ad.reinforce_baseline(r, "s", GROUP),
)
_advantage(
    "gdpo",
    f"""{R}, g AS (SELECT *, count(*) OVER w AS n, avg(s) OVER w AS m, stddev_samp(s) OVER w AS d, avg(len) OVER w AS m2, stddev_samp(len) OVER w AS d2 FROM r WINDOW w AS (PARTITION BY user_id)),
    b AS (SELECT event_id, 0.7 * CASE WHEN n > 1 THEN (s - m) / (d + 1e-6) ELSE s / (1 + 1e-6) END + 0.3 * CASE WHEN n > 1 THEN (len - m2) / (d2 + 1e-6) ELSE len / (1 + 1e-6) END AS x FROM g)
    SELECT event_id, round((x - avg(x) OVER ()) / sqrt(var_samp(x) OVER () + 1e-8), 6) AS adv FROM b""",
    lambda r: ad.gdpo(r, ["s", "len"], [0.7, 0.3], ["user_id"]),
)
_advantage(
    "multi_trajectory",
    f"""{R}, l AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, day ORDER BY event_id DESC) = 1 THEN s END AS x FROM r),
    g AS (SELECT *, count(x) OVER w AS n, avg(x) OVER w AS m, stddev_samp(x) OVER w AS d FROM l WINDOW w AS (PARTITION BY user_id))
    SELECT event_id, round(max(CASE WHEN n > 1 THEN (x - m) / (d + 1e-6) ELSE x / (1 + 1e-6) END) OVER (PARTITION BY user_id, day), 6) AS adv FROM g""",
    lambda r: ad.multi_trajectory(r, "s", ["user_id"], ["day"], "event_id"),
)
_advantage("whitened", f"{R} SELECT event_id, round((s - avg(s) OVER ()) / sqrt(var_samp(s) OVER () + 1e-8), 6) AS adv FROM r", lambda r: ad.whitened(r, "s"))


@query("entropic_risk", f"{R}, t AS (SELECT user_id, max(0.05 * s) AS t FROM r GROUP BY 1) SELECT user_id, round((ln(avg(exp(0.05 * s - t))) + any_value(t)) / 0.05, 6) AS risk FROM r JOIN t USING (user_id) GROUP BY user_id")
def _risk(spark, sf):
    return ad.entropic_risk(rollouts(spark, sf), "s", ["user_id"], 0.05).select("user_id", r6("risk"))


# Tokens: one row for each line of an order


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    logs = ((-F.col("l_discount") * 10 - 0.1).alias("old"), (-F.col("l_tax") * 10 - 0.1).alias("new"))
    return line.select(F.col("l_orderkey").alias("seq"), F.row_number().over(w).alias("pos"), *logs, (F.col("l_quantity") / 10 - 2.5).alias("r"), (F.col("l_extendedprice") / 10000).alias("v"), F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("m"))


T = """WITH t AS (SELECT l_orderkey AS seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS pos,
  -l_discount * 10 - 0.1 AS old, -l_tax * 10 - 0.1 AS new, l_quantity / 10 - 2.5 AS r, l_extendedprice / 10000 AS v, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS m FROM lineitem)"""


def _arrays(spark: SparkSession, sf: str) -> DataFrame:
    rows = tokens(spark, sf).groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("pos", "r", "v", "m", "old", "new"))).alias("x"))
    return rows.select("seq", *(F.col("x")[c].alias(c) for c in ("pos", "r", "v", "m", "old", "new")))


def _by_token(df: DataFrame, value: Column, places: int = 10) -> DataFrame:
    return df.select("seq", F.posexplode(value).alias("i", "x")).select("seq", (F.col("i") + 1).alias("pos"), F.round("x", places).alias("adv"))


_RECURSE = """, k AS (SELECT *, count(*) OVER (PARTITION BY seq) AS n FROM t), f AS (
  SELECT seq, pos, {first} FROM k WHERE pos = n UNION ALL SELECT k.seq, k.pos, {step} FROM f JOIN k ON k.seq = f.seq AND k.pos = f.pos - 1)
SELECT seq, pos::INT AS pos, round(adv, {places}) AS adv FROM f"""


def _recursive(first: str, step: str, places: int = 8) -> str:
    return T.replace("WITH t", "WITH RECURSIVE t", 1) + _RECURSE.format(first=first, step=step, places=places)


@query("discounted_returns", _recursive("r AS adv, r * m AS run", "k.r + 0.9 * f.run, (k.r + 0.9 * f.run) * k.m", 10))
def _returns(spark, sf):
    a = _arrays(spark, sf)
    return _by_token(a, ad.discounted_returns("r", "m", 0.9))


@query("gae", _recursive("(r - v) * m AS adv, v * m AS nv", "(k.r + 0.9090909090909091 * f.nv - k.v + 0.9090909090909091 * 0.95 * f.adv) * k.m + (1 - k.m) * f.adv, k.v * k.m + (1 - k.m) * f.nv"))
def _gae(spark, sf):
    return _by_token(_arrays(spark, sf), ad.gae("r", "v", "m", 0.9090909090909091, 0.95), 8)


@query("gae_unmasked", _recursive("r - v AS adv, v AS nv", "k.r + 0.9090909090909091 * f.nv - k.v + 0.9090909090909091 * 0.95 * f.adv, k.v"))
def _gae_ignore(spark, sf):
    return _by_token(_arrays(spark, sf), ad.gae("r", "v", "m", 0.9090909090909091, 0.95, "ignore"), 8)


@query("remax", T + " SELECT seq, pos::INT AS pos, round(sum(r * m) OVER (PARTITION BY seq ORDER BY pos DESC) - first_value(r) OVER (PARTITION BY seq ORDER BY pos) * m, 10) AS adv FROM t")
def _remax(spark, sf):
    a = _arrays(spark, sf).withColumn("base", F.get("r", F.lit(0)))
    return _by_token(a, ad.remax("r", "base", "m"))


@query("per_token_advantage", T + ", g AS (SELECT *, count(CASE WHEN m = 1 THEN r END) OVER w AS n, avg(CASE WHEN m = 1 THEN r END) OVER w AS mu, stddev_samp(CASE WHEN m = 1 THEN r END) OVER w AS d FROM t WINDOW w AS (PARTITION BY seq)) SELECT seq, pos::INT AS pos, round(CASE WHEN m = 1 THEN (r - mu) / (CASE WHEN n > 1 THEN d ELSE 1 END + 1e-6) ELSE 0 END, 6) AS adv FROM g")
def _per_token(spark, sf):
    return ad.per_token(tokens(spark, sf), "r", "m", ["seq"]).select("seq", "pos", r6("adv"))


CLAMP = "least(greatest({0}, -20), 20)"
RATIO = "exp(least(greatest(new - old, -20), 20))"
for _kind, _sql in (("k1", "new - old"), ("abs", "abs(new - old)"), ("k2", "0.5 * (new - old) * (new - old)"), ("k3", "least(greatest(exp(least(greatest(old - new, -20), 20)) - least(greatest(old - new, -20), 20) - 1, -10), 10)")):
    query(f"kl_{_kind}", f"{T} SELECT seq, pos::INT AS pos, round({_sql}, 6) AS kl FROM t")(lambda spark, sf, k=_kind: tokens(spark, sf).select("seq", "pos", r6(losses.kl_penalty(F.col("new"), F.col("old"), k), "kl")))

_CLIP = f"least(greatest({RATIO}, 0.8), 1.2)"
_LOSSES: dict[str, tuple[str, Callable[[], Column]]] = {
    "loss_clipped": (f"CASE WHEN r < 0 THEN least(-r * 3, greatest(-r * {RATIO}, -r * {_CLIP})) ELSE greatest(-r * {RATIO}, -r * {_CLIP}) END", lambda: losses.clipped_loss(F.col("new"), F.col("old"), F.col("r"))),
    "loss_clip_fraction": (f"CASE WHEN -r * {_CLIP} > -r * {RATIO} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", lambda: losses.was_clipped(F.col("new"), F.col("old"), F.col("r"))),
    "loss_soft_gate": (f"-(1 / (1 + exp(-(CASE WHEN r > 0 THEN 1.0 ELSE 1.05 END) * ({RATIO} - 1)))) * 4 / (CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 1.05::DOUBLE END) * r", lambda: losses.soft_gate_loss(F.col("new"), F.col("old"), F.col("r"))),
    "loss_clipped_weight": (f"-{_CLIP} * r * new", lambda: losses.clipped_weight_loss(F.col("new"), F.col("old"), F.col("r"))),
    "loss_log_likelihood": ("-new * r", lambda: losses.log_likelihood_loss(F.col("new"), F.col("r"))),
    "loss_weighted_reinforce": (f"-new * r * {RATIO}", lambda: losses.weighted_reinforce_loss(F.col("new"), F.col("r"), losses.ratio(F.col("new"), F.col("old")))),
    "loss_value": ("0.5 * greatest((v - r) * (v - r), (least(greatest(v, old - 0.5), old + 0.5) - r) * (least(greatest(v, old - 0.5), old + 0.5) - r))", lambda: losses.value_loss(F.col("v"), F.col("old"), F.col("r"))),
    "reward_penalised": ("r - (old - new) * 0.1", lambda: losses.penalised_reward(F.col("r"), F.col("old"), F.col("new"), 0.1)),
}
for _name, (_sql, _f) in _LOSSES.items():
    query(_name, f"{T} SELECT seq, pos::INT AS pos, round({_sql}, 6) AS loss FROM t")(lambda spark, sf, f=_f: tokens(spark, sf).select("seq", "pos", r6(f(), "loss")))

query("overlong_penalty", "SELECT doc_id, round(least(-(n_chars - (4000 - 1000)) / 1000 * 0.5, 0), 6) AS penalty FROM documents")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", r6(losses.overlong_penalty(F.col("n_chars"), 4000, 1000, 0.5), "penalty"))
)
query(
    "logit_entropy",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT vec_id, ln(sum(exp(x))) AS l FROM e GROUP BY 1)
    SELECT vec_id, round(-sum((x - l) * exp(x - l)), 6) AS entropy, round(sum(exp(2 * (x - l))), 6) AS squares FROM e JOIN s USING (vec_id) GROUP BY vec_id""",
)(lambda spark, sf: table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x")).select("vec_id", r6(losses.entropy(F.col("x")), "entropy"), r6(losses.sum_of_squares(F.col("x")), "squares")))

# Off-policy correction

_X = "new - old"
query("is_token", f"{T} SELECT seq, pos::INT AS pos, round(least({RATIO}, 2) * m, 6) AS weight FROM t")(lambda spark, sf: correction.importance_weights(tokens(spark, sf).withColumn("x", F.expr(_X)), "seq", "x", "m").select("seq", "pos", r6("weight")))
query(
    "is_sequence",
    f"{T}, q AS (SELECT *, sum(CASE WHEN m = 1 THEN {_X} ELSE 0 END) OVER (PARTITION BY seq) AS x FROM t) SELECT seq, pos::INT AS pos, round(CASE WHEN exp(least(greatest(x, -20), 20)) BETWEEN 0.5 AND 2 THEN exp(least(greatest(x, -20), 20)) ELSE 0 END * m, 6) AS weight FROM q",
)(lambda spark, sf: correction.importance_weights(tokens(spark, sf).withColumn("x", F.expr(_X)), "seq", "x", "m", "sequence", "0.5_2").select("seq", "pos", r6("weight")))
query(
    "rejection_mask",
    f"""{T}, q AS (SELECT *, avg(CASE WHEN m = 1 THEN {_X} END) OVER (PARTITION BY seq) AS a, max(CASE WHEN m = 1 THEN 0.5 * ({_X}) * ({_X}) END) OVER (PARTITION BY seq) AS b FROM t)
    SELECT seq, pos::INT AS pos, CASE WHEN m = 1 AND exp({_X}) - 1 - ({_X}) <= 0.08 AND -a >= ln(0.5) AND -a <= ln(2.0) AND b <= 0.3 THEN 1 ELSE 0 END AS kept FROM q""",
)(lambda spark, sf: correction.rejection_mask(tokens(spark, sf).withColumn("x", F.expr(_X)), "seq", "x", "m", {"token_k3": 0.08, "seq_mean_k1": "0.5_2.0", "seq_max_k2": 0.3}).select("seq", "pos", "kept"))
query(
    "is_statistics",
    f"{T}, w AS (SELECT least({RATIO}, 2) AS w FROM t WHERE m = 1) SELECT round(avg(w), 6) AS mean, round(max(w), 6) AS max, round(min(w), 6) AS min, round(avg(w) * avg(w) / avg(w * w), 6) AS ess FROM w",
)(lambda spark, sf: correction.weight_statistics(correction.importance_weights(tokens(spark, sf).withColumn("x", F.expr(_X)), "seq", "x", "m"), "weight", "m").select(*(r6(c) for c in ("mean", "max", "min", "ess"))))
query(
    "offpolicy_statistics",
    f"""{T}, k AS (SELECT round(avg(-(old - new)), 6) AS kl, round(avg(exp(old - new) - 1 - (old - new)), 6) AS k3_kl, round(avg(exp(2 * (old - new))) - 1, 6) AS chi2_token FROM t WHERE m = 1),
    s AS (SELECT avg(old) AS o, avg(new) AS n, sum(old - new) AS x FROM t WHERE m = 1 GROUP BY seq),
    q AS (SELECT round(avg(exp(-o)), 6) AS training_ppl, round(avg(exp(-n)), 6) AS rollout_ppl, round(avg(exp(o - n)), 6) AS ppl_ratio, round(avg(exp(2 * least(greatest(x, -20), 20))) - 1, 6) AS chi2_seq FROM s) SELECT * FROM k, q""",
)(lambda spark, sf: correction.offpolicy_statistics(tokens(spark, sf), "seq", "old", "new", "m").select(*(r6(c) for c in ("kl", "k3_kl", "chi2_token", "training_ppl", "rollout_ppl", "ppl_ratio", "chi2_seq"))))

# Statistics

query("group_stats", f"{R} SELECT user_id, day, count(*) AS n, round(CASE WHEN count(*) > 1 THEN avg(s) ELSE 0 END, 6) AS mean, round(CASE WHEN count(*) > 1 THEN sqrt(greatest(var_samp(s), 1e-6)) ELSE 1 END, 6) AS std FROM r GROUP BY 1, 2")(
    lambda spark, sf: grouped.group_mean_std(rollouts(spark, sf), "s", GROUP).select("user_id", "day", "n", r6("mean"), r6("std"))
)
query("dense_index", "SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS gidx FROM events")(lambda spark, sf: grouped.dense_index(table(spark, sf, "events"), "event_type").select("event_id", "gidx"))
query(
    "masked_stats",
    f"{T} SELECT seq, round(sum(r * m), 6) AS masked_sum, round(sum(r * m) / (sum(m) + 1e-8), 6) AS masked_mean, round(var_samp(CASE WHEN m = 1 THEN r END), 6) AS masked_var FROM t GROUP BY seq",
)(lambda spark, sf: grouped.masked(tokens(spark, sf), "r", "m", ["seq"]).select("seq", r6("masked_sum"), r6("masked_mean"), r6("masked_var")))

_KEYS = "CASE event_type WHEN 'error' THEN 'loss/max' WHEN 'click' THEN 'time/min' WHEN 'view' THEN 'minmax_diff' ELSE 'score/' || event_type END"
query("reduce_metrics", f"WITH k AS (SELECT {_KEYS} AS key, value FROM events) SELECT key, round(CASE WHEN contains(key, 'max') THEN max(value) WHEN contains(key, 'min') THEN min(value) ELSE avg(value) END, 6) AS value FROM k GROUP BY key")(
    lambda spark, sf: grouped.reduce_metrics(table(spark, sf, "events").select(F.expr(_KEYS).alias("key"), "value")).select("key", r6("value"))
)
query(
    "aggregate_metrics",
    "WITH k AS (SELECT CASE event_type WHEN 'error' THEN 'timing_s/gen' WHEN 'click' THEN 'len/mean' WHEN 'view' THEN 'len/max' ELSE 'other' END AS key, value FROM events), "
    "r AS (SELECT key, CASE WHEN key LIKE 'timing_s/%' THEN 'sum' WHEN key LIKE '%mean%' THEN 'avg' WHEN key LIKE '%max%' THEN 'max' ELSE 'avg' END AS rule, value FROM k) "
    "SELECT key, any_value(rule) AS rule, round(CASE any_value(rule) WHEN 'sum' THEN sum(value) WHEN 'max' THEN max(value) ELSE avg(value) END, 6) AS value FROM r GROUP BY key",
)(
    lambda spark, sf: grouped.aggregate_metrics(
        table(spark, sf, "events").select(F.expr("CASE event_type WHEN 'error' THEN 'timing_s/gen' WHEN 'click' THEN 'len/mean' WHEN 'view' THEN 'len/max' ELSE 'other' END").alias("key"), "value", "event_id"), "key", "value", "event_id"
    ).select("key", "rule", r6("value"))
)
query("aggregate_ranks", "WITH s AS (SELECT event_id // 10 AS step, avg(value) AS v FROM events GROUP BY 1) SELECT round(sum(v), 6) AS value FROM s")(
    lambda spark, sf: grouped.aggregate_ranks(table(spark, sf, "events").select((F.col("event_id") % 10).alias("rank"), F.floor(F.col("event_id") / 10).alias("step"), "value"), "rank", "step", "value", "sum").select(r6("value"))
)
query(
    "majority_vote",
    """WITH v AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f, arg_min(value, event_id) AS x FROM events GROUP BY 1, 2)
    SELECT user_id, arg_min(event_type, (-n, f)) AS vote, arg_min(x, (-n, f)) AS maj FROM v GROUP BY user_id""",
)(lambda spark, sf: grouped.majority(table(spark, sf, "events"), ["user_id"], "event_id", "event_type", "value"))
query(
    "validation_report",
    """WITH k AS (SELECT event_type AS source, user_id, value AS s, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value) AS u, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC) AS d, count(*) OVER (PARTITION BY event_type, user_id) AS n FROM events),
    p AS (SELECT source, user_id, avg(s) AS mean, stddev_pop(s) AS std, sum(s * (pow(u / n, 2) - pow((u - 1) / n, 2))) AS best_2, sum(s * (pow(d / n, 2) - pow((d - 1) / n, 2))) AS worst_2,
      sum(s * (pow(u / n, 4) - pow((u - 1) / n, 4))) AS best_4, sum(s * (pow(d / n, 4) - pow((d - 1) / n, 4))) AS worst_4 FROM k GROUP BY 1, 2)
    SELECT source, count(*) AS prompts, round(avg(mean), 6) AS mean, round(avg(std), 6) AS std, round(avg(best_2), 6) AS best_2, round(avg(worst_2), 6) AS worst_2, round(avg(best_4), 6) AS best_4, round(avg(worst_4), 6) AS worst_4 FROM p GROUP BY source""",
)(lambda spark, sf: grouped.validation_report(table(spark, sf, "events").withColumnRenamed("event_type", "source"), "source", "user_id", "value", [2, 4]).select("source", "prompts", *(r6(c) for c in ("mean", "std", "best_2", "worst_2", "best_4", "worst_4"))))
query("average_reward", "WITH a AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY 1, 2) SELECT event_type, round(avg(v), 6) AS reward FROM a GROUP BY 1")(
    lambda spark, sf: grouped.average_reward(table(spark, sf, "events"), "event_type", "user_id", "value").select("event_type", r6("reward"))
)
query("pass_share", "WITH a AS (SELECT source, max(toxic) AS m FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT round(avg((m = 1)::INT), 6) AS pass_rate FROM a")(
    lambda spark, sf: grouped.pass_share(table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id"), "source", "toxic").select(r6("pass_rate"))
)
query("timing_summary", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, quantile_disc(value, 0.9) AS p90, max(value) AS max FROM events WHERE isfinite(value) GROUP BY 1")(
    lambda spark, sf: grouped.timing_summary(table(spark, sf, "events"), "event_type", "value").select("event_type", "n", r6("mean"), r6("median"), "p90", "max")
)
query("latency_percentiles", "SELECT round(quantile_cont(value, 0.5), 6) AS tp50, round(quantile_cont(value, 0.95), 6) AS tp95, round(quantile_cont(value, 0.99), 6) AS tp99 FROM events")(
    lambda spark, sf: grouped.percentiles(table(spark, sf, "events"), "value").select(r6("tp50"), r6("tp95"), r6("tp99"))
)
query(
    "data_metrics",
    f"""{R}, x AS (SELECT s, s * 2 AS a, CASE WHEN len > 8 THEN len ELSE 0 END AS len FROM r) SELECT round(avg(CASE WHEN len > 0 THEN s END), 6) AS score_mean, max(CASE WHEN len > 0 THEN s END) AS score_max, min(CASE WHEN len > 0 THEN s END) AS score_min,
    round(avg(a), 6) AS adv_mean, max(a) AS adv_max, min(a) AS adv_min, round(avg(len), 6) AS length_mean, max(len)::DOUBLE AS length_max, min(len)::DOUBLE AS length_min, round(avg((len = 0)::INT), 6) AS aborted FROM x""",
)(
    lambda spark, sf: grouped.data_metrics(rollouts(spark, sf).select("s", (F.col("s") * 2).alias("a"), F.when(F.col("len") > 8, F.col("len")).otherwise(0).alias("len")), "s", "a", "len").select(
        r6("score_mean"), "score_max", "score_min", r6("adv_mean"), "adv_max", "adv_min", r6("length_mean"), "length_max", "length_min", r6("aborted")
    )
)
query("explained_variance", f"{T} SELECT round(1 - var_samp(r - v) / (var_samp(r) + 1e-5), 6) AS explained_var FROM t")(lambda spark, sf: grouped.explained_variance(tokens(spark, sf), "r", "v").select(r6("explained_var")))
_ROWS = ", s AS (SELECT seq, sum(r * m) AS t, sum(m) AS n FROM t GROUP BY seq)"
for _mode, _sql in (
    ("token-mean", f"{T} SELECT round(sum(r * m) / (sum(m) + 1e-8), 6) AS loss FROM t"),
    ("seq-mean-token-sum", f"{T}{_ROWS} SELECT round(sum(t) / (sum((n > 0)::INT) + 1e-8), 6) AS loss FROM s"),
    ("seq-mean-token-mean", f"{T}{_ROWS} SELECT round(sum(t / (n + 1e-8)) / (sum((n > 0)::INT) + 1e-8), 6) AS loss FROM s"),
):
    query("agg_loss_" + _mode.replace("-", "_"), _sql)(lambda spark, sf, mode=_mode: grouped.aggregate_loss(tokens(spark, sf), "seq", "r", "m", mode).select(r6("loss")))
query("agg_loss_counted", f"{T}{_ROWS} SELECT round(sum(t) / count(*), 6) AS loss FROM s")(lambda spark, sf: grouped.aggregate_loss(tokens(spark, sf), "seq", "r", "m", "seq-mean-token-sum", "counted").select(r6("loss")))

# Programs: ranking, sampling, islands, lineage


def programs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    parent = F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 2))
    return p.select(F.col("p_partkey").alias("id"), parent.alias("parent"), F.col("p_retailprice").alias("score"), (F.col("p_size") / 7).alias("raw"), (F.col("p_partkey") % 10 / 10).alias("w"), F.col("p_brand").alias("island"), F.floor(F.log2(F.col("p_partkey") + 1)).cast("int").alias("generation"))


P = "WITH RECURSIVE p AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN p_partkey // 2 END AS parent, p_retailprice AS score, p_size / 7 AS raw, p_partkey % 10 / 10 AS w, p_brand AS island, floor(log2(p_partkey + 1))::INT AS generation FROM part)"
query(
    "effective_score",
    P + ", b AS (SELECT *, round_even(raw / 0.01, 0) * 0.01 AS b FROM p), d AS (SELECT DISTINCT island, b FROM b), g AS (SELECT island, b, coalesce(lead(b) OVER w - b, b - lag(b) OVER w, 0) AS gap FROM d WINDOW w AS (PARTITION BY island ORDER BY b)) "
    "SELECT id, round(b.b + w * gap * 0.99, 6) AS effective FROM b JOIN g USING (island, b)",
)(lambda spark, sf: ranking.effective_scores(programs(spark, sf), "score", "raw", "w", ["island"]).select("id", r6("effective")))
query("top_programs", P + " SELECT island, id, score FROM p QUALIFY row_number() OVER (PARTITION BY island ORDER BY score DESC, id) <= 3")(lambda spark, sf: ranking.top_programs(programs(spark, sf), 3, "score", "id", ["island"]).select("island", "id", "score"))
query("best_program", P + " SELECT id, score FROM p ORDER BY score DESC, id LIMIT 1")(lambda spark, sf: ranking.top_programs(programs(spark, sf), 1, "score", "id").select("id", "score"))
query("archive_rank", P + " SELECT id, round(0.7 * (rank() OVER (PARTITION BY island ORDER BY score) - 1) / count(*) OVER (PARTITION BY island) + 0.3 * (rank() OVER (PARTITION BY island ORDER BY raw DESC) - 1) / count(*) OVER (PARTITION BY island), 10) AS archive_score FROM p")(
    lambda spark, sf: ranking.archive_rank_score(programs(spark, sf), {"score": 0.7, "raw": -0.3}, ["island"]).select("id", F.round("archive_score", 10).alias("archive_score"))
)
query("percentile_rank", P + " SELECT id, round(CASE WHEN count(*) OVER (PARTITION BY island) > 1 THEN percent_rank() OVER (PARTITION BY island ORDER BY raw) ELSE 1 END, 6) AS percentile FROM p")(
    lambda spark, sf: ranking.percentile(programs(spark, sf), "raw", ["island"], "rank").select("id", r6("percentile"))
)
query("percentile_ties", P + " SELECT id, round((rank() OVER w - 1 + 0.5 * (count(*) OVER (PARTITION BY island, raw))) / count(*) OVER (PARTITION BY island), 6) AS percentile FROM p WINDOW w AS (PARTITION BY island ORDER BY raw)")(
    lambda spark, sf: ranking.percentile(programs(spark, sf), "raw", ["island"]).select("id", r6("percentile"))
)
query(
    "parent_weights",
    P + ", c AS (SELECT parent AS id, count(*) AS k FROM p WHERE parent IS NOT NULL GROUP BY 1), x AS (SELECT p.*, coalesce(k, 0) AS k FROM p LEFT JOIN c USING (id)), m AS (SELECT *, median(raw) OVER (PARTITION BY island) AS m FROM x), "
    "d AS (SELECT *, greatest(median(abs(raw - m)) OVER (PARTITION BY island), 1e-6) AS d FROM m), s AS (SELECT *, 1 / (1 + exp(-10 * (raw - m) / d)) / (1 + k) AS s FROM d) SELECT id, round(s / sum(s) OVER (PARTITION BY island), 6) AS weight FROM s",
)(lambda spark, sf: ranking.parent_weights(programs(spark, sf).join(trees.child_counts(programs(spark, sf), "id", "parent"), "id"), "raw", "children", ["island"]).select("id", r6("weight")))
query("power_law", P + ", k AS (SELECT id, island, pow(row_number() OVER (PARTITION BY island ORDER BY score DESC, id), -1.5) AS w FROM p) SELECT id, round(w / sum(w) OVER (PARTITION BY island), 6) AS weight FROM k")(
    lambda spark, sf: ranking.power_law(programs(spark, sf), "score", "id", ["island"], 1.5).select("id", r6("weight"))
)
query("boltzmann", P + ", e AS (SELECT id, island, exp(raw / 0.8 - max(raw / 0.8) OVER (PARTITION BY island)) AS e FROM p) SELECT id, round(e / sum(e) OVER (PARTITION BY island), 6) AS weight FROM e")(
    lambda spark, sf: ranking.softmax(programs(spark, sf), "raw", ["island"], 0.8).select("id", r6("weight"))
)
_ISLANDS = P + ", i AS (SELECT island, count(*) AS n, max(score) AS best, max(generation) AS generation FROM p GROUP BY 1)"
query("island_stats", _ISLANDS + " SELECT island, n, best, generation FROM i")(
    lambda spark, sf: programs(spark, sf).groupBy("island").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.max("generation").alias("generation"))
)
query("island_weights", _ISLANDS + " SELECT island, round((best / sqrt(n)) / sum(best / sqrt(n)) OVER (), 6) AS weight FROM i")(
    lambda spark, sf: ranking.island_weights(programs(spark, sf).groupBy("island").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best")), "best", "n", 1.0, 0.5).select("island", r6("weight"))
)
query(
    "migrants",
    P + ", k AS (SELECT *, count(*) OVER (PARTITION BY island) AS n, row_number() OVER (PARTITION BY island ORDER BY score DESC, id) AS r FROM p), f AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY r) AS k FROM k WHERE n > 1 AND r > 1 AND generation > 0) SELECT island, id FROM f WHERE k <= greatest(1, floor(n * 0.1))",
)(lambda spark, sf: ranking.migrants(programs(spark, sf), "island", "score", "generation", "id", 0.1).select("island", "id"))
query(
    "pareto_front",
    "WITH s AS (SELECT s_suppkey AS id, s_acctbal AS a, -s_nationkey AS b FROM supplier) SELECT id FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.a >= s.a AND o.b >= s.b AND (o.a > s.a OR o.b > s.b))",
)(lambda spark, sf: ranking.pareto_front(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("a"), (-F.col("s_nationkey")).alias("b")), ["a", "b"]).select("id"))
query("bandit_ucb", "WITH a AS (SELECT event_type, avg(value) AS m, count(*) AS n FROM events GROUP BY 1) SELECT event_type, round(m + sqrt(2 * ln(sum(n) OVER ()) / n), 6) AS ucb FROM a")(
    lambda spark, sf: ranking.upper_confidence(table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n")), "m", "n").select("event_type", r6("ucb"))
)
query(
    "ancestry",
    P + ", u AS (SELECT id AS node, parent AS ancestor, 1 AS depth FROM p WHERE parent IS NOT NULL UNION ALL SELECT node, p.parent, depth + 1 FROM u JOIN p ON p.id = u.ancestor WHERE p.parent IS NOT NULL AND depth < 5) SELECT node, ancestor, depth FROM u",
)(lambda spark, sf: trees.ancestry(programs(spark, sf), "id", "parent", 5))
query("child_counts", P + " SELECT p.id, coalesce(c.n, 0) AS children FROM p LEFT JOIN (SELECT parent, count(*) AS n FROM p WHERE parent IS NOT NULL GROUP BY 1) c ON c.parent = p.id")(lambda spark, sf: trees.child_counts(programs(spark, sf), "id", "parent"))
query(
    "subtree",
    P + ", s AS (SELECT 3::BIGINT AS node, 0 AS depth UNION ALL SELECT p.id, depth + 1 FROM s JOIN p ON p.parent = s.node) SELECT node, depth FROM s ORDER BY depth, node LIMIT 100",
)(lambda spark, sf: trees.subtree(programs(spark, sf), "id", "parent", F.col("id") == 3, 100))
query(
    "tree_leaf_means",
    P + ", l AS (SELECT id, raw FROM p WHERE id NOT IN (SELECT parent FROM p WHERE parent IS NOT NULL)), u AS (SELECT id AS node, id AS leaf FROM l UNION ALL SELECT p.parent, leaf FROM u JOIN p ON p.id = u.node WHERE p.parent IS NOT NULL) "
    "SELECT node, count(*) AS leaves, round(avg(raw), 6) AS mean FROM u JOIN l ON l.id = u.leaf GROUP BY node",
)(lambda spark, sf: trees.leaf_means(programs(spark, sf), "id", "parent", "raw").select("node", "leaves", r6("mean")))

# Similarity and retrieval

query(
    "cosine_top_k",
    "WITH s AS (SELECT q.vec_id AS query, c.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS x FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0) "
    "SELECT query, (row_number() OVER (PARTITION BY query ORDER BY x DESC, id))::INT AS rank, id, score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY x DESC, id) <= 5",
)(lambda spark, sf: similarity.top_k(table(spark, sf, "embeddings").filter("vec_id % 20 = 0"), table(spark, sf, "embeddings"), "vec_id", "embedding", 5).select("query", "rank", "id", r6("score")))
query(
    "bm25",
    r"""WITH d AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents), n AS (SELECT count(*) AS docs, avg(len(w)) AS a FROM d),
    q AS (SELECT item_id AS query, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM benchmark), qn AS (SELECT query, w, count(*) AS qn FROM q GROUP BY 1, 2),
    t AS (SELECT id, len(d.w) AS len, unnest(d.w) AS w FROM d), c AS (SELECT id, len, w, count(*) AS tf FROM t WHERE w IN (SELECT w FROM q) GROUP BY 1, 2, 3), df AS (SELECT w, count(*) AS df FROM c GROUP BY 1),
    s AS (SELECT query, id, sum(qn * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * len / a))) AS x FROM c JOIN df USING (w) JOIN qn USING (w), n GROUP BY 1, 2)
    SELECT query, (row_number() OVER (PARTITION BY query ORDER BY round(x, 9) DESC, id))::INT AS rank, id, round(x, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(x, 9) DESC, id) <= 3""",
)(lambda spark, sf: similarity.bm25(table(spark, sf, "benchmark"), table(spark, sf, "documents"), "item_id", "doc_id", "text", 3).select("query", "rank", "id", r6("score")))

# Texts

query("normalise_answer")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", tx.normalise_answer(F.col("text")).alias("answer"))
)
query("estimated_tokens", r"SELECT doc_id, floor(len(list_filter(string_split_regex(trim(text, e' \n\t\r'), '\s+'), lambda x: x <> '')) * 1.3)::BIGINT AS tokens FROM documents")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", tx.estimated_tokens(F.col("text")).alias("tokens"))
)
query("final_number", r"SELECT event_id, list_filter(regexp_extract_all(props, '(\-?[0-9.,]+)'), lambda x: x NOT IN ('', '.'))[-1] AS number FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", tx.final_number(F.col("props"), "flexible").alias("number"))
)
query("tag_answers", "SELECT doc_id, 'x' || lang AS answer, 1 AS em FROM documents")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.concat(F.lit("<answer>no</answer> <think>t</think><answer> x"), F.col("lang"), F.lit(" </answer>")).alias("t"), "lang").select("doc_id", tx.last_answer(F.col("t"), 2).alias("answer"), tx.exact_match(tx.last_answer(F.col("t"), 2), F.array(F.concat(F.lit("The X"), F.upper("lang")))).alias("em"))
)
query("question_mark", "SELECT item_id, trim(text) || CASE WHEN trim(text) LIKE '%?' THEN '' ELSE '?' END AS question FROM benchmark")(lambda spark, sf: table(spark, sf, "benchmark").select("item_id", tx.with_question_mark(F.col("text")).alias("question")))
query("metric_key", r"SELECT event_id, regexp_replace(replace(event_type || '@' || props, '@', '_at_'), '[^A-Za-z0-9/_\-. ]', '_', 'g') AS key FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", tx.metric_key(F.concat("event_type", F.lit("@"), "props")).alias("key"))
)

# Batches


def ordered(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), "o_custkey", "o_totalprice")


query("repeat_interleave", "SELECT o_orderkey * 3 + i AS pos, o_custkey FROM orders, range(3) t(i)")(lambda spark, sf: batch.repeat(ordered(spark, sf), "pos", 3).select("pos", "o_custkey"))
query("repeat_tile", "SELECT i * (SELECT count(*) FROM orders) + o_orderkey AS pos, o_custkey FROM orders, range(2) t(i)")(lambda spark, sf: batch.repeat(ordered(spark, sf), "pos", 2, False).select("pos", "o_custkey"))
query("repeat_per_row", "SELECT o_orderkey AS pos, i::INT AS copy FROM orders, range(4) t(i) WHERE i < o_custkey % 4")(lambda spark, sf: batch.repeat(ordered(spark, sf).withColumn("k", F.col("o_custkey") % 4), "pos", "k").select("pos", "copy"))
query("slice", "SELECT o_orderkey AS pos FROM orders WHERE o_orderkey >= 10 AND o_orderkey < 1000 AND (o_orderkey - 10) % 3 = 0")(lambda spark, sf: batch.take(ordered(spark, sf), "pos", 10, 1000, 3).select("pos"))
query("reorder", "SELECT (SELECT count(*) FROM orders) - 1 - o_orderkey AS pos, o_custkey FROM orders")(
    lambda spark, sf: batch.reorder(ordered(spark, sf), ordered(spark, sf).select(F.col("pos").alias("i")).join(F.broadcast(ordered(spark, sf).agg(F.count(F.lit(1)).alias("n")))).select("i", (F.col("n") - 1 - F.col("i")).alias("new")), "pos", "i", "new").select("pos", "o_custkey")
)
query("concat", "SELECT o_orderkey AS pos, o_custkey FROM orders UNION ALL SELECT o_orderkey + (SELECT count(*) FROM orders), o_custkey FROM orders")(lambda spark, sf: batch.concat([ordered(spark, sf), ordered(spark, sf)], "pos").select("pos", "o_custkey"))
query("unfold", "SELECT vec_id * 4 + i AS pos, list_sum(embedding[i * 16 + 1 : i * 16 + 16]::DOUBLE[]).round(5) AS total FROM embeddings, range(4) t(i)")(
    lambda spark, sf: batch.unfold(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "pos"), "pos", 4, ["embedding"]).select("pos", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))
)
query("union_columns", "SELECT o_orderkey AS pos, o_custkey, o_totalprice, o_orderstatus FROM orders")(
    lambda spark, sf: batch.union_columns(ordered(spark, sf), table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), "o_custkey", "o_orderstatus"), "pos").select("pos", "o_custkey", "o_totalprice", "o_orderstatus")
)
query("missing_numbers", "SELECT i AS l_orderkey FROM range((SELECT min(l_orderkey) FROM lineitem), (SELECT max(l_orderkey) + 1 FROM lineitem)) t(i) WHERE i NOT IN (SELECT l_orderkey FROM lineitem)")(
    lambda spark, sf: batch.missing_numbers(table(spark, sf, "lineitem"), "l_orderkey")
)
query("response_mask", "WITH t AS (SELECT l_orderkey AS seq, list(l_linenumber ORDER BY l_linenumber) AS ids FROM lineitem GROUP BY 1) SELECT seq, len(list_filter(ids, lambda x: x < 4))::INT + (CASE WHEN list_contains(ids, 4) THEN 1 ELSE len(list_filter(ids, lambda x: x > 4)) END)::INT AS n FROM t")(
    lambda spark, sf: table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("seq")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("ids")).select("seq", F.aggregate(batch.response_mask(F.col("ids"), 4), F.lit(0), lambda a, x: a + x).alias("n"))
)

# Streams, as batch equivalents

query("count_windows", "SELECT event_id // 64 AS window, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1 HAVING count(*) = 64")(
    lambda spark, sf: replay.count_windows(table(spark, sf, "events"), "event_id", 64).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean")).filter("n = 64")
)
