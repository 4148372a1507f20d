"""Queries of grading and of tags, over texts of conversations and numbers of parts; their SQL works the results out from the same columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserakt.functions import grading
from tesserakt.functions import text as tx
from tesserakt.plans.registry import query, table

# Texts: a turn, and the next one as what should have been said; ASCII, as both engines break words alike there


def _said(spark, sf):
    plain = F.regexp_replace("text", "[^ -~]+", " ")
    following = F.coalesce(F.lead(plain).over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("none"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", plain.alias("t"), following.alias("g"))
    words = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    return rows.withColumn("gw", words("g")).withColumn("tw", words("t")).withColumn("s", F.split("t", r"\. ", -1))


_C = """WITH c AS (SELECT conv_id, turn, regexp_replace(text, '[^ -~]+', ' ', 'g') AS t FROM conversations), n AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY conv_id ORDER BY turn), 'none') AS g FROM c),
  p AS (SELECT *, list_filter(string_split(t, ' '), lambda x: x <> '') AS tw, list_filter(string_split(g, ' '), lambda x: x <> '') AS gw, string_split(t, '. ') AS s FROM n)"""


def _norm(x: str) -> str:
    return r"trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[!-/:-@\[-`\{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))".format(x)


def _turns(name: str, sql: str, column, alias: str) -> None:
    query(name, f"{_C} SELECT conv_id, turn, {sql} AS {alias} FROM p")(lambda spark, sf: _said(spark, sf).select("conv_id", "turn", column().alias(alias)))


query(
    "token_f1",
    _C + f""", q AS (SELECT *, {_norm('t')} AS pn, {_norm('g')} AS gn FROM p), w AS (SELECT *, list_filter(string_split(pn, ' '), lambda x: x <> '') AS a, list_filter(string_split(gn, ' '), lambda x: x <> '') AS b FROM q),
    o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))), 0) AS n FROM w)
    SELECT conv_id, turn, round(CASE WHEN (pn IN ('yes', 'no', 'noanswer') OR gn IN ('yes', 'no', 'noanswer')) AND pn <> gn OR n = 0 THEN 0 ELSE 2.0 * n / (len(a) + len(b)) END, 6)::DOUBLE AS f1 FROM o""",
)(lambda spark, sf: _said(spark, sf).select("conv_id", "turn", F.round(tx.token_f1(F.col("t"), F.col("g")), 6).alias("f1")))
_turns("contains_match", f"(contains({_norm('t')}, {_norm('gw[1]')}) OR contains({_norm('t')}, {_norm('gw[-1]')}))::INT", lambda: tx.contains_match(F.col("t"), F.array(F.get("gw", F.lit(0)), F.element_at("gw", -1))), "found")
_turns("retrieved_right", f"len(list_filter(s, lambda x: contains({_norm('x')}, {_norm('gw[1]')}))) > 0", lambda: grading.retrieved_right(F.array_join(F.transform("s", lambda x: F.concat(F.lit("<information>"), x, F.lit("</information>"))), " and "), F.slice("gw", 1, 1)), "found")
_turns(
    "search_score",
    f"(CASE WHEN turn = 0 THEN 0 WHEN list_contains(list_transform(gw, lambda x: {_norm('x')}), {_norm('tw[1]')}) THEN CASE WHEN 2 * turn + 1 > 10 THEN 0.25 ELSE 1 END ELSE 0.1 END)::DOUBLE",
    lambda: grading.search_score(F.concat(F.repeat(F.lit("<answer>-</answer>"), (2 * F.col("turn")).cast("int")), F.lit("<answer>"), F.get("tw", F.lit(0)), F.lit("</answer>")), F.col("gw"), form=0.1), "score",
)
_turns("substring_score", f"(contains({_norm('t')}, {_norm('gw[1]')}) OR coalesce(contains({_norm('t')}, {_norm('gw[2]')}), false))::INT::DOUBLE", lambda: grading.substring_score(F.concat(F.lit("<answer>-</answer><answer>"), "t", F.lit("</answer>")), F.filter(F.array(F.get("gw", F.lit(0)), F.get("gw", F.lit(1))), lambda x: x.isNotNull())), "score")
_turns("tag_counts", "((length(t) - length(replace(t, 'th', ''))) / 2)::INT", lambda: tx.count_of(F.col("t"), "th"), "n")
_REST = "substr(t, strpos(t, ' and ') + 5)"
_turns("between_marks", f"CASE WHEN strpos(t, ' and ') > 0 AND strpos({_REST}, ' the ') > 0 THEN substr({_REST}, 1, strpos({_REST}, ' the ') - 1) END", lambda: tx.between(F.col("t"), " and ", " the "), "inside")
_turns("json_array", "len(string_split(t, ' '))", lambda: F.size(grading.first_json_array(F.concat(F.lit("here: "), F.to_json(F.split("t", " ", -1)), F.lit(" done")))).cast("long"), "n")


def _tag(kind, x):
    return F.concat(F.lit("<"), kind, F.lit(">"), x, F.lit("</"), kind, F.lit(">"))


def _kinds(x):
    """What a sentence is, by its length."""
    return F.element_at(F.array(F.lit("search"), F.lit("answer"), F.lit("think")), (F.length(x) % 3 + 1).cast("int"))


def _tagged(kinds: list[str]):
    return F.array_join(F.transform("s", lambda x: F.when(_kinds(x).isin(kinds), _tag(_kinds(x), x)).otherwise(x)), " ")


_KIND = "['search', 'answer', 'think'][length(x) % 3 + 1]"
query("first_action", _C + f", f AS (SELECT conv_id, turn, list_filter(s, lambda x: length(x) % 3 < 2)[1] AS x FROM p) SELECT conv_id, turn, CASE WHEN x IS NOT NULL THEN {_KIND} END AS kind, trim(x) AS content FROM f")(
    lambda spark, sf: _said(spark, sf).select("conv_id", "turn", tx.first_action(_tagged(["search", "answer"])).alias("a")).select("conv_id", "turn", "a.*")
)
_turns("actions", f"array_to_string(list_transform(s, lambda x: {_KIND} || '=' || trim(x)), ';')", lambda: F.array_join(F.transform(tx.actions(_tagged(["search", "answer", "think"])), lambda x: F.concat_ws("=", x["kind"], x["content"])), ";"), "parts")
_turns(
    "valid_sequence", "len(s) % 3 = 1 AND length(g) % 5 > 0",
    lambda: tx.valid_sequence(F.concat(F.lit("hello<|im_start|>assistant\n"), F.array_join(F.transform("s", lambda x, i: _tag(F.element_at(F.array(F.lit("think"), F.lit("search"), F.lit("information")), (i % 3 + 1).cast("int")), x)), "\n"), F.when(F.length("g") % 5 == 0, "stray").otherwise(""), F.lit("<answer>x</answer>"))), "valid",
)

# Numbers: a and b of each part, alike for every second one, in different spellings


def _parts(spark, sf):
    p = table(spark, sf, "part").withColumn("a", F.col("p_size").cast("long")).withColumn("k", F.col("p_partkey") % 6)
    p = p.withColumn("b", F.when(F.col("p_partkey") % 2 == 0, F.col("a")).otherwise(F.col("p_partkey") % 50 + 1))
    return p.withColumn("sa", F.col("a").cast("string")).withColumn("sb", F.col("b").cast("string"))


_P = "WITH p AS (SELECT *, p_size::BIGINT AS a, p_partkey % 6 AS k, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_partkey % 50 + 1 END::BIGINT AS b FROM part)"


def _numbers(name: str, sql: str, column, alias: str) -> None:
    query(name, f"{_P} SELECT p_partkey, {sql} AS {alias} FROM p")(lambda spark, sf: _parts(spark, sf).select("p_partkey", column().alias(alias)))


def _say(*parts: str):
    """A text of parts; sa and sb are the numbers."""
    return F.concat(*(F.col(x) if x in ("sa", "sb") else F.lit(x) for x in parts))


def _by_kind(*values):
    return F.element_at(F.array(*values), (F.col("k") % len(values) + 1).cast("int"))


_numbers(
    "canonical_latex",
    r"CASE k WHEN 0 THEN '\frac{' || a || '}{' || b || '}' WHEN 1 THEN '\frac{' || a || '}{' || b || '}' WHEN 2 THEN a::VARCHAR || b WHEN 3 THEN CASE WHEN a = 5 THEN '\frac{1}{2}' ELSE '0.' || a END WHEN 4 THEN a::VARCHAR ELSE '\sqrt{' || a % 9 || '}+' || b END",
    lambda: grading.canonical_latex(_by_kind(_say("\\dfrac{", "sa", "}{", "sb", "}"), _say("sa", "/", "sb"), _say("x = ", "sa", " \\!", "sb"), _say(".", "sa"), _say("sa", "\\text{ cm}"), F.concat(F.lit("\\left\\sqrt"), (F.col("a") % 9).cast("string"), _say(" + ", "sb", "\\%")))), "canonical",
)
_numbers("math_score", "(a = b)::INT::DOUBLE", lambda: grading.math_score(F.concat(F.lit("\\boxed{no} or \\boxed{"), _by_kind(_say("sa", "/7"), _say("\\dfrac{", "sa", "}{7}")), F.lit("}.")), _say("\\frac{", "sb", "}{7}")), "score")
_numbers("final_answer", "(p_partkey * 1234567)::VARCHAR", lambda: grading.final_answer(grading.answer_line(F.concat(F.lit("Answer: 0\nwork\nanswer : x = $"), F.format_number(F.col("p_partkey") * 1234567, 0), F.lit("$ dollars")))), "answer")
_numbers("announced_score", "CASE WHEN a = b THEN 1 ELSE -1 END::DOUBLE", lambda: grading.announced_score(F.concat(F.repeat(F.lit("Answer: 0\n"), 60), _say("Answer: ", "sa", " cm")), F.col("sb")), "score")
_numbers("strictly_boxed_score", "CASE WHEN a = b AND k < 4 THEN 1 ELSE -1 END::DOUBLE", lambda: grading.strictly_boxed_score(F.concat(_say("\\boxed{", "sb", "} then \\boxed{", "sa"), F.when(F.col("k") < 4, "").otherwise(" "), F.lit("}")), F.col("sb")), "score")
_numbers("geometry_score", "round(0.9 * (a = b)::INT + 0.1 * (k % 2 = 0)::INT, 6)::DOUBLE", lambda: F.round(grading.geometry_score(F.concat(F.when(F.col("k") % 2 == 0, "<think>x</think> ").otherwise(""), _say("\\boxed{", "sa", "}")), F.col("sb")), 6), "score")
_numbers("tagged_integer_score", "CASE WHEN k = 5 THEN 0 WHEN a = b THEN 1 ELSE 0.1 END::DOUBLE", lambda: grading.tagged_integer_score(F.concat(_say("User: <answer>", "sb", "</answer> Assistant: <answer>3</answer><answer> "), F.when(F.col("k") == 5, "none").otherwise(F.col("sa")), F.lit(" </answer>")), F.col("b")), "score")
_numbers("number_score", "CASE WHEN k = 0 THEN 0 WHEN a = b THEN 1 ELSE 0.1 END::DOUBLE", lambda: tx.number_score(F.when(F.col("k") > 0, F.concat(F.lit("so 7 #### "), F.format_number(F.col("p_partkey") * 1000 + F.col("a"), 0))).otherwise("none"), (F.col("p_partkey") * 1000 + F.col("b")).cast("string"), format_score=0.1), "score")
_numbers(
    "countdown_score", "CASE WHEN k % 3 = 2 OR k % 3 = 0 AND a + b * k <> (a + b) * k THEN 0.1 ELSE 1 END::DOUBLE",
    lambda: grading.countdown_score(_by_kind(F.concat(_say("sa", " + ", "sb", " * "), F.col("k").cast("string")), F.concat(_say("(", "sa", " + ", "sb", ") * "), F.col("k").cast("string")), _say("sa", "+", "sb")), F.array("b", "k", "a"), ((F.col("a") + F.col("b")) * F.col("k")).cast("double")), "score",
)
_numbers("call_form", "(k = 1)::INT::DOUBLE", lambda: grading.call_form(F.concat(F.lit("<think>x</think>"), F.repeat(F.lit("\n<tool_call>\n{}\n</tool_call>"), F.col("k").cast("int"))), F.lit("<tool_call>{}</tool_call>")), "score")
_numbers(
    "routed_score", "CASE WHEN a = b THEN 1 WHEN k % 3 = 2 THEN -1 ELSE 0 END::DOUBLE",
    lambda: grading.routed_score(_by_kind(F.lit("openai/gsm8k"), F.lit("lighteval/MATH"), F.lit("math_dapo")), _say("#### ", "sa", " \\boxed{", "sa", "}\nAnswer: ", "sa"), F.col("sb")), "score",
)
_LETTERS = "regexp_extract_all(lower({}), '[a-z0-9]')"
query(
    "tool_overlap",
    f"""WITH l AS (SELECT p_partkey, {_LETTERS.format('p_name')} AS a, {_LETTERS.format('p_brand')} AS b FROM part),
    o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))), 0) AS n FROM l)
    SELECT p_partkey, round(CASE WHEN a = b THEN 1 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE n / (len(a) + len(b) - n) END, 6)::DOUBLE AS overlap FROM o""",
)(lambda spark, sf: table(spark, sf, "part").select("p_partkey", F.round(grading.multiset_overlap(*(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]"), F.lit(0)) for c in ("p_name", "p_brand"))), 6).alias("overlap")))
