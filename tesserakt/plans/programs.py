"""Queries of edits, answers, claims, pairs and samples of programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserakt.functions import code_metrics, propositions, symbolic, tool_calls
from tesserakt.operators import bandits, inspiration, pairs, patches, rollouts, trees
from tesserakt.operators.stages import staged
from tesserakt.plans.extra import PS, _archive, _programs
from tesserakt.plans.registry import query, table

# Edits of programs made of documents: lines of words within a region, a patch of one of five kinds for each

_LINES = "list_filter(list_transform(string_split(regexp_replace(text, '[^A-Za-z0-9.]+', ' ', 'g'), '.'), lambda x: trim(x)), lambda x: x <> '')"


def _edited(spark, sf):
    docs = table(spark, sf, "documents")
    lines = F.filter(F.transform(F.split(F.regexp_replace("text", "[^A-Za-z0-9.]+", " "), r"\."), lambda x: F.trim(x)), lambda x: x != "")
    docs = docs.select("doc_id", "source", lines.alias("l"))
    body = F.array_join(F.transform("l", lambda x: F.concat(F.lit("    "), x)), "\n")
    text = F.concat(F.lit("# EVOLVE-BLOCK-START\n"), body, F.lit("\n# EVOLVE-BLOCK-END\nreturn "), "source")
    programs = docs.select(F.col("doc_id").alias("program_id"), text.alias("text"), F.lit("python").alias("language"))
    block = lambda search, replace: F.concat(F.lit("<<<<<<< SEARCH\n"), search, F.lit("\n=======\n"), replace, F.lit("\n>>>>>>> REPLACE\n"))
    two = F.array_join(F.slice("l", 1, 2), "\n")
    kind = F.col("doc_id") % 5
    missing = block(F.lit("no such line"), F.lit("x"))
    patch = (
        F.when((kind == 0) & (F.size("l") > 1), F.concat(block(two, F.lit("x = 1\n  y = 2")), block(F.lit("x = 1"), F.lit("x = 3"))))
        .when(kind == 1, block(F.lit(""), F.lit("z = 4"))).when(kind == 2, block(F.concat(F.lit("return "), "source"), F.lit("return 0")))
        .when(kind == 3, F.lit("here it is\n```python\nz = 5\n```\n")).otherwise(missing)
    )
    made = docs.select(F.col("doc_id").alias("patch_id"), F.col("doc_id").alias("program_id"), F.when(kind == 3, "full").otherwise("diff").alias("kind"), patch.alias("patch"))
    return programs, made


def _applied(spark, sf):
    return patches.children(*_edited(spark, sf)).select("patch_id", "applied", "reason", F.md5("text").alias("text"))


query(
    "applied_patches",
    f"""WITH d AS (SELECT doc_id, source, {_LINES} AS l FROM documents), p AS (SELECT *, array_to_string(list_transform(l, lambda x: '    ' || x), chr(10)) AS body, doc_id % 5 AS k FROM d),
    t AS (SELECT *, '# EVOLVE-BLOCK-START' || chr(10) AS head, rtrim('return ' || source) AS foot, chr(10) || '# EVOLVE-BLOCK-END' || chr(10) AS mark FROM p)
    SELECT doc_id AS patch_id, (CASE WHEN k = 0 AND len(l) > 1 THEN 2 WHEN k IN (1, 3) THEN 1 ELSE 0 END)::INT AS applied,
      CASE WHEN k = 2 THEN 'outside the regions' WHEN k = 4 OR k = 0 AND len(l) < 2 THEN 'search text not found' END AS reason,
      md5(CASE WHEN k = 0 AND len(l) > 1 THEN head || '    x = 3' || chr(10) || '      y = 2' || substr(body, length(l[1]) + length(l[2]) + 10) || mark || foot
        WHEN k = 1 THEN head || body || chr(10) || 'z = 4' || substr(mark, 2) || foot WHEN k = 3 THEN rtrim(head, chr(10)) || chr(10) || 'z = 5' || mark || foot ELSE head || body || mark || foot END) AS text FROM t""",
)(_applied)

# Answers: spellings of one number against those of another

_A, _B = "p_size", "(p_partkey % 50 + 1)"


def _answers(spark, sf):
    p = table(spark, sf, "part").withColumn("a", F.col("p_size").cast("string")).withColumn("b", (F.col("p_partkey") % 50 + 1).cast("string"))
    say = lambda *parts: F.concat(*(F.col(x) if x in ("a", "b") else F.lit(x) for x in parts))
    twice = (F.col("b").cast("int") * 2).cast("string")
    given = [say("a"), say("\\frac{", "a", "}{4}"), say("a", "x + x"), say("(", "a", ", x^2-1)"), say("\\sqrt{", "a", "^2}"), say("[", "a", ", 7)"), say("\\begin{pmatrix}", "a", " & 1\\\\2&3\\end{pmatrix}"), say("\\frac{x^2-", "a", "^2}{x-", "a", "}")]
    truth = [say("b"), F.concat(F.col("b"), F.lit("/4")), F.concat(F.lit("("), (F.col("b").cast("int") + 1).cast("string"), F.lit(")x")), say("(", "b", ", (x-1)(x+1))"), F.concat(twice, F.lit("/2")), say("[", "b", ", 14/2)"), say("[[", "b", ",1],[2,3]]"), say("x+", "b")]
    pick = lambda values: F.element_at(F.array(*values), (F.col("p_partkey") % 8 + 1).cast("int"))
    return p.select("p_partkey", symbolic.answers_equal(pick(given), pick(truth)).alias("equal"))


query("answers_equal", f"SELECT p_partkey, {_A} = {_B} OR p_partkey % 8 IN (0, 3, 5, 6) AND ({_A} = 100 * {_B} OR 100 * {_A} = {_B}) AS equal FROM part")(_answers)

# Claims: a puzzle of three persons for each customer, its statements made of the key

_PEOPLE = ["Ava", "Ben", "Cleo"]


def _puzzles(spark, sf):
    c = table(spark, sf, "customer")
    x, y, z = (e.cast("string") for e in (F.col("c_nationkey") % 3, F.floor(F.col("c_custkey") / 3) % 3, F.col("c_custkey") % 2))
    truth, lie = (lambda v: F.concat(F.lit('["telling-truth", '), v, F.lit("]"))), (lambda v: F.concat(F.lit('["lying", '), v, F.lit("]")))
    of = lambda kind, *parts: F.concat(F.lit(f'["{kind}", '), F.concat_ws(", ", *parts), F.lit("]"))
    first = F.when(F.col("c_custkey") % 3 == 0, lie(x)).when(F.col("c_custkey") % 3 == 1, of("and", lie(x), truth(y))).otherwise(of("->", truth(x), lie(y)))
    said = F.concat(F.lit("["), F.concat_ws(", ", first, of("<=>", truth(x), of("not", lie(y))), of("or", lie(y), lie(z))), F.lit("]"))
    return c.select("c_custkey", "c_nationkey", said.alias("statements"), F.array(*map(F.lit, _PEOPLE)).alias("names"))


_SAID = """WITH z AS (SELECT c_custkey, c_custkey % 3 AS k, (c_nationkey % 3)::INT AS x, (c_custkey // 3 % 3)::INT AS y, (c_custkey % 2)::INT AS z FROM customer),
  a AS (SELECT i, [(i & 4) = 0, (i & 2) = 0, (i & 1) = 0] AS t FROM range(8) r(i)),
  s AS (SELECT c_custkey, i, t, CASE k WHEN 0 THEN NOT t[x + 1] WHEN 1 THEN NOT t[x + 1] AND t[y + 1] ELSE NOT t[x + 1] OR NOT t[y + 1] END AS s1, t[x + 1] = t[y + 1] AS s2, NOT t[y + 1] OR NOT t[z + 1] AS s3 FROM z, a)"""
query("satisfying", _SAID + " SELECT c_custkey, count(*) FILTER (t[1] = s1 AND t[2] = s2 AND t[3] = s3) AS n, arg_min(t, i) FILTER (t[1] = s1 AND t[2] = s2 AND t[3] = s3)::VARCHAR AS first FROM s GROUP BY c_custkey")(
    lambda spark, sf: _puzzles(spark, sf).select("c_custkey", propositions.solutions(F.col("statements")).alias("s")).select("c_custkey", "s.n", F.concat(F.lit("["), F.array_join(F.transform("s.first", lambda b: b.cast("string")), ", "), F.lit("]")).alias("first"))
)


def _reasoned(spark, sf):
    role = lambda bit: F.when(F.expr(f"c_custkey & {bit} = 0"), "knight").otherwise("knave")
    text = F.concat(
        F.lit("Let us see.\n\nAssume Ava is a "), role(4), F.lit(" and Ben is a "), role(8), F.lit(". No contradiction.\n\nAssume Cleo is a "), role(16), F.lit(". Then "),
        F.lit("Ben cannot be a "), role(32), F.lit(".\n\nZoe being a knight is impossible\n\nIf Ava were a "), role(64), F.lit(", what then?\n\n### Final Answer\n\nBen is a knave"),
    )
    return _puzzles(spark, sf).withColumn("text_id", F.col("c_custkey")).withColumn("text", text)


def _can(roles: dict[int, str]) -> str:
    """Whether each person of assumed role can have said their words under all that is assumed (an assignment each)."""
    under = " AND ".join(f"t[{i}] = ({r})" for i, r in roles.items())
    return " AND ".join(f"coalesce(bool_or(s{i} = ({r}) AND {under}), false)" for i, r in roles.items())


_R = {b: f"(s.c_custkey & {b}) = 0" for b in (4, 8, 16, 32, 64)}
query(
    "claim_counts",
    f"""{_SAID}, c AS (SELECT c_custkey, {_can({1: _R[4], 2: _R[8]})} AS one, NOT ({_can({3: _R[16], 2: _R[32]})}) AS two, NOT ({_can({1: _R[64]})}) AS three FROM s GROUP BY c_custkey)
    SELECT c_custkey AS text_id, (one::INT + two::INT + three::INT)::BIGINT AS n_correct, (3 - one::INT - two::INT - three::INT)::BIGINT AS n_wrong FROM c""",
)(lambda spark, sf: propositions.claim_counts(_reasoned(spark, sf)))


def _goals_met(spark, sf):
    solved = _reasoned(spark, sf).withColumn("puzzle_id", F.col("c_custkey") % 8)
    tree = propositions.goals(spark.range(8).select(F.col("id").alias("puzzle_id"), F.array(*map(F.lit, _PEOPLE)).alias("names"), F.transform(F.array(F.lit(4), F.lit(2), F.lit(1)), lambda b: F.col("id").bitwiseAND(b) > 0).alias("solution")))
    met = staged(propositions.met(solved.withColumn("solved", F.lit(False)), tree))  # read by the scores of each level and by the counts
    key = lambda c: F.concat(F.col("text_id").cast("string"), F.lit("/"), F.col(c))
    scores = trees.goal_scores(met.select(key("goal").alias("goal"), key("parent").alias("parent"), (F.col("level") - 1).alias("level"), F.col("satisfied").cast("double").alias("score")), "goal", "parent", "level", "score", 2, "children")
    root = scores.filter("level = 0").select(F.substring_index("goal", "/", 1).cast("long").alias("text_id"), F.round("score", 6).alias("score"))
    return met.groupBy("text_id").agg(F.count_if("satisfied").alias("met"), F.count(F.lit(1)).alias("goals")).join(root, "text_id")


_TRY = {"Ava": ("(c & 4) = 0", "(c & 64) = 0"), "Ben": ("(c & 8) = 0", "(c & 32) = 0"), "Cleo": ("(c & 16) = 0", None)}


def _met_sql() -> str:
    """The text assumes a role of each person once, refutes one of Ben, and asks "if Ava were"; its last line has Ben a knave."""
    said = "SELECT c_custkey AS c, c_custkey % 8 AS p FROM customer"
    own = {"Ava": "(p & 4) > 0", "Ben": "(p & 2) > 0", "Cleo": "(p & 1) > 0"}
    # 'Assume ... N is a R' holds if any assumption before the end of its line has it; confirmed: with a confirmation anywhere behind it
    tried = {n: _TRY[n][0] for n in own}
    is_own = {n: f"(({tried[n]}) = ({own[n]}))" for n in own}
    confirmed = {"Ava": is_own["Ava"], "Ben": is_own["Ben"], "Cleo": "false"}
    refuted = {"Ava": "false", "Ben": f"(({_TRY['Ben'][1]}) <> ({own['Ben']}))", "Cleo": "false"}
    identity = {"Ava": f"({confirmed['Ava']} OR {is_own['Ava']})", "Ben": f"({is_own['Ben']} OR NOT ({own['Ben']}))", "Cleo": is_own["Cleo"]}
    columns, scores = [], []
    for n in own:
        steps = [f"(NOT {is_own[n]})", refuted[n], is_own[n], confirmed[n], *(f"({is_own[n]} AND {is_own[m]})" for m in own if m != n)]
        columns += [identity[n], *steps]
        mean = "(" + " + ".join(f"({s})::INT" for s in steps) + f") / {len(steps)}"
        scores.append(f"CASE WHEN {identity[n]} THEN 1.0 ELSE 0.7 * ({mean}) END")
    total = " + ".join(f"({c})::INT" for c in columns)
    return f"WITH s AS ({said}) SELECT c AS text_id, ({total})::BIGINT AS met, {len(columns) + 1}::BIGINT AS goals, round(0.7 * ({' + '.join(scores)}) / 3, 6)::DOUBLE AS score FROM s"


query("goals_met", _met_sql())(_goals_met)

# Pairs: customers are nodes, nations pools


def _nodes(spark, sf):
    cover = F.array(*(F.expr(f"CAST((c_custkey >> {b}) & 1 AS DOUBLE)") for b in range(4)))
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("pool"), F.col("c_custkey").alias("node"), F.col("c_custkey").alias("place"), F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.0).alias("value"), cover.alias("cover"))


_N = "WITH n AS (SELECT c_nationkey AS pool, c_custkey AS node, (c_mktsegment = 'BUILDING')::INT AS v, [(c_custkey >> 0) & 1, (c_custkey >> 1) & 1, (c_custkey >> 2) & 1, (c_custkey >> 3) & 1] AS c, c_custkey & 15 AS m FROM customer)"
_LEAD = "(0.7 * greatest({a}.v, {b}.v) + 0.3 * CASE WHEN ({a}.m | {b}.m) & 1 = 0 THEN 0 WHEN ({a}.m | {b}.m) & 2 = 0 THEN 1 WHEN ({a}.m | {b}.m) & 4 = 0 THEN 2 WHEN ({a}.m | {b}.m) & 8 = 0 THEN 3 ELSE 4 END / 4)"
_MEAN = "10 * bit_count(({a}.m | {b}.m)::INT) / 4"
#: Goal 0 is the root, 1 and 2 its children, 3 a child of 1.
_PARENTS = [None, 0, 0, 1]
_TREE = "CASE WHEN ({a}.m | {b}.m) & 1 > 0 THEN 10 ELSE 10 * (CASE WHEN ({a}.m | {b}.m) & 2 > 0 OR ({a}.m | {b}.m) & 8 > 0 THEN 1 ELSE 0 END + CASE WHEN ({a}.m | {b}.m) & 4 > 0 THEN 1 ELSE 0 END) / 2 END"
for _name, _joint, _sql in (("leading", pairs.leading, _LEAD), ("mean", pairs.mean, _MEAN), ("tree", pairs.tree(_PARENTS), _TREE)):
    query(
        f"best_pair_{_name}",
        f"{_N} SELECT a.pool, a.node AS a, b.node AS b, round({_sql.format(a='a', b='b')}, 6)::DOUBLE AS score FROM n a JOIN n b ON a.pool = b.pool AND a.node < b.node QUALIFY row_number() OVER (PARTITION BY a.pool ORDER BY round({_sql.format(a='a', b='b')}, 9) DESC, a.node, b.node) = 1",
    )(lambda spark, sf, joint=_joint: pairs.best_pair(_nodes(spark, sf), joint).select("pool", "a", "b", F.round("score", 6).alias("score")))

_U = "((('0x' || substr(md5({}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"
query(
    "drawn_pairs",
    f"""{_N}, k AS (SELECT pool, v, m, count(*) AS n, min(node) AS f FROM n GROUP BY ALL),
    p AS (SELECT a.pool, a.f AS fa, b.f AS fb, a.v AS va, a.m AS ma, b.v AS vb, b.m AS mb, CASE WHEN a.f = b.f THEN a.n * (a.n - 1) / 2 ELSE a.n * b.n END AS n, {_LEAD.format(a='a', b='b')} AS score FROM k a JOIN k b ON a.pool = b.pool AND (a.f < b.f OR a.f = b.f AND a.n > 1)),
    w AS (SELECT pool, d, fa, va, ma, vb, mb, score FROM p, range(3) r(d) QUALIFY row_number() OVER (PARTITION BY pool, d ORDER BY score / 0.2 + ln(n) - ln(-ln({_U.format("concat_ws(':', 5, pool, d, fa, fb)")})) DESC) = 1),
    x AS (SELECT w.*, arg_min(n.node, md5(concat_ws(':', 5, 1, d, n.node))) AS a FROM w JOIN n ON n.pool = w.pool AND n.v = va AND n.m = ma GROUP BY ALL),
    y AS (SELECT x.pool, d, score, a, arg_min(n.node, md5(concat_ws(':', 5, 2, d, n.node))) AS b FROM x JOIN n ON n.pool = x.pool AND n.v = vb AND n.m = mb AND n.node <> a GROUP BY ALL)
    SELECT pool, d::INT AS draw, least(a, b) AS a, greatest(a, b) AS b, round(score, 6)::DOUBLE AS score FROM y""",
)(lambda spark, sf: pairs.drawn_pairs(_nodes(spark, sf), pairs.leading, 0.2, draws=3, seed=5).select("pool", "draw", "a", "b", F.round("score", 6).alias("score")))

# Samples: nations ask for parents and inspirations among all parts


def _sampled(spark, sf):
    p = _programs(spark, sf)
    programs = p.join(trees.child_counts(p, "id", "parent"), "id").select(F.col("id").alias("program"), "island", "score", "correct", "children", "generation")
    archive = _archive(spark, sf).withColumnRenamed("id", "program")
    requests = table(spark, sf, "nation").select(F.col("n_nationkey").alias("request"))
    asked = inspiration.islands(requests, programs, "equal")
    return requests, programs, archive, inspiration.parents(asked, programs, archive)


_W = """, kids AS (SELECT parent AS id, count(*) AS k FROM p WHERE parent IS NOT NULL GROUP BY 1), able AS (SELECT q.*, coalesce(k, 0) AS k FROM q LEFT JOIN kids USING (id) WHERE correct AND id IN (SELECT id FROM arch)),
  m AS (SELECT *, median(score) OVER (PARTITION BY island) AS m FROM able), dev AS (SELECT *, greatest(median(abs(score - m)) OVER (PARTITION BY island), 1e-6) AS d FROM m),
  wt AS (SELECT island, id, 1 / (1 + exp(-10 * (score - m) / d)) / (1 + k) AS w FROM dev), ws AS (SELECT island, id, w / sum(w) OVER (PARTITION BY island) AS w FROM wt),
  asked AS (SELECT n_nationkey AS request, arg_min(island, -ln({0})) AS island FROM nation, (SELECT DISTINCT island FROM q) GROUP BY 1),
  chosen AS (SELECT request, island, arg_min(id, -ln({1}) / w) AS parent FROM asked LEFT JOIN ws USING (island) GROUP BY ALL)""".format(_U.format("concat_ws(':', 0, n_nationkey, island)"), _U.format("concat_ws(':', 1, request, island, id)"))
query("sampled_parents", PS + _W + " SELECT request, island, parent FROM chosen")(lambda spark, sf: _sampled(spark, sf)[3])
_I = """, top AS (SELECT id, island AS home FROM q WHERE correct ORDER BY score DESC, id LIMIT 1), one AS (SELECT request, 0 AS place, id AS program, 'best' AS step FROM chosen, top WHERE id IS DISTINCT FROM chosen.parent),
  elite AS (SELECT request, row_number() OVER (PARTITION BY request ORDER BY score DESC, id) - 1 + (SELECT count(*) FROM one WHERE one.request = chosen.request) AS place, id AS program, 'elite' AS step FROM chosen JOIN able USING (island)
    WHERE id IS DISTINCT FROM chosen.parent AND (request, id) NOT IN (SELECT (request, program) FROM one)), two AS (FROM one UNION ALL FROM elite WHERE place < 4),
  ring AS (SELECT id, row_number() OVER (ORDER BY md5(concat_ws(':', 2, 1, id)), id) - 1 AS position FROM able), whole AS (SELECT count(*) AS n FROM ring),
  near AS (SELECT chosen.*, i, ring.id FROM chosen, whole, range(9) r(i), ring WHERE i < n AND ring.position = (('0x' || substr(md5(concat_ws(':', 2, 2, request)), 1, 13))::BIGINT + i) % n),
  loose AS (SELECT request, row_number() OVER (PARTITION BY request ORDER BY i, id) - 1 + (SELECT count(*) FROM two WHERE two.request = near.request) AS place, id AS program, 'any' AS step FROM near
    WHERE id IS DISTINCT FROM near.parent AND (request, id) NOT IN (SELECT (request, program) FROM two)), taken AS (FROM two UNION ALL FROM loose WHERE place < 4)"""
query("archive_inspirations", PS + _W + _I + " SELECT request, place::INT AS place, program, step FROM taken")(lambda spark, sf: _inspired(spark, sf)[-1])


def _inspired(spark, sf):
    _, programs, archive, chosen = _sampled(spark, sf)
    return programs, archive, chosen, inspiration.archive_inspirations(chosen, programs, archive, 4, 0.3)


def _context(spark, sf):
    programs, archive, chosen, taken = _inspired(spark, sf)
    best = inspiration.top_inspirations(chosen, taken, programs, archive, 3, 4)
    return inspiration.context(chosen, taken, best, programs)


query(
    "inspiration_context",
    PS + _W + _I + """, best AS (SELECT request, row_number() OVER (PARTITION BY request ORDER BY score DESC, id) AS turn, id AS program FROM chosen, able WHERE id IS DISTINCT FROM chosen.parent AND (request, id) NOT IN (SELECT (request, program) FROM taken)),
    every AS (SELECT request, program, place AS came FROM taken UNION ALL SELECT request, program, turn + 1000000 FROM best WHERE turn <= 3)
    SELECT request, (row_number() OVER (PARTITION BY request ORDER BY score, came) - 1)::INT AS place, program FROM every JOIN q ON id = program""",
)(_context)

# Tool calls: turns of conversations as calls of two grammars, every fifth broken


def _called(spark, sf):
    t = table(spark, sf, "conversations")
    body = F.to_json(F.struct(F.concat(F.lit("say"), F.col("turn").cast("string")).alias("name"), F.struct("text", "turn").alias("arguments")))
    mark = lambda x: F.concat(F.lit("<tool_call>"), x, F.lit("</tool_call>"))
    broken = F.when(F.col("conv_id") % 5 == 1, F.lit('{"name": "x"}')).otherwise(F.lit("{"))
    hermes = F.concat(F.col("role"), mark(body), F.when(F.col("conv_id") % 5 < 3, mark(broken)).otherwise(""))
    xml = F.concat("role", F.lit("<tool_call>\n<function=say>\n<parameter=text>\n"), F.replace("text", F.lit("<"), F.lit("(")), F.lit("\n</parameter>\n<parameter=turn>"), F.col("turn").cast("string"), F.lit("</parameter>\n</function>"))
    even = F.col("turn") % 2 == 0
    said = t.select("conv_id", "turn", F.when(even, hermes).otherwise(xml).alias("text"), F.when(even, "hermes").otherwise("qwen3_coder").alias("grammar"))
    types = F.lit('{"say": {"text": "string", "turn": "integer"}}')
    calls = said.lateralJoin(tool_calls.tool_calls(F.col("text").outer(), F.col("grammar").outer(), types))
    return calls.select("conv_id", "turn", "place", "name", F.md5(F.get_json_object("arguments", "$.text")).alias("text"), F.get_json_object("arguments", "$.turn").cast("long").alias("argument"), "reason", F.col("content"))


query(
    "called_tools",
    """WITH t AS (SELECT *, turn % 2 = 0 AS even FROM conversations)
    SELECT conv_id, turn, 0 AS place, CASE WHEN even THEN 'say' || turn ELSE 'say' END AS name, md5(CASE WHEN even THEN text ELSE replace(text, '<', '(') END) AS text, turn::BIGINT AS argument, NULL AS reason, role AS content FROM t
    UNION ALL SELECT conv_id, turn, 1, NULL, NULL, NULL, CASE WHEN conv_id % 5 = 1 THEN 'no name or no arguments' ELSE 'not JSON' END, role FROM t WHERE even AND conv_id % 5 < 3""",
)(_called)

# Code: documents as programs of a language each


def _measured(spark, sf):
    docs = table(spark, sf, "documents").withColumn("language", F.when(F.col("doc_id") % 2 == 0, "cpp").otherwise("text"))
    code = F.replace(F.replace("text", F.lit(". "), F.lit("{\nif x else ")), F.lit(","), F.lit("}\n//"))
    got = code_metrics.code_metrics(docs.withColumn("code", code), "code", "language")
    rounded = [F.round(f"metrics.{n}", 6).alias(n) if k == "double" else F.col(f"metrics.{n}").alias(n) for n, k in zip(code_metrics.NAMES, code_metrics.KINDS, strict=True)]
    return got.select("doc_id", *rounded)


query(
    "code_metrics",
    r"""WITH d AS (SELECT doc_id, doc_id % 2 = 0 AS c, replace(replace(text, '. ', '{' || chr(10) || 'if x else '), ',', '}' || chr(10) || '//') AS t FROM documents),
    l AS (SELECT *, list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS l FROM d),
    m AS (SELECT *, 1 + len(regexp_extract_all(t, '(?i)\bif\b')) + len(regexp_extract_all(t, '(?i)\belse\b')) + len(regexp_extract_all(t, '(?i)\bwhile\b')) + len(regexp_extract_all(t, '(?i)\bfor\b')) + len(regexp_extract_all(t, '(?i)\bswitch\b'))
      + len(regexp_extract_all(t, '(?i)\bcase\b')) + len(regexp_extract_all(t, '(?i)\bcatch\b')) + len(regexp_extract_all(t, '\b\?\b')) AS cc, len(l) AS loc,
      len(list_filter(l, lambda x: x <> '')) AS filled, len(list_filter(l, lambda x: x LIKE '//%' OR x LIKE '/*%' OR x LIKE '%*/')) AS comments,
      list_reduce(list_concat([0::BIGINT], list_transform(regexp_extract_all(t, '[{}]'), lambda b: CASE WHEN b = '{' THEN 1 ELSE -1 END::BIGINT)), lambda s, b: greatest(s // 1000000, greatest(0, s % 1000000 + b)) * 1000000 + greatest(0, s % 1000000 + b)) // 1000000 AS depth FROM l),
    v AS (SELECT *, filled - comments AS lloc, greatest(1.0, (filled - comments) * log2(greatest(1.0, cc::DOUBLE))) AS v, greatest(filled, 1) AS g FROM m)
    SELECT doc_id, CASE WHEN c THEN cc ELSE 1 END::INT AS cyclomatic_complexity, CASE WHEN c THEN cc ELSE 1 END::DOUBLE AS average_cyclomatic_complexity, round(CASE WHEN c THEN v ELSE g END, 6) AS halstead_volume, 1.0::DOUBLE AS halstead_difficulty,
      round(CASE WHEN c THEN v ELSE g END, 6) AS halstead_effort, CASE WHEN c THEN loc ELSE filled END::INT AS lines_of_code, CASE WHEN c THEN lloc ELSE filled END::INT AS logical_lines_of_code, CASE WHEN c THEN comments ELSE 0 END::INT AS comments,
      round(CASE WHEN c THEN greatest(0, 171 - 5.2 * log2(v) - 0.23 * cc - 16.2 * log2(greatest(loc, 1))) ELSE 100 END, 6)::DOUBLE AS maintainability_index, CASE WHEN c THEN depth ELSE 1 END::INT AS max_nesting_depth,
      CASE WHEN c THEN round(least(0.4 * least(cc / 10, 1) + 0.4 * least(log2(v + 1) / 10, 1) + 0.1 * least(log2(loc + 1) / 10, 1) + 0.1 * least(depth / 5, 1), 1), 3) ELSE round(least(log2(g) / 10, 1), 3) END::DOUBLE AS complexity_score FROM v""",
)(_measured)

# Bandits: kinds of events are arms, every seventh reward is missing


def _pulls(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", "event_type", F.when(F.col("event_id") % 7 > 0, F.col("value") / 100).alias("reward"), ((F.col("user_id") % 3) / 10).alias("baseline"))


def _bandit(spark, sf):
    return bandits.states(_pulls(spark, sf), "event_id", "event_type", "reward", "baseline")


query("bandit_states")(lambda spark, sf: _bandit(spark, sf))
query("bandit_betas")(lambda spark, sf: bandits.betas(_bandit(spark, sf)))
query("bandit_bounds")(lambda spark, sf: bandits.bounds(_bandit(spark, sf)))

# Batches of rollouts

_Z = "WITH c AS (SELECT c_nationkey AS g, c_custkey AS pos, c_custkey % 7 AS micro, abs(c_acctbal) AS load, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal), c_custkey) - 1 AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)"


def _loads(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("pos"), (F.col("c_custkey") % 7).alias("micro"), F.abs("c_acctbal").alias("load"))


query("ends_light", f"{_Z} SELECT pos, CASE WHEN r % 2 = 0 THEN r // 2 ELSE n - 1 - r // 2 END::BIGINT AS place FROM c")(lambda spark, sf: rollouts.ends_light(_loads(spark, sf), ["g"], "load", "pos").select("pos", "place"))
query(
    "balanced_batch",
    f"{_Z}, b AS (SELECT g, sum(count(*)) OVER (ORDER BY g) - count(*) AS before FROM c GROUP BY g) SELECT pos, (before + CASE WHEN r % 2 = 0 THEN r // 2 ELSE n - 1 - r // 2 END)::BIGINT AS index FROM c JOIN b USING (g)",
)(lambda spark, sf: rollouts.balanced_batch(_loads(spark, sf), "g", "load", "pos").select("pos", "index"))
query(
    "micro_batch_order",
    f"{_Z}, m AS (SELECT g, micro, sum(load) AS l, min(pos) AS p FROM c GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(l, 4) DESC, p DESC) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM m) SELECT g, micro, (CASE WHEN r % 2 = 0 THEN (n + 1) // 2 - 1 - r // 2 ELSE (n + 1) // 2 + r // 2 END)::BIGINT AS place FROM k",
)(lambda spark, sf: rollouts.micro_batch_order(_loads(spark, sf), ["g"], "micro", "load", "pos"))
query(
    "restored_batch",
    "SELECT c_custkey AS pos, abs(c_acctbal) AS back FROM customer",
)(lambda spark, sf: (lambda b: rollouts.restored(b, "index", "pos", b.select("index", F.col("load").alias("back")), "back"))(rollouts.balanced_batch(_loads(spark, sf), "g", "load", "pos")))


def _spans(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("long").alias("p"), F.col("l_suppkey").cast("long").alias("s"), F.col("l_quantity").cast("long").alias("q")))).alias("x"))
    part = lambda c, k: F.transform("x", lambda x: F.when(x["l_linenumber"] % k == 0, F.lit(0).cast("long")).otherwise(x[c]))
    return rows.select("l_orderkey", part("p", 2).alias("prompt"), part("s", 3).alias("response"), F.when(F.col("l_orderkey") % 4 > 0, part("q", 9)).alias("info"))


def _concatenated(spark, sf):
    rows = _spans(spark, sf)
    whole, shown = rollouts.masked_concat(F.col("prompt"), F.transform("prompt", lambda x: x), F.col("response"), F.col("info"), 0)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("l_orderkey", text(whole).alias("whole"), text(shown).alias("shown"))


query(
    "masked_concat",
    """WITH x AS (SELECT l_orderkey, list({'n': l_linenumber, 'p': l_partkey::BIGINT, 's': l_suppkey::BIGINT, 'q': floor(l_quantity)::BIGINT} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS x FROM lineitem GROUP BY 1),
    p AS (SELECT l_orderkey, list_transform(x, lambda e: CASE WHEN e.n % 2 = 0 THEN 0 ELSE e.p END) AS p, list_transform(x, lambda e: CASE WHEN e.n % 3 = 0 THEN 0 ELSE e.s END) AS r,
      CASE WHEN l_orderkey % 4 > 0 THEN list_transform(x, lambda e: CASE WHEN e.n % 9 = 0 THEN 0 ELSE e.q END) ELSE [] END AS i FROM x),
    b AS (SELECT l_orderkey, list_concat(p, list_concat(r, i)) AS w, list_concat(p, list_concat(r, list_transform(i, lambda e: 0::BIGINT))) AS s FROM p),
    z AS (SELECT l_orderkey, w, list_transform(range(1, len(w) + 1), lambda k: {'w': w[k], 's': s[k]}) AS z FROM b)
    SELECT l_orderkey, array_to_string(list_concat(list_filter(w, lambda e: e = 0), list_filter(w, lambda e: e <> 0)), ',') AS whole,
      array_to_string(list_concat(list_transform(list_filter(z, lambda e: e.w = 0), lambda e: e.s), list_transform(list_filter(z, lambda e: e.w <> 0), lambda e: e.s)), ',') AS shown FROM z""",
)(_concatenated)
query(
    "collated",
    """WITH s AS (SELECT l_orderkey, list(l_partkey::BIGINT ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS x FROM lineitem GROUP BY 1), n AS (SELECT *, (ceil(max(len(x)) OVER (PARTITION BY l_orderkey // 64) / 4) * 4)::INT AS n FROM s)
    SELECT l_orderkey, array_to_string(list_concat(x, list_transform(range(0, n - len(x)), lambda i: -1)), ',') AS ids, len(x)::INT AS kept, n AS width FROM n""",
)(
    lambda spark, sf: rollouts.collated(_spans(spark, sf).join(table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("long").alias("p"), "l_suppkey", "l_quantity"))), lambda x: x["p"]).alias("ids")), "l_orderkey").select("l_orderkey", "ids", F.floor(F.col("l_orderkey") / 64).alias("batch")), ["batch"], {"ids": -1}, 4)
    .select("l_orderkey", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), F.aggregate("attention", F.lit(0), lambda a, x: a + x).alias("kept"), F.size("attention").alias("width"))
)


def _rounds(spark, sf):
    p = table(spark, sf, "part").select("p_partkey")
    prompts = p.count() // 5
    first = p.filter(F.col("p_partkey") < 2 * prompts).withColumn("pos", F.col("p_partkey"))
    second = p.filter(F.col("p_partkey") >= 2 * prompts).withColumn("pos", F.col("p_partkey") - 2 * prompts)
    return rollouts.interleaved([first, second], "pos", [2, 3]).select("p_partkey", "index")


query("interleaved", "WITH n AS (SELECT count(*) // 5 AS n FROM part) SELECT p_partkey, CASE WHEN p_partkey < 2 * n THEN p_partkey // 2 * 5 + p_partkey % 2 ELSE (p_partkey - 2 * n) // 3 * 5 + 2 + (p_partkey - 2 * n) % 3 END::BIGINT AS index FROM part, n")(_rounds)
query(
    "action_metrics",
    """WITH t AS (SELECT event_id % 5 AS turns, event_id % 3 = 0 AS active, event_id % 2 AS valid, length(props) AS searches FROM events),
    a AS (SELECT avg(turns) AS m, max(turns) AS x, min(turns) AS n, 1 - avg(active::INT) AS f, avg(valid) AS v, avg(CASE WHEN turns > 0 THEN valid / turns END) AS r, avg(searches) AS s FROM t)
    SELECT unnest(['env/number_of_actions/mean', 'env/number_of_actions/max', 'env/number_of_actions/min', 'env/finish_ratio', 'env/number_of_valid_action', 'env/ratio_of_valid_action', 'env/number_of_valid_search']) AS name,
      round(unnest([m, x, n, f, v, r, s]), 6)::DOUBLE AS value FROM a""",
)(lambda spark, sf: rollouts.action_metrics(table(spark, sf, "events").select((F.col("event_id") % 5).alias("t"), (F.col("event_id") % 3 == 0).alias("a"), (F.col("event_id") % 2).alias("v"), F.length("props").alias("s")), "t", "a", "v", "s").select("name", F.round("value", 6).alias("value")))
query(
    "slowest_report",
    """WITH t AS (SELECT event_id, value AS g, event_id % 11 AS c, event_id % 4 AS p, user_id AS l, length(props) AS r FROM events), s AS (SELECT * FROM t ORDER BY g + c DESC, event_id LIMIT 1),
    a AS (SELECT min(p) AS p0, max(p) AS p1, avg(p) AS p2, min(g) AS g0, max(g) AS g1, avg(g) AS g2, min(c) AS c0, max(c) AS c1, avg(c) AS c2 FROM t)
    SELECT unnest(['agent_loop/num_preempted/min', 'agent_loop/num_preempted/max', 'agent_loop/num_preempted/mean', 'agent_loop/generate_sequences/min', 'agent_loop/generate_sequences/max', 'agent_loop/generate_sequences/mean', 'agent_loop/tool_calls/min', 'agent_loop/tool_calls/max', 'agent_loop/tool_calls/mean',
      'agent_loop/slowest/generate_sequences', 'agent_loop/slowest/tool_calls', 'agent_loop/slowest/num_preempted', 'agent_loop/slowest/prompt_length', 'agent_loop/slowest/response_length']) AS name, round(unnest([p0, p1, p2, g0, g1, g2, c0, c1, c2, g, c, p, l, r]::DOUBLE[]), 6) AS value FROM a, s""",
)(
    lambda spark, sf: rollouts.slowest_report(table(spark, sf, "events").select("event_id", F.col("value").alias("g"), (F.col("event_id") % 11).alias("c"), (F.col("event_id") % 4).alias("p"), "user_id", F.length("props").alias("r")), "g", "c", "p", "user_id", "r", "event_id").select("name", F.round("value", 6).alias("value"))
)
