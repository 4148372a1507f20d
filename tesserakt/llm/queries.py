"""The thin queries over the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserakt.llm import bpe, decontam, divergence, html_content, langid, minhash, mixture, pii, pivot_topk, spelling, suffix_dedup, toxicity, warc
from tesserakt.llm.common import fold, read_table

#: Vocabulary of op7 and of the pipeline.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary(name: str = VOCABULARY) -> tuple[str, str]:
    """Path of the vocabulary and the pattern that splits a text."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(fold("doc_id", 4) != 2))
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.numbered(warc.capture_index(read_table(spark, sf_dir, "pages")))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(fold("doc_id", 5) != 0))
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pivot_topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
    return found.select("query_id", "rank", "vec_id", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), path, pattern, keep_ids=False)


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), k=4, percent=80)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extract(read_table(spark, sf_dir, "pages"))


def op11_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(read_table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"), least=30, top=50)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages), last AS (SELECT h, max(page_id) AS m FROM p GROUP BY h),
u AS (SELECT *, regexp_extract(url, '^[a-z]+://(?:www\.)?([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM p),
k AS (SELECT *, array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE lower(path) END || CASE WHEN q = '' THEN '' ELSE '?' || lower(q) END AS url_key FROM u),
letters AS (
  SELECT page_id, h, m, url_key, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(sha1(h), 5 * (i // 4)::INT + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS d FROM k JOIN last USING (h)
)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, d AS payload_digest, url_key, row_number() OVER (ORDER BY url_key, page_id) - 1 AS position,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM letters
"""

OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

#: Exact: all pairs of documents that share a shingle, then the closure of their links.
OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)
), ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, e.b FROM reached r JOIN ends e ON r.b = e.a
), component AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN component c USING (doc_id) LEFT JOIN sizes s USING (doc_id)
"""

#: Sources in the order in which they fill up: the first that isn't full at the level of those from it on gives the level.
OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 15) AS k FROM documents
), s AS (
  SELECT source, sum(size)::HUGEINT AS total, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::HUGEINT AS w FROM d GROUP BY source
), o AS (
  SELECT *, sum(total) OVER () AS words, row_number() OVER u AS i, coalesce(sum(2 * total) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(w) OVER (u ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM s WINDOW u AS (ORDER BY total / w, total, source NULLS LAST)
), level AS (
  SELECT arg_min((3 * words - 2 * used)::HUGEINT, i) AS a, arg_min((2 * free)::HUGEINT, i) AS b FROM o WHERE w * (3 * words - 2 * used) <= 2 * total * 2 * free
), t AS (
  SELECT source, total, CASE WHEN b IS NULL OR w * a > 2 * total * b THEN 2 * total::DOUBLE ELSE (w * a)::DOUBLE / b::DOUBLE END AS target FROM o, level
), r AS (
  SELECT *, CASE WHEN total > 0 THEN floor(target / total::DOUBLE) ELSE 0 END::BIGINT AS whole FROM t
), x AS (
  SELECT doc_id, size, total, target, whole, floor(target + 0.5)::BIGINT - whole * total AS extra, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, total::BIGINT AS source_size, target, (whole * size + greatest(0, least(size, extra - before)))::BIGINT AS taken FROM x
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM (SELECT id, lang, source, unnest(w) AS term FROM d) GROUP BY ALL
), kept AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY lang, term HAVING sum(docs) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(t.n, 0) AS n, k.n AS n_lang FROM g JOIN kept k USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
totals AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (
  SELECT c.lang, c.source, c.term, c.n, 1 + 1000000000::HUGEINT * (c.n + 5) // (totals.total + 5 * l.v) AS p, 1 + 1000000000::HUGEINT * (c.n_lang + 5) // (l.total + 5 * l.v) AS q
  FROM c JOIN totals ON totals.lang = c.lang AND totals.source = c.source JOIN l ON l.lang = c.lang
), s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (FROM pair UNION ALL FROM term)
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50
"""

#: Checksums bit by bit through the table of 256 remainders; near words share a word without one code point, or one is the other's.
OP13_SQL = r"""
WITH RECURSIVE bits AS (SELECT v, v AS r, 0 AS i FROM (SELECT unnest(range(0, 256)) AS v) UNION ALL SELECT v, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, i + 1 FROM bits WHERE i < 8),
remainders AS (SELECT list(r ORDER BY v) AS t FROM bits WHERE i = 8),
runs AS (
  SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS w FROM documents
  ) WHERE length(w) >= 7 GROUP BY ALL
), bytes AS (
  SELECT w, n, list_concat([4294967295], flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END))) AS b FROM runs
), sums AS (SELECT w, n, xor(list_reduce(b, lambda h, x: xor(t[(xor(h, x) & 255) + 1], h >> 8)), 4294967295) AS h FROM bytes, remainders),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM sums),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
without AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, n, unnest(range(0, length(word)))::INT AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM without a JOIN without b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.d = b.word
), best AS (SELECT word, count(*) AS n_near, max(other_n) AS best_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 10 * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.other_n = b.best_n) END AS form,
    CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN best b USING (word)
), chain AS (SELECT word, word AS root, 0 AS depth FROM forms UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_warc": op2_warc,
    "op3_language": op3_language,
    "op4_topk": op4_topk,
    "op5_decontamination": op5_decontamination,
    "op6_pii": op6_pii,
    "op7_bpe": op7_bpe,
    "op8_suffix": op8_suffix,
    "op9_minhash": op9_minhash,
    "op10_html": op10_html,
    "op11_mix": op11_mix,
    "op12_divergence": op12_divergence,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {"op2_warc": OP2_SQL, "op4_topk": OP4_SQL, "op9_minhash": OP9_SQL, "op11_mix": OP11_SQL, "op12_divergence": OP12_SQL, "op13_spelling": OP13_SQL}
