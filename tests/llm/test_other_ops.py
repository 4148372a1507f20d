"""Archives, exact search, page content and the pipeline."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserakt.llm import html_content, pivot_topk, queries, warc
from tesserakt.llm.common import fold, read_table


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit("x")).withColumn("bytes", F.lit(1))


ROWS = [(1, "http://b.org/x", "<p>one</p>"), (2, "http://www.a.org/y?q=1", "<p>one</p>"), (3, None, None), (4, "http://é.x/ä b?q=%20", ""), (5, "http://b.org/x", "x\r\n\r\nWARC/1.1\r\n"), (None, "http://c.org/", "<p>one</p>"), (6, "u", "é" * 5000), (5, "http://b.org/x", "x\r\n\r\nWARC/1.1\r\n")]


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_archives(spark, min_bytes):
    out = warc.capture_index(pages(spark, ROWS), min_bytes=min_bytes).collect()
    last = {}
    for i, _, h in ROWS:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, url, h in ROWS:
        body = (h or "").encode()
        revisit = i is not None and len(body) >= min_bytes and last[h or ""] != i
        want.append((i, url or "-", len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", last[h or ""] if revisit else None))
    assert sorted(((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=str) == sorted(want, key=str)
    ordered = sorted(out, key=lambda r: (r["range"], r["place"]))
    keys = [(r["url_key"], r["time"], r["page_id"] is not None, r["page_id"] or 0) for r in ordered]
    assert keys == sorted(keys)
    assert warc.capture_index(pages(spark, [])).count() == 0


def test_captures_in_time_and_bounded_files(spark, monkeypatch, tmp_path):
    """Captures of one URL follow each other in time, runs are true runs, and files are bounded by bytes."""
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    rows = [(i, "http://a.org/same" if i % 2 else f"http://b.org/{i % 5}", "z" * (9_000 if i % 7 == 0 else 10), f"2024-02-{1 + (i * 11) % 28:02d} 10:00:00") for i in range(60)] + [(60, "http://a.org/same", "q", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, at string").withColumn("at", F.to_timestamp("at"))
    out = warc.capture_index(df, path=f"file://{tmp_path}/warc", time_col="at").collect()
    assert len(out) == 61 and max(r["offset"] + r["length"] for r in out) <= 44_000 and len({r["file"] for r in out}) > 3
    ordered = sorted(out, key=lambda r: (r["range"], r["place"]))
    keys = [(r["url_key"], r["time"], r["page_id"]) for r in ordered]
    assert keys == sorted(keys)
    times = {r["page_id"]: r["time"] for r in out}
    assert times[60] == warc.TIME and all(times[i] == at.replace(" ", "T") + "Z" for i, _, _, at in rows[:60])


def test_loser_tree():
    rng = np.random.default_rng(3)
    for k in (0, 1, 2, 3, 6, 17):
        runs = [sorted(rng.integers(0, 30, rng.integers(0, 25)).tolist()) for _ in range(k)]
        assert list(warc.merge([iter([(x,) for x in r]) for r in runs])) == sorted((x,) for r in runs for x in r)


def test_broken_archives():
    with pytest.raises(ValueError):
        list(warc.parse(b"HTTP/1.1 200\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcdefgh\r\n\r\n"))


def test_exact_search(spark, monkeypatch):
    monkeypatch.setattr(pivot_topk, "BLOCK", 40)
    monkeypatch.setattr(pivot_topk, "QUERIES", 7)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.2).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)]  # ties
    bad = [(2000, None), (2020, [1.0, None] + [0.0] * 6), (2040, [float("nan")] * 8), (2060, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad + rows[:2], "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    got = {}
    for r in pivot_topk.top_k(df, F.col("id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ids, v = np.array([i for i, _ in rows]), np.floor(64 * np.array([x for _, x in rows]))
    assert sorted(got) == sorted(int(i) for i in ids if i % 20 == 0)
    for q in got:
        scores = v @ v[ids == q][0]
        best = sorted((-int(s), int(i)) for s, i in zip(scores, ids, strict=True) if i != q)[:20]
        assert got[q] == [(i, -s) for s, i in best]
    assert pivot_topk.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (20, [1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in pivot_topk.top_k(few, F.col("id") % 20 == 0).collect()] == [(0, 1)]


def test_page_content(spark, sf):
    model = html_content.train()
    wrong = total = 0
    for text, labels in html_content.labelled_pages(150, seed=99):
        page = html_content.Page(text)
        belief = model.marginals(page)
        wrong += sum(int(belief[leaf].argmax()) != label for leaf, label in zip(page.text, labels, strict=True))
        total += len(labels)
    assert wrong < 0.04 * total
    odd = [(1, "u", None), (2, "u", ""), (3, "u", "<div>" * 3000 + "x" + "</div>" * 3000), (4, "u", "<article><h1>T &amp; U</h1><p>one <b>two</b>three&nbsp;four<br>five<p>six &lt;7&gt;</article><footer>(c) me</footer>"), (5, "u", "<script>'<p>no</p>'</script><!-- <p>no -->"), (6, "u", '<p class="a>b'), (7, "u", "<ul><li><a href=x>menu</a></ul><nav>n</nav>")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_content.extract(pages(spark, odd), model).collect()}
    text = "T & U one twothree four five six <7>"
    assert got[1] == got[2] == got[5] == ("", 0) and got[4] == (text, len(text)) and got[7][0] == ""
    assert html_content.extract(pages(spark, []), model).count() == 0


def test_broken_and_hostile_pages():
    """Nothing but script and style runs to the end of a page, and time is linear in its length."""
    import time

    model = html_content.train()
    article = "<article><h1>Title of it</h1><p>Before this there was a sentence of words.</p>{}<p>After it there came another sentence of words.</p></article>"
    for odd, inside in (("<svg width=1>", ""), ("<math><mi>E</mi></math>", "E "), ("<object>the words of an object here</object>", "the words of an object here "), ("<canvas>", ""), ("<xmp>a <b> c</xmp>", "a <b> c "), ("<!-- <p> -->", ""), ("<script>'<p>x</p>'</script>", "")):
        assert model.extract(article.format(odd)) == f"Title of it Before this there was a sentence of words. {inside}After it there came another sentence of words.", odd
    assert model.extract(article.format("<script>")) == "Title of it Before this there was a sentence of words."
    assert "another sentence" in model.extract(article.format('<p class="open>'))
    for piece in ("<div>", '<a "', "<p", "<", "<!-", "</x", "<li><ul>", "<button><div>", "&amp", "<svg>", "</b>", "<b x><div>"):
        took = []
        for n in (4_000, 16_000):
            began = time.perf_counter()
            html_content.Page("<p>x" + piece * n)
            took.append(time.perf_counter() - began)
        assert took[1] < 12 * max(took[0], 0.02), piece


def test_marginals_by_enumeration():
    """Sum-product against the sum over all labelings of small trees."""
    from itertools import product

    model = html_content.train()
    for text in ("<div class=menu><a href=x>one</a><p>two words", "<article><p>some text here</p></article><footer>x", "<p>a<p>b<div>c"):
        page = html_content.Page(text)
        n = len(page.parent)
        own = np.zeros((n, 3))
        for i, names in enumerate(page.evidence()):
            own[i] = sum((model.evidence[x] for x in names if x in model.evidence), np.zeros(3))
            if i in page.text:
                own[i, html_content.MIXED] = -60.0
        total = np.zeros((n, 3))
        for labels in product(range(3), repeat=n):
            weight = np.exp(model.root[labels[0]] + sum(own[i, k] for i, k in enumerate(labels)) + sum(model.child[labels[page.parent[i]], labels[i]] for i in range(1, n)))
            for i, k in enumerate(labels):
                total[i, k] += weight
        assert n < 9 and np.allclose(model.marginals(page), total / total.sum(axis=1, keepdims=True), atol=1e-9)


def test_page_content_of_the_table(spark, sf):
    import html
    import re

    for r in html_content.extract(read_table(spark, sf, "pages")).join(read_table(spark, sf, "pages").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<(?:br|/?p|/?h1)>", " ", inner))).split())
        assert (r["text"], r["n_chars"]) == (want, len(want))


def odd_documents(spark, docs):
    """Null and repeated ids, null, empty and long texts, and a column that clashes with the operators' own names."""
    rows = [(None, None, "en", "src0", None), (900_001, "", "en", "src0", 0), (900_002, "x" * 30_000, None, None, 30_000), (900_003, "same text " * 20, "en", "src1", 200), (900_003, "same text " * 20, "en", "src1", 200), (None, "same text " * 20, "en", "src1", 200), (900_004, "mail ann@x.org " + "a b c " * 9_000, "en", "src0", 54_015)]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumn("id", F.lit("x")).withColumn("n", F.lit(1)).withColumn("bucket", F.lit(2)).withColumn("toxic", F.lit(1))


def test_pipeline_by_brute_force(spark, sf):
    """Every stage on what the one before kept, against plain code."""
    import re

    import tiktoken

    from tesserakt.llm import bpe, decontam, minhash, toxicity

    from .test_text_ops import brute_base, brute_components

    docs = odd_documents(spark, read_table(spark, sf, "documents"))
    names = docs.columns
    plain = lambda df: sorted(map(tuple, df.collect()), key=str)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == names, name
        before, kept[name] = plain(docs), plain(out)
        if name == "toxicity":
            labels = read_table(spark, sf, "labels").filter(fold("doc_id", 4) != 2)
            scores = toxicity.score(docs.withColumn("doc_id", F.xxhash64("doc_id", "text")), toxicity.fit(docs, labels))
            gone = {r["doc_id"] for r in scores.collect() if r["score"] >= toxicity.THRESHOLD}
            hashed = sorted(((r["h"], tuple(r)[:-1]) for r in docs.withColumn("h", F.xxhash64("doc_id", "text")).collect()), key=str)
            assert kept[name] == sorted((row for h, row in hashed if h not in gone), key=str)
        elif name == "near_duplicates":
            rows = [(r[0], r[1]) for r in before]
            component, _ = brute_components([r for r in rows if r[0] is not None], 5, 80)
            want = [r for r in before if r[0] is None or component[r[0]] == r[0]]
            want = [r for i, r in enumerate(want) if r[0] is None or (r[0], r[1]) not in {(x[0], x[1]) for x in want[:i]}]
            assert [r[:2] for r in kept[name]] == [r[:2] for r in want]
        elif name == "decontamination":
            found = {r["doc_id"] for r in decontam.contaminated(docs, read_table(spark, sf, "benchmark")).collect()}
            assert kept[name] == [r for r in before if r[0] is None or r[0] not in found]
        else:
            texts = {(r[0], r[3]): r[1] for r in kept[name]}
            for r in before:
                new = texts[r[0], r[3]]
                spans = brute_base(r[1] or "")
                assert new is None if r[1] is None else all(r[1][a:b] not in new for a, _, b in spans)
                if r[1] is not None and not spans and not re.search("[0-9]", r[1]):
                    assert new == r[1]
            assert all(r[4] == (None if r[1] is None else len(r[1])) for r in kept[name])
        docs = spark.createDataFrame([r for r in out.collect()], out.schema)
    path, pattern = queries.vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = sorted(((r[0], hashlib.sha256(np.array(own.encode_ordinary(r[1] or ""), "<u4").tobytes()).hexdigest()) for r in kept["personal_data"]), key=str)
    got = sorted(((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()), key=str)
    assert got == want and minhash.BANDS * minhash.ROWS <= minhash.PLACES


def test_pipeline_stages(spark, sf):
    docs = read_table(spark, sf, "documents")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == names, name
        rows = out.count()
        assert rows <= docs.count() and rows > 0.6 * docs.count(), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    tokens = corpus_pipeline.run(spark, sf)
    assert tokens.count() == docs.count()
    assert sorted(r["doc_id"] for r in tokens.collect()) == sorted(r["doc_id"] for r in docs.collect())


def test_every_operator_has_a_query():
    for n in range(1, 11):
        assert any(name.startswith(f"op{n}_") for name in queries.QUERIES)
    assert fold("doc_id", 4) is not None


def test_topk_never_broadcasts_blocks_of_vectors(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "id long, v array<double>")
    plan = pivot_topk.top_k(df, F.col("id") % 20 == 0, k=3, id_col="id", vector_col="v")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
