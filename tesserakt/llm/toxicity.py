"""Toxicity by weak supervision.

Three kinds of voters look at a text. Lexicon voters of two sorts: a fixed list of
insults, which no label chose, and words and beginnings of words read off a bounded
labelled sample because they go with one class. Pattern voters: shouting, rows of
exclamation marks, insults that recur, a word said twice running. A generative label
model treats the given label as one more voter and estimates by
expectation-maximisation how often each voter fires in either class, the given label
included, and along a forest of the strongest correlations how voters depend on each
other within a class. Its posterior labels train a linear classifier over hashed word
features, and that scores every whole text.

Only doc_id (to choose the sample and join labels), text and the labels of the
training folds are read. Rows with a null label are not learned from; a doc_id
with contradicting labels counts with each of them. A null or empty text scores
by the intercept alone. Without labels of both classes every score is the share
of the one class (0 without any). Texts of any length are read whole. Repeated rows
are scored each for itself; extra columns are ignored; an empty table gives no rows.

Features are counted and chosen on the executors; the driver gets KEPT features and,
of at most about 2 * SAMPLE_ROWS rows, which of those they have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserakt.llm.common import LOWER, buffers, chunks, materialise, portion, prefix_sums, range_hash, trimmed, word_spans

#: Labelled rows of each class that are learned from, about.
SAMPLE_ROWS = 4_000
#: Lengths in bytes of the beginnings of words that are features; 0: the whole word.
PREFIXES = (4, 5, 6, 7, 9, 0)
#: Features that occur so often or more count twice: once for being there, once for recurring.
RECURS = (1, 2, 4)
SPACE = 1 << 22
KEPT = 3_000
VOTERS = 300
#: What the given label is trusted with before its reliability is estimated, and the least correlation within a class that is modelled.
TRUST, DEPENDS = 0.9, 0.1
THRESHOLD = 0.3
#: Bytes of text whose features are made at once.
PIECE = 1 << 18
#: Insults in English, German, French and Spanish.
LEXICON = """idiot moron stupid trash loser scum clown pathetic worthless disgusting dumb fool jerk garbage filth vermin creep imbecile
dumm dummkopf trottel abschaum versager widerlich wertlos erbärmlich ekelhaft müll
imbécile crétin stupide ordure minable pathétique dégoûtant déchet nul abruti
idiota estúpido imbécil basura escoria patético asqueroso inútil payaso tonto""".split()
PATTERNS = ("insult", "insults", "shouting", "exclamation", "repetition")


def _letters() -> np.ndarray:
    """Bytes that belong to words: letters, digits and all of non-ASCII characters."""
    inside = np.zeros(256, dtype=bool)
    inside[128:] = True
    inside[ord("0") : ord("9") + 1] = inside[ord("a") : ord("z") + 1] = True
    return inside


_LETTERS = _letters()


def features(data: np.ndarray, doc_offs: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text and hashed feature of every feature of each text, once, in order of text.

    `wanted`: whether a feature's number counts; others are left out early.
    """
    lowered = np.where(_LETTERS[LOWER[data]], LOWER[data], np.uint8(32))
    starts, ends, first = word_spans(lowered, doc_offs)
    doc = np.repeat(np.arange(len(doc_offs) - 1), np.diff(first))
    sums = prefix_sums(lowered)
    docs, numbers = [], []
    forms = None if wanted is None else wanted.view(np.uint32) != 0  # whether any of the four numbers of a word form counts
    for p in PREFIXES:
        long_enough = ends - starts >= p
        end = np.minimum(starts + p, ends) if p else ends
        h = range_hash(sums, starts[long_enough], end[long_enough]) ^ np.uint64(p * 0x9E3779B9)
        d = doc[long_enough]
        base = (h % np.uint64(SPACE // 4)).astype(np.int64) * 4  # up to four numbers for one word form: how often it recurs
        if wanted is not None:
            some = forms[base >> 2]
            base, d = base[some], d[some]
        key, times = np.unique(d * SPACE + base, return_counts=True)
        for r, least in enumerate(RECURS):
            got = key[times >= least] + r
            docs.append(got // SPACE)
            numbers.append(got % SPACE)
    docs, numbers = np.concatenate(docs), np.concatenate(numbers)
    if wanted is not None:
        keep = wanted[numbers]
        docs, numbers = docs[keep], numbers[keep]
    key = np.unique(docs * SPACE + numbers)
    return key // SPACE, key % SPACE


def _lexicon() -> np.ndarray:
    data = np.frombuffer(" ".join(LEXICON).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return np.unique(range_hash(prefix_sums(data), starts, ends))


def patterns(data: np.ndarray, doc_offs: np.ndarray) -> np.ndarray:
    """Which of PATTERNS each text shows: texts x patterns."""
    n = len(doc_offs) - 1
    lowered = np.where(_LETTERS[LOWER[data]], LOWER[data], np.uint8(32))
    starts, ends, first = word_spans(lowered, doc_offs)
    doc = np.repeat(np.arange(n), np.diff(first))
    words = range_hash(prefix_sums(lowered), starts, ends)
    insults = np.bincount(doc[np.isin(words, _lexicon())], minlength=n)
    upper, marks = (np.concatenate(([0], np.cumsum(x))) for x in ((data >= 65) & (data <= 90), data == ord("!")))
    letters = np.concatenate(([0], np.cumsum(_LETTERS[LOWER[data]])))
    inside = lambda sums: sums[doc_offs[1:]] - sums[doc_offs[:-1]]
    again = np.flatnonzero((words[1:] == words[:-1]) & (doc[1:] == doc[:-1]))
    twice = np.bincount(doc[again], minlength=n)
    size = np.maximum(np.diff(first), 1)
    return np.column_stack([insults > 0, insults > 1, 5 * inside(upper) > inside(letters), 20 * inside(marks) > size, 50 * twice > size])


def dependencies(votes: np.ndarray, posterior: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each voter the one it depends on (-1: none): a forest of the strongest correlations that the classes leave unexplained."""
    n, m = votes.shape
    w1, w0 = weight * posterior, weight * (1 - posterior)
    left = votes - np.outer(posterior, w1 @ votes / max(w1.sum(), 1e-9)) - np.outer(1 - posterior, w0 @ votes / max(w0.sum(), 1e-9))
    left *= np.sqrt(weight / weight.sum())[:, None]
    cov = left.T @ left
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    corr = np.abs(cov / np.outer(sd, sd))
    parent, inside, best, by = np.full(m, -1), np.zeros(m, bool), np.full(m, -1.0), np.full(m, -1)
    for _ in range(m):  # Prim's tree, cut where the correlation is slight
        at = int(np.where(inside, -2, best).argmax())
        inside[at] = True
        if best[at] > DEPENDS:
            parent[at] = by[at]
        closer = ~inside & (corr[at] > best)
        best[closer], by[closer] = corr[at][closer], at
    return parent


def label_model(votes: np.ndarray, gold: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior probability of class 1 for each row.

    votes: rows x voters, 1 where a voter fires; gold: the given label, a voter too.
    The parameters are the class prior, the reliability of the given label in either
    class, and for every voter its firing rate given the class and, where it depends on
    another voter, whether that one fires. All of them come from
    expectation-maximisation, which begins with the given labels at TRUST.
    """
    given = (gold == 1).astype(float)
    posterior = np.where(gold == 1, TRUST, 1 - TRUST)
    parent = np.full(votes.shape[1], -1)
    for turn in range(rounds):
        if turn in (1, rounds // 2):
            parent = dependencies(votes, posterior, weight)
        upper = np.where(parent >= 0, votes[:, parent], 0.0)  # whether the voter that each depends on fires
        odds = np.zeros(len(votes))
        for w, sign in ((weight * posterior, 1), (weight * (1 - posterior), -1)):
            plain = (w @ votes + 0.5) / (w.sum() + 1)
            with_, without = w @ upper, w.sum() - w @ upper
            both = w @ (upper * votes)
            on = (both + 2 * plain) / (with_ + 2)
            off = (w @ votes - both + 2 * plain) / (without + 2)
            rate = np.where(upper > 0, on, off)
            right = min(max((w @ given + 1) / (w.sum() + 2), 0.005), 0.995)
            share = w.sum() / weight.sum()
            odds += sign * (np.log(np.where(votes > 0, rate, 1 - rate)).sum(axis=1) + np.log(np.where(given > 0, right, 1 - right)) + np.log(max(share, 1e-9)))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done = turn > rounds // 2 and np.abs(new - posterior).max() < 1e-4
        posterior = new
        if done:
            break
    return posterior


def train(numbers: np.ndarray, owner: np.ndarray, marks: np.ndarray, gold: np.ndarray, prior: float, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Numbers and weights of the classifier's features, and its intercept.

    Row owner[i] has the feature numbers[i], one of `used` (sorted); marks: rows x
    PATTERNS; prior: the share of class 1 among all labels.
    """
    rows = len(gold)
    n1, n0 = max(int((gold == 1).sum()), 1), max(int((gold == 0).sum()), 1)
    weight = np.where(gold == 1, prior / n1, (1 - prior) / n0) * rows
    o, c = owner, np.searchsorted(used, numbers)
    has1, has0 = (np.bincount(c, gold[o] == k, len(used)) for k in (1, 0))
    a, b = (has1 + 0.5) / (n1 + 1), (has0 + 0.5) / (n0 + 1)
    order = np.lexsort((used, -((a - b) ** 2) / (a + b)))
    # voters: the patterns, the strongest words for class 1, and against it
    chosen = np.concatenate((order[a[order] > 2 * b[order]][: VOTERS * 2 // 3], order[b[order] > 1.5 * a[order]][: VOTERS // 3]))
    voter = np.full(len(used), -1)
    voter[chosen] = np.arange(len(chosen))
    votes = np.zeros((rows, len(chosen)))
    v = voter[c]
    votes[o[v >= 0], v[v >= 0]] = 1
    target = label_model(np.column_stack([marks, votes]), gold, weight)
    # logistic regression with Adam on the whole sample, features scaled by how often they occur
    freq = np.bincount(c, minlength=len(used)) / max(rows, 1)
    scale = np.minimum(1 / np.sqrt(freq + 0.002), 4.0)
    beta, bias = np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    m, s, mb, sb = np.zeros_like(beta), np.zeros_like(beta), 0.0, 0.0
    for step in range(1, 301):
        z = bias + np.bincount(o, (beta * scale)[c], rows)
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / rows
        g = scale * np.bincount(c, err[o], len(used)) + 2e-3 * beta
        gb = err.sum()
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        f = 0.02 / np.sqrt(1 - 0.99**step) if step < 10 else 0.02
        beta -= f * m / (np.sqrt(s) + 1e-6)
        bias -= f * mb / (np.sqrt(sb) + 1e-6)
    return used, (beta * scale).astype(np.float32), bias


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, rows of class 1, rows of class 0) over a partition, SPACE features at most."""
    has = np.zeros((2, SPACE), np.int32)
    for batch in batches:
        for toxic, held in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            has[toxic, np.frombuffer(held.as_buffer(), np.uint32)] += 1
    at = np.flatnonzero(has.any(axis=0))
    for i in range(0, len(at), 100_000):
        part = at[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(has[1, part].astype(np.int64)), pa.array(has[0, part].astype(np.int64))], names=["feature", "has1", "has0"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """Learn from `labels` (id, toxic); the caller leaves held-out rows away."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    have = {r["_toxic"]: r["count"] for r in usable.groupBy("_toxic").count().collect()}
    n1, n0 = have.get(1, 0), have.get(0, 0)
    nothing = np.zeros(0, np.int64), np.zeros(0, np.float32)
    if not n1 or not n0:
        return *nothing, 40.0 if n1 else -40.0
    sample = F.broadcast(usable.filter(F.when(F.col("_toxic") == 1, portion("_id", SAMPLE_ROWS, n1)).otherwise(portion("_id", SAMPLE_ROWS, n0))))  # about 2 * SAMPLE_ROWS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = buffers(batch.column(1))
            for i, j in chunks(offs, PIECE):
                data, own = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                doc, number = features(data, own)
                ends = np.searchsorted(doc, np.arange(j - i + 1))
                lists = pa.array([number[a:b].astype(np.uint32).tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
                marks = patterns(data, own) @ (1 << np.arange(len(PATTERNS)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(marks.astype(np.int32)), lists], names=["toxic", "marks", "features"])

    got = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(sample, "_id").select("_toxic", "_text")
    got = materialise(got.mapInArrow(trimmed(run), "toxic int, marks int, features binary"), "toxicity-sample")
    sizes = {r["toxic"]: r["count"] for r in got.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return *nothing, 40.0 if n1 > n0 else -40.0
    s1, s0 = sizes[1], sizes[0]
    counts = got.coalesce(4).mapInArrow(trimmed(_counted), "feature long, has1 long, has0 long").groupBy("feature").agg(F.sum("has1").alias("has1"), F.sum("has0").alias("has0"))
    a, b = F.col("has1") / s1, F.col("has0") / s0
    gain = (a - b) * (a - b) / (a + b + 2 / (s1 + s0))
    best = counts.filter("has1 + has0 >= 3").orderBy(gain.desc(), "feature").limit(KEPT).select("feature").collect()
    used = np.sort(np.array([r[0] for r in best], np.int64))
    if not len(used):
        return *nothing, float(np.log(n1 / n0))
    shared = docs.sparkSession.sparkContext.broadcast(used)

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(2)]
            lists = pa.array([x[np.isin(x, shared.value)].tobytes() for x in held], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["toxic", "marks", "features"])

    rows = [tuple(r) for r in got.mapInArrow(trimmed(only), "toxic int, marks int, features binary").collect()]
    rows.sort(key=lambda r: (r[0], r[1], bytes(r[2])))  # the same model whatever the order of rows
    held = [np.frombuffer(r[2], np.uint32) for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in held])
    marks = np.array([r[1] for r in rows])[:, None] >> np.arange(len(PATTERNS)) & 1
    return train(np.concatenate(held).astype(np.int64), owner, marks.astype(float), np.array([r[0] for r in rows]), n1 / (n1 + n0), used)


def _scores(column: pa.Array, model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    used, weights, bias = model
    wanted, table = np.zeros(SPACE, dtype=bool), np.zeros(SPACE, dtype=np.float32)
    wanted[used], table[used] = True, weights
    raw, offs = buffers(column)
    z = np.full(len(column), bias)
    for i, j in chunks(offs, PIECE):
        doc, number = features(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], wanted)
        z[i:j] += np.bincount(doc, table[number], j - i)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most KEPT features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), shared.value))], names=["id", "score"])

    kind = dict(docs.select(id_col).dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(trimmed(run), f"id {kind}, score double")
    return out.withColumnRenamed("id", id_col)


def reject(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, all their columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(_scores(batch.column(at), shared.value) < threshold)
            for i, j in chunks(buffers(batch.column(at))[1]):  # never a second copy of the whole batch
                yield batch.slice(i, j - i).filter(keep.slice(i, j - i))

    return docs.mapInArrow(trimmed(run), docs.schema)
