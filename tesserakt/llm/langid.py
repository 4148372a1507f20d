"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is read as characters, A-Z in lower case; its 1- to MAX_N-grams fall into
BUCKETS hash buckets. The log-probability matrix (buckets x languages) is
broadcast: its size is fixed but for the number of languages, which the bounded
training sample limits. Batches are scored in numpy, whole texts always.

A null text, one without a letter, and any text when nothing could be learned
get ``und`` and score 0. Ties go to the language that sorts first. Rows without
a language are never learned from. Repeated rows are scored each for itself;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserakt.llm.common import LOWER, buffers, chunks, mix, portion

BUCKETS = 1 << 16
MAX_N = 4
#: Rows learned from, about; chosen by a hash of the id when there are more.
SAMPLE_ROWS = 20_000
SMOOTHING = 0.5


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each UTF-8 character starts, and a number that stands for it."""
    continued = (data & 0xC0) == 0x80
    starts = np.flatnonzero(~continued)
    value = LOWER[data[starts]].astype(np.uint64)
    n = len(data)
    going = np.ones(len(starts), dtype=bool)
    for r in (1, 2, 3):
        at = np.minimum(starts + r, n - 1)
        going &= (starts + r < n) & continued[at]
        if not going.any():
            break
        value |= np.where(going, data[at].astype(np.uint64) << np.uint64(8 * r), np.uint64(0))
    return starts, value


def ngram_buckets(data: np.ndarray, doc_offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the bucket of every n-gram, in order, and each text's first n-gram. None crosses texts."""
    starts, chars = characters(data)
    first = np.searchsorted(starts, doc_offs)
    size = np.diff(first)
    for n in range(1, MAX_N + 1):
        count = np.maximum(size - n + 1, 0)
        offs = np.concatenate(([0], np.cumsum(count)))
        h = np.full(max(len(chars) - n + 1, 0), n, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + chars[j : j + len(h)]
        h = (mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64)
        if n > 1:  # drop those that begin in one text and end in the next
            whole = np.zeros(len(h) + 1, dtype=np.int64)
            begin, end = first[:-1][count > 0], (first[:-1] + count)[count > 0]
            np.add.at(whole, begin, 1)
            np.add.at(whole, end, -1)
            h = h[np.cumsum(whole[:-1]) > 0]
        yield h, offs


def _training(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    total = rows.count()
    if total > SAMPLE_ROWS:
        rows = rows.filter(portion(id_col, SAMPLE_ROWS, total))
    return rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and the matrix (BUCKETS x languages) of log-probabilities, priors divided out of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            raw, offs = buffers(batch.column(1))
            langs = batch.column(0).to_pylist()
            for i, j in chunks(offs):
                for h, starts in ngram_buckets(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
                    for r in range(j - i):
                        got = counts.setdefault(langs[i + r], np.zeros(BUCKETS, np.int64))
                        got += np.bincount(h[starts[r] : starts[r + 1]], minlength=BUCKETS) if starts[r + 1] - starts[r] > 4096 else 0
                        if starts[r + 1] - starts[r] <= 4096:
                            np.add.at(got, h[starts[r] : starts[r + 1]], 1)
        for lang, got in counts.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(got[at])], names=["lang", "bucket", "n"])

    # at most languages x BUCKETS rows
    rows = _training(docs, id_col, text_col, lang_col).repartition(12).mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique().tolist())
    counts = np.zeros((BUCKETS, len(langs)))
    counts[rows["bucket"].to_numpy(np.int64), np.searchsorted(np.array(langs, dtype=object), rows["lang"].to_numpy(object)) if langs else []] = rows["n"]
    matrix = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * BUCKETS)) if langs else counts
    return langs, matrix.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score, the posterior of the predicted language under even priors."""
    langs = model[0]
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model[1].T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        for batch in batches:
            raw, offs = buffers(batch.column(1))
            lettered = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for i, j in chunks(offs):
                total = np.zeros((len(langs), j - i))
                for h, starts in ngram_buckets(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
                    for k in range(len(langs)):
                        sums = np.concatenate(([0.0], np.cumsum(matrix[k][h], dtype=np.float64)))
                        total[k] += sums[starts[1:]] - sums[starts[:-1]]
                if langs:
                    best[i:j] = total.argmax(axis=0)
                    score[i:j] = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
            known = lettered & bool(langs)
            names = [langs[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], names=["id", "lang_pred", "score"])

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    kind = dict(docs.select(id_col).dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), text_col, letter.alias("letter")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
