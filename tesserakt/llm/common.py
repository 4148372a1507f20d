"""Shared helpers: shared-folder stages, Arrow text buffers, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)
#: Longer ranges are hashed in blocks of so many bytes: beyond 512, some strings (Thue-Morse) collide modulo 2**64 whatever the base.
_BLOCK = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none (single-machine tests) is one made in the
    temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tesserakt-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tesserakt/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and reread it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, whatever the user has called theirs."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(column: str, k: int):
    """crc32 of the id as text, modulo k."""
    return F.crc32(F.col(column).cast("string")) % k


def portion(column: str, wanted: int, total: int) -> Column:
    """Whether a row is in the sample of about `wanted` of `total` rows, chosen by a hash of the column; never an empty share."""
    space = 1 << 60
    return F.pmod(F.xxhash64(column), F.lit(space)) < F.lit(max(1, space * min(wanted, total) // max(total, 1)))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    width = np.int64 if large else np.int32
    offs = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def chunks(offs: np.ndarray, target: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `target` bytes; a longer text is a range of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + target, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow; its worker, which may lie idle for long, gives free memory back to the system when the task ends."""

    @wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return out


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        base = np.full(size, _BASE, dtype=np.uint64)
        base[0] = 1
        inverse = np.full(size, _BASE_INV, dtype=np.uint64)
        inverse[0] = 1
        _pow, _inv = np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    return _pow, _inv


def sums_of(values: np.ndarray) -> np.ndarray:
    """Prefix sums of 64-bit values whose differences, times inverse powers, hash any range of them."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(n + 1)[0][:n], out=sums[1:])
    return sums


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums for range_hash over bytes."""
    return sums_of(_TABLE[data])


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ranges: equal for equal contents; a range of more than _BLOCK chains the hashes of its blocks."""
    inverse = powers(len(sums))[1]
    whole = end - start
    out = mix((sums[np.minimum(end, start + _BLOCK)] - sums[start]) * inverse[start])
    at = np.flatnonzero(whole > _BLOCK)
    done = _BLOCK
    while len(at):
        a = start[at] + done
        block = mix((sums[np.minimum(end[at], a + _BLOCK)] - sums[a]) * inverse[a])
        out[at] = mix(out[at] * np.uint64(0x9FB21C651E98DF25) + block)
        done += _BLOCK
        at = at[whole[at] > done]
    return out


def word_spans(data: np.ndarray, doc_offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without ASCII white space, and each text's first word."""
    n = len(data)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[doc_offs[(doc_offs >= 0) & (doc_offs <= n)]] = True
    before = np.concatenate(([False], inside[:-1])) if n else inside
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.concatenate((inside[1:], [False])) if n else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, doc_offs)


def word_hashes(data: np.ndarray, doc_offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word, A-Z in lower case, and each text's first word."""
    starts, ends, first = word_spans(data, doc_offs)
    return range_hash(prefix_sums(LOWER[data]), starts, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and each text's first one; a shorter text is one shingle."""
    counts = np.diff(first)
    n_out = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_first = np.concatenate(([0], np.cumsum(n_out)))
    if not out_first[-1]:
        return np.zeros(0, np.uint64), out_first
    start = np.repeat(first[:-1] - out_first[:-1], n_out) + np.arange(out_first[-1])
    length = np.repeat(np.minimum(counts, k), n_out)
    h = np.repeat(np.minimum(counts, k), n_out).astype(np.uint64)
    last = len(words) - 1
    for j in range(k):
        step = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[np.minimum(start + j, last)])
        h = np.where(j < length, step, h)
    return h, out_first
