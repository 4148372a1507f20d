"""Count-min sketches of hashed keys, merged over all tasks, as flags of bounded size.

A cell adds up what its keys count and stops at the least count asked for, so it never says less than the truth. With a least count of 1 the
flags are a Bloom filter of the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserakt.llm.common import trimmed

#: Rows of the sketch. With 2**24 cells in a row, the most that callers ask for, its flags take 6 MB.
DEPTH = 3
_CHUNK = 1 << 16
#: Keys that a task counts at once.
_KEYS = 1 << 17
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], dtype=np.uint64)


def cells_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((hashes.view(np.uint64) * _ODD[row]) >> np.uint64(64 - bits)).astype(np.int64)


def has(flags: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether a key may have the least count."""
    keep = np.ones(len(hashes), dtype=bool)
    for row in range(DEPTH):
        at = cells_of(hashes, row, bits)
        keep &= (flags[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return keep


def among(keys: DataFrame, most_bits: int) -> Callable[[Column], Column]:
    """Whether a hash may be one of the keys (h long), as a condition on a column; true for every key.

    The Bloom filter's size follows the number of keys up to 2**most_bits cells in a row; with more keys it lets more of the others through.
    """
    bits = min(max((8 * keys.count()).bit_length(), 16), most_bits)
    shared = keys.sparkSession.sparkContext.broadcast(sketch(keys.select("h", F.lit(1).alias("n")), 1, bits))

    @F.pandas_udf("boolean")
    def may(h: pd.Series) -> pd.Series:
        return pd.Series(has(shared.value, h.to_numpy(), bits))

    return may


def at_most(counts: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """How often keys occur at most, but for what a cell can hold, from the counts of ``frequencies``."""
    return np.minimum.reduce([counts[row][cells_of(hashes, row, bits)] for row in range(DEPTH)])


def frequencies(lists: DataFrame, bits: int) -> np.ndarray:
    """DEPTH x 2**bits counts, 255 at most, of the keys in lists (h array of long)."""
    return _merged(lists.select("h"), lambda batch: [(batch.column(0).flatten().to_numpy(), None)], 255, bits, False)


def sketch(keys: DataFrame, least: int, bits: int) -> np.ndarray:
    """DEPTH x 2**bits flags, packed: whether what the keys (h long, n long) of a cell count is `least` or more, or 255 if that's less."""
    return sketch_of(keys.select("h", "n"), lambda batch: [(batch.column(0).to_numpy(), batch.column(1).to_numpy())], least, bits)


def sketch_of(rows: DataFrame, read: Callable[[pa.RecordBatch], Iterable[tuple[np.ndarray, np.ndarray]]], least: int, bits: int) -> np.ndarray:
    """The same of rows of which `read` gets hashes and counts, a batch at a time."""
    return _merged(rows, read, least, bits, True)


def _merged(keys: DataFrame, read: Callable[[pa.RecordBatch], Iterable[tuple[np.ndarray, np.ndarray | None]]], least: int, bits: int, packed: bool) -> np.ndarray:
    per_row = max(1, (1 << bits) // _CHUNK)
    size = min(1 << bits, _CHUNK)
    limit = min(least, 255)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((DEPTH, 1 << bits), dtype=np.uint8)
        for h, n in (pair for batch in batches for pair in read(batch)):
            for i, row in product(range(0, len(h), _KEYS), range(DEPTH)):
                at, where = np.unique(cells_of(h[i : i + _KEYS], row, bits), return_inverse=True)
                times = np.bincount(where, None if n is None else np.minimum(n[i : i + _KEYS], limit))
                table[row, at] = np.minimum(table[row, at] + times, limit)
        parts = table.reshape(DEPTH * per_row, size)
        for i in np.flatnonzero(parts.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([parts[i].tobytes()], pa.binary())], names=["part", "cells"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(cells.as_buffer(), np.uint8).astype(np.int16)
                sums[i] = np.minimum(sums[i] + got, limit) if i in sums else got
        done = [np.packbits(x >= limit).tobytes() if packed else x.astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(done, pa.binary())], names=["part", "bits"])

    rows = keys.mapInArrow(trimmed(counted), "part int, cells binary")
    flags = rows.repartition(DEPTH * min(per_row, 64), "part").mapInArrow(trimmed(merged), "part int, bits binary")
    out = np.zeros((DEPTH * per_row, size // 8 if packed else size), dtype=np.uint8)
    for r in flags.collect():  # DEPTH * 2**bits bits or bytes at most
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(DEPTH, -1)
