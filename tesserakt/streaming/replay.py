"""Streams of rollouts: count windows, bounded queues, staleness, token buckets, metric streams.

Order is a column (sequence number or time). What folds over order runs for each
key by itself in ``applyInPandas``; a live stream does the same per key in
``applyInPandasWithState``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F


def count_windows(df: DataFrame, seq: str, size: int) -> GroupedData:
    """Groups of `size` consecutive sequence numbers, ready to aggregate; an incomplete one has fewer rows."""
    return df.groupBy(F.floor(F.col(seq) / size).alias("window"))


def bounded_queue(log: DataFrame, key: str, seq: str, action: str, item: str, capacity: int) -> DataFrame:
    """Replay of puts and gets: a put on a full queue drops the oldest item, a get on an empty one gives null."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        queue: deque = deque()
        out = []
        for row in frame.sort_values(seq).itertuples(index=False):
            kind, dropped, got = getattr(row, action), None, None
            if kind == "put":
                if len(queue) >= capacity:
                    dropped = queue.popleft()
                queue.append(getattr(row, item))
            elif queue:
                got = queue.popleft()
            out.append((getattr(row, key), getattr(row, seq), got, dropped, len(queue)))
        return pd.DataFrame(out, columns=[key, seq, "got", "dropped", "size"])

    kinds = dict(log.dtypes)
    return log.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {seq} {kinds[seq]}, got {kinds[item]}, dropped {kinds[item]}, size int")


def token_bucket(requests: DataFrame, key: str, time: str, tokens: str, rate: float, capacity: float) -> DataFrame:
    """When each request may go on: the bucket refills at `rate`, and a request greater than what is there goes into debt and waits."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        level, last, out = capacity, None, []
        for row in frame.sort_values([time, tokens]).itertuples(index=False):
            now, n = getattr(row, time), getattr(row, tokens)
            if last is not None:
                level = min(capacity, level + (now - last) * rate)
            last = now
            level -= n
            out.append((getattr(row, key), now, n, now + max(0.0, -level / rate)))
        return pd.DataFrame(out, columns=[key, time, tokens, "ready"])

    kinds = dict(requests.dtypes)
    return requests.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {time} {kinds[time]}, {tokens} {kinds[tokens]}, ready double")


def should_pause(queued: Column, queue_limit: int, stale: Column, required: int, threshold: float, sync_steps: int) -> Column:
    """Generation pauses when the queue is full or too many samples are of older parameters."""
    return (queued >= queue_limit) | (stale >= required * (threshold + 1) * sync_steps)


def micro_batches(requests: DataFrame, key: str, time: str, most: int, wait: float) -> DataFrame:
    """Number of the batch of each request: the first opens one, and it closes at `most` requests or after `wait`."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(time)
        number, size, opened, out = -1, 0, 0.0, []
        for now in frame[time]:
            if number < 0 or size >= most or now - opened > wait:
                number, size, opened = number + 1, 0, now
            size += 1
            out.append(number)
        return frame[[key, time]].assign(batch=out)

    kinds = dict(requests.dtypes)
    return requests.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {time} {kinds[time]}, batch long")


def stagnant(generation: Column, best_generation: Column, threshold: int) -> Column:
    return generation - best_generation >= threshold


def running_metrics(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Per-key running count, sum, least and greatest over a stream, by a stateful operator that keeps four numbers a key."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, low, high = state.get if state.exists else (0, 0.0, float("inf"), float("-inf"))
        for frame in frames:
            v = frame[value].dropna()
            n, total = n + len(v), total + float(v.sum())
            low, high = min(low, float(v.min()) if len(v) else low), max(high, float(v.max()) if len(v) else high)
        state.update((n, total, low, high))
        yield pd.DataFrame([(keys[0], n, total, low, high)], columns=[key, "n", "total", "low", "high"])

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, total double, low double, high double", "n long, total double, low double, high double", "update", GroupStateTimeout.NoTimeout)


def event_windows(df: DataFrame, time: str, length: str, keys: list[str], value: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """start, keys, n and total of event-time windows, tumbling or sliding; on a stream, `late` is how long rows may lag behind the newest."""
    rows = df.withWatermark(time, late) if late and df.isStreaming else df
    span = F.window(time, length, slide) if slide else F.window(time, length)
    out = rows.groupBy(span.alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, "n", "total")


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """start, end and number of rows of each key's sessions: rows that follow each other within `gap`."""
    rows = df.withWatermark(time, late) if late and df.isStreaming else df
    out = rows.groupBy(F.session_window(time, gap).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, "n")


def stale_span(lowest: Column, highest: Column) -> Column:
    """Over how many parameter versions a partly generated sample stretches."""
    return F.abs(highest - lowest)
