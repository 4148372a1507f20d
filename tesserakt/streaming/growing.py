"""Training sets that grow while they are used: batches of finished steps, weights of items, and appends that happen once.

Needs Spark's RocksDB state store (``with_state``). All streams restart from their checkpoint without a lost or repeated batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class FinishedSteps(StatefulProcessor):
    """State of a step of training: the latest status of each of its prompts.

    Once the watermark is `patience` past a step's last event and none of its prompts runs any more, its successes leave as one batch and the
    state goes; prompts that still run put that off until `longest` after the last event, when the step is given up as it is. Rows that come for a step afterwards are a step anew.
    """

    def __init__(self, patience: int, longest: int) -> None:
        self.patience, self.longest = patience, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.prompts = handle.getMapState("prompts", "prompt string", "status string")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self.last.get()[0] if self.last.exists() else 0
        for batch in rows:
            for r in batch.sort_values("time", kind="stable").itertuples():
                if r.status == "removed":
                    if self.prompts.containsKey((r.prompt,)):
                        self.prompts.removeKey((r.prompt,))
                else:
                    self.prompts.updateValue((r.prompt,), (r.status,))
                newest = max(newest, int(r.time.timestamp() * 1000))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.last.update((newest,))
        self.handle.registerTimer(newest + self.patience)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return
        found = sorted((p[0], s[0]) for p, s in self.prompts.iterator())
        running, end = any(s == "running" for _, s in found), self.last.get()[0] + self.longest
        if running and expiredTimerInfo.getExpiryTimeInMs() < end:
            self.handle.registerTimer(end)
            return
        done = [p for p, s in found if s == "success"]
        yield pd.DataFrame({"step": [key[0]] * len(done), "prompt": done, "whole": [not running] * len(done)})
        self.prompts.clear()
        self.last.clear()

    def close(self) -> None:
        pass


def finished_steps(events: DataFrame, delay: str = "1 minute", patience: int = 60_000, longest: int = 600_000) -> DataFrame:
    """Of a stream of (step, prompt, status, time), status running, success, failure or removed: step, prompt, whole, all of a step in one batch."""
    rows = events.withWatermark("time", delay).groupBy("step")
    kind = dict(events.dtypes)["step"]
    return rows.transformWithStateInPandas(FinishedSteps(patience, longest), f"step {kind}, prompt string, whole boolean", "Append", "EventTime")


class ItemWeights(StatefulProcessor):
    """State of an item: how often it was answered and how well; it's forgotten when nothing comes for `ttl` milliseconds."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long, total double", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total = self.seen.get() if self.seen.exists() else (0, 0.0)
        for batch in rows:
            n, total = n + len(batch), total + float(batch["reward"].sum())
        self.seen.update((n, total))
        mean = total / n
        yield pd.DataFrame({"item": [key[0]], "n": [n], "mean": [mean], "weight": [mean * (1 - mean) + 1 / (n + 1)]})

    def close(self) -> None:
        pass


def item_weights(answers: DataFrame, ttl: int = 86_400_000) -> DataFrame:
    """Of a stream of (item, reward from 0 to 1): item, n, mean and weight after each trigger; items that are neither solved nor hopeless, or seldom seen, weigh most."""
    kind = dict(answers.dtypes)["item"]
    return answers.groupBy("item").transformWithStateInPandas(ItemWeights(ttl), f"item {kind}, n long, mean double, weight double", "Update", "ProcessingTime")


def append_once(stream: DataFrame, path: str, checkpoint: str, generate: Callable[[DataFrame], DataFrame] | None = None, longest: int | None = None, prompt: str = "prompt"):
    """A query that appends each batch, or what `generate` makes of it, as a folder of its own; a batch that is repeated after a failure replaces its folder.

    Prompts of more than `longest` characters are left out. Read the set as Parquet; column `batch` is the folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = generate(batch) if generate else batch
        if longest is not None:
            rows = rows.filter(F.length(prompt) <= longest)
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
