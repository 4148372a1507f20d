"""Growing training sets: restart from a checkpoint, timers, forgetting, and batches that fail half-way."""

import time

import pytest
from pyspark.sql import functions as F

from tesserakt.streaming import growing


@pytest.fixture
def stateful(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield growing.with_state(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


EVENTS = "step long, prompt string, status string, time timestamp"


def put(spark, path, rows):
    spark.createDataFrame(rows, "step long, prompt string, status string, time string").coalesce(1).write.mode("append").json(path)


def run(stream, state, mode, out):
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", state).trigger(availableNow=True).start()
    assert query.awaitTermination(180)


def test_finished_steps_across_a_restart(stateful, tmp_path):
    source, state, out = str(tmp_path / "in"), str(tmp_path / "state"), []
    read = lambda: growing.finished_steps(stateful.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(source), "10 seconds", 30_000, 300_000)
    put(stateful, source, [(1, "a", "running", "2024-01-01 00:00:00"), (1, "b", "running", "2024-01-01 00:00:01"), (2, "c", "running", "2024-01-01 00:00:01"), (3, "x", "running", "2024-01-01 00:00:02")])
    put(stateful, source, [(1, "a", "success", "2024-01-01 00:00:20"), (1, "b", "failure", "2024-01-01 00:00:21"), (2, "c", "success", "2024-01-01 00:00:22"), (2, "d", "success", "2024-01-01 00:00:22"), (2, "e", "removed", "2024-01-01 00:00:22")])
    run(read(), state, "append", out)
    assert out == []  # nobody knows yet that no more comes
    put(stateful, source, [(9, "z", "running", "2024-01-01 00:02:00")])  # the next run goes on from the checkpoint
    put(stateful, source, [(9, "z", "running", "2024-01-01 00:02:01")])
    run(read(), state, "append", out)
    assert sorted(map(tuple, out)) == [(1, "a", True), (2, "c", True), (2, "d", True)]
    put(stateful, source, [(3, "y", "success", "2024-01-01 00:02:10"), (9, "z", "success", "2024-01-01 00:02:11")])
    put(stateful, source, [(10, "q", "running", "2024-01-01 00:30:00")])
    put(stateful, source, [(10, "q", "running", "2024-01-01 00:30:01")])
    run(read(), state, "append", out)
    assert sorted(map(tuple, out[3:])) == [(3, "y", False), (9, "z", True)]  # x never ended: the step is given up without it
    run(read(), state, "append", out)
    assert len(out) == 5


def test_weights_of_items(stateful, tmp_path):
    source, out = str(tmp_path / "in"), []
    for rows in ([("a", 1.0), ("a", 0.0), ("b", 1.0)], [("a", 1.0), ("b", 1.0)]):
        stateful.createDataFrame(rows, "item string, reward double").coalesce(1).write.mode("append").json(source)
    stream = stateful.readStream.schema("item string, reward double").option("maxFilesPerTrigger", 1).json(source)
    query = growing.item_weights(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).start()
    deadline = time.time() + 150
    while time.time() < deadline and sum(r["n"] >= 2 for r in out) < 3:  # a stream with forgetting never runs dry
        time.sleep(0.5)
    query.stop()
    last = {r["item"]: (r["n"], round(r["mean"], 6), round(r["weight"], 6)) for r in out}
    assert last == {"a": (3, round(2 / 3, 6), round(2 / 9 + 0.25, 6)), "b": (2, 1.0, round(1 / 3, 6))}


def test_a_batch_that_fails_is_appended_once(spark, tmp_path):
    source, path, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    failed = []

    def generate(batch):
        made = batch.union(batch.select(F.concat("prompt", F.lit("!"))))
        if batch.filter("prompt = 'two'").count() and not failed:
            failed.append(1)
            made.write.mode("overwrite").parquet(f"{path}/batch=1")  # what a task may have left
            raise RuntimeError("lost")
        return made

    stream = lambda: spark.readStream.schema("prompt string").option("maxFilesPerTrigger", 1).json(source)
    for text in ("one", "two", "a very long prompt"):
        spark.createDataFrame([(text,)], "prompt string").coalesce(1).write.mode("append").json(source)
    with pytest.raises(Exception, match="lost"):
        growing.append_once(stream(), path, state, generate, 6).awaitTermination(120)
    assert growing.append_once(stream(), path, state, generate, 6).awaitTermination(120)
    assert sorted(r["prompt"] for r in spark.read.parquet(path).collect()) == ["one", "one!", "two", "two!"]
