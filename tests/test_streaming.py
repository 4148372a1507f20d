"""A live stream against the batch result."""

import pandas as pd
from pyspark.sql import functions as F

from tesserakt.streaming import replay


def test_running_metrics(spark, tmp_path):
    rows = pd.DataFrame({"key": ["a", "b", "a", "a"], "value": [1.0, 2.0, 3.0, -1.0]})
    source, out = str(tmp_path / "in"), []
    for i in range(2):
        spark.createDataFrame(rows.iloc[2 * i : 2 * i + 2]).coalesce(1).write.mode("append").json(source)
    stream = spark.readStream.schema("key string, value double").option("maxFilesPerTrigger", 1).json(source)
    query = (
        replay.running_metrics(stream, "key", "value")
        .writeStream.outputMode("update")
        .foreachBatch(lambda df, _: out.extend(df.collect()))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(120)
    last = {r["key"]: (r["n"], r["total"], r["low"], r["high"]) for r in out}
    assert last == {"a": (3, 3.0, -1.0, 3.0), "b": (1, 2.0, 2.0, 2.0)}


def test_count_windows(spark):
    got = replay.count_windows(spark.range(10), "id", 4).agg(F.count(F.lit(1)).alias("n")).orderBy("window").collect()
    assert [r["n"] for r in got] == [4, 4, 2]
