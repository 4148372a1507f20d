"""Stages that cut a plan's lineage, and numbers along an order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def staged(df: DataFrame) -> DataFrame:
    """Written as Parquet to the checkpoint folder and reread; a single machine that names none gets one in its temporary folder."""
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tesserakt-")
        spark.conf.set("spark.checkpoint.dir", path)
    path = f"{path.rstrip('/')}/tesserakt/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Rows with their number from 0 in the whole order; each range of the order is numbered by itself, and only the ranges' sizes meet."""
    parts = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(sizes.select("_part", before.alias("_before")), "_part").select(*df.columns, (F.col("_before") + within).alias(out))


def first_of(df: DataFrame, order: list[Column], number: int) -> DataFrame:
    """The first rows of an order, which has no ties; only the ranges of the order that hold one of them are numbered, each by itself."""
    parts = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = parts.join(F.broadcast(sizes.select("_part", before.alias("_before")).filter(F.col("_before") < number)), "_part")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return held.withColumn("_at", F.col("_before") + within).filter(F.col("_at") <= number).select(*df.columns)
