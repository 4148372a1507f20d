"""A table of programs that is updated by key and can be read as it was: Parquet folders by bucket of the key, and a list of folders for each version.

An update rewrites the buckets that its keys fall into and leaves the others' files as they are. A version exists once its list, a single file, is there;
two writers of the same version can't both succeed, and what a failed one left behind isn't in any list.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Versions:
    """A versioned table at a path that driver and executors share; rows are unique by `key`."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def lists(self) -> DataFrame:
        """version, bucket, made: the folder of each bucket; bucket -1 has the columns of the table in `made`."""
        try:
            return self.spark.read.schema("bucket int, made string, version long").json(f"{self.path}/versions")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "bucket int, made string, version long")

    def latest(self) -> int:
        """The newest version, -1 before the first."""
        found = self.lists().agg(F.max("version")).first()[0]
        return -1 if found is None else found

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some buckets of it, as of a version, the newest by default."""
        version = self.latest() if version is None else version
        found = {r["bucket"]: r["made"] for r in self.lists().filter(F.col("version") == version).collect()}  # as many as buckets
        if not found:
            raise ValueError(f"no version {version}")
        schema = StructType.fromJson(json.loads(found.pop(-1)))
        folders = [f"{self.path}/data/{made}/bucket={b}" for b, made in found.items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())

    def _commit(self, rows: DataFrame, version: int, touched: list[int]) -> int:
        """Write the touched buckets to a folder of this attempt, and then the version's list; the list fails if another writer has made that version."""
        made = f"{version}-{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("error").partitionBy("bucket").parquet(f"{self.path}/data/{made}")
        full = self._touched(rows)
        kept = self.lists().filter((F.col("version") == version - 1) & ~F.col("bucket").isin([-1, *touched])).select("bucket", "made")
        new = self.spark.createDataFrame([(-1, rows.schema.json()), *((b, made) for b in full)], "bucket int, made string")
        kept.union(new).coalesce(1).write.mode("error").json(f"{self.path}/versions/version={version}")
        return version

    def save(self, rows: DataFrame) -> int:
        """The whole table anew, as the next version."""
        version = self.latest() + 1
        return self._commit(rows, version, list(range(self.buckets)))

    def upsert(self, rows: DataFrame) -> int:
        """Rows replace those of their keys or are added; the number of the new version."""
        version = self.latest() + 1
        if not version:
            return self.save(rows)
        touched = self._touched(rows)
        old = self.read(version - 1, touched)
        return self._commit(old.join(rows.select(self.key), self.key, "left_anti").unionByName(rows, allowMissingColumns=True), version, touched)

    def update(self, changes: dict[str, Column], where: Column) -> int:
        """Change columns of the rows for which `where` holds, as in scoring all programs anew; buckets without such rows stay."""
        chosen = self.read().filter(where)
        return self.upsert(chosen.withColumns(changes))

    def delete(self, keys: DataFrame) -> int:
        """The table without the rows of some keys."""
        version = self.latest() + 1
        touched = self._touched(keys)
        return self._commit(self.read(version - 1, touched).join(keys.select(self.key), self.key, "left_anti"), version, touched)
