"""Folders of results as a Spark data source: a row for each run's folder, written by tasks and published at commit.

    spark.dataSource.register(ResultFolders)
    spark.read.format("results").load(path)
    df.write.format("results").mode("append").save(path)

A run's folder holds metrics.json, correct.json and the job's logs. Tasks write into a hidden folder of their attempt; commit moves the runs of the
successful attempts into place, abort removes them all, so a failed task or job leaves no run. Reading skips what isn't a run.
Paths are of any file system that pyarrow knows, shared by driver and executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

# The files of a run.
METRICS, CORRECT, OUT, ERR = "metrics.json", "correct.json", "job_log.out", "job_log.err"
SCHEMA = "run string, correct boolean, error string, metrics string, stdout_log string, stderr_log string"
#: Runs that a partition reads.
RUNS = 200


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _read(system: fs.FileSystem, path: str) -> str | None:
    if system.get_file_info(path).type != fs.FileType.File:
        return None
    with system.open_input_stream(path) as f:
        return f.read().decode("utf-8", "replace")


def _object(text: str | None) -> dict:
    """What a JSON file holds; nothing if it's missing or broken."""
    try:
        found = json.loads(text or "{}")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


@dataclass
class Runs(InputPartition):
    paths: list[str]


class Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        system, path = opened(self.path)
        found = system.get_file_info(fs.FileSelector(path))
        runs = sorted(x.path for x in found if x.type == fs.FileType.Directory and not x.base_name.startswith((".", "_")))
        return [Runs(runs[i : i + RUNS]) for i in range(0, len(runs), RUNS)] or [Runs([])]

    def read(self, partition: Runs) -> Iterator[tuple]:
        system, _ = opened(self.path)
        for path in partition.paths:
            correct, metrics = _object(_read(system, f"{path}/{CORRECT}")), _object(_read(system, f"{path}/{METRICS}"))
            logs = (_read(system, f"{path}/{name}") or "" for name in (OUT, ERR))
            yield path.rsplit("/", 1)[1], bool(correct.get("correct", False)), correct.get("error"), json.dumps(metrics), *logs


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    runs: list[str]


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, path = opened(self.path)
        attempt, runs = f"{path}/{self.staging}/{uuid.uuid4().hex}", []
        for row in rows:
            run = row["run"]
            if not run or "/" in run or run.startswith((".", "_")):
                raise ValueError(f"not a name of a run: {run}")
            files = {METRICS: row["metrics"] or "{}", CORRECT: json.dumps({"correct": bool(row["correct"]), "error": row["error"]}), OUT: row["stdout_log"], ERR: row["stderr_log"]}
            system.create_dir(f"{attempt}/{run}")
            for name, text in files.items():
                if text:
                    with system.open_output_stream(f"{attempt}/{run}/{name}") as f:
                        f.write(text.encode())
            runs.append(run)
        return Written(attempt, runs)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, path = opened(self.path)
        done = [m for m in messages if m is not None]
        runs = [r for m in done for r in m.runs]
        if len(runs) != len(set(runs)):
            self.abort(messages)
            raise ValueError("a run occurs twice")
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if x.type == fs.FileType.Directory and not x.base_name.startswith((".", "_")):
                    system.delete_dir(x.path)
        for m in done:
            for run in m.runs:
                if system.get_file_info(f"{path}/{run}").type != fs.FileType.NotFound:
                    system.delete_dir(f"{path}/{run}")
                system.move(f"{m.attempt}/{run}", f"{path}/{run}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """What tasks have staged goes, failed attempts' too."""
        system, path = opened(self.path)
        if system.get_file_info(f"{path}/{self.staging}").type != fs.FileType.NotFound:
            system.delete_dir(f"{path}/{self.staging}")


class ResultFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "results"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options["path"], overwrite)
