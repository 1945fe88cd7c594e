"""A polled feed of JSON rows as a streaming source, and acts that are done at least once and then marked.

The feed is a folder to which files of JSON lines are added.  An offset is the name of the last file taken, so
files are taken in the order of their names, which must not fall behind (a time or a running number).  A batch has a partition per
``files_per_task`` files, read by the executors.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions.text import normal_email
from ..operators.records import pending_texts

SCHEMA = "name string, email string, phone string, ts string, texted_at string"


class _Files(InputPartition):
    def __init__(self, files: tuple[str, ...]):
        self.files = files


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, schema: StructType, files_per_task: int):
        self.folder, self.fields, self.files_per_task = folder, [f.name for f in schema], files_per_task

    def _names(self) -> list[str]:
        return sorted(n for n in os.listdir(self.folder) if n.endswith(".json")) if os.path.isdir(self.folder) else []

    def initialOffset(self) -> dict:  # noqa: N802
        return {"last": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"last": (self._names() or [""])[-1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        new = [os.path.join(self.folder, n) for n in self._names() if start["last"] < n <= end["last"]]
        return [_Files(tuple(new[k : k + self.files_per_task])) for k in range(0, len(new), self.files_per_task)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for file in partition.files:
            with open(file, encoding="utf-8") as lines:
                for line in lines:
                    if line.strip():
                        row = json.loads(line)
                        yield tuple(None if row.get(f) is None else str(row[f]) for f in self.fields)

    def commit(self, end: dict) -> None:
        pass


class Feed(DataSource):
    """Format ``polled-feed``: options ``path`` (a folder that driver and executors share) and ``files_per_task``."""

    @classmethod
    def name(cls) -> str:
        return "polled-feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(self.options["path"], schema, int(self.options.get("files_per_task", "16")))


def feed_stream(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """Rows of the feed as they come; all columns are strings."""
    spark.dataSource.register(Feed)
    return spark.readStream.format("polled-feed").schema(_parse_datatype_string(schema)).load(folder)


def run_acts(rows: DataFrame, marks: str, checkpoint: str, act: Callable[[DataFrame], None], mark: Callable[[DataFrame, str], None] | None = None) -> StreamingQuery:
    """Act on every row that is still to be sent a text and not yet marked, then mark it: at least once, never not at all.

    Marks are a Parquet folder per batch below ``marks``.  A run that ends between act and mark repeats the batch, and so the
    act; one that ends after the mark finds the rows marked when the batch is run again, and adds nothing to its marks.
    """
    write = mark or (lambda done, folder: done.write.mode("append").parquet(folder))

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = pending_texts(batch).withColumn("_email", normal_email(batch["email"])).dropDuplicates(["_email"])
        known = os.path.join(marks, "batch=*")
        there = spark._jvm.org.apache.hadoop.fs.Path(known)
        found = there.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(there)
        todo = own.join(spark.read.parquet(*[f.getPath().toString() for f in found]).select("_email"), "_email", "left_anti") if found else own
        todo = todo.persist()
        act(todo.drop("_email"))
        write(todo.select("_email"), os.path.join(marks, f"batch={number}"))
        todo.unpersist()

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
