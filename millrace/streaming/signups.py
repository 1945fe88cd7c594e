"""Sign-ups as a stream: one row per address ever, written so that a repeated batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.records import chain_faults, clean_signups, first_signups, head, heads_after, mark_texted

SCHEMA = "ts string, name string, email string, phone string, note string, source string"


def signup_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New JSON files of a folder, cleaned; duplicates of an address are dropped across the whole stream."""
    return clean_signups(spark.readStream.schema(SCHEMA).json(folder)).dropDuplicates(["email"])


def run_signups(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append new addresses to a Parquet folder; each batch has a folder of its own, which a retry overwrites."""

    def write(batch: DataFrame, number: int) -> None:
        first_signups(batch, "email", "ts", "name").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return signup_stream(spark, source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """The batches that have a folder of their own below ``folder``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def run_chain_check(records: DataFrame, checkpoint: str, act: Callable[[DataFrame], None], stream: str = "stream_id", seq: str = "seq", heads: str | None = None) -> StreamingQuery:
    """Hand each batch's numbering faults to ``act``; a batch goes on from where the ones before it ended.

    What each stream ended with is a table per batch in the folder ``heads`` (below the checkpoint by default); a
    retried batch reads that of the one before it and overwrites its own.
    """
    folder = heads or f"{checkpoint}/heads"

    def check(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [n for n in _versions(spark, folder) if n < number]
        batch = batch.persist()
        ends = spark.read.parquet(f"{folder}/batch={before[-1]}") if before else head(batch, stream, seq).limit(0)
        act(chain_faults(batch, stream, seq, heads=ends))
        heads_after(ends, batch, stream, seq).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        batch.unpersist()

    return records.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_callbacks(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Mark sign-ups as texted: every batch of ``(texted, at)`` JSON files makes a new version of the table in ``target``.

    The latest version is that of the highest batch; version ``batch=-1`` is the table to begin with.
    """

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = [n for n in _versions(session, target) if n < number]
        mark_texted(session.read.parquet(f"{target}/batch={before[-1]}"), batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.schema("texted string, at string").json(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
