"""Event streams and running them to the end of what has arrived."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.functions.dates import utc_instant
from tillwork.session import STATE_STORE, STATE_STORE_SETTING
from tillwork.sources.scratch import new_path
from tillwork.sources.star import TABLE_SCHEMAS

EVENT_TIME = "event_time"
HEARTBEAT = "heartbeat"


def read_events(
    spark: SparkSession, folder: str, pattern: str = "events.parquet*", files_per_trigger: int = 1000,
) -> DataFrame:
    """A stream of the event table, be it one file or a folder of part files.

    A backlog is taken in batches of at most ``files_per_trigger`` files.
    """
    stream = (
        spark.readStream.schema(TABLE_SCHEMAS["events"])
        .option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{pattern}")
    )
    return with_event_time(stream)


def with_event_time(events: DataFrame) -> DataFrame:
    """Add ``event_time``, the zone-less ``ts`` read as UTC, which watermarks can use."""
    return events.withColumn(EVENT_TIME, utc_instant(F.col("ts")))


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, whatever the session's setting."""
    before = spark.conf.get(STATE_STORE_SETTING)
    spark.conf.set(STATE_STORE_SETTING, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE_SETTING, before)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything available to parquet files at ``path``, then stop.

    Run again with the same paths to continue after new files or a failure.
    """
    with rocksdb_state(stream.sparkSession):
        running = (
            stream.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(path)
        )
    running.awaitTermination()


def drain_batches(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
) -> None:
    """Hand everything available to ``write`` batch by batch, then stop.

    A batch that failed is handed over again with the same number after a restart, so
    ``write`` replaces what it may have written before.
    """
    with rocksdb_state(stream.sparkSession):
        running = (
            stream.writeStream.outputMode(mode).foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    running.awaitTermination()


def read_written(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table that batches wrote to ``path``, with the columns of ``like``; empty if none did."""
    try:
        return spark.read.schema(like.schema).parquet(path).select(*like.columns)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], like.schema)


def upsert(stream: DataFrame, path: str, checkpoint: str, key: str) -> None:
    """Keep a table at ``path`` with the latest row of each ``key``, one partition each.

    The stream is an aggregation by ``key`` with a watermark. A batch brings the keys that
    changed and replaces their partitions only; keys behind the watermark leave the state and
    stay in the table.
    """

    def replace(changed: DataFrame, batch: int) -> None:
        (
            changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(key).parquet(path)
        )

    drain_batches(stream, replace, checkpoint, "update")


def upserted(stream: DataFrame, label: str, key: str) -> DataFrame:
    """``upsert`` into a fresh intermediate table and return the table."""
    path = new_path(stream.sparkSession, label)
    upsert(stream, path, new_path(stream.sparkSession, f"{label}-checkpoint"), key)
    return read_written(stream.sparkSession, path, stream)


def with_heartbeats(events: DataFrame, folder: str) -> DataFrame:
    """Events and the heartbeats of ``folder``, which move the watermark when events are few or at an end."""
    spark = events.sparkSession
    schema = TABLE_SCHEMAS["events"]
    spark.createDataFrame([], schema).write.mode("append").parquet(folder)
    beats = with_event_time(spark.readStream.schema(schema).parquet(folder))
    return events.unionByName(beats)


def beat(spark: SparkSession, folder: str, at: datetime.datetime) -> None:
    """Write a heartbeat: by ``at`` all events have come that are not later than the watermark's delay."""
    row = (None, at, None, HEARTBEAT, None, None)
    spark.createDataFrame([row], TABLE_SCHEMAS["events"]).coalesce(1).write.mode("append").parquet(folder)


def no_heartbeat() -> Column:
    """True for events; names the event time so that the watermark still sees heartbeats."""
    return ~F.col("event_type").eqNullSafe(HEARTBEAT) | F.col(EVENT_TIME).isNull()


def snapshot(stream: DataFrame, label: str) -> DataFrame:
    """The whole result of an aggregation after all that has arrived, open groups included.

    Each batch replaces the table before it, so only for results of bounded size,
    such as a row per day.
    """
    spark = stream.sparkSession
    path = new_path(spark, label)

    def replace(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch-{batch}")
        last[0] = f"{path}/batch-{batch}"

    last = [f"{path}/none"]
    (
        stream.writeStream.outputMode("complete").foreachBatch(replace)
        .option("checkpointLocation", new_path(spark, f"{label}-checkpoint"))
        .trigger(availableNow=True).start().awaitTermination()
    )
    if last[0].endswith("none"):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(last[0])


def drained(stream: DataFrame, label: str) -> DataFrame:
    """``drain`` into a fresh intermediate table and return the table."""
    spark = stream.sparkSession
    path = new_path(spark, label)
    drain(stream, path, new_path(spark, f"{label}-checkpoint"))
    return spark.read.schema(stream.schema).parquet(path)
