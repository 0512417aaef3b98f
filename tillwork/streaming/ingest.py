"""Validation and de-duplication of an event stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.streaming.events import EVENT_TIME, drain_batches, read_written

# The known event types.
EVENT_TYPES = ("view", "click", "signup", "purchase", "error")


def default_rules() -> dict[str, Column]:
    """Rule name -> condition a good event meets."""
    return {
        "has_id": F.col("event_id").isNotNull(),
        "has_time": F.col("ts").isNotNull(),
        "has_user": F.col("user_id").isNotNull(),
        "known_type": F.col("event_type").isin(*EVENT_TYPES),
        "valid_value": F.col("value") >= 0,
    }


def with_broken_rules(events: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """Add ``broken_rules``, the names of the rules an event does not meet."""
    rules = default_rules() if rules is None else rules
    broken = [
        F.when(~F.coalesce(condition, F.lit(False)), F.lit(name)) for name, condition in rules.items()
    ]
    return events.withColumn("broken_rules", F.array_compact(F.array(*broken)))


def accepted_events(events: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """Events that meet every rule, repeats and late ones included; needs no state."""
    return with_broken_rules(events, rules).where(F.size("broken_rules") == 0).drop("broken_rules")


def once_each(accepted: DataFrame) -> DataFrame:
    """One row for each ``event_id`` of a table, not a stream: the earliest, then the smallest."""
    first = ["ts", *(c for c in accepted.columns if c not in ("event_id", "ts"))]
    return accepted.groupBy("event_id").agg(F.min(F.struct(*first)).alias("event")).select(
        *(F.col("event_id") if c == "event_id" else F.col("event")[c].alias(c) for c in accepted.columns))


def valid_events(
    events: DataFrame, rules: dict[str, Column] | None = None, watermark: str = "1 hour"
) -> DataFrame:
    """Events that meet every rule, each id once, in whatever order they come.

    Nothing is dropped as late: the watermark is set after the de-duplication, for
    what follows. Only valid events reach the state, so it never holds a missing id,
    but it holds every id seen. A backlog is better drained as ``accepted_events``
    and read through ``once_each``, which keeps no state.
    """
    return accepted_events(events, rules).dropDuplicates(["event_id"]).withWatermark(EVENT_TIME, watermark)


def rejected_events(events: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """Events that break a rule, with the names of the rules, for quarantine."""
    return with_broken_rules(events, rules).where(F.size("broken_rules") > 0)


def file_row() -> Column:
    """What names a row of a stream of Parquet files, the same in every attempt."""
    return F.concat(
        F.col("_metadata.file_path"), F.lit("#"), F.col("_metadata.row_index").cast("string"))


def judged_events(
    events: DataFrame, rules: dict[str, Column] | None = None, row_name: Column | None = None,
) -> DataFrame:
    """Every event with its ``broken_rules``, those that break none once for each ``event_id``.

    One pass for both kinds. Each rejected row stays, as it is de-duplicated by its own
    name: ``row_name``, by default its file and place. The state holds a short text for
    each id and rejected row, in RocksDB and so on disk.
    """
    judged = with_broken_rules(events, rules)
    name = F.when(F.size("broken_rules") == 0, F.concat(F.lit("id "), F.col("event_id").cast("string"))).otherwise(
        F.concat(F.lit("row "), file_row() if row_name is None else row_name))
    return judged.withColumn("_once", name).dropDuplicates(["_once"]).drop("_once")


def two_sinks(valid: str, rejected: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that parts judged events into two tables, a folder for each batch.

    The batch is computed once. A batch that comes again replaces its folders, so a kill
    at any place between the two writes and the commit leaves each event once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            good = F.size("broken_rules") == 0
            batch.where(good).drop("broken_rules").write.mode("overwrite").parquet(f"{valid}/batch={number}")
            batch.where(~good).write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        finally:
            batch.unpersist()

    return write


def ingest(
    events: DataFrame, folder: str, rules: dict[str, Column] | None = None, row_name: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Drain ``events`` into the tables ``valid`` and ``rejected`` below ``folder``, and return both.

    Run again with the same folder to go on after new files or a failure.
    """
    spark = events.sparkSession
    judged = judged_events(events, rules, row_name)
    valid, rejected = f"{folder}/valid", f"{folder}/rejected"
    drain_batches(judged, two_sinks(valid, rejected), f"{folder}/checkpoint")
    return (
        read_written(spark, valid, judged.drop("broken_rules")), read_written(spark, rejected, judged))
