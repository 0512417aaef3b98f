"""Daily KPIs of an event stream and alerts on them."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwork.functions.dates import utc_day
from tillwork.functions.measures import ratio
from tillwork.streaming.events import EVENT_TIME, beat, drain, no_heartbeat, with_heartbeats
from tillwork.streaming.processors import EarlierDays

METRICS = ("revenue", "purchases", "views", "errors")


def daily_kpis(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Revenue and counts per UTC day.

    In append mode a day is emitted once, when the watermark passes its end; in update
    mode (``events.upsert``) with every batch that changes it. Events
    later than the watermark are dropped and state is one row per open day, so a
    watermark of months costs little. In
    complete mode (``events.snapshot``) all days are there, open ones too, and late
    events are counted; state is one row per day. Heartbeats are no events of their day.
    """
    purchase = F.col("event_type") == "purchase"
    return (
        events.withWatermark(EVENT_TIME, watermark).where(no_heartbeat())
        .groupBy(F.window(EVENT_TIME, "1 day"))
        .agg(
            F.coalesce(F.sum(F.when(purchase, F.col("value").cast("decimal(18,4)"))), F.lit(0))
            .cast("decimal(28,4)").alias("revenue"),
            F.count_if(purchase).alias("purchases"),
            F.count_if(F.col("event_type") == "view").alias("views"),
            F.count_if(F.col("event_type") == "error").alias("errors"),
        )
        .select(utc_day(F.col("window.start")).alias("day"), *METRICS)
    )


def by_metric(kpis: DataFrame) -> DataFrame:
    """One row per day and metric."""
    entries = [
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS
    ]
    return kpis.select("day", F.inline(F.array(*entries)))


def baseline(history: DataFrame) -> DataFrame:
    """Mean and sample deviation of each metric over past days."""
    return by_metric(history).groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def kpi_alerts(kpis: DataFrame, expected: DataFrame, z: float = 2.0) -> DataFrame:
    """Days on which a metric is ``z`` deviations or more from its baseline.

    ``kpis`` may be a stream; ``expected`` has one row per metric.
    """
    score = ratio(F.col("value") - F.col("mean"), F.col("std"))
    return (
        by_metric(kpis).join(expected, "metric")
        .withColumn("z_score", score)
        .where(F.abs("z_score") >= z)
        .select(
            "day", "metric", "value", "z_score",
            F.when(F.col("z_score") > 0, "high").otherwise("low").alias("direction"))
    )


def alerts_against_earlier_days(kpis: DataFrame, z: float = 2.0) -> DataFrame:
    """As ``kpi_alerts``, each day held against the days before it and no others."""
    # One row per day and metric.
    earlier = Window.partitionBy("metric").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    scored = by_metric(kpis).select(
        "day", "metric", "value", F.avg("value").over(earlier).alias("mean"),
        F.stddev_samp("value").over(earlier).alias("std"))
    return (
        scored.withColumn("z_score", ratio(F.col("value") - F.col("mean"), F.col("std")))
        .where(F.abs("z_score") >= z)
        .select(
            "day", "metric", "value", "z_score",
            F.when(F.col("z_score") > 0, "high").otherwise("low").alias("direction"))
    )


ALERTS = "day DATE, metric STRING, value DOUBLE, z_score DOUBLE, direction STRING"


def alert_stream(kpis: DataFrame, z: float = 2.0) -> DataFrame:
    """As ``alerts_against_earlier_days``, for a stream of ``daily_kpis`` in append mode.

    A day's alerts come when it closes. The days are summed before they are keyed by
    metric, so a key has one row for each day.
    """
    return by_metric(kpis).groupBy("metric").transformWithState(EarlierDays(z), ALERTS, "Append", "None")


def drain_alerts(
    events: DataFrame, folder: str, z: float = 2.0, watermark: str = "1 hour",
    until: datetime.datetime | None = None,
) -> DataFrame:
    """The alerts on all closed days of what has arrived, in a table below ``folder``.

    Run again with the same folder to go on. ``until`` closes all days before its
    watermark by a heartbeat, for when no later events are to come. An append
    appears once, as the state and the table go on from the same checkpoint.
    """
    spark = events.sparkSession
    beats, path, checkpoint = (f"{folder}/{part}" for part in ("heartbeats", "alerts", "checkpoint"))
    alerts = alert_stream(daily_kpis(with_heartbeats(events, beats), watermark), z)
    drain(alerts, path, checkpoint)
    if until is not None:
        beat(spark, beats, until)
        drain(alerts, path, checkpoint)
    return spark.read.schema(ALERTS).parquet(path)


def threshold_alerts(kpis: DataFrame, metric: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Days on which one metric is below ``low`` or above ``high``."""
    value = F.col(metric).cast("double")
    direction = F.when(value < F.lit(low), "low").when(value > F.lit(high), "high")
    return kpis.select(
        "day", F.lit(metric).alias("metric"), value.alias("value"), direction.alias("direction"),
    ).where(F.col("direction").isNotNull())
