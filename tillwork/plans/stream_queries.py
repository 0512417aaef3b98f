"""Streams over the event files, run to the end of what is there."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.plans.oracle import rounded
from tillwork.plans.registry import query
from tillwork.sources.scratch import new_path
from tillwork.sources.star import Star
from tillwork.streaming import ingest, kpis
from tillwork.streaming.events import read_events, upserted, with_event_time

# An event may come this much later than the latest one, as part files come in any order.
LATENESS = datetime.timedelta(days=90)
WATERMARK = f"{LATENESS.days} days"

DAYS = """
days AS (
  SELECT CAST(ts AS DATE) AS day,
         COALESCE(SUM(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,4)) END), 0)
           AS revenue,
         COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchases,
         COUNT(*) FILTER (WHERE event_type = 'view') AS views,
         COUNT(*) FILTER (WHERE event_type = 'error') AS errors
  FROM events GROUP BY 1
)"""


def _rules():
    return {**ingest.default_rules(), "value_in_range": F.col("value") <= 100}


@query("validated_ingest", f"""
SELECT event_id, event_type, user_id, {rounded('value')} AS value,
       CASE WHEN value <= 100 THEN '' ELSE 'value_in_range' END AS broken_rules
FROM events""")
def validated_ingest(star: Star):
    return ingested(read_events(star.spark, star.root))


def ingested(events: DataFrame) -> DataFrame:
    """All accepted events, each id once, and all rejected ones, however the stream is cut into batches."""
    columns = ["event_id", "event_type", "user_id", "value"]
    accepted, rejected = ingest.ingest(events, new_path(events.sparkSession, "ingest"), _rules())
    return accepted.select(*columns, F.lit("").alias("broken_rules")).unionByName(
        rejected.select(*columns, F.array_join("broken_rules", ",").alias("broken_rules")))


@query("stream_kpis", f"""WITH {DAYS}
SELECT day, {rounded('revenue')} AS revenue, purchases, views, errors FROM days""")
def stream_kpis(star: Star):
    return upserted(kpis.daily_kpis(read_events(star.spark, star.root), WATERMARK), "kpis", "day")


_LONG = "\n  UNION ALL ".join(
    f"SELECT day, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM days"
    for m in ("revenue", "purchases", "views", "errors"))


@query("kpi_alerts", f"""WITH {DAYS}, long AS ({_LONG})
SELECT day, metric, {rounded('value')} AS value, {rounded('z_score')} AS z_score,
       CASE WHEN z_score > 0 THEN 'high' ELSE 'low' END AS direction
FROM (
  SELECT day, metric, value, (value - AVG(value) OVER before) / NULLIF(STDDEV_SAMP(value) OVER before, 0)
           AS z_score
  FROM long
  WINDOW before AS (PARTITION BY metric ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
) AS scored WHERE abs(z_score) >= 1.5""")
def kpi_alerts(star: Star):
    return alerts(read_events(star.spark, star.root), star.table("events"))


def alerts(events: DataFrame, table: DataFrame) -> DataFrame:
    """Alerts on every day of the stream, its last one included: ``table`` says when it ends."""
    last = table.agg(F.max("ts")).first()[0]
    until = last + LATENESS + datetime.timedelta(days=2) if last is not None else None
    return kpis.drain_alerts(events, new_path(events.sparkSession, "alerts"), 1.5, WATERMARK, until)


@query("batch_kpis", f"""
SELECT CAST(ts AS DATE) AS day,
       {rounded("COALESCE(SUM(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,4)) END), 0)")}
         AS revenue,
       COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchases,
       COUNT(*) FILTER (WHERE event_type = 'view') AS views,
       COUNT(*) FILTER (WHERE event_type = 'error') AS errors
FROM events GROUP BY 1""")
def batch_kpis(star: Star):
    return kpis.daily_kpis(with_event_time(star.table("events")))
