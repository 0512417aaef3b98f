"""How visits turn into sales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.functions.dates import day_of
from tillwork.functions.measures import percent


def conversion_rate(events: DataFrame, start: str = "view", goal: str = "purchase") -> DataFrame:
    """Per day: events of the ``start`` and ``goal`` type and their ratio in percent."""
    return (
        events.where(F.col("ts").isNotNull())
        .groupBy(day_of(F.col("ts")).alias("day"))
        .agg(
            F.count_if(F.col("event_type") == start).alias("starts"),
            F.count_if(F.col("event_type") == goal).alias("goals"),
        )
        .withColumn("conversion_rate", percent(F.col("goals"), F.col("starts")))
        .orderBy("day")
    )
