"""Filtered sales and the tables behind each KPI and chart."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.functions.dates import day_of
from tillwork.functions.measures import cents, mean, mean_cents, percent, sale_count, value_count

CATEGORICAL_COLUMNS = ("product_category", "sales_channel", "region", "customer_segment")


@dataclass(frozen=True)
class FilterSpec:
    """What to keep. ``None`` leaves a column unfiltered; an empty list keeps nothing."""

    start: datetime.date | None = None
    end: datetime.date | None = None
    categories: Sequence[str] | None = None
    regions: Sequence[str] | None = None
    channels: Sequence[str] | None = None


def filter_sales(sales: DataFrame, spec: FilterSpec) -> DataFrame:
    """Sales within an inclusive date range and with listed values.

    The date range applies only when both ends are given.
    """
    if spec.start is not None and spec.end is not None:
        sales = sales.where(day_of(F.col("transaction_date")).between(F.lit(spec.start), F.lit(spec.end)))
    for column, values in (
        ("product_category", spec.categories),
        ("region", spec.regions),
        ("sales_channel", spec.channels),
    ):
        if values is not None:
            sales = sales.where(F.col(column).isin(list(values)) if values else F.lit(False))
    return sales


def filter_options(sales: DataFrame) -> DataFrame:
    """The values each filter can take: one row per value, and the first and last date."""
    columns = ("product_category", "region", "sales_channel")
    entries = [
        F.struct(F.lit(c).alias("option"), F.col(c).alias("value")) for c in columns]
    # One pass: combinations are few, and hold each value and the date range.
    combined = sales.groupBy(*columns).agg(
        F.min("transaction_date").alias("first"), F.max("transaction_date").alias("last"))
    entries += [
        F.struct(F.lit("first_date").alias("option"), F.col("first").cast("date").cast("string").alias("value")),
        F.struct(F.lit("last_date").alias("option"), F.col("last").cast("date").cast("string").alias("value")),
    ]
    options = combined.select(F.inline(F.array(*entries))).where(F.col("value").isNotNull())
    dates = F.col("option").isin("first_date", "last_date")
    # All dates of one kind share a key, all other values keep their own.
    return (
        options.groupBy("option", F.when(dates, F.lit(None)).otherwise(F.col("value")).alias("own"))
        .agg(F.min("value").alias("least"), F.max("value").alias("greatest"))
        .select("option", F.when(F.col("option") == "last_date", F.col("greatest"))
                .otherwise(F.col("least")).alias("value"))
        .orderBy("option", "value")
    )


def kpi_summary(sales: DataFrame) -> DataFrame:
    """One row of headline figures; with no sales, zero totals and NULL ratios."""
    return (
        sales.agg(
            F.coalesce(F.sum("total_amount"), F.lit(0)).alias("total_revenue"),
            F.coalesce(F.sum("profit"), F.lit(0)).alias("total_profit"),
            mean(sales, "total_amount").alias("avg_order_value"),
            F.count_distinct("customer_id").alias("total_customers"),
            F.coalesce(sale_count(sales), F.lit(0)).alias("total_transactions"),
        )
        .withColumn("profit_margin", percent(F.col("total_profit"), F.col("total_revenue")))
    )


def empty_guard(sales: DataFrame, spec: FilterSpec) -> DataFrame:
    """Headline figures of the filtered sales and whether there are any."""
    return kpi_summary(filter_sales(sales, spec)).withColumn(
        "has_data", F.col("total_transactions") > 0)


def category_performance(sales: DataFrame) -> DataFrame:
    """Revenue, profit and units per category."""
    return (
        sales.where(F.col("product_category").isNotNull())
        .groupBy("product_category")
        .agg(*[
            F.coalesce(F.sum(column), F.lit(0)).alias(name)
            for name, column in (("revenue", "total_amount"), ("profit", "profit"), ("units", "quantity"))
        ])
        .orderBy("product_category")
    )


def segment_performance(sales: DataFrame) -> DataFrame:
    """Revenue, mean amount and distinct customers per customer segment."""
    per_customer = (
        sales.where(F.col("customer_segment").isNotNull())
        .groupBy("customer_segment", "customer_id")
        .agg(F.sum("total_amount").alias("revenue"), value_count(sales, "total_amount").alias("amounts"))
    )
    return (
        per_customer.groupBy("customer_segment")
        .agg(
            cents(F.coalesce(F.sum("revenue"), F.lit(0))).alias("total_revenue"),
            mean_cents(F.sum("revenue"), F.sum("amounts")).alias("avg_order_value"),
            F.count("customer_id").alias("customer_count"),
        )
        .orderBy("customer_segment")
    )


def region_distribution(sales: DataFrame) -> DataFrame:
    """Revenue per region and its share of all revenue."""
    everything = Window.partitionBy()
    return (
        sales.where(F.col("region").isNotNull())
        .groupBy("region").agg(F.coalesce(F.sum("total_amount"), F.lit(0)).alias("revenue"))
        # One row per region is left here.
        .withColumn("share", percent(F.col("revenue"), F.sum("revenue").over(everything)))
        .orderBy("region")
    )


def channel_stats(sales: DataFrame) -> DataFrame:
    """Revenue and number of sales with a transaction id per channel."""
    return (
        sales.where(F.col("sales_channel").isNotNull())
        .groupBy("sales_channel")
        .agg(
            F.coalesce(F.sum("total_amount"), F.lit(0)).alias("revenue"),
            value_count(sales, "transaction_id").alias("transactions"),
        )
        .orderBy("sales_channel")
    )


def hourly_pattern(sales: DataFrame) -> DataFrame:
    """Revenue per hour of the day, labelled ``H:00``."""
    return (
        sales.where(F.col("transaction_date").isNotNull())
        .groupBy(F.hour("transaction_date").alias("hour"))
        .agg(F.coalesce(F.sum("total_amount"), F.lit(0)).alias("revenue"))
        .orderBy("hour")
        .select(F.concat(F.col("hour").cast("string"), F.lit(":00")).alias("hour_label"), "revenue")
    )


def categorical_counts(sales: DataFrame, columns: Sequence[str] = CATEGORICAL_COLUMNS) -> DataFrame:
    """Number of sales per value of each column; columns the table lacks are skipped.

    Sales are counted per combination first, so only the combinations are
    turned into one row per column.
    """
    present = [c for c in columns if c in sales.columns]
    combined = sales.groupBy(*present).agg(sale_count(sales).alias("n"))
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in present]
    return (
        combined.select("n", F.inline(F.array(*entries)))
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value").agg(F.sum("n").alias("frequency"))
        .orderBy("column_name", F.col("frequency").desc())
    )


def preview_rows(df: DataFrame, order: Sequence[str | Column], n: int = 1000) -> DataFrame:
    """The first ``n`` rows in the given order."""
    return df.orderBy(*order).limit(n)
