"""Revenue over time, by product and by channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwork.functions.dates import day_name, day_of, month_of, quarter_of, weekday_sunday0
from tillwork.functions.measures import mean, percent, ratio, sale_count


def monthly_revenue(sales: DataFrame) -> DataFrame:
    """Revenue, number of sales and mean amount per month."""
    return (
        sales.groupBy(month_of(F.col("transaction_date")).alias("month"))
        .agg(
            F.sum("total_amount").alias("monthly_revenue"),
            sale_count(sales).alias("transaction_count"),
            mean(sales, "total_amount").alias("avg_order_value"),
        )
        .orderBy(F.col("month").asc_nulls_last())
    )


def top_products(sales: DataFrame, limit: int = 20) -> DataFrame:
    """The products with the most revenue; equal revenue is ordered by name, then category."""
    return (
        sales.groupBy("product_name", "product_category")
        .agg(
            F.sum("total_amount").alias("total_revenue"),
            F.sum("quantity").alias("units_sold"),
            mean(sales, "unit_price").alias("avg_price"),
        )
        .orderBy(F.col("total_revenue").desc_nulls_first(), "product_name", "product_category")
        .limit(limit)
    )


def channel_performance(sales: DataFrame) -> DataFrame:
    """Per channel: revenue, sales, mean amount and share of all revenue."""
    everything = Window.partitionBy()
    return (
        sales.groupBy("sales_channel")
        .agg(
            F.sum("total_amount").alias("revenue"),
            sale_count(sales).alias("transactions"),
            mean(sales, "total_amount").alias("avg_order_value"),
        )
        # One row per channel is left here.
        .withColumn(
            "revenue_percentage", percent(F.col("revenue"), F.sum("revenue").over(everything)))
        .orderBy(F.col("revenue").desc_nulls_first())
    )


def day_of_week_sales(sales: DataFrame) -> DataFrame:
    """Per weekday, Sunday = 0."""
    return (
        sales.groupBy(weekday_sunday0(F.col("transaction_date")).cast("bigint").alias("day_of_week"))
        .agg(
            F.sum("total_amount").alias("revenue"),
            sale_count(sales).alias("transactions"),
            mean(sales, "total_amount").alias("avg_order_value"),
        )
        .select(
            "day_of_week", day_name(F.col("day_of_week").cast("int")).alias("day_name"),
            "revenue", "transactions", "avg_order_value",
        )
        .orderBy(F.col("day_of_week").asc_nulls_last())
    )


def hourly_sales(sales: DataFrame) -> DataFrame:
    """Per hour of the day."""
    return (
        sales.groupBy(F.hour("transaction_date").cast("bigint").alias("hour_of_day"))
        .agg(
            F.sum("total_amount").alias("revenue"),
            sale_count(sales).alias("transactions"),
            mean(sales, "total_amount").alias("avg_order_value"),
        )
        .orderBy(F.col("hour_of_day").asc_nulls_last())
    )


def daily_revenue(sales: DataFrame) -> DataFrame:
    """Revenue per calendar date; sales without a date are left out."""
    return (
        sales.where(F.col("transaction_date").isNotNull())
        .groupBy(day_of(F.col("transaction_date")).alias("sale_date"))
        .agg(F.coalesce(F.sum("total_amount"), F.lit(0)).alias("revenue"))
        .orderBy("sale_date")
    )


def revenue_growth(sales: DataFrame) -> DataFrame:
    """Revenue per quarter and its change on the quarter before, in percent."""
    # One row per quarter is left when the window runs.
    in_time = Window.partitionBy().orderBy("quarter")
    return (
        sales.where(F.col("transaction_date").isNotNull())
        .groupBy(quarter_of(F.col("transaction_date")).alias("quarter"))
        .agg(F.sum("total_amount").alias("revenue"))
        .withColumn("previous_revenue", F.lag("revenue").over(in_time))
        .withColumn(
            "growth_rate",
            percent(F.col("revenue") - F.col("previous_revenue"), F.col("previous_revenue")))
        .orderBy("quarter")
    )


def seasonal_index(sales: DataFrame) -> DataFrame:
    """Per category and quarter of the year: mean daily revenue against the category's own mean.

    An index over 1 is a season above the category's average day on which it sold.
    """
    daily = (
        sales.where(F.col("transaction_date").isNotNull())
        .groupBy("product_category", day_of(F.col("transaction_date")).alias("day"))
        .agg(F.sum("total_amount").alias("revenue"))
    )
    by_category = Window.partitionBy("product_category")
    return (
        daily.groupBy("product_category", F.quarter("day").cast("bigint").alias("quarter_of_year"))
        .agg(F.sum("revenue").alias("quarter_revenue"), F.count("revenue").alias("days"))
        .withColumn("quarter_mean", ratio(F.col("quarter_revenue"), F.col("days")))
        .withColumn(
            "category_mean",
            ratio(F.sum("quarter_revenue").over(by_category), F.sum("days").over(by_category)))
        .select(
            "product_category", "quarter_of_year", "quarter_mean",
            ratio(F.col("quarter_mean"), F.col("category_mean")).alias("seasonal_index"),
        )
        .orderBy("product_category", "quarter_of_year")
    )


def gross_margin_by_category(sales: DataFrame) -> DataFrame:
    """Profit as a percentage of revenue per category."""
    return (
        sales.groupBy("product_category")
        .agg(F.sum("total_amount").alias("revenue"), F.sum("profit").alias("profit"))
        .withColumn("gross_margin", percent(F.col("profit"), F.col("revenue")))
        .orderBy(F.col("gross_margin").desc_nulls_last())
    )


def kpi_drilldown(sales: DataFrame, levels: tuple[str, ...] = ("region", "product_category", "product_name")) -> DataFrame:
    """Revenue, profit and sales at every level of a drill-down path.

    ``depth`` is the number of levels a row is broken down by; deeper columns
    are NULL. Sales are summed at the finest level first, so the roll-up
    expands those sums and not the sales.
    """
    finest = sales.groupBy(*levels).agg(
        F.sum("total_amount").alias("revenue"),
        F.sum("profit").alias("profit"),
        sale_count(sales).alias("transactions"),
    )
    rolled = finest.rollup(*levels).agg(
        F.sum("revenue").alias("revenue"),
        F.sum("profit").alias("profit"),
        F.sum("transactions").alias("transactions"),
        F.bit_count(F.grouping_id()).alias("_rolled"),
    )
    return rolled.select(
        (F.lit(len(levels)) - F.col("_rolled")).cast("bigint").alias("depth"),
        *levels, "revenue", "profit", "transactions",
        percent(F.col("profit"), F.col("revenue")).alias("margin"),
    )
