"""Regional revenue, preferences, customer density and delivery time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwork.functions.measures import percent, ratio, sale_count, value_count


def regional_performance(sales: DataFrame) -> DataFrame:
    """Per region: revenue, sales, distinct customers, mean amount, revenue per customer.

    Sales are summed per region and customer first, so distinct customers are
    counted by counting rows.
    """
    per_customer = sales.groupBy("region", "customer_id").agg(
        F.sum("total_amount").alias("revenue"),
        value_count(sales, "total_amount").alias("amounts"),
        sale_count(sales).alias("sales"),
    )
    return (
        per_customer.groupBy("region")
        .agg(
            F.sum("revenue").alias("total_revenue"),
            F.sum("sales").alias("total_transactions"),
            F.count("customer_id").alias("unique_customers"),
            ratio(F.sum("revenue"), F.sum("amounts")).alias("avg_order_value"),
            ratio(F.sum("revenue"), F.count("customer_id")).alias("revenue_per_customer"),
        )
        .orderBy(F.col("total_revenue").desc_nulls_first())
    )


def regional_category_rank(sales: DataFrame) -> DataFrame:
    """Per region: each category's revenue, share of the region and rank."""
    region = Window.partitionBy("region")
    return (
        sales.groupBy("region", "product_category")
        .agg(F.sum("total_amount").alias("category_revenue"))
        .select(
            "region", "product_category", "category_revenue",
            percent(F.col("category_revenue"), F.sum("category_revenue").over(region))
            .alias("percentage_of_regional_sales"),
            F.rank().over(region.orderBy(F.col("category_revenue").desc_nulls_first()))
            .cast("bigint").alias("category_rank"),
        )
        .orderBy(F.col("region").asc_nulls_last(), "category_rank")
    )


def customer_density(sales: DataFrame) -> DataFrame:
    """Distinct customers per region and their share of all regions' customers."""
    everything = Window.partitionBy()
    return (
        sales.where(F.col("customer_id").isNotNull())
        .groupBy("region").agg(F.count_distinct("customer_id").alias("customers"))
        # One row per region is left here.
        .withColumn("customer_share", percent(F.col("customers"), F.sum("customers").over(everything)))
        .orderBy(F.col("customers").desc())
    )


def fulfilment_time(sales: DataFrame) -> DataFrame:
    """Days from sale to shipment per region."""
    days = F.datediff("ship_date", "transaction_date")
    return (
        sales.groupBy("region")
        .agg(
            F.count(days).alias("shipments"),
            ratio(F.sum(days), F.count(days)).alias("avg_days_to_ship"),
            F.min(days).cast("bigint").alias("fastest_days"),
            F.max(days).cast("bigint").alias("slowest_days"),
        )
        .orderBy("avg_days_to_ship")
    )
