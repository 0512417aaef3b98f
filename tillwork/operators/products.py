"""Category growth, stock turnover, price and discount tiers, reorder points."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.functions.buckets import at_most, first_match
from tillwork.functions.dates import day_of, month_of
from tillwork.functions.measures import mean, percent, ratio, sale_count
from tillwork.sources.scratch import materialise

def category_growth(sales: DataFrame) -> DataFrame:
    """Per category: mean monthly revenue, mean month-on-month growth and its deviation.

    The first month has nothing to compare with and is left out. Growth over a
    month without revenue is NULL.
    """
    monthly = sales.groupBy(
        "product_category", month_of(F.col("transaction_date")).alias("month")
    ).agg(F.sum("total_amount").alias("revenue"))
    in_time = Window.partitionBy("product_category").orderBy(F.col("month").asc_nulls_last())
    growth = percent(F.col("revenue") - F.col("previous"), F.col("previous"))
    return (
        monthly.withColumn("previous", F.lag("revenue").over(in_time))
        .where(F.col("previous").isNotNull())
        .withColumn("growth", growth)
        .groupBy("product_category")
        .agg(
            ratio(F.sum("revenue"), F.count("revenue")).alias("avg_monthly_revenue"),
            F.avg("growth").alias("avg_growth_rate"),
            F.stddev_samp("growth").alias("growth_volatility"),
        )
        .orderBy(F.col("avg_monthly_revenue").desc_nulls_first())
    )


def inventory_turnover(sales: DataFrame, min_months: int = 3) -> DataFrame:
    """Per product sold in at least ``min_months`` months: units, months, units per month, price.

    Sales are summed per product and month first; the months are then counted,
    which needs no distinct.
    """
    monthly = sales.groupBy(
        "product_category", "product_name", month_of(F.col("transaction_date")).alias("month")
    ).agg(F.sum("quantity").alias("units"), F.sum("total_amount").alias("revenue"))
    return (
        monthly.groupBy("product_category", "product_name")
        .agg(
            F.sum("units").alias("total_units_sold"),
            F.count("month").alias("months_active"),
            ratio(F.sum("units"), F.count("month")).alias("avg_monthly_sales"),
            ratio(F.sum("revenue"), F.sum("units")).alias("avg_selling_price"),
        )
        .where(F.col("months_active") >= min_months)
        .orderBy(F.col("avg_monthly_sales").desc_nulls_first())
    )


def discount_label(
    discount: Column, bounds: tuple[int, int] = (10, 20)
) -> Column:
    """Discount tier; a missing discount falls into the highest."""
    low, medium = bounds
    return first_match(
        [
            (discount == 0, "No Discount"),
            (discount <= low, f"Low Discount (1-{low}%)"),
            (discount <= medium, f"Medium Discount ({low + 1}-{medium}%)"),
        ],
        f"High Discount (>{medium}%)",
    )


def discount_tiers(sales: DataFrame, bounds: tuple[int, int] = (10, 20)) -> DataFrame:
    """Per discount tier: sales, revenue, mean amount, quantity and discount."""
    return (
        sales.groupBy(discount_label(F.col("discount_percent"), bounds).alias("discount_tier"))
        .agg(
            sale_count(sales).alias("transaction_count"),
            F.sum("total_amount").alias("revenue"),
            mean(sales, "total_amount").alias("avg_order_value"),
            mean(sales, "quantity").alias("avg_quantity"),
            mean(sales, "discount_percent").alias("avg_discount_rate"),
        )
        .orderBy(F.col("avg_order_value").desc_nulls_first())
    )


# Price tiers with their upper bounds, and the tier above them.
PRICE_TIERS = ((50, "Low Price"), (200, "Medium Price"))
HIGHEST_PRICE_TIER = "High Price"


def price_tier(
    sales: DataFrame,
    tiers: Sequence[tuple[float, str]] = PRICE_TIERS,
    highest: str = HIGHEST_PRICE_TIER,
) -> Column:
    """The tier of a sale's unit price."""
    return at_most(F.col("unit_price"), tiers, highest)


def price_tiers(
    sales: DataFrame,
    tiers: Sequence[tuple[float, str]] = PRICE_TIERS,
    highest: str = HIGHEST_PRICE_TIER,
) -> DataFrame:
    """Per category and price tier: sales, units, mean price, revenue.

    ``sales`` may have a ``price_tier`` already, made by ``price_tier`` before they were summed.
    """
    tier = F.col("price_tier") if "price_tier" in sales.columns else price_tier(sales, tiers, highest)
    return (
        sales.groupBy("product_category", tier.alias("price_tier"))
        .agg(
            sale_count(sales).alias("transaction_count"),
            F.sum("quantity").alias("total_quantity"),
            mean(sales, "unit_price").alias("avg_price"),
            F.sum("total_amount").alias("revenue"),
        )
        .orderBy(F.col("product_category").asc_nulls_last(), F.col("avg_price").asc_nulls_last())
    )


def reorder_points(
    sales: DataFrame, lead_days: int = 7, service_level: float | None = None, z: float = 1.645
) -> DataFrame:
    """Per product: mean and deviation of daily demand, safety stock and reorder point.

    ``z`` deviations are kept in stock (the default is the usual rounding for 95 %),
    or as many as ``service_level`` asks for.

    Days without a sale count as zero demand, from the first to the last day of
    the whole table. They are not made as rows: sums and squares over the days
    with sales, and the number of days, are enough.
    """
    z = z if service_level is None else NormalDist().inv_cdf(service_level)
    daily = (
        sales.where(F.col("transaction_date").isNotNull())
        .groupBy("product_category", "product_name", day_of(F.col("transaction_date")).alias("day"))
        .agg(F.sum("quantity").alias("units"))
    )
    units = F.col("units").cast("decimal(18,0)")
    # Written once, as the length of the calendar comes from all products.
    products = materialise(
        daily.groupBy("product_category", "product_name").agg(
            F.sum("units").alias("total_units"),
            F.sum(units * units).alias("squares"),
            F.min("day").alias("first_day"),
            F.max("day").alias("last_day"),
        ),
        "demand",
    )
    calendar = products.agg(
        (F.datediff(F.max("last_day"), F.min("first_day")) + 1).alias("days"))
    days = F.col("days").cast("double")
    total = F.col("total_units").cast("double")
    variance = ratio(F.col("squares").cast("double") - total * total / days, days - 1)
    deviation = F.sqrt(F.greatest(variance, F.lit(0.0)))
    return (
        products.withColumn("days", calendar.scalar())
        .withColumn("avg_daily_demand", total / days)
        .withColumn("demand_std", deviation)
        .withColumn("safety_stock", F.lit(float(z)) * F.col("demand_std") * F.sqrt(F.lit(float(lead_days))))
        .select(
            "product_category", "product_name", "total_units", "avg_daily_demand", "demand_std",
            "safety_stock",
            (F.col("avg_daily_demand") * lead_days + F.col("safety_stock")).alias("reorder_point"),
        )
    )
