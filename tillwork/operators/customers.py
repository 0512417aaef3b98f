"""Customer value, RFM segments, concentration, cohorts and clusters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.functions.buckets import at_least, first_match
from tillwork.functions.dates import day_of, elapsed_days, month_of
from tillwork.functions.measures import cents, mean_cents, percent, ratio, sale_count, value_count
from tillwork.operators.ranking import ntile_columns

# Spending tiers with their lower bounds, and the tier below them.
VALUE_TIERS = ((1000, "High Value"), (500, "Medium Value"))
LOWEST_TIER = "Low Value"


def _average(column: str) -> Column:
    return ratio(F.sum(column), F.count(column))


def customer_ltv_segments(
    sales: DataFrame, tiers: Sequence[tuple[float, str]] = VALUE_TIERS, lowest: str = LOWEST_TIER
) -> DataFrame:
    """Customers by total spend tier: how many, and their mean spend, sales and lifetime."""
    customers = sales.groupBy("customer_id").agg(
        sale_count(sales).alias("orders"),
        F.sum("total_amount").alias("spent"),
        F.datediff(F.max("transaction_date"), F.min("transaction_date")).alias("lifetime_days"),
    )
    return (
        customers.groupBy(at_least(F.col("spent"), tiers, lowest).alias("customer_segment"))
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            _average("spent").alias("avg_lifetime_value"),
            _average("orders").alias("avg_orders"),
            _average("lifetime_days").alias("avg_lifetime_days"),
        )
        .orderBy(F.col("avg_lifetime_value").desc_nulls_first())
    )


def customer_rfm(sales: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Per customer: days since the last sale, number of sales, total spend."""
    as_of = F.current_date() if as_of is None else as_of
    return sales.groupBy("customer_id").agg(
        F.datediff(as_of, F.max("transaction_date")).cast("bigint").alias("recency_days"),
        sale_count(sales).alias("frequency"),
        F.sum("total_amount").alias("monetary_value"),
    )


def rfm_scores(sales: DataFrame, as_of: Column | None = None) -> DataFrame:
    """``customer_rfm`` with quintile scores, 5 the most recent, frequent and valuable."""
    return ntile_columns(
        customer_rfm(sales, as_of), "customer_id", 5,
        {
            "recency_score": ("recency_days", False),
            "frequency_score": ("frequency", True),
            "monetary_score": ("monetary_value", True),
        },
    )


# Segment names with the lowest and highest score each asks for.
# The first segment whose ranges hold all its scores is taken.
RFM_SEGMENTS = (
    ("Champions", {"recency": (4, 5), "frequency": (4, 5), "monetary": (4, 5)}),
    ("Loyal Customers", {"recency": (3, 5), "frequency": (3, 5), "monetary": (3, 5)}),
    ("Potential Loyalists", {"recency": (3, 5), "frequency": (1, 2)}),
    ("At Risk", {"recency": (1, 2), "frequency": (3, 5)}),
    ("Lost Customers", {"recency": (1, 2), "frequency": (1, 2)}),
)
OTHER_SEGMENT = "Others"


def rfm_label(scores: dict[str, Column], segments=RFM_SEGMENTS, otherwise: str = OTHER_SEGMENT) -> Column:
    """Segment name for the scores of a customer, given by measure."""
    rules = [
        (reduce(and_, [scores[m].between(low, high) for m, (low, high) in ranges.items()]), name)
        for name, ranges in segments
    ]
    return first_match(rules, otherwise)


def rfm_segments(sales: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Number of customers and their mean spend, sales and recency per RFM segment."""
    label = rfm_label({m: F.col(f"{m}_score") for m in ("recency", "frequency", "monetary")})
    return (
        rfm_scores(sales, as_of).groupBy(label.alias("customer_segment"))
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            _average("monetary_value").alias("avg_monetary_value"),
            _average("frequency").alias("avg_frequency"),
            _average("recency_days").alias("avg_recency_days"),
        )
        .orderBy(F.col("avg_monetary_value").desc_nulls_first())
    )


def customer_behaviour(sales: DataFrame) -> DataFrame:
    """Per customer: spend, mean amount, number of amounts, first and last sale, whole days between."""
    return (
        sales.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            cents(F.coalesce(F.sum("total_amount"), F.lit(0))).alias("total_spent"),
            mean_cents(F.sum("total_amount"), value_count(sales, "total_amount"))
            .alias("avg_order_value"),
            value_count(sales, "total_amount").alias("order_count"),
            F.min("transaction_date").alias("first_purchase"),
            F.max("transaction_date").alias("last_purchase"),
        )
        .withColumn(
            "customer_lifetime_days",
            elapsed_days(F.col("first_purchase"), F.col("last_purchase")).cast("bigint"))
    )


def customer_concentration(sales: DataFrame, tiles: int = 5) -> DataFrame:
    """Share of revenue by customer tile, tile 1 the highest spenders.

    With five tiles, row 1 says what the top 20 % of customers bring in.
    """
    spend = sales.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.sum("total_amount").alias("spent"))
    tiled = ntile_columns(spend, "customer_id", tiles, {"tile": ("spent", False)})
    # One row per tile is left when the windows run.
    running = Window.partitionBy().orderBy("tile").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    return (
        tiled.groupBy("tile")
        .agg(F.count(F.lit(1)).alias("customers"), F.sum("spent").alias("revenue"))
        .select(
            "tile", "customers", "revenue",
            percent(F.col("revenue"), F.sum("revenue").over(everything)).alias("revenue_share"),
            percent(F.sum("revenue").over(running), F.sum("revenue").over(everything))
            .alias("cumulative_share"),
        )
        .orderBy("tile")
    )


def retention_cohorts(sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Customers by month of first sale who buy again n months later.

    ``by`` adds customer attributes such as ``customer_segment`` to the cohort.
    Sales are first reduced to distinct (customer, month) pairs, so the window
    sees at most one row per month for any customer.
    """
    active = (
        sales.where(F.col("customer_id").isNotNull() & F.col("transaction_date").isNotNull())
        .select(*by, "customer_id", month_of(F.col("transaction_date")).alias("month"))
        .distinct()
    )
    first = F.min("month").over(Window.partitionBy(*by, "customer_id"))
    offset = F.months_between("month", "cohort_month").cast("bigint")
    sizes = Window.partitionBy(*by, "cohort_month")
    return (
        active.withColumn("cohort_month", first)
        .groupBy(*by, "cohort_month", offset.alias("months_since"))
        .agg(F.count(F.lit(1)).alias("customers"))
        # A customer's first month is offset 0, so that row is the cohort's size.
        .withColumn("cohort_size", F.max(F.when(F.col("months_since") == 0, F.col("customers"))).over(sizes))
        .withColumn("retention_rate", percent(F.col("customers"), F.col("cohort_size")))
        .orderBy(*by, "cohort_month", "months_since")
    )


def segment_retention(sales: DataFrame) -> DataFrame:
    """Share of each segment's customers who bought on more than one day."""
    customers = (
        sales.where(F.col("customer_id").isNotNull())
        .groupBy("customer_segment", "customer_id")
        .agg(
            (F.min(day_of(F.col("transaction_date"))) < F.max(day_of(F.col("transaction_date"))))
            .alias("returned"))
    )
    return (
        customers.groupBy("customer_segment")
        .agg(F.count(F.lit(1)).alias("customers"), F.count_if("returned").alias("returning_customers"))
        .withColumn("retention_rate", percent(F.col("returning_customers"), F.col("customers")))
        .orderBy("customer_segment")
    )


def customer_clusters(
    sales: DataFrame, k: int = 4, seed: int = 42, as_of: Column | None = None
) -> DataFrame:
    """k-means over standardised recency, frequency and spend: customers with their cluster.

    Clusters are numbered by mean spend from 0, then by mean frequency and recency, so
    a number keeps its meaning from run to run. Customers who lack a feature have no cluster.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    from tillwork.sources.scratch import materialise

    features = ["recency_days", "frequency", "monetary_value"]
    # Each iteration reads the customers again, so write them once.
    everyone = materialise(customer_rfm(sales, as_of).select(
        "customer_id", *[F.col(c).cast("double").alias(c) for c in features]), "rfm")
    known = everyone.dropna(subset=["customer_id", *features])
    if known.isEmpty():
        return everyone.withColumn("cluster", F.lit(None).cast("bigint"))
    model = Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        KMeans(featuresCol="scaled", predictionCol="cluster", k=k, seed=seed),
    ]).fit(known)
    found = materialise(model.transform(known).select("customer_id", *features, "cluster"), "clusters")
    # One row for each cluster.
    means = [r["cluster"] for r in found.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in features]).orderBy(
        "monetary_value", "frequency", "recency_days", "cluster").collect()]
    place = F.array_position(F.array(*map(F.lit, means)), F.col("cluster")) - 1
    unknown = everyone.where(" OR ".join(f"{c} IS NULL" for c in ["customer_id", *features]))
    return found.withColumn("cluster", place.cast("bigint")).unionByName(
        unknown.withColumn("cluster", F.lit(None).cast("bigint")))


def cluster_profile(clustered: DataFrame) -> DataFrame:
    """Size and mean features of each cluster."""
    return clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("customers"),
        *[_average(c).alias(f"avg_{c}") for c in ("recency_days", "frequency", "monetary_value")],
    ).orderBy("cluster")
