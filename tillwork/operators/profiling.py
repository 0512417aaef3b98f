"""Shape, quality and distribution of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.functions.measures import ROW_COUNT, mean, percent, sale_count, value_count, value_rows
from tillwork.operators.ranking import describe
from tillwork.sources.scratch import materialise

NUMERIC_PROFILE = ("quantity", "unit_price", "discount_percent", "total_amount")


def dataset_shape(df: DataFrame, date_column: str = "transaction_date") -> DataFrame:
    """Number of rows and columns, first and last date."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.to_date(F.min(date_column)).alias("first_date"),
        F.to_date(F.max(date_column)).alias("last_date"),
    )


def row_digest(df: DataFrame) -> Column:
    """128 bits of a row, equal for rows that are equal in every column."""
    # As in grouping, negative zero is zero.
    values = [
        F.col(f.name) + F.lit(0.0).cast(f.dataType) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields]
    return F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(1), *reversed(values)).alias("b"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier row in every column, NULLs being equal.

    Digests are counted first, 16 bytes a row; whole rows are grouped only where a digest
    occurs twice, so the count is exact whatever the digests do. If none does, the rows are not read
    again.
    """
    spark = df.sparkSession
    repeated = materialise(
        df.select(row_digest(df).alias("_digest")).groupBy("_digest").agg(F.count(F.lit(1)).alias("_rows"))
        .where("_rows > 1").select("_digest"), "digests")
    if repeated.isEmpty():
        return spark.range(1).select(F.lit(0).cast("bigint").alias("duplicate_rows"))
    rows = df.withColumn("_digest", row_digest(df)).join(repeated, "_digest", "left_semi")
    groups = rows.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"))


def null_counts(df: DataFrame) -> DataFrame:
    """NULLs per column, one row per column, from one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counted.unpivot([], df.columns, "column_name", "null_count")


def column_types(df: DataFrame) -> DataFrame:
    """Position, name, type and number of values of each column."""
    fields = df.schema.fields
    position = F.array_position(F.array(*[F.lit(f.name) for f in fields]), F.col("column_name"))
    types = F.array(*[F.lit(f.dataType.simpleString()) for f in fields])
    counted = df.agg(*[F.count(F.col(f.name)).alias(f.name) for f in fields])
    return counted.unpivot([], df.columns, "column_name", "non_null_count").select(
        (position - 1).alias("position"), "column_name",
        F.element_at(types, position.cast("int")).alias("data_type"), "non_null_count",
    )


def describe_numeric(
    df: DataFrame, columns: Sequence[str] | None = None, accuracy: int | None = None
) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max per numeric column.

    Quartiles are exact. ``accuracy`` asks for approximate ones instead, which
    need no sort: a rank error of 1/accuracy of the rows.
    """
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if accuracy is None:
        return describe(df, columns)
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value"))
        for c in columns
    ]
    quartiles = F.percentile_approx("value", [0.25, 0.5, 0.75], accuracy)
    return (
        df.select(F.inline(F.array(*entries)))
        .groupBy("column_name")
        .agg(
            F.count("value").alias("count"), F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
            quartiles.alias("q"), F.max("value").alias("max"),
        )
        .select(
            "column_name", "count", "mean", "std", "min",
            *[F.get("q", F.lit(i)).alias(name) for i, name in enumerate(("p25", "p50", "p75"))],
            "max",
        )
    )


def describe_dates(df: DataFrame, column: str = "transaction_date") -> DataFrame:
    """Count, mean, min, exact quartiles and max of a timestamp column, to the second."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = df.select(
        F.timestamp_diff("SECOND", epoch, F.col(column).cast("timestamp_ntz")).alias(column))

    def moment(name: str):
        return F.timestamp_add("SECOND", F.floor(name), epoch).alias(name)

    return describe(seconds, [column]).select(
        "column_name", "count", *[moment(n) for n in ("mean", "min", "p25", "p50", "p75", "max")])


def business_metrics(sales: DataFrame, by_product: DataFrame | None = None) -> DataFrame:
    """Revenue, mean amount, distinct customers and products, mean discount, number of sales.

    ``by_product`` may hold the same sales summed by product, ``sales`` being summed by customer;
    then no row carries both keys. Each key is counted by a grouping of its own, so no row is copied
    for each distinct count.
    """
    measures = ["total_amount", "discount_percent"]
    sums = sales.groupBy("customer_id").agg(
        *[F.sum(m).alias(m) for m in measures],
        *[value_count(sales, m).alias(value_rows(m)) for m in measures], sale_count(sales).alias(ROW_COUNT))
    products = (sales if by_product is None else by_product).select("product_name").distinct().agg(
        F.count("product_name").alias("products"))
    return sums.agg(
        F.coalesce(F.sum("total_amount"), F.lit(0)).alias("total_revenue"),
        mean(sums, "total_amount").alias("avg_order_value"),
        F.count("customer_id").alias("unique_customers"),
        mean(sums, "discount_percent").alias("avg_discount"),
        F.coalesce(sale_count(sums), F.lit(0)).alias("total_transactions"),
    ).select(
        "total_revenue", "avg_order_value", "unique_customers", products.scalar().alias("unique_products"),
        "avg_discount", "total_transactions")


def category_revenue(sales: DataFrame) -> DataFrame:
    """Revenue per category, highest first."""
    return _revenue_by(sales, "product_category").orderBy(F.col("revenue").desc())


def region_revenue(sales: DataFrame) -> DataFrame:
    """Revenue per region."""
    return _revenue_by(sales, "region").orderBy("region")


def _revenue_by(sales: DataFrame, column: str) -> DataFrame:
    return (
        sales.where(F.col(column).isNotNull())
        .groupBy(column).agg(F.coalesce(F.sum("total_amount"), F.lit(0)).alias("revenue"))
    )


def channel_share(sales: DataFrame) -> DataFrame:
    """Number of sales per channel and its share of all, most frequent first."""
    everything = Window.partitionBy()
    return (
        sales.where(F.col("sales_channel").isNotNull())
        .groupBy("sales_channel").agg(sale_count(sales).alias("transactions"))
        # One row per channel is left here.
        .withColumn("share", percent(F.col("transactions"), F.sum("transactions").over(everything)))
        .orderBy(F.col("transactions").desc())
    )


def histogram(df: DataFrame, column: str = "total_amount", bins: int = 50) -> DataFrame:
    """Counts in equal-width bins from min to max; the last bin includes the max.

    Empty bins are listed with a zero count. Where all values are equal the
    range is widened by a half on both sides.
    """
    values = df.select(F.col(column).cast("double").alias("value")).where(
        F.col("value").isNotNull() & ~F.isnan("value"))
    ends = values.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(
        F.struct(
            F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        ).alias("ends"))
    lo, width = F.col("ends.lo"), (F.col("ends.hi") - F.col("ends.lo")) / bins
    counts = (
        values.withColumn("ends", ends.scalar())
        .groupBy(F.least(F.floor((F.col("value") - lo) / width), F.lit(bins - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("frequency"))
    )
    edges = (
        df.sparkSession.range(bins).withColumnRenamed("id", "bin")
        .withColumn("ends", ends.scalar())
        .select("bin", (lo + F.col("bin") * width).alias("bin_start"),
                (lo + (F.col("bin") + 1) * width).alias("bin_end"))
    )
    return edges.join(counts, "bin", "left").fillna(0, subset=["frequency"]).orderBy("bin")


def customer_behaviour_summary(behaviour: DataFrame) -> DataFrame:
    """Distribution of the per-customer figures of ``customer_behaviour``."""
    return describe(
        behaviour, ["total_spent", "avg_order_value", "order_count", "customer_lifetime_days"])
