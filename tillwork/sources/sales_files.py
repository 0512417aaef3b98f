"""Read and write the denormalised sales table as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillwork.functions.dates import month_of

SALES_SCHEMA = (
    "transaction_id BIGINT, transaction_date TIMESTAMP_NTZ, customer_id BIGINT, "
    "product_category STRING, product_name STRING, quantity BIGINT, unit_price DOUBLE, "
    "discount_percent DOUBLE, total_amount DECIMAL(18,4), sales_channel STRING, region STRING, "
    "customer_segment STRING, profit_margin DOUBLE, profit DECIMAL(18,8)"
)

MONTH_PARTITION = "sales_month"


def read_sales(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: str | StructType | None = SALES_SCHEMA,
    renames: dict[str, str] | None = None,
) -> DataFrame:
    """Read a sales table. ``renames`` maps file column names to ours.

    Pass ``schema=None`` for self-describing files with their own types.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", True)
    df = reader.load(path)
    return df.withColumnsRenamed(renames) if renames else df


def with_amounts(df: DataFrame) -> DataFrame:
    """Add ``total_amount`` and, where a margin is known, ``profit``."""
    df = df.withColumn(
        "total_amount",
        F.expr("CAST(quantity * unit_price * (1 - discount_percent / 100) AS DECIMAL(18,4))"),
    )
    if "profit_margin" not in df.columns:
        return df
    return df.withColumn(
        "profit", F.expr("CAST(total_amount * CAST(profit_margin AS DECIMAL(6,4)) AS DECIMAL(18,8))")
    )


def write_sales(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write sales as parquet, one folder per month, so date filters skip files.

    The rebalance gathers a month's rows into files of a good size, and splits
    a month that holds a large part of the sales over several tasks.
    """
    (
        df.withColumn(MONTH_PARTITION, month_of(F.col("transaction_date")))
        .hint("rebalance", MONTH_PARTITION)
        .write.mode(mode).partitionBy(MONTH_PARTITION).parquet(path)
    )


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write rows as CSV part files, each with a header; quotes in values are doubled."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
