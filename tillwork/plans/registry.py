"""The list of runnable queries, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.sources.star import Star

DIGITS = 4
OFFSET = 0.4567


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Star], DataFrame]
    sql: str | None
    digits: int = DIGITS

    def __call__(self, spark: SparkSession, root: str) -> DataFrame:
        return comparable(self.build(Star(spark, root)), self.digits)


_queries: dict[str, Query] = {}


def query(name: str, sql: str | None = None, digits: int = DIGITS) -> Callable:
    """Register the decorated function, which builds the query from a ``Star``."""

    def register(build: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = Query(name, build, sql, digits)
        return build

    return register


def registered() -> dict[str, Query]:
    # Importing the modules fills the registry.
    from tillwork.plans import (  # noqa: F401
        dashboard_queries, forecast_queries, insight_queries, profile_queries, report_queries,
        series_queries, source_queries, stream_queries,
    )

    return dict(_queries)


def comparable(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Decimals as doubles, doubles at a few places, integers as BIGINT.

    Two engines sum doubles in different orders, so their last bits differ.
    ``floor(x * 10^digits + OFFSET)`` hides that. The offset is not 0.5, as a
    mean of amounts often lies exactly halfway between two results.
    """
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DecimalType, T.DoubleType, T.FloatType)):
            scale = F.lit(10.0 ** digits)
            column = F.floor(column.cast("double") * scale + OFFSET).cast("double") / scale
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)
