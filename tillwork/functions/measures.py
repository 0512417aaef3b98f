"""Counts, sums and means that work on single sales and on partial sums alike.

A sales frame holds either one row per sale, or partial sums made before a
join (see ``Star.sales``). The second kind carries ``row_count``, the number
of sales behind a row, and ``<measure>_rows``, how many of them had a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_COUNT = "row_count"


def value_rows(measure: str) -> str:
    return f"{measure}_rows"


def sale_count(df: DataFrame) -> Column:
    """COUNT(*) over sales."""
    if ROW_COUNT in df.columns:
        return F.sum(ROW_COUNT)
    return F.count(F.lit(1))


def value_count(df: DataFrame, measure: str) -> Column:
    """COUNT(measure) over sales."""
    if value_rows(measure) in df.columns:
        return F.sum(value_rows(measure))
    return F.count(measure)


def ratio(numerator: Column, denominator: Column) -> Column:
    """True division in double; NULL where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def mean(df: DataFrame, measure: str) -> Column:
    """AVG(measure) over sales, from an exact sum."""
    return ratio(F.sum(measure), value_count(df, measure))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part * 100, whole)


def cents(value: Column) -> Column:
    """A decimal rounded to two places, halves to even."""
    return F.bround(value, 2)


def mean_cents(amount_sum: Column, amounts: Column) -> Column:
    """An exact sum over a count, rounded to cents, halves to even."""
    return cents(F.try_divide(amount_sum, amounts))
