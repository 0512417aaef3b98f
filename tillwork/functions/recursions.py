"""Recursions over short arrays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def durbin_levinson(autocovariance: Column, order: int) -> Column:
    """Solve the Yule-Walker equations for orders 1 to ``order``.

    ``autocovariance`` holds lags 0 to ``order``. The result is a struct of
    ``ar``, the coefficients of the last order, and ``pacf``, the last
    coefficient of every order, which is the partial autocorrelation.
    """
    empty = F.array().cast("array<double>")
    start = F.struct(
        empty.alias("ar"), empty.alias("pacf"), F.get(autocovariance, F.lit(0)).alias("rest"))

    def step(state: Column, k: Column) -> Column:
        # Lags k-1 down to 1, against the coefficients of lags 1 to k-1.
        back = F.reverse(F.slice(autocovariance, F.lit(2), k - 1))
        explained = F.aggregate(
            F.zip_with(state["ar"], back, lambda a, r: a * r), F.lit(0.0), lambda x, y: x + y)
        last = F.try_divide(F.get(autocovariance, k) - explained, state["rest"])
        return let(
            last,
            lambda phi: F.struct(
                F.concat(
                    F.zip_with(state["ar"], F.reverse(state["ar"]), lambda a, b: a - phi * b),
                    F.array(phi),
                ).alias("ar"),
                F.concat(state["pacf"], F.array(phi)).alias("pacf"),
                (state["rest"] * (1 - phi * phi)).alias("rest"),
            ),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(order)), start, step)
