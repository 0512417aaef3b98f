"""Least squares from sums of products, which any number of tasks can add up.

A fit needs the Gram matrix of the features, their products with the target, and the
target's sum of squares. These are plain sums per group; the small systems that follow are
solved by elimination over arrays, in column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.functions.recursions import let

# A pivot this much smaller than the feature's own sum of squares counts as zero.
SINGULAR = 1e-11


def numbers(array: Column) -> Column:
    return array.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)


def steps(first: Column, last: Column) -> Column:
    """The whole numbers from ``first`` to ``last``; none if ``last`` is smaller."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def gram_matrix(rows: DataFrame, keys: Sequence[str], values: Column, name: str = "gram") -> DataFrame:
    """Per group: the matrix of sums of products of the entries of ``values``, and the ``rows`` counted.

    Each row gives its products of pairs, half of the matrix, which are added up before
    and after the shuffle.
    """
    # Outer, or the optimiser would compute the values twice to test their size.
    each = rows.select(*keys, numbers(values).alias("_values")).select(
        *keys, "_values", F.posexplode_outer("_values").alias("i", "_left"))
    pairs = each.select(*keys, "i", "_left", F.posexplode_outer(
        F.slice("_values", F.col("i") + 1, F.size("_values"))).alias("_ahead", "_right"))
    sums = pairs.groupBy(*keys, "i", (F.col("i") + F.col("_ahead")).alias("j")).agg(
        F.sum(F.col("_left") * F.col("_right")).alias("v"), F.count(F.lit(1)).alias("c"))
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j", "v", "c"))).otherwise(F.array(
        F.struct("i", "j", "v", "c"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "v", "c")))
    entries = sums.select(*keys, F.inline(both)).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("i", "j", "v"))).alias("_entries"), F.max("i").alias("_last"),
        F.max("c").alias("rows"))
    width = F.col("_last") + 1
    matrix = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda i: F.slice(
        F.col("_entries")["v"], i * width + 1, width))
    return entries.select(*keys, matrix.alias(name), "rows")


def product_sums(features: Sequence[Column], target: Column, usable: Column) -> list[Column]:
    """The sums a regression needs, to be taken in one grouping with whatever else it computes.

    ``regression_of`` makes arrays of them. For a few features; ``gram_matrix`` is for many.
    """
    values = [*features, target]
    return [
        F.sum(F.when(usable, values[i] * values[j])).alias(f"_sum_{i}_{j}")
        for i in range(len(values)) for j in range(i, len(values))
    ] + [F.count_if(usable).alias("rows")]


def regression_of(sums: DataFrame, features: int) -> DataFrame:
    """``product_sums`` as ``gram``, ``moment`` (features by target) and ``squares`` (of the target)."""
    def entry(i: int, j: int) -> str:
        return f"_sum_{min(i, j)}_{max(i, j)}"

    names = range(features)
    nothing = F.array().cast("array<double>")
    return sums.withColumns({
        "gram": F.array(*(F.array(*(entry(i, j) for j in names)) for i in names)) if features
        else F.array().cast("array<array<double>>"),
        "moment": F.array(*(entry(i, features) for i in names)) if features else nothing,
        "squares": F.col(entry(features, features)),
    }).drop(*(entry(i, j) for i in range(features + 1) for j in range(i, features + 1)))


def solved(matrix: Column, right: Column) -> Column:
    """The solution of a symmetric positive definite system; NULLs where it is singular.

    ``matrix`` is an array of rows. Each step clears the first column left by its pivot row
    and drops it.
    """
    start = F.transform(matrix, lambda row, i: F.concat(row, F.array(F.get(right, i))))

    def rest(row: Column) -> Column:
        return F.slice(row, F.lit(2), F.size(row))

    def clear(system: Column, k: Column) -> Column:
        own = F.get(F.get(matrix, k), k)
        pivot = F.get(F.get(system, k), F.lit(0))
        usable = F.when(F.abs(pivot) > F.abs(own) * SINGULAR, pivot)
        scaled = let(usable, lambda p: F.transform(rest(F.get(system, k)), lambda v: v / p))
        return let(scaled, lambda pivot_row: F.transform(system, lambda row, i: F.when(
            i == k, pivot_row).otherwise(let(F.get(row, F.lit(0)), lambda factor: F.zip_with(
                rest(row), pivot_row, lambda v, q: v - factor * q)))))

    return F.aggregate(
        steps(F.lit(0), F.size(matrix) - 1), start, clear,
        lambda system: F.transform(system, lambda row: F.get(row, F.lit(0))))


def squared_residuals(gram: Column, moment: Column, squares: Column, coefficients: Column) -> Column:
    """The sum of squared residuals of any coefficients."""
    fitted = F.transform(gram, lambda row: dot(row, coefficients))
    return F.greatest(
        squares - 2 * dot(coefficients, moment) + dot(coefficients, fitted), F.lit(0.0))


def stable(coefficients: Column) -> Column:
    """Whether an autoregression with these coefficients is stationary.

    The order is stepped down: the last coefficient of each order is a partial
    autocorrelation, and all must lie within -1 and 1.
    """
    def step_down(state: Column, _: Column) -> Column:
        last = F.element_at(state["ar"], -1)
        head = F.slice(state["ar"], F.lit(1), F.size(state["ar"]) - 1)
        lower = F.zip_with(head, F.reverse(head), lambda a, b: F.try_divide(a + last * b, 1 - last * last))
        return F.struct(lower.alias("ar"), (state["ok"] & (F.abs(last) < 1)).alias("ok"))

    start = F.struct(numbers(coefficients).alias("ar"), F.lit(True).alias("ok"))
    within = F.aggregate(
        steps(F.lit(1), F.size(coefficients)), start, step_down, lambda state: state["ok"])
    return F.coalesce(within, F.lit(False))
