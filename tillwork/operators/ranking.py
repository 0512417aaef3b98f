"""Positions, tiles and quantiles over whole tables without a single-task sort.

A window without PARTITION BY sends every row to one task. Here rows are
range-sorted over all tasks instead, each notes its place inside its task, and
the few per-task counts give the offset to add. The sort order always ends in
a row id or in distinct values, so equal values cannot pile up in one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.functions.measures import ratio
from tillwork.sources.scratch import materialise

_TASK = "_task"
_PLACE = "_place"


def _placed(df: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """Rows sorted over all tasks, with task number and place within the task.

    The sorted rows are written, because range bounds are sampled and must be
    the same for the rows and for the per-task counts.
    """
    ranged = df.orderBy(F.col(group), *order)
    return materialise(
        ranged.withColumn(_TASK, F.spark_partition_id())
        .withColumn(_PLACE, F.monotonically_increasing_id()),
        "placed",
    )


def _offsets(placed: DataFrame, group: str, weight: Column) -> DataFrame:
    """Weight before each (group, task) run, and in the whole group.

    Groups are contiguous after the sort, so there are at most as many rows as
    sort tasks plus groups.
    """
    runs = placed.groupBy(group, _TASK).agg(
        F.min(_PLACE).alias("_first"), F.sum(weight).alias("_run"))
    earlier = Window.partitionBy(group).orderBy(_TASK).rowsBetween(Window.unboundedPreceding, -1)
    return runs.select(
        group, _TASK, "_first",
        F.coalesce(F.sum("_run").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_run").over(Window.partitionBy(group)).alias("group_rows"),
    )


def tile_of(position: Column, rows: Column, tiles: int) -> Column:
    """NTILE's tile for a 1-based position: the first ``rows % tiles`` tiles get one row more."""
    small = F.floor(rows / tiles)
    extra = rows % tiles
    wide_rows = extra * (small + 1)
    return F.when(position <= wide_rows, F.floor((position - 1) / (small + 1)) + 1).otherwise(
        extra + F.floor((position - 1 - wide_rows) / F.greatest(small, F.lit(1))) + 1
    )


def ntile_columns(
    df: DataFrame, id_col: str, tiles: int, scores: dict[str, tuple[str, bool]]
) -> DataFrame:
    """Add one NTILE column per entry of ``scores``: name -> (ordered column, ascending).

    Ties are broken by ``id_col``, which must be unique. NULLs come last when
    ascending and first when descending. All orderings share one sort: each row
    is sorted once per score, keyed by the score's name.
    """
    names = list(scores)
    payload = [c for c in df.columns if c != id_col]
    signed = df.select("*", *[
        (F.col(column) if ascending else -F.col(column)).alias(name)
        for name, (column, ascending) in scores.items()
    ])
    rising = F.col("score").isin([name for name in names if scores[name][1]])
    long = signed.unpivot(df.columns, names, "score", "value").withColumn(
        "null_rank",
        F.when(F.col("value").isNotNull(), 0).when(rising, 1).otherwise(-1))
    placed = _placed(
        long, "score", [F.col("null_rank"), F.col("value"), F.col(id_col).asc_nulls_last()])
    offsets = _offsets(placed, "score", F.lit(1))
    position = F.col("_before") + F.col(_PLACE) - F.col("_first") + 1
    tile = tile_of(position, F.col("group_rows"), tiles).cast("bigint")
    # A row's copies differ in score only, so any of them gives its other columns.
    return placed.join(F.broadcast(offsets), ["score", _TASK]).groupBy(id_col).agg(
        *[F.first(c).alias(c) for c in payload],
        *[F.max(F.when(F.col("score") == name, tile)).alias(name) for name in names],
    )


def describe(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, sample deviation, min, exact quantiles and max, one row per column.

    Quantiles interpolate linearly between neighbouring values. Rows are first
    counted per (column, value), so a frequent value is one row from there on
    and no task collects a column's values. After the sort only the runs that hold
    a wanted rank are opened; all else is sums over the sorted rows where they lie.
    """
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    counts = (
        values.unpivot([], list(columns), "column_name", "value")
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    placed = _placed(counts, "column_name", [F.col("value")])
    # A row for each described column and sort task, written as it is read several times.
    runs = materialise(_runs_of(placed), "runs")
    totals = runs.groupBy("column_name").agg(
        F.max("group_rows").alias("count"), ratio(F.sum("total"), F.max("group_rows")).alias("mean"),
        F.min("low").alias("min"), F.max("high").alias("max"))
    squares = placed.join(F.broadcast(totals.select("column_name", "mean")), "column_name").groupBy(
        "column_name").agg(F.sum(F.col("n") * F.pow(F.col("value") - F.col("mean"), 2)).alias("squares"))
    stats = totals.join(squares, "column_name").join(
        _selected(placed, runs, probabilities), "column_name").select(
        "column_name", "count", "mean", F.sqrt(ratio(F.col("squares"), F.col("count") - 1)).alias("std"),
        "min", *[quantile_name(p) for p in probabilities], "max")
    # A column without values still gets its row.
    listed = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name STRING")
    return listed.join(stats, "column_name", "left").fillna(0, subset=["count"])


def _runs_of(placed: DataFrame) -> DataFrame:
    """Rows, sum, ends and rows before of each (column, task) run of counted values."""
    runs = placed.groupBy("column_name", _TASK).agg(
        F.sum("n").alias("_run"), F.sum(F.col("value") * F.col("n")).alias("total"),
        F.min("value").alias("low"), F.max("value").alias("high"))
    earlier = Window.partitionBy("column_name").orderBy(_TASK).rowsBetween(Window.unboundedPreceding, -1)
    return runs.select(
        "*", F.coalesce(F.sum("_run").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_run").over(Window.partitionBy("column_name")).alias("group_rows"))


def _selected(placed: DataFrame, runs: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """The quantiles of each column, from the runs that hold their neighbouring ranks."""
    def target(p: float) -> Column:
        return (F.col("group_rows") - 1) * F.lit(float(p))

    ranks = F.array(*[
        F.struct(F.lit(quantile_name(p)).alias("name"), rank(target(p)).cast("bigint").alias("rank"),
                 weight.alias("weight"))
        for p in probabilities
        for rank, weight in ((F.floor, 1 - (target(p) - F.floor(target(p)))), (F.ceil, target(p) - F.floor(target(p))))])
    # Two ranks for each column and quantile.
    wanted = runs.select("column_name", _TASK, "_before", "_run", F.inline(ranks)).where(
        (F.col("_before") <= F.col("rank")) & (F.col("rank") < F.col("_before") + F.col("_run")))
    opened = placed.select("column_name", _TASK, "value", "n").join(
        F.broadcast(wanted.select("column_name", _TASK).distinct()), ["column_name", _TASK], "left_semi")
    before = (
        Window.partitionBy("column_name", _TASK).orderBy("value")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    met = opened.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).join(
        F.broadcast(wanted), ["column_name", _TASK]).withColumn("within", F.col("rank") - F.col("_before"))
    found = met.where((F.col("start") <= F.col("within")) & (F.col("within") < F.col("start") + F.col("n")))
    ends = found.groupBy("column_name", "name").agg(
        F.min("value").alias("low"), F.max("value").alias("high"),
        # The upper rank's weight; the lower one's is what is left of 1.
        F.max_by("weight", F.struct("rank", "weight")).alias("upper"))
    part = F.col("low") + (F.col("high") - F.col("low")) * F.when(F.col("low") < F.col("high"), F.col("upper")).otherwise(0.0)
    return ends.groupBy("column_name").agg(
        *[F.max(F.when(F.col("name") == quantile_name(p), part)).alias(quantile_name(p)) for p in probabilities])


def quantile_name(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")
