"""Tiles and quantiles over all tasks against windows and numpy."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillwork.operators import ranking
from tillwork.operators.ranking import describe, ntile_columns


def tiles_by_window(df, tiles):
    low = Window.orderBy(F.col("v").asc_nulls_last(), "id")
    high = Window.orderBy(F.col("w").desc_nulls_first(), "id")
    return df.select(
        "id", F.ntile(tiles).over(low).alias("a"), F.ntile(tiles).over(high).alias("b"))


@pytest.mark.parametrize("rows,tiles", [(1, 5), (3, 5), (5, 5), (1003, 5), (1000, 7)])
def test_ntile_is_the_window_function(spark, rows, tiles):
    # Two thirds of the values are one value, some are missing.
    df = spark.range(rows).select(
        "id",
        F.when(F.col("id") % 3 != 0, 10).when(F.col("id") % 7 != 0, F.col("id") * 37 % 101).alias("v"),
        F.when(F.col("id") % 11 != 0, (F.col("id") * 53 % 97).cast("decimal(28,4)")).alias("w"),
    )
    ours = ntile_columns(df, "id", tiles, {"a": ("v", True), "b": ("w", False)})
    assert ours.columns == ["id", "v", "w", "a", "b"]
    expected = {r.id: (r.a, r.b) for r in tiles_by_window(df, tiles).collect()}
    assert {r.id: (r.a, r.b) for r in ours.collect()} == expected


def test_ntile_uses_no_single_task_window(spark):
    df = spark.range(100).select("id", F.col("id").alias("v"))
    plan = ntile_columns(df, "id", 5, {"a": ("v", True)})._jdf.queryExecution().executedPlan().toString()
    # The one window runs over the per-task counts and is partitioned by score.
    assert "SinglePartition" not in plan


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.sampled_from([0.0, 1.5, -2.0]),
                          st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_describe_is_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    row = describe(df, ["v"], (0.1, 0.25, 0.5, 0.75)).first()
    known = np.array([v for v in values if v is not None])
    assert row["count"] == len(known)
    if len(known) == 0:
        assert row["mean"] is None and row["p50"] is None
        return
    close = lambda a, b: np.isclose(a, b, rtol=1e-9, atol=1e-6)
    assert close(row["mean"], known.mean())
    assert row["min"] == known.min() and row["max"] == known.max()
    for name, p in (("p10", 0.1), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        assert close(row[name], np.quantile(known, p))
    if len(known) > 1:
        assert close(row["std"], known.std(ddof=1))
    else:
        assert row["std"] is None


def test_describe_several_columns_with_a_hot_value(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.rand(7) * 100).alias("x"),
        F.lit(2).alias("same"), (F.col("id") % 4).cast("decimal(10,2)").alias("few"))
    data = {c: np.array([float(r[0]) for r in df.select(c).collect()]) for c in df.columns}
    for row in describe(df, df.columns).collect():
        known = data[row["column_name"]]
        for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
            assert np.isclose(row[name], np.quantile(known, p))


def test_describe_opens_only_the_runs_that_hold_wanted_ranks(spark):
    """On 64 runs a column, three quantiles read at most six of them again."""
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    counts = df.select(F.lit("v").alias("column_name"), F.col("v").alias("value")).groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("n"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        placed = ranking._placed(counts, "column_name", [F.col("value")])
        runs = ranking._runs_of(placed)
        assert runs.count() > 40
        plan = ranking._selected(placed, runs, (0.25, 0.5, 0.75))._jdf.queryExecution().executedPlan().toString()
        # The sorted rows meet the few wanted runs before any exchange or window.
        window = plan[plan.index("Window [sum(n"):]
        assert window.index("LeftSemi") < window.index("FileScan")
        assert window.index("Exchange hashpartitioning(column_name") < window.index("LeftSemi")
        row = describe(df, ["v"]).first()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    known = np.arange(200_000) * 7919 % 200_003
    assert [row["p25"], row["p50"], row["p75"]] == np.quantile(known, [0.25, 0.5, 0.75]).tolist()
    assert np.isclose(row["std"], known.std(ddof=1)) and row["max"] == known.max()
