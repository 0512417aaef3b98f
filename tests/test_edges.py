"""Rules at the edges: missing values, zeros, boundaries, ties, short and empty input."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, day
from tillwork.operators import customers, dashboard, engagement, products, profiling, regions, sales
from tillwork.sources.star import Star

SCHEMA = (
    "transaction_date TIMESTAMP_NTZ, customer_id BIGINT, product_category STRING, "
    "product_name STRING, quantity BIGINT, unit_price DOUBLE, discount_percent DOUBLE, "
    "total_amount DECIMAL(18,4), sales_channel STRING, region STRING, customer_segment STRING, "
    "transaction_id BIGINT, profit DECIMAL(18,8)"
)
NAMES = [part.strip().split()[0] for part in SCHEMA.split(", ")]


def frame(spark, *rows):
    defaults = dict.fromkeys(NAMES)
    defaults.update(transaction_date=day("2024-01-01"), customer_id=1, product_category="a",
                    product_name="p", quantity=1, unit_price=1.0, discount_percent=0.0,
                    total_amount=Decimal("1"), sales_channel="Online", region="North",
                    customer_segment="Premium", transaction_id=1, profit=Decimal("0.5"))
    return spark.createDataFrame([tuple({**defaults, **row}[n] for n in NAMES) for row in rows], SCHEMA)


def by(df, key):
    return {row[key]: row for row in df.collect()}


def test_discount_tier_bounds(spark):
    rows = frame(spark, *[{"discount_percent": d} for d in (0.0, 0.5, 10.0, 10.5, 20.0, 21.0, None)])
    counts = {r["discount_tier"]: r["transaction_count"] for r in products.discount_tiers(rows).collect()}
    assert counts == {
        "No Discount": 1, "Low Discount (1-10%)": 2, "Medium Discount (11-20%)": 2,
        "High Discount (>20%)": 2}


def test_price_tier_bounds(spark):
    rows = frame(spark, *[{"unit_price": p} for p in (50.0, 50.01, 200.0, 200.01, None)])
    counts = {r["price_tier"]: r["transaction_count"] for r in products.price_tiers(rows).collect()}
    assert counts == {"Low Price": 1, "Medium Price": 2, "High Price": 2}


def test_value_tier_bounds_and_missing_spend(spark):
    rows = frame(spark, *[
        {"customer_id": i, "total_amount": None if a is None else Decimal(a)}
        for i, a in enumerate(("1000", "999.9999", "500", "499.9999", None))])
    got = by(customers.customer_ltv_segments(rows), "customer_segment")
    assert {k: v["customer_count"] for k, v in got.items()} == {
        "High Value": 1, "Medium Value": 2, "Low Value": 2}
    # A customer without a known amount does not count into the mean.
    assert got["Low Value"]["avg_lifetime_value"] == 499.9999


def test_sql_reports_keep_a_missing_group_and_charts_drop_it(spark):
    rows = frame(spark, {"product_category": None, "region": None}, {})
    assert None in by(regions.regional_performance(rows), "region")
    assert set(by(profiling.region_revenue(rows), "region")) == {"North"}
    assert set(by(dashboard.category_performance(rows), "product_category")) == {"a"}


def test_growth_over_a_zero_month_is_null(spark):
    rows = frame(
        spark, {"transaction_date": day("2024-01-05"), "total_amount": Decimal("10")},
        {"transaction_date": day("2024-02-05"), "total_amount": Decimal("0")},
        {"transaction_date": day("2024-03-05"), "total_amount": Decimal("5")})
    row = products.category_growth(rows).first()
    assert row["avg_growth_rate"] == -100.0 and row["growth_volatility"] is None
    assert row["avg_monthly_revenue"] == 2.5


def test_turnover_needs_three_months_and_keeps_fractions(spark):
    dates = [("p", m, q) for m, q in (("01", 3), ("02", 2), ("03", 2))] + [("q", "01", 9), ("q", "02", 9)]
    rows = frame(spark, *[
        {"product_name": p, "transaction_date": day(f"2024-{m}-01"), "quantity": q} for p, m, q in dates])
    (row,) = products.inventory_turnover(rows).collect()
    assert row["product_name"] == "p" and row["avg_monthly_sales"] == pytest.approx(7 / 3)


def test_days_by_the_clock_and_by_the_calendar(spark):
    rows = frame(spark, {"transaction_date": day("2024-01-01 23:00:00")},
                 {"transaction_date": day("2024-01-02 01:00:00")})
    assert customers.customer_behaviour(rows).first()["customer_lifetime_days"] == 0
    assert customers.customer_ltv_segments(rows).first()["avg_lifetime_days"] == 1.0


def test_amounts_round_half_to_even(spark):
    rows = frame(spark, {"customer_id": 1, "total_amount": Decimal("0.125")},
                 {"customer_id": 2, "total_amount": Decimal("0.135")})
    got = by(customers.customer_behaviour(rows), "customer_id")
    assert got[1]["total_spent"] == Decimal("0.12") and got[2]["total_spent"] == Decimal("0.14")


def test_nothing_left_after_the_filter(spark):
    rows = frame(spark, {}, {})
    row = dashboard.empty_guard(rows, dashboard.FilterSpec(regions=["Nowhere"])).first()
    assert (row["total_revenue"], row["total_transactions"], row["has_data"]) == (0, 0, False)
    assert row["avg_order_value"] is None and row["profit_margin"] is None
    assert dashboard.filter_sales(rows, dashboard.FilterSpec(categories=[])).count() == 0


def test_date_range_is_inclusive_and_needs_both_ends(spark):
    rows = frame(spark, *[{"transaction_date": day(f"2024-01-0{d} 13:00:00")} for d in (1, 2, 3, 4)])
    start, end = datetime.date(2024, 1, 2), datetime.date(2024, 1, 3)
    assert dashboard.filter_sales(rows, dashboard.FilterSpec(start, end)).count() == 2
    assert dashboard.filter_sales(rows, dashboard.FilterSpec(start)).count() == 4


def test_duplicates_count_missing_values_as_equal(spark):
    rows = frame(spark, {"region": None}, {"region": None}, {"region": None}, {}, {"customer_id": 2})
    assert profiling.duplicate_count(rows).first()[0] == 2


def test_null_counts_and_types(spark):
    rows = frame(spark, {"region": None}, {"region": None, "customer_id": None})
    got = by(profiling.null_counts(rows), "column_name")
    assert (got["region"]["null_count"], got["customer_id"]["null_count"]) == (2, 1)
    types = by(profiling.column_types(rows), "column_name")
    assert types["total_amount"]["data_type"] == "decimal(18,4)"
    assert types["transaction_date"]["position"] == 0 and types["region"]["non_null_count"] == 0


def test_histogram_of_one_value_and_of_many(spark):
    flat = profiling.histogram(frame(spark, {}, {}), bins=4).collect()
    assert [r["frequency"] for r in flat] == [0, 0, 2, 0]
    assert (flat[0]["bin_start"], flat[-1]["bin_end"]) == (0.5, 1.5)
    spread = profiling.histogram(frame(spark, *[{"total_amount": Decimal(v)} for v in range(11)]), bins=5)
    assert [r["frequency"] for r in spread.collect()] == [2, 2, 2, 2, 3]


def test_categorical_counts_skip_absent_columns_and_values(spark):
    rows = frame(spark, {}, {"region": None}).drop("customer_segment")
    got = {(r["column_name"], r["value"]): r["frequency"] for r in dashboard.categorical_counts(rows).collect()}
    assert got == {("product_category", "a"): 2, ("sales_channel", "Online"): 2, ("region", "North"): 1}


def test_channel_stats_count_known_ids(spark):
    row = dashboard.channel_stats(frame(spark, {}, {"transaction_id": None})).first()
    assert row["transactions"] == 1


def test_hour_labels_have_no_padding(spark):
    rows = frame(spark, {"transaction_date": day("2024-01-01 09:30:00")},
                 {"transaction_date": day("2024-01-01 17:00:00")})
    assert [r["hour_label"] for r in dashboard.hourly_pattern(rows).collect()] == ["9:00", "17:00"]


def test_weekday_starts_on_sunday(spark):
    rows = frame(spark, {"transaction_date": day("2024-01-07")}, {"transaction_date": None})
    got = by(sales.day_of_week_sales(rows), "day_of_week")
    assert got[0]["day_name"] == "Sunday" and got[None]["day_name"] is None


def test_top_products_break_ties_by_name(spark):
    rows = frame(spark, *[{"product_name": n} for n in "cab"])
    assert [r["product_name"] for r in sales.top_products(rows, 2).collect()] == ["a", "b"]


def test_rfm_other_segment(spark):
    triple = spark.createDataFrame([(3, 3, 2), (5, 5, 5), (3, 4, 4), (5, 1, 5), (1, 5, 5), (1, 1, 1)], "r INT, f INT, m INT")
    labels = triple.select(customers.rfm_label({"recency": F.col("r"), "frequency": F.col("f"), "monetary": F.col("m")})).collect()
    assert [r[0] for r in labels] == [
        "Others", "Champions", "Loyal Customers", "Potential Loyalists", "At Risk", "Lost Customers"]


def test_drilldown_tells_totals_from_missing_values(spark):
    rows = frame(spark, {"region": None}, {})
    got = sales.kpi_drilldown(rows, ("region",)).collect()
    assert sorted((r["depth"], str(r["region"]), r["transactions"]) for r in got) == [
        (0, "None", 2), (1, "None", 1), (1, "North", 1)]


def test_reorder_point_counts_days_without_sales(spark):
    rows = frame(spark, {"transaction_date": day("2024-01-01"), "quantity": 4},
                 {"transaction_date": day("2024-01-04"), "quantity": 2, "product_name": "q"})
    row = by(products.reorder_points(rows, lead_days=4), "product_name")["p"]
    assert row["avg_daily_demand"] == 1.0 and row["demand_std"] == pytest.approx(2.0)
    assert row["reorder_point"] == pytest.approx(4 + 1.645 * 2 * 2)


def test_conversion_without_views_is_null(spark):
    events = spark.createDataFrame(
        [(day("2024-01-01"), "purchase"), (day("2024-01-02"), "view"), (day("2024-01-02"), "purchase")],
        "ts TIMESTAMP_NTZ, event_type STRING")
    assert [r["conversion_rate"] for r in engagement.conversion_rate(events).collect()] == [None, 100.0]


def test_cohorts(spark):
    rows = frame(
        spark, *[{"customer_id": c, "transaction_date": day(d)} for c, d in (
            (1, "2024-01-05"), (1, "2024-01-25"), (1, "2024-03-31"), (2, "2024-01-31"), (3, "2024-02-01"))])
    got = {(str(r["cohort_month"]), r["months_since"]): (r["customers"], r["retention_rate"])
           for r in customers.retention_cohorts(rows).collect()}
    assert got == {("2024-01-01", 0): (2, 100.0), ("2024-01-01", 2): (1, 50.0), ("2024-02-01", 0): (1, 100.0)}


def test_duplicates_of_rows_with_equal_digests(spark, monkeypatch):
    """Digests that meet by chance are told apart; equal rows are found whatever their zeros and NULLs."""
    rows = [(1, None, 0.0), (1, None, -0.0), (None, 1, 0.0), (2, 2, 5.0), (2, 2, 5.0), (2, 2, 5.0), (3, 3, float("nan")), (3, 3, float("nan"))]
    df = spark.createDataFrame(rows, "a BIGINT, b BIGINT, c DOUBLE")
    assert profiling.duplicate_count(df).first()[0] == 4
    monkeypatch.setattr(profiling, "row_digest", lambda rows: F.lit(7))
    assert profiling.duplicate_count(df).first()[0] == 4
    monkeypatch.undo()
    assert profiling.duplicate_count(df.distinct()).first()[0] == 0
    assert profiling.duplicate_count(df.limit(0)).first()[0] == 0


def test_metrics_copy_no_rows_for_distinct_counts(spark):
    star = Star(spark, SMALL)
    metrics = profiling.business_metrics(
        star.summed(["customer_id"], ["total_amount", "discount_percent"]), star.summed(["product_name"]))
    assert "Expand" not in metrics._jdf.queryExecution().executedPlan().toString()
    one = profiling.business_metrics(star.sales(["customer_id", "product_name", "total_amount", "discount_percent"]))
    assert metrics.first() == one.first()


def test_price_tiers_are_summed_before_the_join(spark):
    star = Star(spark, SMALL)
    rows = star.summed(["product_category"], ["unit_price", "quantity", "total_amount"], {"price_tier": products.price_tier})
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
    single = products.price_tiers(star.sales(["product_category", "unit_price", "quantity", "total_amount"]))
    keyed = {(r[0], r[1]): r for r in single.collect()}
    for r in products.price_tiers(rows).collect():
        other = keyed.pop((r[0], r[1]))
        assert r["transaction_count"] == other["transaction_count"] and r["revenue"] == other["revenue"]
        assert abs(r["avg_price"] - other["avg_price"]) < 1e-6
    assert not keyed


def test_approximate_quartiles_are_near_the_exact_ones(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    exact, near = (profiling.describe_numeric(df, ["v"], accuracy).first() for accuracy in (None, 1000))
    for name in ("p25", "p50", "p75"):
        assert abs(exact[name] - near[name]) <= 20_000 / 1000 * 1.5
    assert (exact["count"], exact["min"], exact["max"]) == (near["count"], near["min"], near["max"])
