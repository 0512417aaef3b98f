"""What the sales source reads and joins, and the file formats."""

from __future__ import annotations

import itertools
import re

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from tillwork import Star, read_sales, write_sales
from tillwork.operators import basket, customers, dashboard, sales
from tillwork.sources import scratch
from tillwork.sources.sales_files import export_csv, with_amounts


def plan(df):
    return df._jdf.queryExecution().toString()


def tables_read(df):
    physical = plan(df).split("== Physical Plan ==")[1]
    return set(re.findall(r"(\w+)\.parquet", physical))


def test_only_needed_tables_are_joined(spark):
    star = Star(spark, SMALL)
    assert tables_read(star.sales(["total_amount"])) == {"lineitem"}
    assert tables_read(star.summed(["transaction_date"], ["total_amount"])) == {"lineitem", "orders"}
    assert tables_read(star.summed(["product_name"], ["quantity"])) == {"lineitem", "part"}
    assert tables_read(star.sales(["customer_segment"])) >= {"lineitem", "orders", "customer"}


def test_only_needed_columns_are_read(spark):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(sales.monthly_revenue(
        Star(spark, SMALL).summed(["transaction_date"], ["total_amount"]))))
    columns = {c.split(":")[0] for s in schemas for c in s.split(",")}
    assert columns == {"l_orderkey", "l_extendedprice", "l_discount", "o_orderkey", "o_orderdate"}


def test_filters_reach_the_scan_and_drop_outer_joins(spark):
    import datetime

    spec = dashboard.FilterSpec(datetime.date(1996, 1, 1), datetime.date(1996, 12, 31), ["PROMO"])
    text = plan(dashboard.filter_sales(
        Star(spark, SMALL).sales(["transaction_date", "product_category", "total_amount"]), spec))
    physical = text.split("== Physical Plan ==")[1]
    assert "LeftOuter" not in physical and "CartesianProduct" not in physical
    assert re.search(r"PushedFilters: \[[^\]]*o_orderdate", physical)
    assert re.search(r"PushedFilters: \[[^\]]*p_type", physical)


def test_summing_before_the_join_shuffles_once_per_key(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = Star(spark, SMALL).summed(["transaction_date"], ["total_amount"])
        physical = plan(df).split("== Physical Plan ==")[1]
        # One exchange for the summed lines and one for the orders, none between sum and join.
        assert physical.count("Exchange hashpartitioning") == 2
        assert physical.count("HashAggregate") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_summed_rows_carry_counts(spark):
    summed = Star(spark, SMALL).summed(["transaction_date"], ["total_amount"])
    single = Star(spark, SMALL).sales(["transaction_date", "total_amount"])
    assert {"row_count", "total_amount_rows"} <= set(summed.columns)
    assert summed.agg(F.sum("row_count")).first()[0] == single.count()
    assert sales.monthly_revenue(summed).collect() == sales.monthly_revenue(single).collect()


def test_no_sale_is_lost_to_a_missing_dimension(spark, skewed_root):
    star = Star(spark, skewed_root)
    rows = star.table("lineitem").count()
    assert star.sales().count() == rows
    orphans = star.sales(["order_id", "customer_id", "sales_channel"]).where("order_id = 999999")
    assert [(r["customer_id"], r["sales_channel"]) for r in orphans.collect()] == [(None, None)]


def test_sql_on_the_registered_views(spark):
    Star(spark, SMALL).register_views()
    counted = spark.sql("""
        SELECT region, COUNT(*) AS n, NTILE(2) OVER (ORDER BY region) AS half
        FROM sales_transactions WHERE EXTRACT(YEAR FROM transaction_date) = 1996 GROUP BY region""")
    assert counted.count() == 5
    assert spark.table("event_sales").count() > 0


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_formats_round_trip(spark, fmt):
    star = Star(spark, SMALL)
    columns = ["transaction_id", "transaction_date", "product_name", "quantity", "total_amount"]
    rows = star.sales(columns)
    path = scratch.new_path(spark, fmt)
    if fmt == "csv":
        export_csv(rows, path)
    else:
        rows.write.format(fmt).save(path)
    back = read_sales(spark, path, fmt, schema=rows.schema)
    assert back.exceptAll(rows).count() == 0 and back.count() == rows.count()


def test_monthly_folders_are_pruned(spark):
    star = Star(spark, SMALL)
    path = scratch.new_path(spark, "sales")
    write_sales(star.sales(), path)
    month = spark.read.parquet(path).where("sales_month = DATE '1996-05-01'")
    assert "PartitionFilters: [isnotnull(sales_month" in plan(month)
    assert month.count() == star.sales(["transaction_date"]).where(
        "transaction_date >= '1996-05-01' AND transaction_date < '1996-06-01'").count()


def test_renamed_columns_and_derived_amounts(spark):
    path = scratch.new_path(spark, "own")
    spark.createDataFrame([(1, 2, 10.0, 25.0, 0.4)], "id BIGINT, quantity BIGINT, price DOUBLE, "
                          "discount_percent DOUBLE, profit_margin DOUBLE").write.parquet(path)
    rows = read_sales(spark, path, schema=None, renames={"id": "transaction_id", "price": "unit_price"})
    row = with_amounts(rows).first()
    assert float(row["total_amount"]) == 15.0 and float(row["profit"]) == 6.0


class Cluster:
    """Stands in for a session: its settings, and a master that is no local one."""

    def __init__(self, **conf):
        self.conf = conf
        self.sparkContext = type("Context", (), {"master": "yarn", "applicationId": "app"})


def test_intermediate_tables_go_to_the_configured_folder(spark):
    df = scratch.materialise(spark.range(5), "five")
    assert df.count() == 5 and scratch.application_folder(spark) in df.inputFiles()[0]
    configured = Cluster(**{"spark.checkpoint.dir": "hdfs://shared/check/"})
    assert scratch.new_path(configured, "x").startswith("hdfs://shared/check/tillwork-app/x-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Cluster())


def test_rules_against_brute_force(spark):
    baskets = {1: "abc", 2: "abc", 3: "ab", 4: "c", 5: "ad", 6: "b", 7: "e"}
    rows = [(k, item) for k, items in baskets.items() for item in items] * 2
    df = spark.createDataFrame(rows, "order_id BIGINT, product_name STRING")
    got = {(r["antecedent"], r["consequent"]): r
           for r in basket.market_basket_rules(df, min_support=2 / 7, min_confidence=0.1).collect()}
    holds = lambda items: sum(set(items) <= set(b) for b in baskets.values())
    expected = {}
    for left, right in [("a", "b"), ("b", "a"), ("a", "c"), ("c", "a"), ("b", "c"), ("c", "b"),
                        ("ab", "c"), ("ac", "b"), ("bc", "a")]:
        both = holds(left + right)
        expected[(" + ".join(left), right)] = (
            both / 7, both / holds(left), both / holds(left) / (holds(right) / 7))
    assert set(got) == set(expected)
    for key, values in expected.items():
        assert (got[key]["support"], got[key]["confidence"], got[key]["lift"]) == pytest.approx(values)


def test_pairs_with_a_basket_that_holds_most_sales(spark):
    rows = [(1, f"p{i % 5}") for i in range(2000)] + [(c, f"p{c % 5}") for c in range(2, 50)]
    df = spark.createDataFrame(rows, "customer_id BIGINT, product_category STRING")
    got = basket.cross_sell_pairs(df, min_support=0.001).collect()
    assert len(got) == 20 and all(r["both_buyers"] == 1 for r in got)


def test_clusters_cover_every_customer(spark):
    rows = Star(spark, SMALL).summed(["customer_id", "transaction_date"], ["total_amount"])
    found = customers.customer_clusters(rows, k=3, as_of=F.lit("2001-08-02").cast("date"))
    assert found.count() == rows.select("customer_id").distinct().count()
    profile = customers.cluster_profile(found).collect()
    assert len(profile) == 3 and sum(r["customers"] for r in profile) == found.count()


def test_clusters_are_numbered_by_spend_and_keep_customers_without_features(spark):
    import numpy as np

    rows = [(i, f"2024-01-{1 + i % 28:02d} 00:00:00", 10.0 ** (i % 3) + i / 100) for i in range(90)]
    rows += [(200, None, 5.0), (201, None, None)]
    df = spark.createDataFrame(rows, "customer_id BIGINT, d STRING, total_amount DOUBLE").select(
        "customer_id", F.to_timestamp_ntz("d").alias("transaction_date"), F.col("total_amount").cast("decimal(18,4)"))
    found = [customers.customer_clusters(df, k=3, seed=seed, as_of=F.lit("2024-02-01").cast("date")).collect()
             for seed in (1, 42)]
    for got in found:
        assert {r["customer_id"] for r in got if r["cluster"] is None} == {200, 201} and len(got) == 92
        known = [r for r in got if r["cluster"] is not None]
        x = np.array([[r["recency_days"], r["frequency"], r["monetary_value"]] for r in known])
        own = np.array([r["cluster"] for r in known])
        spends = [x[own == k, 2].mean() for k in range(3)]
        assert spends == sorted(spends)
        # Every customer is nearest to the mean of its own cluster, in standardised features.
        spread = x.std(0)
        z = (x - x.mean(0)) / np.where(spread > 0, spread, 1)
        means = np.array([z[own == k].mean(0) for k in range(3)])
        assert (((z[:, None] - means) ** 2).sum(2).argmin(1) == own).mean() > 0.97
    empty = customers.customer_clusters(df.limit(0), as_of=F.lit("2024-02-01").cast("date"))
    assert empty.count() == 0 and "cluster" in empty.columns


def test_a_hot_join_key_is_split_over_tasks(spark, skewed_root):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        # A partition is split between map tasks, so there must be several.
        "spark.sql.files.maxPartitionBytes": "16KB",
        "spark.sql.files.openCostInBytes": "0",
    }
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        # Single sales, which cannot be summed first: a third of them share one order and part.
        df = Star(spark, skewed_root).sales(["transaction_date", "product_name", "total_amount"])
        result = df.groupBy("product_name").agg(F.sum("total_amount").alias("revenue"))
        rows = {r["product_name"]: r["revenue"] for r in result.collect()}
        assert "skew=true" in plan(result)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert rows == {r["product_name"]: r["revenue"] for r in Star(spark, skewed_root).summed(
        ["product_name"], ["total_amount"]).groupBy("product_name").agg(
            F.sum("total_amount").alias("revenue")).collect()}


def test_csv_keeps_quotes_commas_and_line_breaks(spark):
    names = ['a "quoted" name', "with, comma", "two\nlines", 'back\\slash']
    path = scratch.new_path(spark, "csv")
    export_csv(spark.createDataFrame([(n,) for n in names], "product_name STRING"), path)
    assert sorted(r[0] for r in read_sales(spark, path, "csv", schema="product_name STRING").collect()) == sorted(names)


def test_keys_of_both_chains_are_summed_between_the_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = Star(spark, SMALL).summed(["region", "product_category"], ["total_amount"])
        physical = plan(df).split("== Physical Plan ==")[1]
        upper = physical.split("HashAggregate")[0]
        assert "p_partkey" in upper and "o_orderkey" not in upper
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_settled_results_leave_no_tables_on_the_way(spark):
    from pathlib import Path

    from tillwork.sources import scratch

    folder = Path(scratch.application_folder(spark).removeprefix("file:"))
    kept = scratch.materialise(spark.range(3), "kept")
    before = set(folder.iterdir())

    def build():
        first = scratch.materialise(spark.range(10), "first")
        return scratch.materialise(first.where("id > 2"), "second").join(first, "id")

    result = scratch.settled(build, "result")
    assert result.count() == 7 and kept.count() == 3
    assert [path.name.split("-")[0] for path in set(folder.iterdir()) - before] == ["result"]


def test_itemsets_of_any_size_with_alike_baskets_counted_together(spark):
    baskets = ["abcd", "abcd", "abcd", "dcba", "abc", "ab", "ad", "e", "cd", "ef"]
    rows = [(k, item) for k, items in enumerate(baskets) for item in items] * 2 + [(None, "a"), (1, None)]
    df = spark.createDataFrame(rows, "order_id BIGINT, product_name STRING")
    got = basket.frequent_itemsets(basket.frequent_sets(df, "order_id", "product_name", 0.4)).collect()
    holds = lambda items: sum(set(items) <= set(b) for b in baskets)
    expected = {
        items: holds(items) for size in range(1, 5) for items in itertools.combinations("abcdef", size) if holds(items) >= 4}
    assert len(got) == len(expected) and ("a", "b", "c", "d") in expected
    assert {tuple(r["items"]): r["times"] for r in got} == expected
    assert basket.market_basket_rules(df.limit(0)).count() == 0
