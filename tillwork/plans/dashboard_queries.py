"""Tables behind the dashboard's filters, KPIs and charts."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tillwork.operators import dashboard, sales
from tillwork.operators.profiling import describe_numeric
from tillwork.plans.oracle import average, half_even_cents, on_events, on_sales, quotient, rounded, total
from tillwork.plans.profile_queries import describe_sql
from tillwork.plans.registry import query
from tillwork.sources.star import Star

SPEC = dashboard.FilterSpec(
    start=datetime.date(1996, 1, 1), end=datetime.date(1999, 12, 31),
    categories=("ECONOMY", "PROMO", "STANDARD"), regions=("ASIA", "EUROPE", "AMERICA"),
    channels=("Online", "In-Store"),
)
# A year without sales, and one with: known only once the table is read.
FILTERS = {
    "none": dashboard.FilterSpec(start=datetime.date(2049, 1, 1), end=datetime.date(2049, 12, 31)),
    "some": dashboard.FilterSpec(start=datetime.date(1997, 1, 1), end=datetime.date(1997, 12, 31)),
}
FILTER_COLUMNS = ("transaction_date", "product_category", "region", "sales_channel")

FILTERED = """
filtered AS (
  SELECT * FROM sales
  WHERE CAST(transaction_date AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'
    AND product_category IN ('ECONOMY', 'PROMO', 'STANDARD')
    AND region IN ('ASIA', 'EUROPE', 'AMERICA') AND sales_channel IN ('Online', 'In-Store')
)"""


def filtered(star: Star, *columns: str):
    """The filtered sales, with the filter's own columns and those asked for."""
    return dashboard.filter_sales(star.sales([*FILTER_COLUMNS, *columns]), SPEC)


@query("filter_sales", on_sales(f"""
SELECT order_id, transaction_id, transaction_date, customer_id, product_category, product_name,
       region, sales_channel, quantity, {rounded('total_amount')} AS total_amount
FROM filtered""", FILTERED))
def filter_sales(star: Star):
    return filtered(
        star, "order_id", "transaction_id", "customer_id", "product_name", "quantity", "total_amount")


@query("filter_options", on_sales("""
SELECT * FROM (
SELECT DISTINCT 'product_category' AS option, product_category AS value FROM sales
UNION ALL SELECT DISTINCT 'region', region FROM sales
UNION ALL SELECT DISTINCT 'sales_channel', sales_channel FROM sales
UNION ALL SELECT 'first_date', CAST(CAST(MIN(transaction_date) AS DATE) AS VARCHAR) FROM sales
UNION ALL SELECT 'last_date', CAST(CAST(MAX(transaction_date) AS DATE) AS VARCHAR) FROM sales
) AS options WHERE value IS NOT NULL"""))
def filter_options(star: Star):
    return dashboard.filter_options(star.sales(FILTER_COLUMNS))


def kpi_sql(table: str, extra: str = "") -> str:
    return f"""
SELECT {rounded('COALESCE(SUM(total_amount), 0)')} AS total_revenue,
       {rounded('COALESCE(SUM(profit), 0)')} AS total_profit,
       {average('total_amount')} AS avg_order_value,
       COUNT(DISTINCT customer_id) AS total_customers, COUNT(*) AS total_transactions,
       {rounded(quotient('SUM(profit) * 100', 'SUM(total_amount)'))} AS profit_margin{extra}
FROM {table}"""


@query("kpi_summary", on_sales(kpi_sql("filtered"), FILTERED))
def kpi_summary(star: Star):
    return dashboard.kpi_summary(filtered(star, "customer_id", "total_amount", "profit"))


def _guard_sql(name: str, year: int) -> str:
    table = f"""(SELECT * FROM sales WHERE transaction_date >= TIMESTAMP '{year}-01-01'
                 AND transaction_date < TIMESTAMP '{year + 1}-01-01') AS part"""
    return kpi_sql(table, f", COUNT(*) > 0 AS has_data, '{name}' AS filter")


@query("empty_guard", on_sales(f"{_guard_sql('none', 2049)} UNION ALL {_guard_sql('some', 1997)}"))
def empty_guard(star: Star):
    rows = star.sales([*FILTER_COLUMNS, "customer_id", "total_amount", "profit"])
    none, some = (
        dashboard.empty_guard(rows, spec).withColumn("filter", F.lit(name)) for name, spec in FILTERS.items())
    return none.unionByName(some)


@query("daily_trend", on_sales(f"""
SELECT CAST(transaction_date AS DATE) AS sale_date, {total('total_amount')} AS revenue
FROM filtered GROUP BY 1""", FILTERED))
def daily_trend(star: Star):
    return sales.daily_revenue(filtered(star, "total_amount"))


@query("category_performance", on_sales(f"""
SELECT product_category, {total('total_amount')} AS revenue, {total('profit')} AS profit,
       CAST(SUM(quantity) AS BIGINT) AS units
FROM filtered GROUP BY 1""", FILTERED))
def category_performance(star: Star):
    return dashboard.category_performance(filtered(star, "total_amount", "profit", "quantity"))


@query("segment_performance", on_sales(f"""
SELECT customer_segment, {rounded(half_even_cents('SUM(total_amount)'))} AS total_revenue,
       {rounded(half_even_cents('SUM(total_amount)', 'COUNT(total_amount)'))} AS avg_order_value,
       COUNT(DISTINCT customer_id) AS customer_count
FROM filtered GROUP BY 1""", FILTERED))
def segment_performance(star: Star):
    return dashboard.segment_performance(
        filtered(star, "customer_segment", "customer_id", "total_amount"))


@query("region_distribution", on_sales(f"""
SELECT region, {total('total_amount')} AS revenue,
       {rounded(quotient('SUM(total_amount) * 100', 'SUM(SUM(total_amount)) OVER ()'))} AS share
FROM filtered GROUP BY 1""", FILTERED))
def region_distribution(star: Star):
    return dashboard.region_distribution(filtered(star, "total_amount"))


@query("channel_stats", on_sales(f"""
SELECT sales_channel, {total('total_amount')} AS revenue, COUNT(transaction_id) AS transactions
FROM filtered GROUP BY 1""", FILTERED))
def channel_stats(star: Star):
    return dashboard.channel_stats(filtered(star, "total_amount", "transaction_id"))


@query("hourly_pattern", on_events(f"""
SELECT concat(EXTRACT(HOUR FROM transaction_date), ':00') AS hour_label,
       {total('total_amount')} AS revenue
FROM event_sales WHERE transaction_date IS NOT NULL GROUP BY 1"""))
def hourly_pattern(star: Star):
    return dashboard.hourly_pattern(star.event_sales())


@query("categorical_counts", on_sales("\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS value, COUNT(*) AS frequency FROM filtered GROUP BY {c}"
    for c in dashboard.CATEGORICAL_COLUMNS), FILTERED))
def categorical_counts(star: Star):
    return dashboard.categorical_counts(filtered(star, "customer_segment"))


DASHBOARD_NUMERIC = (
    "transaction_id", "customer_id", "quantity", "unit_price", "discount_percent", "total_amount",
    "profit_margin", "profit",
)


@query("describe_filtered", on_sales(describe_sql(DASHBOARD_NUMERIC, "filtered"), FILTERED))
def describe_filtered(star: Star):
    return describe_numeric(filtered(star, *DASHBOARD_NUMERIC), DASHBOARD_NUMERIC)


@query("preview_rows", on_sales(f"""
SELECT transaction_date, order_id, transaction_id, product_name, quantity,
       {rounded('total_amount')} AS total_amount
FROM filtered
ORDER BY CAST(transaction_date AS DATE), order_id, transaction_id, product_name, quantity,
         sales.total_amount LIMIT 1000""".replace("sales.total_amount", "filtered.total_amount"),
    FILTERED))
def preview_rows(star: Star):
    columns = ["order_id", "transaction_id", "product_name", "quantity", "total_amount"]
    rows = filtered(star, *columns).select("transaction_date", *columns)
    return dashboard.preview_rows(rows, [F.col(c) for c in rows.columns])
