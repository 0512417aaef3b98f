"""Profile of the sales table."""

from __future__ import annotations

from tillwork.operators import customers, profiling, sales
from tillwork.plans.oracle import average, half_even_cents, on_sales, quotient, rounded, total
from tillwork.plans.registry import query
from tillwork.sources.sales_files import with_amounts
from tillwork.sources.star import SALES_COLUMNS, Star

COLUMN_LIST = ", ".join(SALES_COLUMNS)

# The types of the sales columns, by position.
COLUMN_TYPES = (
    "bigint", "bigint", "timestamp_ntz", "bigint", "string", "string", "bigint", "double",
    "decimal(5,2)", "decimal(18,4)", "string", "string", "string", "decimal(6,4)",
    "decimal(18,8)", "timestamp_ntz",
)


def describe_sql(columns: tuple[str, ...], table: str = "sales") -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{c}' AS column_name, COUNT(v) AS count, {rounded('AVG(v)')} AS mean,
       {rounded('STDDEV_SAMP(v)')} AS std, {rounded('MIN(v)')} AS min,
       {rounded('quantile_cont(v, 0.25)')} AS p25, {rounded('quantile_cont(v, 0.5)')} AS p50,
       {rounded('quantile_cont(v, 0.75)')} AS p75, {rounded('MAX(v)')} AS max
FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {table}) AS t"""
        for c in columns)


_MEASURES = ("unit_price", "discount_percent", "total_amount", "profit_margin", "profit")


@query("sales_view", on_sales("SELECT " + ", ".join(
    f"{rounded(c)} AS {c}" if c in _MEASURES else c for c in SALES_COLUMNS) + " FROM sales"))
def sales_view(star: Star):
    return star.sales()


@query("derive_amounts", on_sales(f"""
SELECT order_id, transaction_id,
       {rounded('CAST(quantity * unit_price * (1 - discount_percent / 100) AS DECIMAL(18,4))')} AS total_amount,
       {rounded('CAST(quantity * unit_price * (1 - discount_percent / 100) AS DECIMAL(18,4)) * profit_margin')} AS profit
FROM sales"""))
def derive_amounts(star: Star):
    raw = star.sales(["order_id", "transaction_id", "quantity", "unit_price", "discount_percent", "profit_margin"])
    return with_amounts(raw).select("order_id", "transaction_id", "total_amount", "profit")


@query("dataset_shape", on_sales(f"""
SELECT COUNT(*) AS row_count, CAST({len(SALES_COLUMNS)} AS BIGINT) AS column_count,
       CAST(MIN(transaction_date) AS DATE) AS first_date,
       CAST(MAX(transaction_date) AS DATE) AS last_date
FROM sales"""))
def dataset_shape(star: Star):
    return profiling.dataset_shape(star.sales())


@query("duplicate_count", on_sales(f"""
SELECT CAST(COALESCE(SUM(copies - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT COUNT(*) AS copies FROM sales GROUP BY {COLUMN_LIST}) AS t"""))
def duplicate_count(star: Star):
    return profiling.duplicate_count(star.sales())


@query("null_counts", on_sales("\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count FROM sales"
    for c in SALES_COLUMNS)))
def null_counts(star: Star):
    return profiling.null_counts(star.sales())


@query("column_types", on_sales("\nUNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS column_name, '{t}' AS data_type, "
    f"COUNT({c}) AS non_null_count FROM sales"
    for i, (c, t) in enumerate(zip(SALES_COLUMNS, COLUMN_TYPES)))))
def column_types(star: Star):
    return profiling.column_types(star.sales())


@query("describe_numeric", on_sales(describe_sql(profiling.NUMERIC_PROFILE)))
def describe_numeric(star: Star):
    columns = profiling.NUMERIC_PROFILE
    return profiling.describe_numeric(star.sales(columns), columns)


_SECONDS = "CAST(epoch(transaction_date) AS BIGINT)"


def _moment(value: str) -> str:
    return f"TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST(floor({value}) AS BIGINT))"


@query("describe_dates", on_sales(f"""
SELECT 'transaction_date' AS column_name, COUNT(s) AS count, {_moment('AVG(s)')} AS mean,
       {_moment('MIN(s)')} AS min, {_moment('quantile_cont(s, 0.25)')} AS p25,
       {_moment('quantile_cont(s, 0.5)')} AS p50, {_moment('quantile_cont(s, 0.75)')} AS p75,
       {_moment('MAX(s)')} AS max
FROM (SELECT {_SECONDS} AS s FROM sales) AS t"""))
def describe_dates(star: Star):
    return profiling.describe_dates(star.sales(["transaction_date"]))


@query("business_metrics", on_sales(f"""
SELECT {total('total_amount')} AS total_revenue, {average('total_amount')} AS avg_order_value,
       COUNT(DISTINCT customer_id) AS unique_customers,
       COUNT(DISTINCT product_name) AS unique_products,
       {average('discount_percent')} AS avg_discount, COUNT(*) AS total_transactions
FROM sales"""))
def business_metrics(star: Star):
    return profiling.business_metrics(
        star.summed(["customer_id"], ["total_amount", "discount_percent"]), star.summed(["product_name"]))


@query("category_revenue", on_sales(f"""
SELECT product_category, {total('total_amount')} AS revenue
FROM sales WHERE product_category IS NOT NULL GROUP BY 1"""))
def category_revenue(star: Star):
    return profiling.category_revenue(star.summed(["product_category"], ["total_amount"]))


@query("channel_share", on_sales(f"""
SELECT sales_channel, COUNT(*) AS transactions,
       {rounded(quotient('COUNT(*) * 100', 'SUM(COUNT(*)) OVER ()'))} AS share
FROM sales WHERE sales_channel IS NOT NULL GROUP BY 1"""))
def channel_share(star: Star):
    return profiling.channel_share(star.summed(["sales_channel"]))


@query("order_value_histogram", on_sales(f"""
SELECT bin, {rounded('lo + bin * width')} AS bin_start,
       {rounded('lo + (bin + 1) * width')} AS bin_end, COUNT(v) AS frequency
FROM (SELECT CAST(range AS BIGINT) AS bin FROM range(50)) AS bins
CROSS JOIN ends
LEFT JOIN (
  SELECT CAST(total_amount AS DOUBLE) AS v,
         least(CAST(floor((CAST(total_amount AS DOUBLE) - lo) / width) AS BIGINT), 49) AS own
  FROM sales, ends
) AS binned ON own = bin
GROUP BY bin, lo, width""", """
ends AS (
  SELECT MIN(CAST(total_amount AS DOUBLE)) AS lo,
         (MAX(CAST(total_amount AS DOUBLE)) - MIN(CAST(total_amount AS DOUBLE))) / 50 AS width
  FROM sales
)"""))
def order_value_histogram(star: Star):
    return profiling.histogram(star.sales(["total_amount"]))


@query("region_revenue", on_sales(f"""
SELECT region, {total('total_amount')} AS revenue
FROM sales WHERE region IS NOT NULL GROUP BY 1"""))
def region_revenue(star: Star):
    return profiling.region_revenue(star.summed(["region"], ["total_amount"]))


@query("daily_revenue", on_sales(f"""
SELECT CAST(transaction_date AS DATE) AS sale_date, {total('total_amount')} AS revenue
FROM sales WHERE transaction_date IS NOT NULL GROUP BY 1"""))
def daily_revenue(star: Star):
    return sales.daily_revenue(star.summed(["transaction_date"], ["total_amount"]))


BEHAVIOUR = f"""
behaviour AS (
  SELECT customer_id,
         {half_even_cents('COALESCE(SUM(total_amount), 0)')} AS total_spent,
         {half_even_cents('SUM(total_amount)', 'NULLIF(COUNT(total_amount), 0)')}
           AS avg_order_value,
         COUNT(total_amount) AS order_count,
         MIN(transaction_date) AS first_purchase, MAX(transaction_date) AS last_purchase,
         CAST(floor(date_diff('microsecond', MIN(transaction_date), MAX(transaction_date))
                    / 86400000000) AS BIGINT) AS customer_lifetime_days
  FROM sales WHERE customer_id IS NOT NULL GROUP BY customer_id
)"""


def _behaviour(star: Star):
    return customers.customer_behaviour(
        star.summed(["customer_id", "transaction_date"], ["total_amount"]))


@query("customer_behaviour", on_sales(f"""
SELECT customer_id, {rounded('total_spent')} AS total_spent,
       {rounded('avg_order_value')} AS avg_order_value, order_count, first_purchase,
       last_purchase, customer_lifetime_days
FROM behaviour""", BEHAVIOUR))
def customer_behaviour(star: Star):
    return _behaviour(star)


@query("customer_behaviour_summary", on_sales(describe_sql(
    ("total_spent", "avg_order_value", "order_count", "customer_lifetime_days"), "behaviour"),
    BEHAVIOUR))
def customer_behaviour_summary(star: Star):
    return profiling.customer_behaviour_summary(_behaviour(star))
