"""Baskets, cohorts, concentration, growth, margin, stock and drill-down."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwork.operators import basket, customers, engagement, products, regions, sales
from tillwork.plans.oracle import AS_OF, average, on_sales, quotient, rounded, total
from tillwork.plans.registry import query
from tillwork.plans.report_queries import MONTH, RFM_CTES
from tillwork.plans.series_queries import recursive
from tillwork.sources.star import Star


# Frequent sets with the baskets they are in: a set grows by an item behind its last one while it
# stays frequent, so sets of any size are found.
_SETS = """
grown AS (
  SELECT basket, [item] AS items, item AS last
  FROM (SELECT *, COUNT(*) OVER (PARTITION BY item) AS times FROM bought) AS single
  WHERE times >= (SELECT ceil(0.003 * n - 1e-9) FROM everyone)
  UNION ALL
  SELECT basket, items, last
  FROM (
    SELECT grown.basket, list_append(grown.items, bought.item) AS items, bought.item AS last,
           COUNT(*) OVER (PARTITION BY list_append(grown.items, bought.item)) AS times
    FROM grown JOIN bought ON bought.basket = grown.basket AND bought.item > grown.last) AS longer
  WHERE times >= (SELECT ceil(0.003 * n - 1e-9) FROM everyone)
)"""


@query("market_basket_rules", recursive(on_sales(f"""
SELECT array_to_string(b.items, ' + ') AS antecedent, consequent,
       {rounded(quotient('whole.times', 'n'))} AS support,
       {rounded(quotient('whole.times', 'b.times'))} AS confidence,
       {rounded(quotient('whole.times', 'b.times') + ' / ' + quotient('c.times', 'n'))} AS lift
FROM (SELECT items, times, unnest(items) AS consequent FROM sets WHERE len(items) > 1) AS whole
JOIN sets AS b ON b.items = list_filter(whole.items, lambda x: x <> consequent)
JOIN sets AS c ON c.items = [consequent]
CROSS JOIN everyone
WHERE {quotient('whole.times', 'b.times')} >= 0.05""", """
bought AS (
  SELECT DISTINCT order_id AS basket, product_name AS item FROM sales
  WHERE order_id IS NOT NULL AND product_name IS NOT NULL
)""", "everyone AS (SELECT COUNT(DISTINCT basket) AS n FROM bought)", _SETS,
    "sets AS (SELECT items, COUNT(*) AS times FROM grown GROUP BY items)")))
def market_basket_rules(star: Star):
    return basket.market_basket_rules(star.sales(["order_id", "product_name"]))


@query("cross_sell_pairs", on_sales(f"""
SELECT item_a, item_b, a.buyers AS buyers_a, b.buyers AS buyers_b, both_buyers,
       {rounded(quotient('both_buyers', 'n'))} AS support,
       {rounded(quotient('both_buyers', 'a.buyers'))} AS confidence,
       {rounded(quotient('both_buyers', 'a.buyers') + ' / ' + quotient('b.buyers', 'n'))} AS lift
FROM (
  SELECT x.item AS item_a, y.item AS item_b, COUNT(*) AS both_buyers
  FROM bought AS x JOIN bought AS y ON x.buyer = y.buyer AND x.item <> y.item GROUP BY 1, 2
) AS pairs
JOIN buyers AS a ON a.item = item_a JOIN buyers AS b ON b.item = item_b
CROSS JOIN (SELECT COUNT(DISTINCT buyer) AS n FROM bought) AS everyone
WHERE both_buyers >= ceil(0.01 * n) AND a.buyers >= ceil(0.01 * n) AND b.buyers >= ceil(0.01 * n)
""", """
bought AS (
  SELECT DISTINCT customer_id AS buyer, product_category AS item FROM sales
  WHERE customer_id IS NOT NULL AND product_category IS NOT NULL
)""", "buyers AS (SELECT item, COUNT(*) AS buyers FROM bought GROUP BY 1)"))
def cross_sell_pairs(star: Star):
    return basket.cross_sell_pairs(star.sales(["customer_id", "product_category"]), min_support=0.01)


@query("customer_clusters")
def customer_clusters(star: Star):
    rows = star.summed(["customer_id", "transaction_date"], ["total_amount"])
    return customers.customer_clusters(rows, as_of=F.lit(AS_OF).cast("date"))


@query("rfm_scores", on_sales(f"""
SELECT customer_id, recency_days, frequency, {rounded('monetary_value')} AS monetary_value,
       recency_score, frequency_score, monetary_score
FROM scored""", *RFM_CTES))
def rfm_scores(star: Star):
    rows = star.summed(["customer_id", "transaction_date"], ["total_amount"])
    return customers.rfm_scores(rows, F.lit(AS_OF).cast("date"))


@query("customer_concentration", on_sales(f"""
SELECT tile, customers, {rounded('revenue')} AS revenue,
       {rounded(quotient('revenue * 100', 'SUM(revenue) OVER ()'))} AS revenue_share,
       {rounded(quotient('(SUM(revenue) OVER (ORDER BY tile)) * 100', 'SUM(revenue) OVER ()'))}
         AS cumulative_share
FROM tiles""", """
spend AS (
  SELECT customer_id, SUM(total_amount) AS spent FROM sales
  WHERE customer_id IS NOT NULL GROUP BY 1
)""", """
tiled AS (
  SELECT spent, CAST(NTILE(5) OVER (ORDER BY spent DESC, customer_id) AS BIGINT) AS tile FROM spend
)""", "tiles AS (SELECT tile, COUNT(*) AS customers, SUM(spent) AS revenue FROM tiled GROUP BY 1)"))
def customer_concentration(star: Star):
    return customers.customer_concentration(star.summed(["customer_id"], ["total_amount"]))


def cohort_sql(by: str) -> str:
    keys = f"{by}, " if by else ""
    return on_sales(f"""
SELECT {keys}cohort_month, months_since, customers, cohort_size,
       {rounded(quotient('customers * 100', 'cohort_size'))} AS retention_rate
FROM (
  SELECT *, MAX(CASE WHEN months_since = 0 THEN customers END)
              OVER (PARTITION BY {keys}cohort_month) AS cohort_size
  FROM (
    SELECT {keys}cohort_month, date_diff('month', cohort_month, month) AS months_since,
           COUNT(*) AS customers
    FROM (SELECT *, MIN(month) OVER (PARTITION BY {keys}customer_id) AS cohort_month FROM active)
      AS dated
    GROUP BY ALL
  ) AS counted
) AS sized""", f"""
active AS (
  SELECT DISTINCT {keys}customer_id, {MONTH} AS month FROM sales
  WHERE customer_id IS NOT NULL AND transaction_date IS NOT NULL
)""")


@query("retention_cohorts", cohort_sql(""))
def retention_cohorts(star: Star):
    return customers.retention_cohorts(star.summed(["customer_id", "transaction_date"]))


@query("retention_cohorts_by_segment", cohort_sql("customer_segment"))
def retention_cohorts_by_segment(star: Star):
    return customers.retention_cohorts(
        star.summed(["customer_segment", "customer_id", "transaction_date"]),
        ["customer_segment"])


@query("segment_retention", on_sales(f"""
SELECT customer_segment, COUNT(*) AS customers,
       COUNT(*) FILTER (WHERE first_day < last_day) AS returning_customers,
       {rounded(quotient('COUNT(*) FILTER (WHERE first_day < last_day) * 100', 'COUNT(*)'))}
         AS retention_rate
FROM (
  SELECT customer_segment, customer_id, MIN(CAST(transaction_date AS DATE)) AS first_day,
         MAX(CAST(transaction_date AS DATE)) AS last_day
  FROM sales WHERE customer_id IS NOT NULL GROUP BY 1, 2
) AS spans GROUP BY 1"""))
def segment_retention(star: Star):
    return customers.segment_retention(
        star.summed(["customer_segment", "customer_id", "transaction_date"]))


@query("revenue_growth", on_sales(f"""
SELECT quarter, {rounded('revenue')} AS revenue, {rounded('previous')} AS previous_revenue,
       {rounded(quotient('(revenue - previous) * 100', 'previous'))} AS growth_rate
FROM (
  SELECT quarter, revenue, LAG(revenue) OVER (ORDER BY quarter) AS previous
  FROM (
    SELECT CAST(date_trunc('quarter', transaction_date) AS DATE) AS quarter,
           SUM(total_amount) AS revenue
    FROM sales WHERE transaction_date IS NOT NULL GROUP BY 1
  ) AS quarters
) AS lagged"""))
def revenue_growth(star: Star):
    return sales.revenue_growth(star.summed(["transaction_date"], ["total_amount"]))


@query("seasonal_index", on_sales(f"""
SELECT product_category, quarter_of_year, {rounded('quarter_mean')} AS quarter_mean,
       {rounded(quotient('quarter_mean', 'category_mean'))} AS seasonal_index
FROM (
  SELECT product_category, quarter_of_year, {quotient('revenue', 'days')} AS quarter_mean,
         {quotient('SUM(revenue) OVER w', 'SUM(days) OVER w')} AS category_mean
  FROM (
    SELECT product_category, EXTRACT(QUARTER FROM day) AS quarter_of_year,
           SUM(revenue) AS revenue, COUNT(*) AS days
    FROM (
      SELECT product_category, CAST(transaction_date AS DATE) AS day, SUM(total_amount) AS revenue
      FROM sales WHERE transaction_date IS NOT NULL GROUP BY 1, 2
    ) AS daily GROUP BY 1, 2
  ) AS quarters
  WINDOW w AS (PARTITION BY product_category)
) AS means"""))
def seasonal_index(star: Star):
    return sales.seasonal_index(
        star.summed(["product_category", "transaction_date"], ["total_amount"]))


@query("gross_margin_by_category", on_sales(f"""
SELECT product_category, {total('total_amount')} AS revenue, {total('profit')} AS profit,
       {rounded(quotient('SUM(profit) * 100', 'SUM(total_amount)'))} AS gross_margin
FROM sales GROUP BY 1"""))
def gross_margin_by_category(star: Star):
    return sales.gross_margin_by_category(
        star.summed(["product_category"], ["total_amount", "profit"]))


@query("reorder_points", on_sales(f"""
SELECT product_category, product_name, CAST(total_units AS BIGINT) AS total_units,
       {rounded('demand')} AS avg_daily_demand, {rounded('deviation')} AS demand_std,
       {rounded('1.645 * deviation * sqrt(7.0)')} AS safety_stock,
       {rounded('demand * 7 + 1.645 * deviation * sqrt(7.0)')} AS reorder_point
FROM (
  SELECT *, {quotient('total_units', 'days')} AS demand,
         sqrt(greatest((CAST(squares AS DOUBLE) - CAST(total_units AS DOUBLE) * total_units / days)
                       / (days - 1), 0)) AS deviation
  FROM (
    SELECT product_category, product_name, SUM(units) AS total_units,
           SUM(units * units) AS squares
    FROM (
      SELECT product_category, product_name, CAST(transaction_date AS DATE) AS day,
             SUM(quantity) AS units
      FROM sales WHERE transaction_date IS NOT NULL GROUP BY 1, 2, 3
    ) AS daily GROUP BY 1, 2
  ) AS summed
  CROSS JOIN (
    SELECT CAST(date_diff('day', MIN(CAST(transaction_date AS DATE)),
                          MAX(CAST(transaction_date AS DATE))) + 1 AS DOUBLE) AS days
    FROM sales
  ) AS calendar
) AS stats"""))
def reorder_points(star: Star):
    return products.reorder_points(
        star.summed(["product_category", "product_name", "transaction_date"], ["quantity"]), z=1.645)


@query("conversion_rate", f"""
SELECT CAST(ts AS DATE) AS day, COUNT(*) FILTER (WHERE event_type = 'view') AS starts,
       COUNT(*) FILTER (WHERE event_type = 'purchase') AS goals,
       {rounded(quotient("COUNT(*) FILTER (WHERE event_type = 'purchase') * 100",
                         "COUNT(*) FILTER (WHERE event_type = 'view')"))} AS conversion_rate
FROM events WHERE ts IS NOT NULL GROUP BY 1""")
def conversion_rate(star: Star):
    return engagement.conversion_rate(star.table("events"))


_DAYS = "date_diff('day', CAST(transaction_date AS DATE), CAST(ship_date AS DATE))"


@query("fulfilment_time", on_sales(f"""
SELECT region, COUNT({_DAYS}) AS shipments, {average(_DAYS)} AS avg_days_to_ship,
       MIN({_DAYS}) AS fastest_days, MAX({_DAYS}) AS slowest_days
FROM sales GROUP BY 1"""))
def fulfilment_time(star: Star):
    return regions.fulfilment_time(star.sales(["region", "transaction_date", "ship_date"]))


@query("customer_density", on_sales(f"""
SELECT region, customers,
       {rounded(quotient('customers * 100', 'SUM(customers) OVER ()'))} AS customer_share
FROM (
  SELECT region, COUNT(DISTINCT customer_id) AS customers FROM sales
  WHERE customer_id IS NOT NULL GROUP BY 1
) AS counted"""))
def customer_density(star: Star):
    return regions.customer_density(star.summed(["region", "customer_id"]))


@query("kpi_drilldown", on_sales(f"""
SELECT CAST(3 - bit_count(GROUPING(region, product_category, product_name)) AS BIGINT) AS depth,
       region, product_category, product_name, {total('total_amount')} AS revenue,
       {total('profit')} AS profit, COUNT(*) AS transactions,
       {rounded(quotient('SUM(profit) * 100', 'SUM(total_amount)'))} AS margin
FROM sales GROUP BY ROLLUP (region, product_category, product_name)"""))
def kpi_drilldown(star: Star):
    return sales.kpi_drilldown(star.summed(
        ["region", "product_category", "product_name"], ["total_amount", "profit"]))
