"""The thirteen business reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwork.functions.dates import DAY_NAMES
from tillwork.operators import customers, products, regions, sales
from tillwork.plans.oracle import AS_OF, average, case, on_events, on_sales, quotient, rounded, total
from tillwork.plans.registry import query
from tillwork.sources.star import Star

# Bounds that spread the test tables' amounts over all tiers.
SPEND_TIERS = ((2_500_000, "High Value"), (1_500_000, "Medium Value"))
PRICE_TIERS = ((1000, "Low Price"), (3000, "Medium Price"))
DISCOUNT_BOUNDS = (3, 6)

MONTH = "CAST(date_trunc('month', transaction_date) AS DATE)"


@query("monthly_revenue", on_sales(f"""
SELECT {MONTH} AS month, {total('total_amount')} AS monthly_revenue,
       COUNT(*) AS transaction_count, {average('total_amount')} AS avg_order_value
FROM sales GROUP BY {MONTH}"""))
def monthly_revenue(star: Star):
    return sales.monthly_revenue(star.summed(["transaction_date"], ["total_amount"]))


@query("top_products", on_sales(f"""
SELECT product_name, product_category, {total('total_amount')} AS total_revenue,
       CAST(SUM(quantity) AS BIGINT) AS units_sold, {average('unit_price')} AS avg_price
FROM sales GROUP BY product_name, product_category
ORDER BY SUM(total_amount) DESC, product_name, product_category LIMIT 20"""))
def top_products(star: Star):
    return sales.top_products(star.summed(
        ["product_name", "product_category"], ["total_amount", "quantity", "unit_price"]))


@query("channel_performance", on_sales(f"""
SELECT sales_channel, {total('total_amount')} AS revenue, COUNT(*) AS transactions,
       {average('total_amount')} AS avg_order_value,
       {rounded(quotient('SUM(total_amount) * 100', 'SUM(SUM(total_amount)) OVER ()'))}
         AS revenue_percentage
FROM sales GROUP BY sales_channel"""))
def channel_performance(star: Star):
    return sales.channel_performance(star.summed(["sales_channel"], ["total_amount"]))


@query("customer_ltv_segments", on_sales(f"""
SELECT {case([(f'spent >= {b}', label) for b, label in SPEND_TIERS], customers.LOWEST_TIER)}
         AS customer_segment,
       COUNT(*) AS customer_count, {average('spent')} AS avg_lifetime_value,
       {average('orders')} AS avg_orders, {average('lifetime_days')} AS avg_lifetime_days
FROM per_customer GROUP BY 1""", """
per_customer AS (
  SELECT customer_id, COUNT(*) AS orders, SUM(total_amount) AS spent,
         date_diff('day', CAST(MIN(transaction_date) AS DATE), CAST(MAX(transaction_date) AS DATE))
           AS lifetime_days
  FROM sales GROUP BY customer_id
)"""))
def customer_ltv_segments(star: Star):
    return customers.customer_ltv_segments(
        star.summed(["customer_id", "transaction_date"], ["total_amount"]), SPEND_TIERS)


RFM_CTES = (f"""
rfm AS (
  SELECT customer_id,
         date_diff('day', CAST(MAX(transaction_date) AS DATE), DATE '{AS_OF}') AS recency_days,
         COUNT(*) AS frequency, SUM(total_amount) AS monetary_value
  FROM sales GROUP BY customer_id
)""", """
scored AS (
  SELECT *, NTILE(5) OVER (ORDER BY recency_days DESC NULLS FIRST, customer_id NULLS LAST) AS recency_score,
         NTILE(5) OVER (ORDER BY frequency NULLS LAST, customer_id NULLS LAST) AS frequency_score,
         NTILE(5) OVER (ORDER BY monetary_value NULLS LAST, customer_id NULLS LAST) AS monetary_score
  FROM rfm
)""")


SEGMENT = case(
    [(" AND ".join(f"{m}_score BETWEEN {low} AND {high}" for m, (low, high) in ranges.items()), name)
     for name, ranges in customers.RFM_SEGMENTS], customers.OTHER_SEGMENT)


@query("rfm_segments", on_sales(f"""
SELECT {SEGMENT} AS customer_segment,
       COUNT(*) AS customer_count, {average('monetary_value')} AS avg_monetary_value,
       {average('frequency')} AS avg_frequency, {average('recency_days')} AS avg_recency_days
FROM scored GROUP BY 1""", *RFM_CTES))
def rfm_segments(star: Star):
    return customers.rfm_segments(
        star.summed(["customer_id", "transaction_date"], ["total_amount"]),
        F.lit(AS_OF).cast("date"))


@query("category_growth", on_sales(f"""
SELECT product_category, {average('revenue')} AS avg_monthly_revenue,
       {rounded('AVG(growth)')} AS avg_growth_rate,
       {rounded('STDDEV_SAMP(growth)')} AS growth_volatility
FROM growth WHERE previous IS NOT NULL GROUP BY product_category""", f"""
monthly AS (
  SELECT product_category, {MONTH} AS month, SUM(total_amount) AS revenue
  FROM sales GROUP BY product_category, {MONTH}
)""", """
lagged AS (
  SELECT *, LAG(revenue) OVER (PARTITION BY product_category ORDER BY month) AS previous
  FROM monthly
)""", f"""
growth AS (
  SELECT *, {quotient('(revenue - previous) * 100', 'previous')} AS growth FROM lagged
)"""))
def category_growth(star: Star):
    return products.category_growth(
        star.summed(["product_category", "transaction_date"], ["total_amount"]))


@query("inventory_turnover", on_sales(f"""
SELECT product_category, product_name, CAST(SUM(quantity) AS BIGINT) AS total_units_sold,
       COUNT(DISTINCT {MONTH}) AS months_active,
       {rounded(quotient('SUM(quantity)', f'COUNT(DISTINCT {MONTH})'))} AS avg_monthly_sales,
       {rounded(quotient('SUM(total_amount)', 'SUM(quantity)'))} AS avg_selling_price
FROM sales GROUP BY product_category, product_name HAVING COUNT(DISTINCT {MONTH}) >= 3"""))
def inventory_turnover(star: Star):
    return products.inventory_turnover(star.summed(
        ["product_category", "product_name", "transaction_date"], ["quantity", "total_amount"]))


@query("day_of_week_sales", on_sales(f"""
SELECT CAST(EXTRACT(DOW FROM transaction_date) AS BIGINT) AS day_of_week,
       ({list(DAY_NAMES)})[EXTRACT(DOW FROM transaction_date) + 1] AS day_name,
       {total('total_amount')} AS revenue, COUNT(*) AS transactions,
       {average('total_amount')} AS avg_order_value
FROM sales GROUP BY 1, 2"""))
def day_of_week_sales(star: Star):
    return sales.day_of_week_sales(star.summed(["transaction_date"], ["total_amount"]))


@query("hourly_sales", on_events(f"""
SELECT CAST(EXTRACT(HOUR FROM transaction_date) AS BIGINT) AS hour_of_day,
       {total('total_amount')} AS revenue, COUNT(*) AS transactions,
       {average('total_amount')} AS avg_order_value
FROM event_sales GROUP BY 1"""))
def hourly_sales(star: Star):
    return sales.hourly_sales(star.event_sales())


@query("regional_performance", on_sales(f"""
SELECT region, {total('total_amount')} AS total_revenue, COUNT(*) AS total_transactions,
       COUNT(DISTINCT customer_id) AS unique_customers,
       {average('total_amount')} AS avg_order_value,
       {rounded(quotient('SUM(total_amount)', 'COUNT(DISTINCT customer_id)'))}
         AS revenue_per_customer
FROM sales GROUP BY region"""))
def regional_performance(star: Star):
    return regions.regional_performance(star.summed(["region", "customer_id"], ["total_amount"]))


@query("regional_category_rank", on_sales(f"""
SELECT region, product_category, {rounded('revenue')} AS category_revenue,
       {rounded(quotient('revenue * 100', 'SUM(revenue) OVER (PARTITION BY region)'))}
         AS percentage_of_regional_sales,
       RANK() OVER (PARTITION BY region ORDER BY revenue DESC) AS category_rank
FROM by_category""", """
by_category AS (
  SELECT region, product_category, SUM(total_amount) AS revenue
  FROM sales GROUP BY region, product_category
)"""))
def regional_category_rank(star: Star):
    return regions.regional_category_rank(
        star.summed(["region", "product_category"], ["total_amount"]))


_LOW, _MEDIUM = DISCOUNT_BOUNDS
DISCOUNT_TIER = case(
    [("discount_percent = 0", "No Discount"),
     (f"discount_percent <= {_LOW}", f"Low Discount (1-{_LOW}%)"),
     (f"discount_percent <= {_MEDIUM}", f"Medium Discount ({_LOW + 1}-{_MEDIUM}%)")],
    f"High Discount (>{_MEDIUM}%)")


@query("discount_tiers", on_sales(f"""
SELECT {DISCOUNT_TIER} AS discount_tier,
       COUNT(*) AS transaction_count, {total('total_amount')} AS revenue,
       {average('total_amount')} AS avg_order_value, {average('quantity')} AS avg_quantity,
       {average('discount_percent')} AS avg_discount_rate
FROM sales GROUP BY 1"""))
def discount_tiers(star: Star):
    return products.discount_tiers(
        star.sales(["discount_percent", "total_amount", "quantity"]), DISCOUNT_BOUNDS)


@query("price_tiers", on_sales(f"""
SELECT product_category,
       {case([(f'unit_price <= {b}', label) for b, label in PRICE_TIERS], products.HIGHEST_PRICE_TIER)}
         AS price_tier,
       COUNT(*) AS transaction_count, CAST(SUM(quantity) AS BIGINT) AS total_quantity,
       {average('unit_price')} AS avg_price, {total('total_amount')} AS revenue
FROM sales GROUP BY 1, 2"""))
def price_tiers(star: Star):
    # Summed by part and tier before the join with the parts.
    rows = star.summed(
        ["product_category"], ["unit_price", "quantity", "total_amount"],
        {"price_tier": lambda sales: products.price_tier(sales, PRICE_TIERS)})
    return products.price_tiers(rows, PRICE_TIERS)
