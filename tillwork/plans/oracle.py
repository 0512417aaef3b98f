"""Pieces of the SQL that states each query's result, for an engine other than Spark."""

from __future__ import annotations

from tillwork.plans.registry import DIGITS, OFFSET

AS_OF = "2001-08-02"

_SALES = """
  SELECT l_orderkey AS order_id,
         l_orderkey * 8 + l_linenumber AS transaction_id,
         o_orderdate AS transaction_date,
         o_custkey AS customer_id,
         p_type AS product_category,
         p_name AS product_name,
         CAST(l_quantity AS BIGINT) AS quantity,
         l_extendedprice / NULLIF(l_quantity, 0) AS unit_price,
         CAST(l_discount AS DECIMAL(4,2)) * 100 AS discount_percent,
         CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
           AS total_amount,
         CASE WHEN o_orderkey IS NULL THEN NULL WHEN o_orderstatus = 'O' THEN 'Online'
              WHEN o_orderstatus = 'F' THEN 'In-Store' ELSE 'Mobile' END AS sales_channel,
         r_name AS region,
         c_mktsegment AS customer_segment,
         CAST(0.10 + 3.75 * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(6,4)) AS profit_margin,
         l_shipdate AS ship_date
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN part ON l_partkey = p_partkey"""

_SALES_WITH_PROFIT = f"""
sales AS (
  SELECT *, CAST(total_amount AS DECIMAL(18,4)) * profit_margin AS profit
  FROM ({_SALES}
  ) AS joined
)"""

_EVENT_SALES = """
event_sales AS (
  SELECT ts AS transaction_date, user_id AS customer_id,
         CAST(value AS DECIMAL(18,4)) AS total_amount
  FROM events WHERE event_type = 'purchase'
)"""


def on_sales(body: str, *ctes: str) -> str:
    """``body`` with the sales view, and further CTEs, before it."""
    return "WITH " + ",\n".join([_SALES_WITH_PROFIT, *ctes]) + "\n" + body


def on_events(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([_EVENT_SALES, *ctes]) + "\n" + body


def rounded(expression: str, digits: int = DIGITS) -> str:
    """The rounding of ``registry.comparable``."""
    return f"floor(CAST({expression} AS DOUBLE) * 1e{digits} + {OFFSET}) / 1e{digits}"


def total(column: str) -> str:
    return rounded(f"SUM({column})")


def quotient(numerator: str, denominator: str) -> str:
    return f"(CAST({numerator} AS DOUBLE) / NULLIF(CAST({denominator} AS DOUBLE), 0))"


def average(column: str) -> str:
    return rounded(quotient(f"SUM({column})", f"COUNT({column})"))


def half_even_cents(amount: str, count: str = "1") -> str:
    """A sum of amounts with four places over a count, in cents, halves to even."""
    units = f"CAST(({amount}) * 10000 AS HUGEINT)"
    per_cent = f"(100 * ({count}))"
    down, rest = f"({units} // {per_cent})", f"(2 * ({units} % {per_cent}))"
    up = f"({rest} > {per_cent} OR ({rest} = {per_cent} AND {down} % 2 = 1))"
    return f"CAST({down} + CASE WHEN {up} THEN 1 ELSE 0 END AS DOUBLE) / 100"


def case(rules: list[tuple[str, str]], otherwise: str) -> str:
    """The label of the first condition that holds."""
    arms = " ".join(f"WHEN {condition} THEN '{label}'" for condition, label in rules)
    return f"CASE {arms} ELSE '{otherwise}' END"
