"""Sales rows from a star schema.

One sale is one ``lineitem`` row. ``Star.sales`` joins only the tables the
asked-for columns come from. Dimensions are left-joined on their unique keys,
so no sale is lost or doubled and leaving a join out cannot change a result.

No join is hinted: Catalyst broadcasts a dimension when its size is under
``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise, and
adaptive execution splits a key that holds a large part of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from tillwork.functions.measures import ROW_COUNT, value_rows

TABLE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": (
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    ),
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
        "p_retailprice DOUBLE"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
        "props STRING"
    ),
}

# Amounts are computed in whole units of 1/10,000 (profit: 1/100,000,000) and
# then scaled, which is several times faster than decimal casts of doubles and
# as exact: prices have cents, rates whole percent. Prices up to 9,999,999,999.99
# keep every amount within the 18 digits Spark holds in one long. NaN is NULL.
def _hundredths(column: str) -> str:
    return f"floor(nanvl({column}, CAST(NULL AS DOUBLE)) * 100 + 0.5)"


_AMOUNT_UNITS = f"{_hundredths('l_extendedprice')} * (100 - {_hundredths('l_discount')})"
_MARGIN_UNITS = f"(1000 + 375 * {_hundredths('l_tax')})"

LINE_COLUMNS = {
    "order_id": "l_orderkey",
    "transaction_id": "l_orderkey * 8 + l_linenumber",
    "quantity": "CAST(l_quantity AS BIGINT)",
    "unit_price": "try_divide(l_extendedprice, l_quantity)",
    "discount_percent": f"CAST({_hundredths('l_discount')} AS DECIMAL(5,2))",
    "total_amount": f"CAST(CAST({_AMOUNT_UNITS} AS DECIMAL(18,0)) * 0.0001BD AS DECIMAL(18,4))",
    "profit_margin": f"CAST(CAST({_MARGIN_UNITS} AS DECIMAL(6,0)) * 0.0001BD AS DECIMAL(6,4))",
    "profit": (
        f"CAST(CAST({_AMOUNT_UNITS} * {_MARGIN_UNITS} AS DECIMAL(18,0)) * 0.00000001BD "
        "AS DECIMAL(18,8))"
    ),
    "ship_date": "l_shipdate",
}
ORDER_COLUMNS = {
    "transaction_date": "o_orderdate",
    "customer_id": "o_custkey",
    "sales_channel": (
        "CASE WHEN o_orderkey IS NULL THEN NULL WHEN o_orderstatus = 'O' THEN 'Online' "
        "WHEN o_orderstatus = 'F' THEN 'In-Store' ELSE 'Mobile' END"
    ),
}
CUSTOMER_COLUMNS = {"region": "r_name", "customer_segment": "c_mktsegment"}
PART_COLUMNS = {"product_category": "p_type", "product_name": "p_name"}

SALES_COLUMNS = (
    "order_id", "transaction_id", "transaction_date", "customer_id", "product_category",
    "product_name", "quantity", "unit_price", "discount_percent", "total_amount",
    "sales_channel", "region", "customer_segment", "profit_margin", "profit", "ship_date",
)

_EXPRESSIONS = {**LINE_COLUMNS, **ORDER_COLUMNS, **CUSTOMER_COLUMNS, **PART_COLUMNS}


@dataclass(frozen=True)
class Star:
    """The star-schema tables in one folder, one parquet table each."""

    spark: SparkSession
    root: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{self.root}/{name}.parquet")

    def sales(self, columns: Iterable[str] | None = None) -> DataFrame:
        """One row per sale, with ``columns`` (all by default)."""
        columns = list(SALES_COLUMNS if columns is None else dict.fromkeys(columns))
        return self._joined(columns).select(*[self._column(name) for name in columns])

    def summed(
        self, keys: Iterable[str], sums: Sequence[str] = (), labels: Mapping[str, Callable[[DataFrame], Column]] | None = None,
    ) -> DataFrame:
        """Sales added up by ``keys`` or finer, at every size of the tables.

        ``sums`` names columns to add up; each comes with the number of its values
        (``<name>_rows``), and ``row_count`` is the number of sales in a row.
        ``labels`` are further keys, such as a tier: name -> a function that makes it of
        the columns to add up.

        Line items are summed before they are joined: by order or part where the
        keys come from that chain, so map tasks combine rows, the join handles one
        row per key however many sales a key has, and both share one shuffle. With
        keys of both chains, sales are summed again between the two joins, by the
        order's columns and the part.
        """
        keys = list(dict.fromkeys(keys))
        sums = [name for name in dict.fromkeys(sums) if name not in keys]
        needs_part = any(name in PART_COLUMNS for name in keys)
        needs_customer = any(name in CUSTOMER_COLUMNS for name in keys)
        needs_order = needs_customer or any(name in ORDER_COLUMNS for name in keys)
        added = [*sums, *[value_rows(name) for name in sums], ROW_COUNT]
        labels = labels or {}
        if needs_order != needs_part and not labels and not any(name in LINE_COLUMNS for name in keys):
            facts = self._partial_sums(keys, sums, needs_order, needs_customer)
            return facts.select(*[self._column(name) for name in keys], *added)

        fact_keys = [name for name in keys if name not in PART_COLUMNS]
        facts = self._with_order(self.table("lineitem"), needs_customer) if needs_order else self.table("lineitem")
        rows = facts.select(
            *[self._column(name) for name in [*fact_keys, *sums]], *(["l_partkey"] if needs_part else []))
        rows = rows.withColumns({name: label(rows) for name, label in labels.items()})
        grouped = self._added_up(rows.groupBy(*fact_keys, *labels, *(["l_partkey"] if needs_part else [])), sums)
        if not needs_part:
            return grouped.select(*keys, *labels, *added)
        parts = [self._column(name) for name in keys if name in PART_COLUMNS]
        return self._with_part(grouped).select(*fact_keys, *labels, *parts, *added).select(*keys, *labels, *added)

    def _joined(self, columns: Sequence[str]) -> DataFrame:
        facts = self.table("lineitem")
        needs_customer = any(name in CUSTOMER_COLUMNS for name in columns)
        if needs_customer or any(name in ORDER_COLUMNS for name in columns):
            facts = self._with_order(facts, needs_customer)
        return self._with_part(facts) if any(name in PART_COLUMNS for name in columns) else facts

    @staticmethod
    def _added_up(groups: GroupedData, sums: Sequence[str]) -> DataFrame:
        return groups.agg(
            *[F.sum(name).alias(name) for name in sums],
            *[F.count(name).alias(value_rows(name)) for name in sums],
            F.count(F.lit(1)).alias(ROW_COUNT))

    def event_sales(self) -> DataFrame:
        """Purchases from the event table, the only sales with a time of day."""
        return self.table("events").where("event_type = 'purchase'").select(
            F.col("ts").alias("transaction_date"),
            F.col("user_id").alias("customer_id"),
            F.col("value").cast("decimal(18,4)").alias("total_amount"),
        )

    def register_views(self) -> None:
        """Temp views ``sales_transactions`` and ``event_sales`` for plain SQL."""
        self.sales().createOrReplaceTempView("sales_transactions")
        self.event_sales().createOrReplaceTempView("event_sales")

    @staticmethod
    def _column(name: str) -> Column:
        return F.expr(_EXPRESSIONS[name]).alias(name)

    def _partial_sums(
        self, keys: Sequence[str], sums: Sequence[str], order: bool, customer: bool
    ) -> DataFrame:
        """Line items summed per order or part, with the columns of that dimension chain."""
        link = "l_orderkey" if order else "l_partkey"
        lines = self.table("lineitem").select(link, *[self._column(name) for name in sums])
        facts = self._added_up(lines.groupBy(link), sums)
        if not order:
            return self._with_part(facts)
        facts = self._with_order(facts, customer=False)
        if not customer:
            return facts
        if not any(name in ORDER_COLUMNS for name in keys if name != "customer_id"):
            # Nothing else of the order is needed, so one row per customer will do.
            names = [*sums, *[value_rows(name) for name in sums], ROW_COUNT]
            facts = facts.groupBy("o_custkey").agg(*[F.sum(name).alias(name) for name in names])
        return self._with_customer(facts)

    def _with_part(self, facts: DataFrame) -> DataFrame:
        return facts.join(self.table("part"), F.expr("l_partkey = p_partkey"), "left")

    def _with_order(self, facts: DataFrame, customer: bool) -> DataFrame:
        orders = self.table("orders")
        on_order = F.expr("l_orderkey = o_orderkey")
        # Orders are fewer than line items, so customers are looked up there.
        return facts.join(self._with_customer(orders) if customer else orders, on_order, "left")

    def _with_customer(self, facts: DataFrame) -> DataFrame:
        return (
            facts.join(self.table("customer"), F.expr("o_custkey = c_custkey"), "left")
            .join(self.table("nation"), F.expr("c_nationkey = n_nationkey"), "left")
            .join(self.table("region"), F.expr("n_regionkey = r_regionkey"), "left")
        )
