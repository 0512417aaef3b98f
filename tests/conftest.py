from __future__ import annotations

import datetime
import decimal
import math
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tillwork.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", shuffle_partitions=8,
        **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def duck(root: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = f"{root}/{table}.parquet"
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{source}'")
    return connection


@pytest.fixture(scope="session")
def plain_duck():
    return duck(SMALL)


@pytest.fixture(scope="session")
def skewed_root(spark, tmp_path_factory):
    """The small tables with a third of all sales on one order, customer and part.

    Some sales refer to orders and parts that do not exist, and one order to a
    customer that does not.
    """
    root = str(tmp_path_factory.mktemp("skewed"))
    changes = {
        "lineitem": """
            SELECT CASE WHEN pmod(id, 3) = 0 THEN 7 WHEN id = 1 THEN 999999 ELSE l_orderkey END
                     AS l_orderkey,
                   CASE WHEN pmod(id, 3) = 0 THEN 11 WHEN id = 2 THEN 999999 ELSE l_partkey END
                     AS l_partkey,
                   l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
                   l_returnflag, l_linestatus, l_shipdate
            FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_linenumber,
                                               l_extendedprice) AS id FROM source)""",
        "orders": """
            SELECT o_orderkey,
                   CASE WHEN pmod(o_orderkey, 3) = 0 OR o_orderkey = 7 THEN 5
                        WHEN o_orderkey = 10 THEN 999999 ELSE o_custkey END AS o_custkey,
                   o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
            FROM source""",
    }
    for table in TABLES:
        spark.read.parquet(f"{SMALL}/{table}.parquet").createOrReplaceTempView("source")
        rows = spark.sql(changes.get(table, "SELECT * FROM source"))
        # Sales and events come in many files, as they would.
        rows.repartition({"lineitem": 12, "events": 6}.get(table, 1)).write.parquet(f"{root}/{table}.parquet")
    return root


@pytest.fixture(scope="session")
def skewed_duck(skewed_root):
    return duck(skewed_root)


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, decimal.Decimal):
        return float(value)
    return value


def in_order(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    picked = [tuple(plain(row[i]) for i in at) for row in rows]
    return sorted(picked, key=lambda row: tuple((v is None, str(v)) for v in row))


def day(text: str) -> datetime.datetime:
    return datetime.datetime.fromisoformat(text)
