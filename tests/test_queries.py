"""Every query with SQL against that SQL on another engine."""

from __future__ import annotations

import pytest

from conftest import SMALL, in_order
from tillwork.plans.registry import comparable, registered
from tillwork.sources.star import Star

QUERIES = registered()
WITH_SQL = sorted(name for name, q in QUERIES.items() if q.sql is not None)
SLOW = {"fit_random_forest", "fit_gradient_boosting", "model_selection"}
WITHOUT_SQL = sorted(name for name, q in QUERIES.items() if q.sql is None and name not in SLOW)


def check(df, query, connection):
    cursor = connection.execute(query.sql)
    names = [column[0] for column in cursor.description]
    expected = in_order(names, cursor.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert in_order(df.columns, df.collect()) == expected


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql(spark, plain_duck, name):
    check(QUERIES[name](spark, SMALL), QUERIES[name], plain_duck)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql_on_skewed_tables_of_many_files(spark, skewed_root, skewed_duck, name):
    query = QUERIES[name]
    df = comparable(query.build(Star(spark, skewed_root)), query.digits)
    check(df, query, skewed_duck)


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert len(df.collect()) > 0
    assert len(set(df.columns)) == len(df.columns)


def test_entry_points(spark):
    import __spark_entry__ as entry_points

    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
