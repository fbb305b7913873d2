"""Registered queries against their SQL on the driver's smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodeline import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    at = [want.columns.index(c) for c in order]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_all_registered_queries_have_names_of_their_own():
    assert not set(catalog.oracle_sql()) - set(catalog.queries())


def test_no_sql_is_vacuous(duck):
    """Where the smallest tables have no rows for a query, larger ones do."""
    larger = duckdb.connect()
    for name in TABLES:
        larger.sql(f"create view {name} as select * from '{SF.replace('0.001', '0.01')}/{name}.parquet'")
    for name, sql in catalog.oracle_sql().items():
        count = f"select count(*) from ({sql})"
        assert duck.sql(count).fetchall()[0][0] or larger.sql(count).fetchall()[0][0], name


def test_entry(spark):
    assert entry.entry(spark).count() > 0
