"""The views over parts that follow each other in an order."""

import pytest

from lodeline import views
from lodeline.views import pairs, view
from tests.test_resolve import shuffled


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Lines of unknown, null, repeated and brandless parts, and of no order."""
    d = str(tmp_path_factory.mktemp("odd"))
    part = [(k, f"red {'rod' if k % 2 else 'bolt'}", None if k % 13 == 5 else f"Brand#{k % 4}", ("LARGE", "SMALL", "PROMO")[k % 3]) for k in range(120)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{d}/part.parquet")
    lines = [(None if k % 97 == 0 else k // 7, None if k % 31 == 0 else k * 37 % 130, k % 5 if k % 9 else None, "ANR"[k % 3] if k % 11 else None, 0.01) for k in range(3000)]
    lines += [(k, 50, 9, "A", 0.01) for k in range(40)] * 2
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_discount double").write.parquet(f"{d}/lineitem.parquet")
    return d


@pytest.mark.parametrize("name", ["raw_refs", "bindings"])
def test_pairs_give_what_the_joins_of_the_sql_give(spark, tables, name):
    joined = views._SQL[name]
    for table in ("refs", "symbols", "part"):
        joined = views._named(joined, table)
    part = views.read(spark, tables, "part")
    want = spark.sql(joined, refs=view(spark, tables, "refs"), symbols=view(spark, tables, "symbols"), part=part)
    got = view(spark, tables, name)
    key = lambda row: tuple(map(repr, row))
    rows = sorted((tuple(r) for r in got.collect()), key=key)
    assert got.dtypes == want.dtypes and len(rows) > 100
    assert rows == sorted((tuple(r) for r in want.collect()), key=key)


def test_lines_are_shuffled_twice(spark, tables):
    lines = spark.read.parquet(f"{tables}/lineitem.parquet").count()
    # Their parts and files besides, a few shuffles of 120 rows.
    assert shuffled(spark, lambda: pairs(spark, tables).write.format("noop").mode("overwrite").save()) < 2 * lines + 1500
