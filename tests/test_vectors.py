import numpy as np
import pytest

from lodeline.operators import vectors as V


@pytest.fixture(scope="module")
def points():
    """Clusters of two sizes, copies, and rows that are nothing."""
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 4, (12, 16))
    made = np.concatenate([m + rng.normal(0, 1, (60, 16)) for m in middles] + [np.repeat(middles[:1], 90, axis=0)]).astype(np.float32)
    return {int(i): p for i, p in enumerate(made)}


@pytest.fixture(scope="module")
def table(spark, points):
    rows = [(i, [float(x) for x in p]) for i, p in points.items()]
    return spark.createDataFrame([*rows, (None, [1.0] * 16), (5000, None), (5001, [])], "id long, embedding array<float>").repartition(4)


def brute(points, asked, limit):
    rows = []
    for q in asked:
        distance = {i: float(np.sqrt(((p.astype(float) - points[q].astype(float)) ** 2).sum())) for i, p in points.items()}
        best = sorted((-round(1 / (1 + d), 9), i) for i, d in distance.items())[:limit]
        rows += [(q, i, -s, r) for r, (s, i) in enumerate(best, 1)]
    return sorted(rows)


def rows_of(found):
    return sorted((r.query, r.id, r.score, r["rank"]) for r in found.collect())


@pytest.mark.parametrize("block,probes", [(4096, 1), (16, 3)])
def test_exact_search_matches_a_scan(table, points, monkeypatch, block, probes):
    monkeypatch.setattr(V, "BLOCK", block)
    centres = V.fit(table, cells=15)
    index = V.build(table, centres)
    assert index.selectExpr("sum(n)").first()[0] == len(points)
    asked = [i for i in points if i % 20 == 0]
    got, want = rows_of(V.search(index, centres, table.where("id % 20 = 0 and id < 5000"), limit=12, probes=probes)), brute(points, asked, 12)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-9)


def test_recall_of_few_probes(table, points):
    centres = V.fit(table, cells=24)
    index = V.build(table, centres)
    wanted = table.where("id % 10 = 0 and id < 5000")
    exact = V.search(index, centres, wanted, limit=10, probes=4)
    assert V.recall(V.search(index, centres, wanted, limit=10, probes=4, exact=False), exact) >= 0.9
    assert V.recall(V.search(index, centres, wanted, limit=10, probes=24, exact=False), exact) == 1.0


def test_probes_prune_cells(spark, table):
    centres = V.fit(table, cells=15)
    index = V.build(table, centres)
    plan = index.where("cell in (3)")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:60]


def test_small_and_empty_tables(spark, table):
    empty = table.limit(0)
    centres = V.fit(empty)
    assert V.search(V.build(empty, centres), centres, table).count() == 0
    one = spark.createDataFrame([(7, [1.0, 2.0])], "id long, embedding array<float>")
    centres = V.fit(one, cells=10)
    assert rows_of(V.search(V.build(one, centres), centres, one, limit=3)) == [(7, 7, 1.0, 1)]
    centres = V.fit(table, cells=15)
    assert V.search(V.build(table, centres), centres, empty).count() == 0


def test_recall_on_the_registered_table(spark):
    from lodeline import catalog

    named = catalog.queries()
    sf = "/root/testdata/sf0.01"
    assert V.recall(named["vector_knn_probed"](spark, sf), named["vector_knn_all"](spark, sf)) >= 0.9
