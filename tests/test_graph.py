import random

import pytest

from lodeline.operators import architecture as A
from lodeline.operators import graph as G

SHAPES = {
    "chain": [(1, 2), (2, 3), (3, 4)],
    "star": [(k, 1) for k in range(2, 9)],
    "two_cycle": [(1, 2), (2, 1), (2, 3)],
    "three_cycle": [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4)],
}


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0 + (a + b) % 3) for a, b in pairs], "src long, dst long, weight double")


def brute_rank(pairs):
    nodes = sorted({x for p in pairs for x in p})
    weight = {(a, b): 1.0 + (a + b) % 3 for a, b in pairs}
    out = {n: sum(w for (a, _), w in weight.items() if a == n) for n in nodes}
    rank = {n: 1 / len(nodes) for n in nodes}
    for _ in range(30):
        lost = sum(r for n, r in rank.items() if not out[n])
        rank = {n: 0.15 / len(nodes) + 0.85 * (lost / len(nodes) + sum(rank[a] * w / out[a] for (a, b), w in weight.items() if b == n)) for n in nodes}
    return rank


@pytest.mark.parametrize("shape", ["star", "three_cycle"])
def test_pagerank(spark, shape):
    got = {r.id: r.centrality for r in G.pagerank(frame(spark, SHAPES[shape])).collect()}
    assert got == pytest.approx(brute_rank(SHAPES[shape])) and sum(got.values()) == pytest.approx(1)


def brute_scc(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "two_cycle", "three_cycle"])
def test_scc(spark, shape):
    assert {r.id: r.scc for r in G.scc(frame(spark, SHAPES[shape])).collect()} == brute_scc(SHAPES[shape])


def test_scc_random(spark):
    rng = random.Random(2)
    pairs = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(70)} - {(k, k) for k in range(40)})
    want = brute_scc(pairs)
    got = G.scc(frame(spark, pairs)).collect()
    assert {r.id: r.scc for r in got} == want
    assert all(r.scc_size == list(want.values()).count(r.scc) for r in got)


def test_graphs_without_edges(spark):
    none = frame(spark, SHAPES["chain"]).where("src < 0")
    assert G.pagerank(none).count() == 0 and G.scc(none).count() == 0


def test_louvain_separates_cliques(spark):
    clique = lambda base: [(base + a, base + b) for a in range(5) for b in range(5) if a < b]
    got = {r.id: r.module_id for r in G.louvain(spark.createDataFrame([(a, b, 1.0) for a, b in [*clique(0), *clique(10), (0, 10)]], "src long, dst long, weight double")).collect()}
    assert len({got[k] for k in range(5)}) == 1 and len({got[10 + k] for k in range(5)}) == 1 and got[0] != got[10]
    assert got[0] == 0


def test_depth(spark):
    edges = frame(spark, [*SHAPES["chain"], (1, 3)])
    seeds = spark.createDataFrame([(1,)], "id long")
    assert {r.id: r.depth for r in G.depth(seeds, edges).collect()} == {1: 0, 2: 1, 3: 1, 4: 2}


@pytest.mark.parametrize(
    "ins,outs,rank,scc,entry,role",
    [(0, 2, 0.5, 1, False, "entry_point"), (2, 0, 0.5, 1, False, "leaf"), (0, 0, 0.0, 1, False, "orphan"), (3, 3, 0.5, 1, False, "core"), (3, 3, 0.1, 1, False, "leaf"), (3, 3, 0.5, 3, False, "bridge"), (0, 0, 0.0, 1, True, "entry_point"), (2, 3, 0.9, 2, False, "leaf")],
)
def test_roles(spark, ins, outs, rank, scc, entry, role):
    from pyspark.sql import functions as F

    made = A.role(*(F.lit(x) for x in (ins, outs, rank, 0.3, scc, entry)))
    assert spark.range(1).select(made.alias("r")).first().r == role


def test_callers_limit_before_gate(spark):
    rows = [(k, 1, "f", k, 2, "g", "call", c) for k, c in enumerate([0.9] * 3 + [0.5] * 30)]
    refs = spark.createDataFrame(rows, "id long, source_file_id long, source_symbol string, source_line int, target_file_id long, target_name string, kind string, confidence double")
    files = spark.createDataFrame([(1, "a/x.py")], "id long, path string")
    assert G.callers(refs, files, "g", 2).count() == 2
    assert G.callers(refs, files, "g", 5, 0.7, True).count() == 3
    assert G.callers(refs, files, "none").count() == 0


def test_impact_lists_names_as_often_as_reached(spark):
    rows = [(1, 1, "a", "t"), (2, 2, "a", "t"), (3, 3, "b", "a"), (4, 4, "c", "b"), (5, 9, "test_b", "b")]
    refs = spark.createDataFrame([(i, f, s, 1, None, t, "call", 0.9) for i, f, s, t in rows], "id long, source_file_id long, source_symbol string, source_line int, target_file_id long, target_name string, kind string, confidence double")
    files = spark.createDataFrame([(k, f"d/{'tests/' if k == 9 else ''}{k}.py") for k in (1, 2, 3, 4, 9)], "id long, path string")
    got = G.impact(refs, files, "t", 2)
    assert sorted((r.depth, r.symbol) for r in got.collect()) == [(0, "a"), (0, "a"), (1, "b"), (1, "b"), (2, "c"), (2, "test_b")]
    risk = G.risk(got).first()
    assert (risk.direct, risk.transitive, risk.tests, risk.uncovered) == (2, 3, 1, 4)


def test_louvain_by_parts_is_the_same_as_whole(spark):
    """Random parts and a triangle apart, which is one module only against the degree sum of the whole graph."""
    rng = random.Random(7)
    pairs = sorted({(base + rng.randrange(25), base + rng.randrange(25)) for base in (0, 100, 300) for _ in range(45)})
    rows = spark.createDataFrame([(a, b, 1.0 + (a + b) % 3) for a, b in pairs] + [(200, 201, 1.0), (201, 202, 1.0), (202, 200, 1.0)], "src long, dst long, weight double")
    whole, parts = ({r.id: r.module_id for r in G.louvain(rows, by_parts=b).collect()} for b in (False, True))
    assert parts == whole and parts[200] == parts[201] == parts[202]


def test_louvain_of_a_large_part_is_dealt(spark, monkeypatch):
    """A linked part beyond the limit is no one task's: its modules come from rounds over blocks, in any number of parts."""
    cliques = [(base + a, base + b, 1.0) for base in (0, 10, 20) for a in range(6) for b in range(a)]
    rows = spark.createDataFrame([*cliques, (0, 10, 1.0), (10, 20, 1.0), (90, 91, 1.0)], "src long, dst long, weight double")
    monkeypatch.setattr(G, "KERNEL_EDGES", 10)
    kernel, sizes = G._louvain_kernel, spark.sparkContext.accumulator(0)

    def counted(*given):
        solve = kernel(*given)
        return lambda frame: (sizes.add(len(frame)), solve(frame))[1]

    monkeypatch.setattr(G, "_louvain_kernel", counted)
    got = {r.id: r.module_id for r in G.louvain(rows).collect()}
    assert sizes.value == 1 and len(got) == 20
    assert [len({got[base + k] for k in range(6)}) for base in (0, 10, 20)] == [1, 1, 1] and len(set(got.values())) == 4 and got[90] == got[91] == 3
    one, three = ({r.id: r.label for r in G.blocks.modules(rows, 1.5, 8, parts=n).collect()} for n in (1, 3))
    assert one == three and len(one) == 20
