"""Dependency-graph operators: edges, degrees, PageRank, SCC, Louvain, BFS depth, callers, impact."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.operators import blocks
from lodeline.tables import cut

#: Louvain makes its moves one after the other in a graph, or a weakly linked part, of up to this many edges; at once in larger ones.
KERNEL_EDGES = 2_000_000
DAMPING, ITERATIONS = 0.85, 30
LEAST_CONFIDENCE = 0.5
#: What a request for all callers gets at most.
UNLIMITED = 50_000
SEED_CAP, NODE_CAP = 200, 100

KINDS = {"both": ("call", "field_access", "type_ref", "inherit"), "calls": ("call", "field_access"), "types": ("type_ref",), "inherits": ("inherit",)}


def kind_filter(kinds: list[str] | None) -> tuple[str, ...]:
    """The kinds a caller list shows; unknown or missing names mean all of them."""
    known = {"call": "calls", "calls": "calls", "type": "types", "types": "types", "type_ref": "types", "inherit": "inherits", "inherits": "inherits"}
    named = {known[k] for k in kinds or [] if k in known}
    return KINDS[named.pop()] if len(named) == 1 else KINDS["both"]


def edges(refs: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """src, dst, weight: resolved references between different files, summed."""
    kept = refs.where(F.col("target_file_id").isNotNull() & (F.col("source_file_id") != F.col("target_file_id")) & (F.col("confidence") >= least))
    return kept.groupBy(F.col("source_file_id").alias("src"), F.col("target_file_id").alias("dst")).agg(F.round(F.sum("confidence"), 6).alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree over distinct neighbours."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def _in_one_task(edges: DataFrame, function, schema: str) -> DataFrame:
    """A whole graph of checked size in one task."""
    return edges.groupBy(F.lit(0).alias("_graph")).applyInPandas(function, schema)


def small(edges: DataFrame) -> bool:
    return edges.limit(KERNEL_EDGES + 1).count() <= KERNEL_EDGES


def _numbered(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, at = np.unique(np.concatenate([frame["src"].to_numpy(), frame["dst"].to_numpy()]), return_inverse=True)
    return ids, at[: len(frame)], at[len(frame) :]


def pagerank(edges: DataFrame) -> DataFrame:
    """id, centrality: weighted, a fixed number of iterations, dangling mass spread evenly. Nodes are the edges' ends."""
    return blocks.pagerank(edges, DAMPING, ITERATIONS)


def scc(edges: DataFrame) -> DataFrame:
    """id, scc (smallest id of its strongly connected component), scc_size."""
    return _components(blocks.components(edges)).select("id", "scc", "scc_size")


def _components(found: DataFrame) -> DataFrame:
    size = found.groupBy("c").agg(F.count(F.lit(1)).alias("scc_size"), F.min("id").alias("scc"))
    return found.join(size, "c")


def measures(edges: DataFrame) -> DataFrame:
    """id, centrality, in_degree, out_degree, scc, scc_size of the edges' ends, where all are wanted: edges are dealt to parts once. Edges are distinct."""
    held = blocks.Blocks(edges)
    ranks, found = blocks.pagerank(held, DAMPING, ITERATIONS), blocks.components(held)
    held.drop()
    return ranks.join(_components(found), "id").drop("c")


def spread(values: DataFrame, edges: DataFrame) -> DataFrame:
    """The largest value (id, c) that reaches each node along edges."""
    return blocks.spread(values, edges)


def reach(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that edges reach from the seeds, seeds included."""
    return depth(seeds, edges).select("id")


def depth(seeds: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """id, depth: breadth-first along outgoing edges from several seeds; one join a level."""
    seen = frontier = cut(seeds.select("id").distinct().select("id", F.lit(0).alias("depth")))
    level = 0
    while most is None or level < most:
        level += 1
        step = edges.select("src", "dst").join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen, "id", "left_anti").select("id", F.lit(level).alias("depth")))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    return seen


def _louvain_kernel(resolution: float, sweeps: int, whole: float | None = None):
    """``whole`` is the degree sum of the graph where the kernel gets a part of it."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, src, dst = _numbered(frame)
        n, w = len(ids), frame["weight"].to_numpy(float)
        near: list[dict[int, float]] = [{} for _ in range(n)]
        for a, b, x in zip(src.tolist(), dst.tolist(), w.tolist()):
            if a != b:
                near[a][b] = near[a].get(b, 0.0) + x
                near[b][a] = near[b].get(a, 0.0) + x
        degree = np.array([sum(x.values()) for x in near])
        total, own = degree.sum() if whole is None else whole, np.arange(n)
        mass = degree.copy()
        for _ in range(sweeps if total else 0):
            moved = False
            for v in range(n):
                home = own[v]
                mass[home] -= degree[v]
                links: dict[int, float] = {}
                for u, x in near[v].items():
                    links[own[u]] = links.get(own[u], 0.0) + x
                gain = lambda c: links.get(c, 0.0) - resolution * degree[v] * mass[c] / total  # noqa: B023, E731
                # The largest gain over staying alone; ties go to the smallest community.
                best, top = home, max(gain(home), 0.0)
                for c in sorted(links):
                    if gain(c) > top + 1e-12:
                        best, top = c, gain(c)
                own[v] = best
                mass[best] += degree[v]
                moved |= best != home
            if not moved:
                break
        _, first, number = np.unique(own, return_index=True, return_inverse=True)
        rank = np.argsort(np.argsort(first))
        return pd.DataFrame({"id": ids, "module_id": rank[number]})

    return run


def louvain(edges: DataFrame, resolution: float = 1.5, sweeps: int = 30, by_parts: bool | None = None) -> DataFrame:
    """id, module_id: one level of greedy modularity on the undirected graph, nodes in order of id.

    Sequential moves are made by one task, so a graph beyond ``KERNEL_EDGES`` edges is
    first split into weakly linked parts, which never share a module, and a part per task
    is solved against the degree sum of the whole graph. The moves of parts that are
    themselves beyond ``KERNEL_EDGES`` are made at once, in rounds over blocks
    (``blocks.modules``): the same gains in another order, so modules are not those of a
    sequential pass. Modules are numbered by their smallest id.
    """
    schema = "id long, module_id long"
    if not (by_parts if by_parts is not None else not small(edges)):
        return _in_one_task(edges, _louvain_kernel(resolution, sweeps), schema)
    part = blocks.linked(edges)
    whole = 2 * (edges.where("src <> dst").agg(F.sum("weight")).first()[0] or 0.0)
    solve = _louvain_kernel(resolution, sweeps, whole)

    def per_part(frame: pd.DataFrame) -> pd.DataFrame:
        out = solve(frame)
        return out.assign(module_id=out.groupby("module_id")["id"].transform("min"))

    placed = cut(edges.join(part.select(F.col("id").alias("src"), F.col("c").alias("part")), "src"), "placed")
    # At most one for every KERNEL_EDGES edges.
    giants = [r.part for r in placed.groupBy("part").count().where(F.col("count") > KERNEL_EDGES).select("part").collect()]
    found = cut(placed.where(~F.col("part").isin(giants)).groupBy("part").applyInPandas(per_part, schema))
    if giants:
        # Every module lets go in one of two rounds and takes in the other, which makes a sweep.
        labels = blocks.modules(placed.where(F.col("part").isin(giants)), resolution, 2 * sweeps, whole)
        least = labels.groupBy("label").agg(F.min("id").alias("module_id"))
        named = part.where(F.col("c").isin(giants)).select("id").join(labels.join(least, "label"), "id", "left")
        found = found.unionByName(cut(named.select("id", F.coalesce("module_id", "id").alias("module_id"))))
    return found.join(_ranks(found.select(F.col("module_id").alias("first")).distinct()).withColumnRenamed("first", "module_id"), "module_id").select("id", F.col("rank").alias("module_id"))


def _ranks(values: DataFrame) -> DataFrame:
    """first, rank: the place of each distinct value in their order from 0, by ranges."""
    ranged = cut(values.repartitionByRange("first").withColumn("range", F.spark_partition_id()))
    sizes = [(r["range"], r["count"]) for r in ranged.groupBy("range").count().orderBy("range").collect()]  # a row per range
    starts = [(k, sum(n for _, n in sizes[:i])) for i, (k, _) in enumerate(sizes)]
    placed = ranged.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy("first")) - 1)
    return placed.join(F.broadcast(values.sparkSession.createDataFrame(starts, "range int, start long")), "range").select("first", (F.col("start") + F.col("place")).alias("rank"))


def is_test(path: Column) -> Column:
    from lodeline.functions.paths import is_test_callers

    return is_test_callers(path)


def callers(refs: DataFrame, files: DataFrame, symbol: str, limit: int = 20, least: float = 0.7, include_tests: bool = False, kinds: str = "both") -> DataFrame:
    """Who refers to a symbol. The best ``fetch`` rows are taken first, then gated and freed of tests; a limit of 0 means UNLIMITED.

    Columns: id, file_path, symbol, line, confidence, kind, is_test, excluded_tests (of the fetched rows).
    """
    limit = limit if limit > 0 else UNLIMITED
    fetch = limit if include_tests else max(4 * limit, limit + 16)
    named = refs.where((F.col("target_name") == symbol) & F.col("kind").isin(*KINDS[kinds]))
    # The pool holds a bounded number of rows, so what follows runs on a few.
    pool = named.orderBy(F.desc("confidence"), "id").limit(fetch)
    placed = pool.join(files.select(F.col("id").alias("source_file_id"), "path"), "source_file_id").where(F.col("confidence") >= least).withColumn("is_test", is_test(F.col("path")))
    every = Window.partitionBy(F.lit(0))
    counted = placed.withColumn("excluded_tests", F.lit(0).cast("long") if include_tests else F.count_if("is_test").over(every))
    shown = counted if include_tests else counted.where(~F.col("is_test"))
    return shown.orderBy(F.desc("confidence"), "id").limit(limit).select("id", F.col("path").alias("file_path"), F.coalesce("source_symbol", F.lit("")).alias("symbol"), F.col("source_line").alias("line"), "confidence", "kind", "is_test", "excluded_tests")


def count_callers(refs: DataFrame, files: DataFrame, symbol: str, least: float = 0.7, include_tests: bool = False, kinds: str = "both") -> DataFrame:
    """How many callers there are to show, without a limit."""
    named = refs.where((F.col("target_name") == symbol) & F.col("kind").isin(*KINDS[kinds]) & (F.col("confidence") >= least))
    placed = named.join(files.select(F.col("id").alias("source_file_id"), "path"), "source_file_id")
    return (placed if include_tests else placed.where(~is_test(F.col("path")))).agg(F.count(F.lit(1)).alias("total_available"))


def impact(refs: DataFrame, files: DataFrame, symbol: str, max_depth: int = 3, least: float = 0.7, kinds: str = "both") -> DataFrame:
    """Rows of the reverse search from a symbol: depth, source_file_id, file_path, symbol, is_test, confidence, kind.

    Each name's best references are expanded (``SEED_CAP`` for the start, ``NODE_CAP``
    later). A (file, symbol) is expanded once, but listed as often as it is reached,
    and a name that several files have is expanded for each of them; tests are listed,
    not expanded. One join a level. Rows under ``least`` are listed with their
    confidence, not expanded, and left to ``risk`` to count.
    """
    kept = refs.where(F.col("kind").isin(*KINDS[kinds]))
    path = files.select(F.col("id").alias("source_file_id"), F.col("path").alias("file_path"))
    place = F.row_number().over(Window.partitionBy("target_name").orderBy(F.desc("confidence"), "id"))
    frontier = refs.sparkSession.createDataFrame([(symbol,)], "target_name string")
    seen, out = None, None
    for level in range(max_depth + 1):
        # References of the frontier's names alone are ranked; ranks under the cap are found before the shuffle.
        named = kept.join(frontier.distinct(), "target_name", "left_semi")
        best = named.withColumn("place", place).where(F.col("place") <= (NODE_CAP if level else SEED_CAP)).drop("place")
        placed = best.join(path, "source_file_id").withColumn("is_test", is_test(F.col("file_path")))
        rows = cut(placed.join(frontier, "target_name").select(F.lit(level).alias("depth"), "source_file_id", "file_path", F.coalesce("source_symbol", F.lit("")).alias("symbol"), "is_test", "confidence", "kind"), "impact")
        out = rows if out is None else out.unionByName(rows)
        new = rows.where((F.col("confidence") >= least) & ~F.col("is_test") & (F.col("symbol") != "")).select("source_file_id", "symbol").distinct()
        if level == max_depth:
            break
        new = cut(new if seen is None else new.join(seen, ["source_file_id", "symbol"], "left_anti"), "impact")
        seen = new if seen is None else seen.unionByName(new)
        frontier = new.select(F.col("symbol").alias("target_name"))
        if frontier.isEmpty():
            break
    return out.withColumn("excluded", F.col("confidence") < least)


def uncovered(rows: DataFrame) -> DataFrame:
    """file_path, symbol of production callers whose name no listed test has."""
    shown = rows.where("not excluded")
    return shown.where("not is_test and symbol <> ''").select("file_path", "symbol").distinct().join(shown.where("is_test").select("symbol").distinct(), "symbol", "left_anti")


def risk(rows: DataFrame) -> DataFrame:
    """direct, transitive, tests, uncovered, risk_score and risk_factors of an impact search."""
    sums = rows.agg(*(F.count_if(F.expr(c)).alias(n) for n, c in (("direct", "not excluded and depth = 0 and not is_test"), ("transitive", "not excluded and depth > 0 and not is_test"), ("tests", "not excluded and is_test"), ("excluded", "excluded"))))
    counts = sums.join(F.broadcast(uncovered(rows).agg(F.count(F.lit(1)).alias("uncovered"))))  # one row each
    return counts.select("direct", "transitive", "tests", "uncovered", F.round(risk_score(F.col("direct"), F.col("transitive"), F.col("uncovered")), 6).alias("risk_score"), F.array_join(risk_factors(), "; ").alias("risk_factors"))


def risk_score(direct: Column, transitive: Column, uncovered: Column) -> Column:
    return F.least(F.lit(10.0), (2 * F.log1p(direct) + F.log1p(transitive) + 3 * F.log1p(uncovered)) / 2)


def risk_factors() -> Column:
    """What raises the risk."""
    # The words of the reports.
    said = lambda when, text, column: F.when(when, F.format_string(text, F.col(column)))
    return F.array_compact(
        F.array(
            said(F.col("direct") > 10, "high blast radius (%d direct callers)", "direct"),
            said(F.col("transitive") > 20, "deep dependency chain (%d transitive)", "transitive"),
            said(F.col("uncovered") > 0, "%d call paths without test coverage", "uncovered"),
            said(F.col("excluded") > 0, "%d low-confidence reference(s) excluded (rerun with --min-confidence 0 to see them)", "excluded"),
        )
    )
