"""Graph queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.catalog import query
from lodeline.operators import graph as G
from lodeline.tables import cut
from lodeline.views import sql, view

_EDGES = "edges AS (SELECT source_file_id AS src, target_file_id AS dst, round(sum(confidence), 6) AS weight FROM refs WHERE target_file_id IS NOT NULL AND source_file_id <> target_file_id AND confidence >= 0.5 GROUP BY 1, 2)"
_TEST = "(contains(path, '_test.') OR contains(path, '/test/') OR contains(path, '/tests/') OR contains(path, '.test.') OR contains(path, '.spec.'))"
SYMBOL = "red widget"


def _edges(spark, d):
    return G.edges(view(spark, d, "refs"))


@query("dep_edges", sql(f"WITH {_EDGES} SELECT * FROM edges", "refs"))
def dep_edges(spark, d):
    return _edges(spark, d)


_DEGREES = "degrees AS (SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY id)"


@query("degrees", sql(f"WITH {_EDGES}, {_DEGREES} SELECT * FROM degrees", "refs"))
def degrees(spark, d):
    return G.degrees(_edges(spark, d))


def _rank_sql(iterations: int) -> str:
    parts = [_EDGES, "nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)", "n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes)", "total AS (SELECT src, sum(weight) AS t FROM edges GROUP BY 1)", "shares AS (SELECT e.src, e.dst, e.weight / t.t AS share FROM edges e JOIN total t USING (src))", "r0 AS MATERIALIZED (SELECT id, 1 / n AS r FROM nodes, n)"]
    for i in range(1, iterations + 1):
        parts.append(f"l{i} AS MATERIALIZED (SELECT coalesce(sum(r), 0) AS lost FROM r{i - 1} WHERE id NOT IN (SELECT src FROM total))")
        parts.append(f"g{i} AS MATERIALIZED (SELECT dst AS id, sum(r * share) AS got FROM shares JOIN r{i - 1} ON id = src GROUP BY 1)")
        parts.append(f"r{i} AS MATERIALIZED (SELECT nodes.id, CAST(0.15 AS DOUBLE) / n + CAST(0.85 AS DOUBLE) * (coalesce(got, 0) + lost / n) AS r FROM nodes LEFT JOIN g{i} USING (id), n, l{i})")
    return ", ".join(parts)


_RANK = _rank_sql(30)


@query("pagerank", sql(f"WITH {_RANK} SELECT id, round(r, 9) AS centrality FROM r30", "refs"))
def pagerank(spark, d):
    return G.pagerank(cut(_edges(spark, d), "edges")).select("id", F.round("centrality", 9).alias("centrality"))


@query("top_centrality", sql(f"WITH {_RANK} SELECT id, round(r, 9) AS centrality FROM r30 ORDER BY round(r, 9) DESC, id LIMIT 10", "refs"))
def top_centrality(spark, d):
    return pagerank(spark, d).orderBy(F.desc("centrality"), "id").limit(10)


@query("p80_threshold", sql(f"WITH {_RANK}, o AS (SELECT round(r, 9) AS c, row_number() OVER (ORDER BY round(r, 9)) AS k, count(*) OVER () AS n FROM r30) SELECT c AS threshold FROM o WHERE k = least(n, CAST(floor(0.8 * n) AS BIGINT) + 1)", "refs"))
def p80_threshold(spark, d):
    from lodeline.operators.architecture import p80

    return p80(pagerank(spark, d), "centrality")


# Mutual reachability, from the closure of the edges.
_REACH = "reach AS (SELECT src AS a, dst AS b FROM edges UNION SELECT r.a, e.dst FROM reach r JOIN edges e ON e.src = r.b)"
_SCC = f"{_REACH}, mutual AS (SELECT x.a AS id, x.b AS other FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b), scc AS (SELECT id, least(id, min(other)) AS scc, count(other) + 1 AS scc_size FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) LEFT JOIN mutual USING (id) GROUP BY id)"


@query("scc", sql(f"RECURSIVE WITH {_EDGES}, {_SCC} SELECT * FROM scc", "refs"))
def scc(spark, d):
    return G.scc(cut(_edges(spark, d), "edges"))


@query("bfs_depth", sql(f"RECURSIVE WITH {_EDGES}, walk AS (SELECT id, 0 AS depth FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) WHERE id % 100 = 0 UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.id WHERE w.depth < 20) SELECT id, min(depth) AS depth FROM walk GROUP BY id", "refs"))
def bfs_depth(spark, d):
    edges = cut(_edges(spark, d), "edges")
    seeds = edges.select(F.explode(F.array("src", "dst")).alias("id")).where("id % 100 = 0")
    return G.depth(seeds, edges, 20)


@query("louvain_modules")
def louvain_modules(spark, d):
    return G.louvain(cut(_edges(spark, d), "edges"))


def _pool(kinds: str, fetch: int) -> str:
    return f"pool AS (SELECT * FROM refs WHERE target_name = '{SYMBOL}' AND kind IN ({kinds}) ORDER BY confidence DESC, id LIMIT {fetch}), placed AS (SELECT pool.*, path, {_TEST} AS is_test FROM pool JOIN files f ON f.id = source_file_id WHERE confidence >= 0.7)"


_ALL = "'call', 'field_access', 'type_ref', 'inherit'"
_SHOWN = f"SELECT id, path AS file_path, coalesce(source_symbol, '') AS symbol, source_line AS line, confidence, kind, is_test, (SELECT count(*) FROM placed WHERE is_test) AS excluded_tests FROM placed WHERE NOT is_test ORDER BY confidence DESC, id LIMIT 20"


@query("callers", sql(f"WITH {_pool(_ALL, 80)} {_SHOWN}", "refs", "files"))
def callers(spark, d):
    return G.callers(view(spark, d, "refs"), view(spark, d, "files"), SYMBOL)


@query("callers_with_tests", sql(f"WITH {_pool(_ALL, 20)} SELECT id, path AS file_path, coalesce(source_symbol, '') AS symbol, source_line AS line, confidence, kind, is_test, CAST(0 AS BIGINT) AS excluded_tests FROM placed", "refs", "files"))
def callers_with_tests(spark, d):
    return G.callers(view(spark, d, "refs"), view(spark, d, "files"), SYMBOL, include_tests=True)


for _name, _kinds in (("calls", "'call', 'field_access'"), ("types", "'type_ref'"), ("inherits", "'inherit'")):

    @query(f"callers_{_name}_only", sql(f"WITH {_pool(_kinds, 80)} {_SHOWN}", "refs", "files"))
    def callers_by_kind(spark, d, kinds=_name):
        return G.callers(view(spark, d, "refs"), view(spark, d, "files"), SYMBOL, kinds=kinds)


@query("callers_count", sql(f"SELECT count(*) AS total_available FROM refs JOIN files f ON f.id = source_file_id WHERE target_name = '{SYMBOL}' AND kind IN ({_ALL}) AND confidence >= 0.7 AND NOT {_TEST}", "refs", "files"))
def callers_count(spark, d):
    return G.count_callers(view(spark, d, "refs"), view(spark, d, "files"), SYMBOL)


def _impact_sql(depth: int) -> str:
    parts = [f"ranked AS (SELECT target_name, source_file_id, path AS file_path, coalesce(source_symbol, '') AS symbol, row_number() OVER (PARTITION BY target_name ORDER BY confidence DESC, refs.id) AS place, confidence, kind, {_TEST} AS is_test FROM refs JOIN files f ON f.id = source_file_id WHERE kind IN ({_ALL}))", f"rows0 AS MATERIALIZED (SELECT * FROM ranked WHERE place <= 200 AND target_name = '{SYMBOL}')"]
    new = "SELECT DISTINCT source_file_id, symbol FROM rows{0} WHERE confidence >= 0.7 AND NOT is_test AND symbol <> ''"
    parts.append(f"new0 AS MATERIALIZED ({new.format(0)})")
    for i in range(1, depth + 1):
        parts.append(f"rows{i} AS MATERIALIZED (SELECT ranked.* FROM new{i - 1} n JOIN ranked ON target_name = n.symbol WHERE place <= 100)")
        seen = " UNION ALL ".join(f"SELECT * FROM new{k}" for k in range(i))
        parts.append(f"new{i} AS MATERIALIZED (SELECT * FROM ({new.format(i)}) EXCEPT ({seen}))")
    return ", ".join(parts) + ", impact AS (" + " UNION ALL ".join(f"SELECT {i} AS depth, source_file_id, file_path, symbol, is_test, confidence, kind, confidence < 0.7 AS excluded FROM rows{i}" for i in range(depth + 1)) + ")"


_IMPACT = _impact_sql(2)
_BARE = "uncovered AS (SELECT DISTINCT file_path, symbol FROM impact WHERE NOT excluded AND NOT is_test AND symbol <> '' AND symbol NOT IN (SELECT symbol FROM impact WHERE is_test AND NOT excluded))"


def _impact(spark, d):
    # As in an index, the search reads stored references.
    return G.impact(cut(view(spark, d, "refs"), "refs"), view(spark, d, "files"), SYMBOL, 2)


@query("impact_rows", sql(f"WITH {_IMPACT} SELECT * FROM impact", "refs", "files"))
def impact_rows(spark, d):
    return _impact(spark, d)


@query("uncovered_paths", sql(f"WITH {_IMPACT}, {_BARE} SELECT * FROM uncovered", "refs", "files"))
def uncovered_paths(spark, d):
    return G.uncovered(_impact(spark, d)).select("file_path", "symbol")


@query(
    "impact_summary",
    sql(
        f"""WITH {_IMPACT}, {_BARE}, c AS (SELECT count(*) FILTER (NOT excluded AND depth = 0 AND NOT is_test) AS direct, count(*) FILTER (NOT excluded AND depth > 0 AND NOT is_test) AS transitive, count(*) FILTER (NOT excluded AND is_test) AS tests, count(*) FILTER (excluded) AS excluded, (SELECT count(*) FROM uncovered) AS uncovered FROM impact)
    SELECT direct, transitive, tests, uncovered, round(least(10, (2 * ln(1 + direct) + ln(1 + transitive) + 3 * ln(1 + uncovered)) / 2), 6) AS risk_score,
    concat_ws('; ', CASE WHEN direct > 10 THEN concat('high blast radius (', direct, ' direct callers)') END, CASE WHEN transitive > 20 THEN concat('deep dependency chain (', transitive, ' transitive)') END,
    CASE WHEN uncovered > 0 THEN concat(uncovered, ' call paths without test coverage') END, CASE WHEN excluded > 0 THEN concat(excluded, ' low-confidence reference(s) excluded (rerun with --min-confidence 0 to see them)') END) AS risk_factors FROM c""",
        "refs",
        "files",
    ),
)
def impact_summary(spark, d):
    return G.risk(_impact(spark, d))


@query("risk_score", "SELECT p_partkey AS id, round(least(CAST(10 AS DOUBLE), (2 * ln(1 + p_size) + ln(1 + p_partkey) + 3 * ln(1 + p_size % 7)) / 2), 6) AS risk_score FROM part")
def risk_score(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.select(F.col("p_partkey").alias("id"), F.round(G.risk_score(F.col("p_size"), F.col("p_partkey"), F.col("p_size") % 7), 6).alias("risk_score"))


@query("blast_radius_files", sql("SELECT target_file_id AS id, count(DISTINCT source_file_id) AS callers FROM refs WHERE confidence >= 0.7 AND target_file_id IS NOT NULL GROUP BY 1", "refs"))
def blast_radius(spark, d):
    refs = view(spark, d, "refs").where(F.col("target_file_id").isNotNull() & (F.col("confidence") >= 0.7))
    return refs.groupBy(F.col("target_file_id").alias("id")).agg(F.count_distinct("source_file_id").alias("callers"))


@query("prefix_clusters", sql("SELECT array_to_string(list_slice(string_split(path, '/'), 1, least(2, len(string_split(path, '/')) - 1)), '/') AS label, count(*) AS file_count FROM files GROUP BY 1", "files"))
def prefix_clusters(spark, d):
    parts = F.split("path", "/")
    label = F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(2), F.size(parts) - 1)), "/")
    return view(spark, d, "files").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("file_count"))
