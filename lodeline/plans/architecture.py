"""Architecture and context queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.catalog import query
from lodeline.functions.paths import BORING
from lodeline.operators import architecture as A
from lodeline.operators import context as C
from lodeline.operators import graph as G
from lodeline.plans.graphs import _DEGREES, _EDGES, _RANK, _SCC
from lodeline.tables import cut
from lodeline.views import sql, view

_ENTRY = "(id % 41 = 0)"
_RULES = [(layer, "path", f"(?i){p}", A.PATH_WEIGHT) for layer, p in A.PATH_RULES] + [(layer, "regexp_extract(path, '([^/]*)$', 1)", f"(?i){p}", A.NAME_WEIGHT) for layer, p in A.NAME_RULES]
_HINTS = "hints AS (" + " UNION ALL ".join(f"SELECT id, '{layer}' AS layer, CAST({w} AS DOUBLE) AS weight FROM files WHERE regexp_matches({subject}, '{p}')" for layer, subject, p, w in _RULES) + ")"
_LAYERS = f"""{_HINTS}, weighed AS (SELECT id, layer, round(sum(weight), 6) AS w FROM hints GROUP BY 1, 2), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, layer) AS k, sum(w) OVER (PARTITION BY id) AS total FROM weighed),
layers AS (SELECT f.id, CASE WHEN {_ENTRY.replace('id', 'f.id')} THEN 'entry' ELSE coalesce(layer, 'unknown') END AS layer, CASE WHEN {_ENTRY.replace('id', 'f.id')} THEN CAST(1 AS DOUBLE) ELSE coalesce(round(w / total, 6), 0) END AS layer_conf FROM files f LEFT JOIN ranked r ON r.id = f.id AND k = 1)"""


def _files(spark, d):
    return view(spark, d, "files").withColumn("is_entry", F.col("id") % 41 == 0)


@query("layer_hints", sql(f"WITH {_HINTS} SELECT * FROM hints", "files"))
def layer_hints(spark, d):
    return view(spark, d, "files").select("id", F.explode(A.hints(F.col("path"))).alias("h")).select("id", "h.layer", "h.weight")


@query("layer_fusion", sql(f"WITH {_LAYERS} SELECT * FROM layers", "files"))
def layer_fusion(spark, d):
    return A.fuse_layers(_files(spark, d))


_OVERRIDE = _LAYERS.replace("hints AS (", "hints AS (SELECT id, 'platform' AS layer, CAST(0.9 AS DOUBLE) AS weight FROM files WHERE list_contains(string_split(path, '/'), 'economy') UNION ALL ", 1)


@query("layer_override", sql(f"WITH {_OVERRIDE} SELECT * FROM layers", "files"))
def layer_override(spark, d):
    return A.fuse_layers(_files(spark, d), [("economy", "platform", 0.9)])


@query("layer_histogram", sql(f"WITH {_LAYERS} SELECT layer, count(*) AS n FROM layers GROUP BY 1", "files"))
def layer_histogram(spark, d):
    return A.histogram(layer_fusion(spark, d), "layer")


def _roles(least: str) -> str:
    edges = _EDGES.replace("confidence >= 0.5", f"confidence >= {least}")
    return f"""RECURSIVE WITH {_RANK.replace(_EDGES, edges)}, {_DEGREES}, {_SCC}, ranks AS (SELECT id, round(r, 9) AS centrality FROM r30),
p AS (SELECT c AS threshold FROM (SELECT centrality AS c, row_number() OVER (ORDER BY centrality) AS k, count(*) OVER () AS n FROM ranks) WHERE k = least(n, CAST(floor(0.8 * n) AS BIGINT) + 1)),
facts0 AS (SELECT f.id, f.path, {_ENTRY.replace('id', 'f.id')} AS is_entry, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, coalesce(centrality, 0) AS centrality, coalesce(scc_size, 1) AS scc_size, threshold FROM files f LEFT JOIN degrees USING (id) LEFT JOIN ranks USING (id) LEFT JOIN scc USING (id), p),
facts AS (SELECT id, path, centrality, in_degree, out_degree, CASE WHEN is_entry THEN 'entry_point' WHEN scc_size >= 3 THEN 'bridge' WHEN in_degree = 0 AND out_degree > 0 THEN 'entry_point' WHEN out_degree = 0 AND in_degree > 0 THEN 'leaf' WHEN in_degree = 0 AND out_degree = 0 THEN 'orphan' WHEN centrality >= threshold AND in_degree >= 3 AND out_degree >= 3 THEN 'core' ELSE 'leaf' END AS role FROM facts0)"""


_ROLES, _SURE = _roles("0.5"), _roles("1")


def _facts(spark, d, least=G.LEAST_CONFIDENCE):
    edges = cut(G.edges(view(spark, d, "refs"), least), "edges")
    made = cut(G.measures(edges).withColumn("centrality", F.round("centrality", 9)), "measures")
    files = _files(spark, d)
    return A.facts(files, A.fuse_layers(files), made.select("id", "in_degree", "out_degree"), made.select("id", "centrality"), made.select("id", "scc_size"))


_FACTS = "id, role, centrality, in_degree, out_degree"


@query("role_fusion", sql(f"{_ROLES} SELECT {_FACTS} FROM facts", "files", "refs"))
def role_fusion(spark, d):
    return _facts(spark, d).select(*_FACTS.split(", "))


# References of full confidence only: a sparse graph, in which every role occurs.
@query("role_fusion_sure", sql(f"{_SURE} SELECT {_FACTS} FROM facts", "files", "refs"))
def role_fusion_sure(spark, d):
    return _facts(spark, d, 1.0).select(*_FACTS.split(", "))


@query("role_histogram", sql(f"{_ROLES} SELECT role, count(*) AS n FROM facts GROUP BY 1", "files", "refs"))
def role_histogram(spark, d):
    return A.histogram(_facts(spark, d), "role")


@query("where_summary", sql(f"{_ROLES}, {_LAYERS} SELECT path, layer, layer_conf, role, centrality, in_degree, out_degree FROM facts JOIN layers USING (id) WHERE id = 7", "files", "refs"))
def where_summary(spark, d):
    return _facts(spark, d).where("id = 7").drop("id")


_MEMBERS = "members AS (SELECT id, id % 12 AS module_id, path, CAST(id % 17 AS DOUBLE) / 16 AS centrality, lang_family AS layer FROM files)"


def _members(spark, d):
    return view(spark, d, "files").select("id", (F.col("id") % 12).alias("module_id"), "path", ((F.col("id") % 17).cast("double") / 16).alias("centrality"), F.col("lang_family").alias("layer"))


@query(
    "arch_modules",
    sql(
        f"WITH {_MEMBERS}, l AS (SELECT module_id, layer, count(*) AS n FROM members GROUP BY 1, 2), d AS (SELECT *, sum(n) OVER (PARTITION BY module_id) AS file_count, row_number() OVER (PARTITION BY module_id ORDER BY n DESC, layer) AS k FROM l), c AS (SELECT module_id, path, row_number() OVER (PARTITION BY module_id ORDER BY centrality DESC, path) AS k FROM members) SELECT d.module_id, CAST(file_count AS BIGINT) AS file_count, layer AS dominant_layer, path AS centroid_path FROM d JOIN c ON c.module_id = d.module_id AND c.k = 1 WHERE d.k = 1",
        "files",
    ),
)
def arch_modules(spark, d):
    return A.modules(_members(spark, d))


def _segment(path: str) -> str:
    boring = ", ".join(f"'{b}'" for b in BORING)
    return f"list_filter(string_split(regexp_extract({path}, '^(.*/)', 1), '/'), lambda s: s <> '' AND s NOT IN ({boring}))[1]"


_LABELS = f"""WITH {_MEMBERS}, named AS (SELECT *, {_segment('path')} AS segment FROM members),
spans AS (SELECT module_id, min(path) AS lo, max(path) AS hi, count(*) AS file_count, count(segment) AS known, sum(centrality) FILTER (segment IS NOT NULL) AS mass, max(centrality) FILTER (segment IS NOT NULL) AS peak FROM named GROUP BY 1),
shared AS (SELECT *, lo[1:coalesce(list_sum([CASE WHEN lo[1:i] = hi[1:i] THEN 1 ELSE 0 END FOR i IN range(1, least(length(lo), length(hi)) + 1)]), 0)] AS common FROM spans),
segs AS (SELECT module_id, segment, count(*) AS n, sum(centrality) AS m FROM named WHERE segment IS NOT NULL GROUP BY 1, 2),
heavy AS (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY m DESC, segment) AS by_mass, row_number() OVER (PARTITION BY module_id ORDER BY n DESC, segment) AS by_count FROM segs),
peaks AS (SELECT module_id, count(*) AS at_peak, min(segment) AS peak_segment FROM named JOIN spans USING (module_id) WHERE segment IS NOT NULL AND centrality = peak GROUP BY 1),
labelled AS (SELECT s.module_id, file_count, coalesce({_segment('common')}, CASE WHEN known < 8 AND at_peak = 1 AND peak > 0 THEN peak_segment END, CASE WHEN mass > 0 AND a.m * 2 > mass THEN a.segment END, CASE WHEN b.n * 2 > known THEN b.segment END, concat(CASE WHEN known > 0 THEN 'cluster-' ELSE 'unlabelled-' END, s.module_id)) AS label
    FROM shared s LEFT JOIN heavy a ON a.module_id = s.module_id AND a.by_mass = 1 LEFT JOIN heavy b ON b.module_id = s.module_id AND b.by_count = 1 LEFT JOIN peaks p ON p.module_id = s.module_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY file_count DESC, module_id) AS nth FROM labelled)
SELECT module_id, file_count, CASE WHEN nth = 1 THEN label ELSE concat(label, '-', module_id) END AS label FROM numbered"""


@query("module_labels", sql(_LABELS, "files"))
def module_labels(spark, d):
    return A.labels(_members(spark, d))


_ARCH_MAP = f"{_ROLES}, {_LAYERS} SELECT 'layer' AS section, layer AS item, CAST(count(*) AS DOUBLE) AS value FROM layers GROUP BY layer UNION ALL SELECT 'role', role, CAST(count(*) AS DOUBLE) FROM facts GROUP BY role UNION ALL SELECT * FROM (SELECT 'central', path, centrality FROM facts WHERE centrality > 0 ORDER BY centrality DESC, path LIMIT 10) UNION ALL SELECT 'files', 'all', CAST(count(*) AS DOUBLE) FROM files"


@query("arch_map", sql(_ARCH_MAP, "files", "refs"))
def arch_map(spark, d):
    return C.arch_map(_facts(spark, d))


_CALLERS = """s AS (SELECT id, file_id, name, CASE WHEN id % 7 = 6 THEN 'interface' ELSE kind END AS kind, CAST(id % 400 AS INT) AS line FROM symbols), r AS (SELECT r.id, s.file_id AS source_file_id, t.name, CASE WHEN r.id % 3 > 0 THEN t.file_id END AS target_file_id, r.confidence, CASE WHEN r.id % 5 = 4 THEN 'field_access' ELSE r.kind END AS kind FROM refs r JOIN symbols s ON s.id = r.source_file_id JOIN symbols t ON t.id = r.target_file_id)"""
_USES = f"""{_CALLERS}, uses AS (SELECT s.id AS symbol_id, s.file_id, s.name, s.kind, s.line, r.source_file_id, r.confidence, regexp_matches(lower(f.path), '_test\\.|/tests?/|\\.test\\.|\\.spec\\.') AS test
    FROM s JOIN r ON r.name = s.name AND (r.target_file_id = s.file_id OR r.target_file_id IS NULL) AND r.source_file_id <> s.file_id JOIN code_paths f ON f.id = r.source_file_id
    WHERE s.kind IN ('function', 'method', 'struct', 'class', 'interface', 'type') AND r.kind IN ('call', 'field_access', 'type_ref')),
busy AS (SELECT file_id FROM s GROUP BY file_id ORDER BY count(*) DESC, file_id LIMIT 1)"""
#: Files of tests lie below test folders.
_PATHS = "code_paths AS (SELECT id, concat('repo/', path) AS path FROM code_files)"


def _symbol_refs(spark, d):
    refs, symbols = view(spark, d, "refs"), view(spark, d, "symbols")
    source = symbols.select(F.col("id").alias("source_file_id"), F.col("file_id").alias("from_file"))
    target = symbols.select(F.col("id").alias("target_file_id"), F.col("file_id").alias("to_file"), F.col("name"))
    joined = refs.drop("target_name").join(source, "source_file_id").join(target, "target_file_id")
    kind = F.when(F.col("id") % 5 == 4, F.lit("field_access")).otherwise(F.col("kind")).alias("kind")
    return joined.select("id", F.col("from_file").alias("source_file_id"), "name", F.when(F.col("id") % 3 > 0, F.col("to_file")).alias("target_file_id"), "confidence", kind)


def _code(spark, d):
    """Symbols with lines and an interface among seven, references to them, and files."""
    kind = F.when(F.col("id") % 7 == 6, F.lit("interface")).otherwise(F.col("kind")).alias("kind")
    symbols = view(spark, d, "symbols").select("id", "file_id", "name", kind, (F.col("id") % 400).cast("int").alias("line"))
    return symbols, _symbol_refs(spark, d), view(spark, d, "code_files").select("id", F.concat(F.lit("repo/"), "path").alias("path"))


@query("file_context_callers", sql(f"WITH {_PATHS}, {_USES} SELECT name, kind, line, count(*) FILTER (confidence >= 0.7) AS confident, count(*) FILTER (confidence < 0.7) AS possible, count(DISTINCT source_file_id) AS files FROM uses WHERE file_id = (SELECT file_id FROM busy) GROUP BY symbol_id, name, kind, line", "code_files", "refs", "symbols"))
def file_context_callers(spark, d):
    symbols, refs, files = _code(spark, d)
    busy = symbols.groupBy("file_id").count().orderBy(F.desc("count"), "file_id").first().file_id
    return C.external_callers(symbols, refs, files, busy)


@query("file_context_deps", sql(f"WITH {_CALLERS} SELECT DISTINCT name, target_file_id, kind FROM r WHERE source_file_id = (SELECT min(file_id) FROM s) ORDER BY name, target_file_id NULLS LAST, kind LIMIT 20", "refs", "symbols"))
def file_context_deps(spark, d):
    symbols = view(spark, d, "symbols")
    return C.dependencies(_symbol_refs(spark, d), symbols.agg(F.min("file_id")).first()[0])


@query("contracts", sql(f"WITH {_PATHS}, {_USES} SELECT file_id, name, kind, count(*) FILTER (confidence >= 0.7 AND NOT test) AS prod, count(*) FILTER (confidence >= 0.7 AND test) AS tests, count(DISTINCT symbol_id) AS impls, min(line) AS first_line FROM uses GROUP BY 1, 2, 3", "code_files", "refs", "symbols"))
def contracts(spark, d):
    return C.contracts(*_code(spark, d))
