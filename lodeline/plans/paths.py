"""Path, index-change and row-level queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.catalog import query
from lodeline.functions import paths as P
from lodeline.functions import scalars as S
from lodeline.operators import incremental as I
from lodeline.views import read, sql, view

_LANG = "CASE regexp_extract(path, '\\.([^.]*)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LANGUAGES.items()) + " END"


@query("language_family", sql(f"SELECT id, {_LANG} AS language, lang_family AS family FROM files", "files"))
def language_family(spark, d):
    lang = P.language(F.col("path"))
    return view(spark, d, "files").select("id", lang.alias("language"), P.family(lang).alias("family"))


@query("dir_of_path", sql("SELECT id, regexp_extract(path, '^(.*/)', 1) AS dir FROM files", "files"))
def dir_of_path(spark, d):
    return view(spark, d, "files").select("id", P.dir_of(F.col("path")).alias("dir"))


@query("canonical_path", sql("SELECT id, path AS canonical FROM files", "files"))
def canonical_path(spark, d):
    raw = F.concat(F.lit("/work/tree\\"), F.translate("path", "/", "\\"))
    return view(spark, d, "files").select("id", P.canonical(raw, "/work/tree").alias("canonical"))


@query(
    "is_test_variants",
    sql(
        """SELECT id, (contains(path, '_test.') OR contains(path, '/test/') OR contains(path, '/tests/') OR contains(path, '.test.') OR contains(path, '.spec.')) AS callers,
    (path ILIKE '%\\_test.%' ESCAPE '\\' OR path ILIKE '%/test/%' OR path ILIKE '%/tests/%' OR path ILIKE '%.test.%' OR path ILIKE '%.spec.%') AS context,
    (path ILIKE '%\\_test.%' ESCAPE '\\' OR path ILIKE '%.test.%' OR path ILIKE '%.spec.%' OR path ILIKE 'test/%' OR path ILIKE '%/test/%' OR path ILIKE 'tests/%' OR path ILIKE '%/tests/%' OR path ILIKE '\\_\\_tests\\_\\_/%' ESCAPE '\\' OR path ILIKE '%/\\_\\_tests\\_\\_/%' ESCAPE '\\' OR path ILIKE 'playground/%' OR path ILIKE '%/playground/%') AS candidate,
    (path ILIKE '%_test.%' OR path ILIKE '%.test.%' OR path ILIKE '%/test%' OR path ILIKE '%/\\_\\_tests\\_\\_/%' ESCAPE '\\') AS fulltext,
    (contains(path, '_test.') OR contains(path, '.test.') OR contains(path, '/test/') OR contains(path, '/__tests__/') OR contains(path, '/tests/')) AS fusion,
    (path ILIKE '%_test.%' OR path ILIKE '%/test/%' OR path ILIKE '%.test.%' OR path ILIKE '%.spec.%') AS metric,
    (lower(path) LIKE '%/tests/%' OR lower(path) LIKE 'tests/%' OR contains(lower(path), '/__tests__/') OR starts_with(lower(path), '__tests__/')) AS entry FROM files""",
        "files",
    ),
)
def is_test_variants(spark, d):
    path = F.col("path")
    return view(spark, d, "files").select("id", *(getattr(P, f"is_test_{n}")(path).alias(n) for n in ("callers", "context", "candidate", "fulltext", "fusion", "metric", "entry")))


@query("is_doc_path", sql("SELECT id, regexp_matches(lower(path), '(^|/)(docs_src|docs|examples|tutorials?)/') AS is_doc FROM files", "files"))
def is_doc_path(spark, d):
    return view(spark, d, "files").select("id", P.is_doc(F.col("path")).alias("is_doc"))


@query("path_distance", sql("SELECT a.id, len(x) + len(y) - 2 * coalesce(list_sum([CASE WHEN list_slice(x, 1, i) = list_slice(y, 1, i) THEN 1 ELSE 0 END FOR i IN range(1, least(len(x), len(y)) + 1)]), 0) AS distance FROM (SELECT id, string_split(path, '/') AS x FROM files) a JOIN (SELECT id, string_split(path, '/') AS y FROM files) b ON b.id = (a.id * 7 + 3) % 200", "files"))
def path_distance(spark, d):
    files = view(spark, d, "files").select("id", "path")
    other = files.select(F.col("id").alias("other"), F.col("path").alias("other_path"))
    pairs = files.withColumn("other", (F.col("id") * 7 + 3) % 200).join(other, "other")
    return pairs.select("id", P.distance(F.col("path"), F.col("other_path")).cast("long").alias("distance"))


@query("normalize_path", sql("SELECT id, concat('lib/', path) AS normal FROM files", "files"))
def normalize_path(spark, d):
    raw = F.concat(F.lit("./src/../lib/x/./../"), F.col("path"))
    return view(spark, d, "files").select("id", P.normalize(raw).alias("normal"))


@query("common_prefix", sql("WITH g AS (SELECT lang_family, min(path) AS lo, max(path) AS hi FROM files GROUP BY 1) SELECT lang_family, regexp_extract(lo[1:coalesce(list_sum([CASE WHEN lo[1:i] = hi[1:i] THEN 1 ELSE 0 END FOR i IN range(1, least(length(lo), length(hi)) + 1)]), 0)], '^(.*/)', 1) AS prefix FROM g", "files"))
def common_prefix(spark, d):
    return view(spark, d, "files").groupBy("lang_family").agg(P.common_prefix(F.min("path"), F.max("path")).alias("prefix"))


@query("module_segment", sql("SELECT id, list_filter(string_split(regexp_extract(path, '^(.*/)', 1), '/'), lambda s: s <> '' AND s NOT IN ('packages', 'crates', 'libs', 'src', 'lib', 'app', 'apps', 'services', 'modules', 'internal'))[1] AS segment FROM files", "files"))
def module_segment(spark, d):
    return view(spark, d, "files").select("id", P.module_segment(F.col("path")).alias("segment"))


_FUZZY = "SELECT id, path FROM files WHERE path = '{0}' OR path LIKE '{0}%' OR path LIKE '%{0}' ORDER BY CASE WHEN path = '{0}' THEN 0 WHEN path LIKE '{0}%' THEN 1 ELSE 2 END, length(path), path LIMIT 1"


@query("fuzzy_file", sql(_FUZZY.format("widget_1.py"), "files"))
def fuzzy_file(spark, d):
    return I.fuzzy(view(spark, d, "files"), "widget_1.py").select("id", "path")


@query("siblings", sql("SELECT path FROM files WHERE regexp_extract(path, '^(.*/)', 1) = (SELECT regexp_extract(path, '^(.*/)', 1) FROM files WHERE id = 7) AND id <> 7 ORDER BY path LIMIT 12", "files"))
def siblings(spark, d):
    files = view(spark, d, "files").withColumn("dir", P.dir_of(F.col("path")))
    own = files.where("id = 7").select(F.col("dir"))
    return files.where("id <> 7").join(own, "dir", "left_semi").orderBy("path").limit(12).select("path")


# Two snapshots: the stored one has other contents for some files, lacks some and has some that are gone.
_SNAPSHOTS = "WITH stored AS (SELECT path, md5(concat(symbol, CASE WHEN id % 7 = 0 THEN 'old' ELSE '' END)) AS hash FROM files WHERE id % 5 <> 0), found AS (SELECT path, md5(symbol) AS hash FROM files WHERE id % 11 <> 0)"


def _snapshots(spark, d):
    files = view(spark, d, "files")
    stored = files.where("id % 5 <> 0").select("path", F.md5(F.concat("symbol", F.when(F.col("id") % 7 == 0, F.lit("old")).otherwise(F.lit("")))).alias("hash"))
    return stored, files.where("id % 11 <> 0").select("path", F.md5("symbol").alias("hash"))


@query("changed_files", sql(f"{_SNAPSHOTS} SELECT path FROM found WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.path = found.path AND s.hash = found.hash)", "files"))
def changed_files(spark, d):
    stored, found = _snapshots(spark, d)
    return I.changed(found, stored).select("path")


@query("deleted_files", sql(f"{_SNAPSHOTS} SELECT path FROM stored WHERE path NOT IN (SELECT path FROM found)", "files"))
def deleted_files(spark, d):
    stored, found = _snapshots(spark, d)
    return I.deleted(found, stored).select("path")


@query("files_since", sql(f"{_SNAPSHOTS} SELECT path, hash FROM found WHERE path IN (SELECT path FROM files WHERE id % 13 = 0)", "files"))
def files_since(spark, d):
    _, found = _snapshots(spark, d)
    return I.restrict(found, view(spark, d, "files").where("id % 13 = 0").select("path"))


@query("upsert_files", sql(f"{_SNAPSHOTS} SELECT path, hash FROM found UNION ALL SELECT path, hash FROM stored WHERE path NOT IN (SELECT path FROM found)", "files"))
def upsert_files(spark, d):
    stored, found = _snapshots(spark, d)
    return I.upsert(stored, found)


@query("index_stats", sql("SELECT 'files' AS item, count(*) AS n FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'refs', count(*) FROM refs UNION ALL SELECT 'commits', count(*) FROM commits UNION ALL SELECT 'chunks', count(*) FROM chunks", "files", "symbols", "refs", "commits", "chunks"))
def index_stats(spark, d):
    return I.stats({n: view(spark, d, n) for n in ("files", "symbols", "refs", "commits", "chunks")})


@query("ignored_paths", sql("SELECT path FROM files WHERE NOT (regexp_matches(path, '^docs/') OR regexp_matches(path, 'promo'))", "files"))
def ignored_paths(spark, d):
    return I.without_ignored(view(spark, d, "files"), ["^docs/", "promo"]).select("path")


# Ignore files of four folders, and what their rules mean, by hand: folder, depth, line, negated, folders only, regex.
_IGNORE = [
    (".gitignore", "# generated\n*_test_*\n*.md\ndocs/brand_2*/\n!src/**/*_9?.md"),
    ("src/.gitignore", "handlers/\nstore/*.c\n!/brand_11/economy/handlers/"),
    ("src/brand_12/.gitignore", "*\n!*/\n!*.rs"),
    ("tests/.gitignore", "!*.md"),
]
_RULES = "(VALUES ('', 0, 1, false, false, '(^|/)[^/]*_test_[^/]*$'), ('', 0, 2, false, false, '(^|/)[^/]*\\.md$'), ('', 0, 3, false, true, '^docs/brand_2[^/]*$'), ('', 0, 4, true, false, '^src/(.*/)?[^/]*_9[^/]\\.md$'), ('src', 1, 0, false, true, '(^|/)handlers$'), ('src', 1, 1, false, false, '^store/[^/]*\\.c$'), ('src', 1, 2, true, true, '^brand_11/economy/handlers$'), ('src/brand_12', 2, 0, false, false, '(^|/)[^/]*$'), ('src/brand_12', 2, 1, true, true, '(^|/)[^/]*$'), ('src/brand_12', 2, 2, true, false, '(^|/)[^/]*\\.rs$'), ('tests', 1, 0, true, false, '(^|/)[^/]*\\.md$')) AS rules(dir, depth, line, negated, folders_only, regex)"


@query(
    "layered_ignores",
    sql(
        f"""WITH parts AS (SELECT path, string_split(path, '/') AS p FROM files),
steps AS (SELECT path, array_to_string(p[1:k], '/') AS step, k < len(p) AS folder, k FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS k FROM parts)),
met AS (SELECT DISTINCT step, folder, depth, line, negated FROM steps JOIN {_RULES} ON (dir = '' OR starts_with(step, dir || '/')) AND (folder OR NOT folders_only) AND regexp_matches(CASE WHEN dir = '' THEN step ELSE substr(step, length(dir) + 2) END, regex)),
last AS (SELECT step, folder, arg_max(negated, depth * 100 + line) AS negated FROM met GROUP BY 1, 2)
SELECT DISTINCT path FROM steps JOIN last USING (step, folder) WHERE NOT negated""",
        "files",
    ),
)
def layered_ignores(spark, d):
    from lodeline.sources import tree

    return tree.ignored(view(spark, d, "files"), tree.rules(spark.createDataFrame(_IGNORE, "path string, text string")))


@query("generated_sniff", "SELECT doc_id AS id, (contains(h, 'DO NOT EDIT') OR contains(h, '@generated') OR contains(h, '<auto-generated') OR contains(h, 'Generated by the protocol buffer compiler')) AS generated FROM (SELECT doc_id, array_to_string(list_slice(string_split(substr(concat(CASE WHEN doc_id % 7 = 0 THEN '// @generated' || chr(10) ELSE '' END, text), 1, 2048), chr(10)), 1, 40), chr(10)) AS h FROM documents)")
def generated_sniff(spark, d):
    marked = F.concat(F.when(F.col("doc_id") % 7 == 0, F.lit("// @generated\n")).otherwise(F.lit("")), F.col("text"))
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), P.is_generated(marked).alias("generated"))


@query("content_hash", "SELECT doc_id AS id, sha256(text) AS hash FROM documents")
def content_hash(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))


@query("chunk_token_counts", "SELECT doc_id AS id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS tokens FROM documents")
def chunk_tokens(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), S.whitespace_tokens(F.col("text")).alias("tokens"))


@query("token_estimate", "SELECT doc_id AS id, CAST((strlen(text) + 3) // 4 AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), S.estimate_tokens(F.col("text")).alias("tokens"))


@query("never_worse", "SELECT doc_id AS id, md5(CASE WHEN (strlen(f) + 3) // 4 >= (strlen(text) + 3) // 4 THEN text ELSE f END) AS chosen FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN text || ' and more' WHEN doc_id % 3 = 1 THEN substr(text, 1, 40) ELSE text END AS f FROM documents)")
def never_worse(spark, d):
    text, k = F.col("text"), F.col("doc_id") % 3
    made = F.when(k == 0, F.concat(text, F.lit(" and more"))).when(k == 1, F.substring(text, 1, 40)).otherwise(text)
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(S.never_worse(text, made)).alias("chosen"))


@query("savings_pct", sql("SELECT id, CASE WHEN raw_tokens = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(raw_tokens - filtered_tokens AS DOUBLE) / raw_tokens * 100, 6) END AS pct FROM tracking", "tracking"))
def savings_pct(spark, d):
    return view(spark, d, "tracking").select("id", F.round(S.savings(F.col("raw_tokens"), F.col("filtered_tokens")), 6).alias("pct"))


@query("fmt_num", sql("SELECT id, CASE WHEN v >= 1000000 THEN printf('%.1fM', v / 1000000.0) WHEN v >= 1000 THEN printf('%.1fK', v / 1000.0) ELSE CAST(v AS VARCHAR) END AS shown FROM (SELECT id, raw_tokens * (id % 400) * 2 + 1 AS v FROM tracking)", "tracking"))
def fmt_num(spark, d):
    return view(spark, d, "tracking").select("id", S.short_number(F.col("raw_tokens") * (F.col("id") % 400) * 2 + 1).alias("shown"))


@query("tool_json_path", "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN concat('a/', event_id) WHEN 1 THEN concat('b/', event_id) WHEN 2 THEN concat('c/', event_id) END AS path FROM events")
def tool_json_path(spark, d):
    n, k = F.col("event_id").cast("string"), F.col("event_id") % 4
    body = F.when(k == 0, F.format_string('{"tool_input":{"file_path":"a/%s"}}', n)).when(k == 1, F.format_string('{"file_path":"b/%s"}', n)).when(k == 2, F.format_string('{"tool_input":{"path":"c/%s"}}', n)).otherwise(F.lit("{}"))
    return read(spark, d, "events").select(F.col("event_id").alias("id"), S.tool_path(body).alias("path"))
