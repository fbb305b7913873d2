"""Resolution queries over the driver tables: each tier alone, the cascade, barrels, modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.catalog import query
from lodeline.operators import resolve as R
from lodeline.tables import cut, in_place
from lodeline.views import pairs, sql, view

_TS = ", ".join(f"'{n}'" for n in R.TS_BUILTINS)
_RUST = ", ".join(f"'{n}'" for n in R.RUST_BUILTINS)
_GUARD = f"NOT (r.family = 'ts' AND r.target_name IN ({_TS})) AND NOT (r.family = 'rust' AND (r.target_name IN ({_RUST}) OR coalesce(r.target_qualifier, '') IN ({_RUST})))"
_SELF = "(r.target_qualifier IN ('this', 'self', 'cls', 'super') OR r.target_qualifier LIKE 'super(%')"
_PROD = "NOT regexp_matches(lower(path), '_test\\.|\\.test\\.|\\.spec\\.|(^|/)(test|tests|__tests__|playground)/') AND NOT regexp_matches(lower(path), '(^|/)(docs_src|docs|examples|tutorials?)/')"
# The conditions as correlated subqueries, the way a row store would run them.
_BASE = f"""r AS MATERIALIZED (SELECT q.*, f.dir AS source_dir, f.lang_family AS family FROM raw_refs q JOIN code_files f ON f.id = q.source_file_id WHERE q.kind NOT IN ('import', 'import_binding')),
s AS MATERIALIZED (SELECT s.*, f.path, f.dir, f.lang_family AS family FROM symbols s JOIN code_files f ON f.id = s.file_id), prod AS MATERIALIZED (SELECT * FROM s WHERE {_PROD}),
b AS MATERIALIZED (SELECT source_file_id, target_name, min(target_file_id) AS target_file_id FROM bindings WHERE target_file_id IS NOT NULL GROUP BY 1, 2),
own AS MATERIALIZED (SELECT file_id, name, min(id) AS id FROM s GROUP BY 1, 2)"""
_IN_FILE = "EXISTS (SELECT 1 FROM own o WHERE o.file_id = r.source_file_id AND o.name = r.target_name)"
_NOT_OWN = f"NOT (coalesce({_SELF}, false) AND {_IN_FILE})"


def _tier(name: str, symbol: str, file: str, body: str) -> str:
    order, confidence = R.TIERS[name]
    return f"SELECT r.id AS ref_id, {order} AS tier, CAST({symbol} AS BIGINT) AS symbol_id, CAST({file} AS BIGINT) AS file_id, CAST({confidence} AS DOUBLE) AS confidence FROM {body}"


def _uniq(source: str, match: str) -> str:
    return f"JOIN LATERAL (SELECT count(DISTINCT x.file_id) AS n, min(x.id) AS sid, arg_min(x.file_id, x.id) AS fid FROM {source} x WHERE {match}) c ON true"


_SQLS = {
    "l0": _tier("l0", "c.sid", "c.fid", f"r {_uniq('s', 'x.name = r.target_name AND x.scope = r.receiver_type AND x.family = r.family')} WHERE r.receiver_type IS NOT NULL AND c.n = 1 AND {_NOT_OWN}"),
    "l0c": _tier("l0c", "o.id", "o.file_id", f"r JOIN b ON b.source_file_id = r.source_file_id AND b.target_name = r.receiver_type JOIN own o ON o.file_id = b.target_file_id AND o.name = r.target_name WHERE {_NOT_OWN}"),
    "l0d": _tier("l0d", "o.id", "o.file_id", f"r {_uniq('s', 'x.name = r.receiver_type AND x.family = r.family AND x.kind IN (' + chr(39) + 'class' + chr(39) + ', ' + chr(39) + 'struct' + chr(39) + ', ' + chr(39) + 'interface' + chr(39) + ', ' + chr(39) + 'enum' + chr(39) + ')')} JOIN own o ON o.file_id = c.fid AND o.name = r.target_name WHERE c.n = 1 AND {_NOT_OWN}"),
    "l0b": _tier("l0b", "o.id", "b.target_file_id", "r JOIN b ON b.source_file_id = r.source_file_id AND b.target_name = r.target_name LEFT JOIN own o ON o.file_id = b.target_file_id AND o.name = r.target_name WHERE r.target_qualifier IS NULL"),
    "l1": _tier("l1", "o.id", "o.file_id", f"r JOIN own o ON o.file_id = r.source_file_id AND o.name = r.target_name WHERE (r.receiver_type IS NULL AND r.target_qualifier IS NULL) OR {_SELF}"),
    "l2": _tier("l2", "c.sid", "c.fid", f"r {_uniq('s', 'x.name = r.target_name AND x.dir = r.source_dir AND x.family = r.family AND x.file_id <> r.source_file_id')} WHERE c.n = 1 AND r.receiver_type IS NULL AND {_GUARD} AND (r.target_qualifier IS NULL OR r.family <> 'rust') AND NOT (r.target_qualifier IS NOT NULL AND {_IN_FILE})"),
    "l3": _tier("l3", "c.sid", "c.fid", f"r {_uniq('s', 'x.name = r.target_name AND x.family = r.family AND (x.dir LIKE ' + chr(39) + '%/' + chr(39) + ' || r.target_qualifier || ' + chr(39) + '/' + chr(39) + ' OR x.dir = r.target_qualifier || ' + chr(39) + '/' + chr(39) + ' OR regexp_extract(x.path, ' + chr(39) + '([^/.]*)[.][^/]*$' + chr(39) + ', 1) = r.target_qualifier)')} WHERE c.n = 1 AND r.target_qualifier IS NOT NULL AND EXISTS (SELECT 1 FROM raw_refs i WHERE i.source_file_id = r.source_file_id AND i.kind = 'import' AND (i.target_name = r.target_qualifier OR i.target_name LIKE '%/' || r.target_qualifier OR i.target_name LIKE '%.' || r.target_qualifier))"),
    "l4": _tier("l4", "c.sid", "c.fid", f"r {_uniq('prod', 'x.name = r.target_name AND x.family = r.family')} WHERE c.n = 1 AND r.receiver_type IS NULL AND {_GUARD} AND (r.target_qualifier IS NULL OR EXISTS (SELECT 1 FROM prod p WHERE p.name = r.target_name AND p.family = r.family AND (p.scope IS NOT NULL OR p.kind = 'method')))"),
    "l4a": _tier("l4a", "o.id", "o.file_id", "r JOIN own o ON o.file_id = r.source_file_id AND o.name = r.target_name"),
    "l4b": _tier("l4b", "c.sid", "c.fid", f"r {_uniq('prod', 'x.name = r.target_name AND x.dir = r.source_dir AND x.family = r.family AND x.file_id <> r.source_file_id')} WHERE c.n > 0 AND {_GUARD}"),
    "l5": _tier("l5", "c.sid", "c.fid", f"r {_uniq('prod', 'x.name = r.target_name AND x.family = r.family')} WHERE c.n > 0 AND {_GUARD}"),
}
_VIEWS = ("raw_refs", "symbols", "code_files", "bindings")


def _tables(spark, d):
    return (view(spark, d, n) for n in ("raw_refs", "code_files", "symbols", "bindings"))


for _name in _SQLS:

    @query(f"resolve_{_name}", sql(f"WITH {_BASE} {_SQLS[_name]}", *_VIEWS))
    def resolve_tier(spark, d, name=_name):
        return R.tiers(*_tables(spark, d), names=[name])[name]


# Every way up the bases, with its place in the walk's order; the first that has the name counts.
_MRO = """py AS MATERIALIZED (SELECT id AS file_id, string_split(path, '/') AS parts, length(path) AS chars FROM code_files WHERE lang_family = 'python'),
cls AS MATERIALIZED (SELECT s.name AS base, s.file_id AS g, min(s.id) AS cid, any_value(chars) AS chars FROM symbols s JOIN py USING (file_id) WHERE kind = 'class' GROUP BY 1, 2),
typed AS MATERIALIZED (SELECT q.id, q.source_file_id AS f, q.receiver_type AS c, q.target_name FROM raw_refs q JOIN py ON py.file_id = q.source_file_id WHERE q.kind = 'call' AND q.receiver_type IS NOT NULL),
far AS MATERIALIZED (SELECT a.file_id AS f, b.file_id AS g, len(a.parts) + len(b.parts) - 2 * len(list_filter(range(1, least(len(a.parts), len(b.parts)) + 1), lambda i: a.parts[1:i] = b.parts[1:i])) AS d FROM py a, py b),
up AS MATERIALIZED (SELECT source_file_id AS g, source_symbol AS base, target_name AS above, min(id) AS nth FROM inherits GROUP BY 1, 2, 3),
walk AS (SELECT f, c, above AS base, 1 AS level, CAST([d, chars, cid, nth] AS BIGINT[]) AS key, CAST([] AS VARCHAR[]) AS names FROM (SELECT DISTINCT f, c FROM typed) JOIN cls ON cls.base = c JOIN far USING (f, g) JOIN up ON up.g = cls.g AND up.base = c
UNION ALL SELECT k.f, k.c, above, level + 1, list_concat(key, CAST([-d, -chars, -cid, nth] AS BIGINT[])), list_append(names, k.base) FROM walk k JOIN cls ON cls.base = k.base JOIN far ON far.f = k.f AND far.g = cls.g JOIN up ON up.g = cls.g AND up.base = k.base WHERE level < 6 AND above <> k.base AND NOT list_contains(names, above)),
hits AS (SELECT t.id, list_concat(key, CAST([-4611686018427387904, d, chars, cid] AS BIGINT[])) AS key, o.id AS sid, cls.g AS fid FROM typed t JOIN walk k USING (f, c) JOIN cls ON cls.base = k.base JOIN far ON far.f = t.f AND far.g = cls.g JOIN own o ON o.file_id = cls.g AND o.name = t.target_name),
mro AS MATERIALIZED (SELECT id, sid, fid FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY key) AS k FROM hits) WHERE k = 1)"""
_SQLS["l0e"] = _tier("l0e", "mro.sid", "mro.fid", "r JOIN mro USING (id)")
_MRO_VIEWS = (*_VIEWS, "inherits")


@query("resolve_l0e", sql(f"RECURSIVE WITH {_BASE}, {_MRO} {_SQLS['l0e']}", *_MRO_VIEWS))
def resolve_l0e(spark, d):
    refs, files, symbols, bindings = _tables(spark, d)
    return R.tiers(refs, files, symbols, bindings, R.mro(refs, files, symbols, view(spark, d, "inherits")), names=["l0e"])["l0e"]


_ALL = " UNION ALL ".join(f"({q})" for q in _SQLS.values())
_BEST = f"{_BASE}, {_MRO}, every AS ({_ALL}), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY tier, symbol_id NULLS FIRST) AS k FROM every) WHERE k = 1), done AS (SELECT q.id, tier, symbol_id AS target_symbol_id, file_id AS target_file_id, coalesce(confidence, 0) AS confidence FROM raw_refs q LEFT JOIN best ON ref_id = q.id)"


def _resolved(spark, d):
    # As in an index, resolution reads stored tables; references and bindings are columns of one.
    files, symbols = (cut(view(spark, d, n), "resolve") for n in ("code_files", "symbols"))
    # Equal names lie together: so they do in what is shuffled by name, which makes it smaller.
    following = cut(pairs(spark, d, symbols).sortWithinPartitions("t.name", "r.kind", "s.file_id"), "resolve")
    refs, bindings = (view(spark, d, n, following) for n in ("raw_refs", "bindings"))
    return R.settled(refs, files, symbols, bindings, R.mro(refs, files, symbols, cut(view(spark, d, "inherits"), "resolve")))


@query("resolve_cascade", sql(f"RECURSIVE WITH {_BEST} SELECT * FROM done", *_MRO_VIEWS))
def resolve_cascade(spark, d):
    with in_place(spark):
        return cut(_resolved(spark, d).select("id", "tier", "target_symbol_id", "target_file_id", "confidence"), "cascade")


@query("tier_histogram", sql(f"RECURSIVE WITH {_BEST} SELECT tier, confidence, count(*) AS n FROM done GROUP BY 1, 2", *_MRO_VIEWS))
def tier_histogram(spark, d):
    with in_place(spark):
        return cut(_resolved(spark, d).groupBy("tier", "confidence").agg(F.count(F.lit(1)).alias("n")), "tiers")


def _barrel_sql(hops: int) -> str:
    parts = ["own AS (SELECT DISTINCT file_id, name FROM symbols)", "onward AS (SELECT source_file_id AS f, target_name AS n, min(target_file_id) AS nxt FROM hop WHERE target_file_id IS NOT NULL GROUP BY 1, 2)", "h0 AS (SELECT * FROM hop)"]
    for i in range(1, hops + 1):
        parts.append(f"h{i} AS MATERIALIZED (SELECT h.id, h.source_file_id, h.target_name, CASE WHEN o.name IS NULL AND w.nxt IS NOT NULL AND w.nxt <> h.target_file_id THEN w.nxt ELSE h.target_file_id END AS target_file_id FROM h{i - 1} h LEFT JOIN own o ON o.file_id = h.target_file_id AND o.name = h.target_name LEFT JOIN onward w ON w.f = h.target_file_id AND w.n = h.target_name)")
    return ", ".join(parts)


# Bindings that point to other files' bindings: every target is moved to the file 40 numbers on.
_HOP = "hop AS (SELECT id, source_file_id, target_name, CASE WHEN id % 4 > 0 THEN (SELECT min(file_id) FROM symbols) + (target_file_id * 7) % 190 ELSE target_file_id END AS target_file_id FROM bindings)"


@query("barrel_chase", sql(f"WITH {_HOP}, {_barrel_sql(5)} SELECT * FROM h5", "bindings", "symbols"))
def barrel_chase(spark, d):
    symbols = view(spark, d, "symbols")
    base = symbols.agg(F.min("file_id")).first()[0]
    hop = view(spark, d, "bindings").withColumn("target_file_id", F.when(F.col("id") % 4 > 0, F.lit(base) + (F.col("target_file_id") * 7) % 190).otherwise(F.col("target_file_id")))
    return R.chase_barrels(hop.select("id", "source_file_id", "target_name", "target_file_id"), symbols)


@query("unique_suffix_match", sql("SELECT suffix, min(id) AS file_id FROM (SELECT id, unnest([array_to_string(list_slice(p, i, len(p)), '/') FOR i IN range(1, len(p) + 1)]) AS suffix FROM (SELECT id, string_split(path, '/') AS p FROM code_files)) GROUP BY suffix HAVING count(*) = 1", "code_files"))
def unique_suffix_match(spark, d):
    return R.suffixes(view(spark, d, "code_files"))


@query("module_probe", sql("WITH w AS (SELECT id, concat('brand_', id % 25 + 1, '/', CASE WHEN id % 2 = 0 THEN 'promo' ELSE 'small' END) AS base FROM files), c AS (SELECT w.id, nth, base || tail AS path FROM w, (SELECT unnest(['.py', '.pyi', '/__init__.py', '/__init__.pyi']) AS tail, unnest([0, 1, 2, 3]) AS nth)), e AS (SELECT c.id, arg_min(f.id, nth) AS target_file_id FROM c JOIN code_files f USING (path) GROUP BY c.id), u AS (SELECT suffix, min(id) AS file_id FROM (SELECT id, unnest([array_to_string(list_slice(p, i, len(p)), '/') FOR i IN range(1, len(p) + 1)]) AS suffix FROM (SELECT id, string_split(path, '/') AS p FROM code_files)) GROUP BY suffix HAVING count(*) = 1) SELECT * FROM e UNION ALL SELECT c.id, arg_min(u.file_id, nth) FROM c JOIN u ON u.suffix = c.path WHERE c.id NOT IN (SELECT id FROM e) GROUP BY c.id", "files", "code_files"))
def module_probe(spark, d):
    module = F.concat(F.lit("brand_"), (F.col("id") % 25 + 1).cast("string"), F.when(F.col("id") % 2 == 0, F.lit(".promo")).otherwise(F.lit(".small")))
    return R.resolve_modules(view(spark, d, "files").select("id", module.alias("m")), view(spark, d, "code_files"), R.python_candidates(F.col("m")))


# Each top-level folder is a crate of one workspace; files name their own crate, another one, or their own folder.
_CRATE_WANTED = "w AS (SELECT id, dir, id % 3 AS how, concat('brand_', id % 25 + 1) AS other, CASE id % 5 WHEN 0 THEN 'promo' WHEN 1 THEN 'small' WHEN 2 THEN 'large' WHEN 3 THEN 'medium' ELSE 'economy' END AS leaf FROM code_files)"


@query(
    "rust_workspace_modules",
    sql(
        f"""WITH {_CRATE_WANTED}, top AS (SELECT DISTINCT dir FROM code_files WHERE regexp_matches(dir, '^brand_[0-9]+/$'))
SELECT w.id, f.id AS target_file_id FROM w JOIN code_files f ON f.path = concat(CASE how WHEN 0 THEN CASE WHEN w.dir IN (SELECT dir FROM top) THEN w.dir ELSE 'no/' END WHEN 1 THEN CASE WHEN other || '/' IN (SELECT dir FROM top) THEN other || '/' ELSE 'no/' END ELSE w.dir END, leaf, '.rs')""",
        "code_files",
    ),
)
def rust_workspace_modules(spark, d):
    from lodeline.operators import crates

    files = view(spark, d, "code_files")
    folders = files.select("dir").distinct().where(F.col("dir").rlike("^brand_[0-9]+/$"))
    member = F.concat(F.lit("[package]\nversion = '1'\nname = '"), F.translate("dir", "_/", "-"), F.lit("'\n"))
    root = spark.createDataFrame([("Cargo.toml", "[workspace]\nmembers = [\n  'brand_*',\n]\n[profile.dev]\n")], "path string, content string")
    manifests = folders.select(F.concat("dir", F.lit("Cargo.toml")).alias("path"), member.alias("content")).unionByName(root)
    leaf = F.get(F.array(*map(F.lit, ("promo", "small", "large", "medium", "economy"))), (F.col("id") % 5).cast("int"))
    head = F.when(F.col("id") % 3 == 0, F.lit("crate")).when(F.col("id") % 3 == 1, F.concat(F.lit("brand_"), (F.col("id") % 25 + 1).cast("string"))).otherwise(F.lit("self"))
    return crates.modules(files.select("id", "dir", F.concat_ws("::", head, leaf).alias("module")), files, manifests)
