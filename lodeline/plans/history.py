"""History queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.catalog import query
from lodeline.operators import history as H
from lodeline.views import sql, view

_PAIRS = """pairs AS (
    SELECT a.file_path AS file_a, b.file_path AS file_b, count(DISTINCT a.commit_id) AS co FROM commit_dirs a JOIN commit_dirs b ON a.commit_id = b.commit_id AND a.file_path < b.file_path
    WHERE a.commit_id IN (SELECT commit_id FROM commit_dirs GROUP BY commit_id HAVING count(*) <= 50) AND (SELECT count(*) FROM orders) >= 50
    GROUP BY 1, 2 HAVING count(DISTINCT a.commit_id) >= 4),
totals AS (SELECT file_path, count(DISTINCT commit_id) AS n FROM commit_dirs GROUP BY 1),
coupling AS (SELECT file_a, file_b, CAST(co AS BIGINT) AS co_changes, CAST(t.n AS BIGINT) AS total_changes, round(CAST(co AS DOUBLE) / greatest(1, least(t.n, u.n)), 9) AS score
    FROM pairs JOIN totals t ON t.file_path = file_a JOIN totals u ON u.file_path = file_b)"""
_FILE = "brand_1/economy"
_BOTH = f"SELECT file_b AS other, score FROM coupling WHERE file_a = '{_FILE}' UNION ALL SELECT file_a, score FROM coupling WHERE file_b = '{_FILE}'"


def _coupling(spark, d):
    return H.coupling(view(spark, d, "commits"), view(spark, d, "commit_dirs"))


@query("change_coupling", sql(f"WITH {_PAIRS} SELECT * FROM coupling", "commit_dirs"))
def change_coupling(spark, d):
    return _coupling(spark, d)


@query("top_coupled", sql(f"WITH {_PAIRS} SELECT file_a, file_b, co_changes, score FROM coupling ORDER BY score DESC, file_a, file_b LIMIT 20", "commit_dirs"))
def top_coupled(spark, d):
    return H.top(_coupling(spark, d), 20, F.desc("score"), "file_a", "file_b").drop("total_changes")


@query("coupling_for_file_union_all", sql(f"WITH {_PAIRS} SELECT * FROM ({_BOTH}) ORDER BY score DESC, other LIMIT 10", "commit_dirs"))
def coupling_all(spark, d):
    return H.coupled_with(_coupling(spark, d), _FILE, 10)


@query("coupling_for_file_union", sql(f"WITH {_PAIRS} SELECT * FROM (SELECT DISTINCT * FROM ({_BOTH})) ORDER BY score DESC, other LIMIT 5", "commit_dirs"))
def coupling_distinct(spark, d):
    return H.coupled_with(_coupling(spark, d), _FILE, 5, distinct=True)


@query("coupling_annotation", sql(f"WITH {_PAIRS.replace('commit_dirs', 'commit_packages')} SELECT file_b, score, concat(CAST(CAST(round(score * 100) AS BIGINT) AS VARCHAR), '%') AS shown FROM coupling WHERE file_a = 'economy' AND score > 0.3 ORDER BY score DESC, file_b LIMIT 3", "commit_packages"))
def coupling_annotation(spark, d):
    pairs = H.coupling(view(spark, d, "commits"), view(spark, d, "commit_packages"))
    own = pairs.where((F.col("file_a") == "economy") & (F.col("score") > 0.3))
    return H.top(own, 3, F.desc("score"), "file_b").select("file_b", "score", F.concat(F.round(F.col("score") * 100).cast("long").cast("string"), F.lit("%")).alias("shown"))


_METRICS = """touched AS (SELECT cf.file_id, cf.commit_id, c.author, CAST(epoch(c.at) AS BIGINT) AS ts FROM commit_files cf JOIN commits c ON c.id = cf.commit_id),
now AS (SELECT CAST(epoch(max(o_orderdate)) AS BIGINT) + 86400 AS t FROM orders),
per_file AS (SELECT file_id, count(DISTINCT CASE WHEN ts > t - 30 * 86400 THEN commit_id END) AS d30, count(DISTINCT CASE WHEN ts > t - 90 * 86400 THEN commit_id END) AS d90, max(ts) AS last_ts, count(DISTINCT author) AS authors FROM touched, now GROUP BY file_id),
measured AS (SELECT f.id AS file_id, CAST(f.lines AS DOUBLE) AS cyclomatic, coalesce(d30, 0) AS changes_30d, coalesce(d90, 0) AS changes_90d, last_ts AS last_changed_ts, coalesce(authors, 0) AS unique_authors,
    CASE WHEN coalesce(d30, 0) > 0 THEN d30 * CAST(f.lines AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS hotspot_score FROM files f LEFT JOIN per_file p ON p.file_id = f.id)"""


def _metrics(spark, d):
    commits = view(spark, d, "commits")
    # One number: a day after the last commit.
    as_of = F.lit(commits.agg(F.max(F.unix_seconds("at"))).first()[0]) + H.DAY
    base = view(spark, d, "files").select(F.col("id").alias("file_id"), F.col("lines").cast("double").alias("cyclomatic"))
    return H.metrics(base, commits, view(spark, d, "commit_files"), as_of)


@query("file_metrics", sql(f"WITH {_METRICS} SELECT * FROM measured", "files", "commits", "commit_files"))
def file_metrics(spark, d):
    return _metrics(spark, d)


@query("top_hotspots", sql(f"WITH {_METRICS} SELECT * FROM measured WHERE hotspot_score > 0 ORDER BY hotspot_score DESC, file_id LIMIT 15", "files", "commits", "commit_files"))
def top_hotspots(spark, d):
    return H.hotspots(_metrics(spark, d), 15)


@query("churn_rate", sql("SELECT f.id AS file_id, round(CAST(coalesce(n, 0) AS DOUBLE) / greatest(f.size, 1), 9) AS churn_rate FROM files f LEFT JOIN (SELECT file_id, CAST(sum(added + deleted) AS BIGINT) AS n FROM commit_files GROUP BY 1) c ON c.file_id = f.id", "files", "commit_files"))
def churn_rate(spark, d):
    return H.churn(view(spark, d, "commit_files"), view(spark, d, "files"))


@query("evolution_summary", sql("SELECT cf.file_id, count(DISTINCT cf.commit_id) AS total_changes, count(DISTINCT c.author) AS unique_authors FROM commit_files cf JOIN commits c ON c.id = cf.commit_id GROUP BY 1", "commits", "commit_files"))
def evolution_summary(spark, d):
    return H.change_counts(view(spark, d, "commits"), view(spark, d, "commit_files"))


@query("evolution_trace", sql("SELECT c.id, c.author, CAST(epoch(c.at) AS BIGINT) AS ts, c.message, cf.added, cf.deleted FROM commits c JOIN commit_files cf ON cf.commit_id = c.id WHERE cf.file_id = 7 ORDER BY c.at DESC, c.id LIMIT 30", "commits", "commit_files"))
def evolution_trace(spark, d):
    return H.evolution(view(spark, d, "commits"), view(spark, d, "commit_files"), 7)


_MAP = f"""{_METRICS}, {_PAIRS}
SELECT 'hotspot' AS section, CAST(file_id AS VARCHAR) AS item, hotspot_score AS score FROM (SELECT * FROM measured WHERE hotspot_score > 0 ORDER BY hotspot_score DESC, file_id LIMIT 15)
UNION ALL SELECT 'coupling', concat(file_a, ' ', file_b), score FROM (SELECT * FROM coupling ORDER BY score DESC, file_a, file_b LIMIT 15)
UNION ALL SELECT 'count', 'files', CAST(count(*) AS DOUBLE) FROM files UNION ALL SELECT 'count', 'commits', CAST(count(*) AS DOUBLE) FROM commits UNION ALL SELECT 'count', 'couplings', CAST(count(*) AS DOUBLE) FROM coupling"""


@query("code_map", sql(f"WITH {_MAP}", "files", "commits", "commit_files", "commit_dirs"))
def code_map(spark, d):
    pairs, files, commits = _coupling(spark, d), view(spark, d, "files"), view(spark, d, "commits")
    hot = H.hotspots(_metrics(spark, d), 15).select(F.lit("hotspot").alias("section"), F.col("file_id").cast("string").alias("item"), F.col("hotspot_score").alias("score"))
    near = H.top(pairs, 15, F.desc("score"), "file_a", "file_b").select(F.lit("coupling").alias("section"), F.concat_ws(" ", "file_a", "file_b").alias("item"), "score")
    counts = [t.agg(F.lit("count").alias("section"), F.lit(n).alias("item"), F.count(F.lit(1)).cast("double").alias("score")) for n, t in (("files", files), ("commits", commits), ("couplings", pairs))]
    out = hot.unionByName(near)
    for frame in counts:
        out = out.unionByName(frame)
    return out


@query("git_numstat_forward_fill", sql("SELECT commit_id, concat('f', CAST(file_id AS VARCHAR)) AS file_path, added, deleted FROM commit_files cf JOIN commits c ON c.id = cf.commit_id WHERE file_id % 19 <> 0", "commits", "commit_files"))
def git_numstat(spark, d):
    from lodeline.sources.gitlog import parse_numstat

    commits, files = view(spark, d, "commits"), view(spark, d, "commit_files")
    head = commits.select(F.col("id").alias("block"), F.lit(0).cast("long").alias("pos"), F.concat_ws("|", F.lit("@@"), F.col("id").cast("string"), "author", F.unix_seconds("at").cast("string"), "message").alias("line"))
    added = F.when(F.col("file_id") % 19 == 0, F.lit("-")).otherwise(F.col("added").cast("string"))
    body = files.join(commits.select(F.col("id").alias("commit_id")), "commit_id", "left_semi").select(F.col("commit_id").alias("block"), (F.col("file_id") + 1).alias("pos"), F.concat_ws("\t", added, F.col("deleted").cast("string"), F.concat(F.lit("f"), F.col("file_id").cast("string"))).alias("line"))
    parsed = parse_numstat(head.unionByName(body), "block", "pos")
    return parsed.select(F.col("hash").cast("long").alias("commit_id"), "file_path", "added", "deleted")


# One text per 8 commits; each commit's lines go over four blocks of it, so most blocks have no header.
@query("git_log_segmented", sql("SELECT commit_id, concat('f', CAST(file_id AS VARCHAR)) AS file_path, added, deleted FROM commit_files cf JOIN commits c ON c.id = cf.commit_id WHERE file_id % 19 <> 0", "commits", "commit_files"))
def git_log_segmented(spark, d):
    from lodeline.sources.gitlog import parse_numstat

    commits, files = view(spark, d, "commits"), view(spark, d, "commit_files")
    place = lambda commit, pos: (F.floor(commit / 8).alias("file"), (commit * 4 + F.pmod(pos, F.lit(4))).alias("block"), F.floor(pos / 4).alias("pos"))
    head = commits.select(*place(F.col("id"), F.lit(0)), F.concat_ws("|", F.lit("@@"), F.col("id").cast("string"), "author", F.unix_seconds("at").cast("string"), "message").alias("line"))
    added = F.when(F.col("file_id") % 19 == 0, F.lit("-")).otherwise(F.col("added").cast("string"))
    body = files.join(commits.select(F.col("id").alias("commit_id")), "commit_id", "left_semi").select(*place(F.col("commit_id"), F.col("file_id") + 4), F.concat_ws("\t", added, F.col("deleted").cast("string"), F.concat(F.lit("f"), F.col("file_id").cast("string"))).alias("line"))
    parsed = parse_numstat(head.unionByName(body), "block", "pos", group=["file"])
    return parsed.select(F.col("hash").cast("long").alias("commit_id"), "file_path", "added", "deleted")


# One hunk of a file a commit: a..a+b-1 became c..c+d-1; a symbol's range goes back through them.
_HUNKS = """h AS (SELECT file_id, commit_id, row_number() OVER (PARTITION BY file_id ORDER BY commit_id DESC) AS step, CAST(b AS INT) AS b, CAST(d AS INT) AS d, CAST(c AS INT) AS c, CAST(c + CASE WHEN d = 0 THEN 1 ELSE 0 END - CASE WHEN b = 0 THEN 1 ELSE 0 END AS INT) AS a
    FROM (SELECT file_id, commit_id, commit_id % 4 AS b, (commit_id // 4) % 4 AS d, 1 + (commit_id * 7 + file_id) % 120 AS c FROM commit_files) WHERE b + d > 0)"""
_BACK = f"""RECURSIVE WITH {_HUNKS},
moved AS (
    SELECT id AS file_id, CAST(1 AS BIGINT) AS step, CAST(10 + id % 40 AS INT) AS lo, CAST(10 + id % 40 + lines AS INT) AS hi FROM files
    UNION ALL
    SELECT file_id, step + 1, lo, hi FROM (
        SELECT m.file_id, m.step,
            CASE WHEN d > 0 AND c <= lo AND c + d - 1 >= lo THEN CASE WHEN b > 0 THEN a ELSE a + 1 END ELSE lo + CASE WHEN CASE WHEN d > 0 THEN c + d - 1 < lo ELSE c < lo END THEN b - d ELSE 0 END END AS lo,
            CASE WHEN d > 0 AND c <= hi AND c + d - 1 >= hi THEN CASE WHEN b > 0 THEN a + b - 1 ELSE a END ELSE hi + CASE WHEN CASE WHEN d > 0 THEN c + d - 1 < hi ELSE c < hi END THEN b - d ELSE 0 END END AS hi
        FROM moved m JOIN h ON h.file_id = m.file_id AND h.step = m.step) WHERE lo <= hi)
SELECT file_id, commit_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY commit_id DESC) AS INT) AS nth FROM moved JOIN h USING (file_id, step)
WHERE CASE WHEN d > 0 THEN c <= hi AND c + d - 1 >= lo ELSE c >= lo AND c < hi END"""


@query("symbol_history", sql(_BACK, "files", "commit_files"))
def symbol_history(spark, d):
    files = view(spark, d, "files").select(F.col("id").alias("symbol_id"), F.col("id").cast("string").alias("file_path"), (10 + F.col("id") % 40).alias("first"), (10 + F.col("id") % 40 + F.col("lines")).alias("last"))
    commit, file = F.col("commit_id"), F.col("file_id")
    old, new, start = (commit % 4).cast("int"), (F.floor(commit / 4) % 4).cast("int"), (1 + (commit * 7 + file) % 120).cast("int")
    parts = view(spark, d, "commit_files").select(file.cast("string").alias("file_path"), commit.cast("string").alias("hash"), (-commit).alias("pos"), old.alias("old_lines"), new.alias("new_lines"), start.alias("new_start"))
    hunks = parts.where("old_lines + new_lines > 0").withColumn("old_start", F.expr("new_start + if(new_lines = 0, 1, 0) - if(old_lines = 0, 1, 0)"))
    return H.symbol_trace(files, hunks).select(F.col("symbol_id").alias("file_id"), F.col("hash").cast("long").alias("commit_id"), "nth")


@query("commits_on_indexed_files", sql("SELECT DISTINCT c.id, c.author FROM commits c JOIN commit_files cf ON cf.commit_id = c.id JOIN files f ON f.id = cf.file_id WHERE f.lang_family <> ''", "commits", "commit_files", "files"))
def commits_on_indexed(spark, d):
    indexed = view(spark, d, "files").where("lang_family <> ''").select(F.col("id").alias("file_id"))
    kept = view(spark, d, "commit_files").join(indexed, "file_id", "left_semi").select(F.col("commit_id").alias("id"))
    return view(spark, d, "commits").select("id", "author").join(kept, "id", "left_semi")


@query("last_touched_days", sql("WITH m AS (SELECT max(commits.at) AS t FROM commits) SELECT cf.file_id, greatest(0, (CAST(epoch(m.t) AS BIGINT) - max(CAST(epoch(c.at) AS BIGINT))) // 86400) AS days FROM commits c JOIN commit_files cf ON cf.commit_id = c.id, m GROUP BY cf.file_id, m.t", "commits", "commit_files"))
def last_touched(spark, d):
    commits = view(spark, d, "commits").select(F.col("id").alias("commit_id"), F.unix_seconds("at").alias("ts"))
    latest = F.broadcast(commits.agg(F.max("ts").alias("now")))
    last = view(spark, d, "commit_files").join(commits, "commit_id").groupBy("file_id").agg(F.max("ts").alias("ts"))
    return last.join(latest).select("file_id", F.greatest(F.lit(0), F.floor((F.col("now") - F.col("ts")) / 86400)).cast("long").alias("days"))
