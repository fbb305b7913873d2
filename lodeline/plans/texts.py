"""Text-filter, savings and evaluation queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.catalog import query
from lodeline.functions import scalars as S
from lodeline.operators import evalkit as E
from lodeline.operators import handlers
from lodeline.operators import textfilter as T
from lodeline.views import read, sql, view

_ANSI = "regexp_replace({0}, '\\x1b\\[[0-9;?]*[A-Za-z]', '', 'g')"
# Pages as command output: tags on lines of their own, some coloured.
_PAGES = "pages_text AS (SELECT page_id AS id, concat(chr(27), '[31m', replace(replace(html, '>', '>' || chr(10)), '</', chr(27) || '[0m' || chr(10) || '</')) AS text FROM pages)"


def _pages(spark, d):
    marked = F.replace(F.replace("html", F.lit(">"), F.lit(">\n")), F.lit("</"), F.lit("\x1b[0m\n</"))
    return read(spark, d, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("\x1b[31m"), marked).alias("text"))


@query("strip_ansi", f"WITH {_PAGES} SELECT id, md5({_ANSI.format('text')}) AS plain FROM pages_text")
def strip_ansi(spark, d):
    return _pages(spark, d).select("id", F.md5(S.strip_ansi(F.col("text"))).alias("plain"))


RULE = T.Rule("^show", True, (("href", "link"),), (("<title>Never</title>", "nothing", None),), (r"^\s*$", "^</"), (), 60, 12, 6, 15, "empty")
_LINES = "string_split_regex(regexp_replace({0}, '\\r?\\n$', ''), '\\r?\\n')"
_FILTERED = f"""WITH {_PAGES}, l AS (SELECT id, list_transform(list_filter({_LINES.format("replace(" + _ANSI.format('text') + ", 'href', 'link')")}, lambda x: NOT regexp_matches(x, '^\\s*$') AND NOT starts_with(x, '</')), lambda x: CASE WHEN length(x) > 60 THEN substr(x, 1, 60) || '...' ELSE x END) AS l FROM pages_text),
h AS (SELECT id, CASE WHEN len(l) > 18 THEN l[1:12] || ['... (' || (len(l) - 18) || ' lines skipped)'] || l[len(l) - 5:] ELSE l END AS l FROM l), m AS (SELECT id, CASE WHEN len(l) > 15 THEN l[1:15] || ['... (' || (len(l) - 15) || ' more lines)'] ELSE l END AS l FROM h)
SELECT id, md5(CASE WHEN trim(array_to_string(l, chr(10)), ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty' ELSE array_to_string(l, chr(10)) END) AS output FROM m"""


@query("filter_pipeline", _FILTERED)
def filter_pipeline(spark, d):
    return _pages(spark, d).select("id", F.md5(T.compile_rule(RULE, F.col("text"))).alias("output"))


_DOC_LINES = _LINES.format("text")


@query("head_tail", f"WITH l AS (SELECT doc_id AS id, {_DOC_LINES} AS l FROM documents) SELECT id, md5(array_to_string(CASE WHEN len(l) > 7 THEN l[1:4] || ['... (' || (len(l) - 7) || ' lines skipped)'] || l[len(l) - 2:] ELSE l END, chr(10))) AS output FROM l")
def head_tail(spark, d):
    lines = T.lines_of(F.col("text"))
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(F.array_join(T.head_tail(lines, 4, 3), "\n")).alias("output"))


@query("max_lines", f"WITH l AS (SELECT doc_id AS id, {_DOC_LINES} AS l FROM documents) SELECT id, md5(array_to_string(CASE WHEN len(l) > 5 THEN l[1:5] || ['... (' || (len(l) - 5) || ' more lines)'] ELSE l END, chr(10))) AS output FROM l")
def max_lines(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(F.array_join(T.head_tail(T.lines_of(F.col("text")), 5, None), "\n")).alias("output"))


@query("tail_lines", f"WITH l AS (SELECT doc_id AS id, {_DOC_LINES} AS l FROM documents) SELECT id, md5(array_to_string(CASE WHEN len(l) > 5 THEN ['... (' || (len(l) - 5) || ' lines before)'] || l[len(l) - 4:] ELSE l END, chr(10))) AS output FROM l")
def tail_lines(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(F.array_join(T.head_tail(T.lines_of(F.col("text")), None, 5), "\n")).alias("output"))


_STAMPED = "stamped AS (SELECT id, pos, CASE WHEN pos % 2 = 0 THEN '2024-01-02T03:04:05.678Z ' || line ELSE line END AS line FROM lines)"


@query("dedup_lines", sql(f"WITH {_STAMPED}, k AS (SELECT id, pos, regexp_replace(line, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9:.,]+(Z|[+-][0-9:]+)? *|[A-Z][a-z]{{2}} [ 0-9][0-9] [0-9:]{{8}} *)', '') AS line FROM stamped), c AS (SELECT id, line, min(pos) AS first_pos, count(*) AS n FROM k WHERE line <> '' GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY first_pos) AS place FROM c) WHERE place <= 40", "lines"))
def dedup_lines(spark, d):
    stamped = view(spark, d, "lines").select("id", "pos", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("2024-01-02T03:04:05.678Z "), "line")).otherwise(F.col("line")).alias("line"))
    return T.dedup_lines(stamped)


@query("group_by_dir", sql("WITH c AS (SELECT size % 3 AS id, regexp_extract(path, '^(.*)/', 1) AS key, count(*) AS n FROM files GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, key) AS place FROM c) WHERE place <= 15", "files"))
def group_by_dir(spark, d):
    found = view(spark, d, "files").select((F.col("size") % 3).alias("id"), F.col("path").alias("line"))
    return T.by_key(found, F.regexp_extract("line", "^(.*)/", 1), 15)


@query("group_by_ext", sql("WITH c AS (SELECT size % 3 AS id, regexp_extract(path, '\\.([^./]+)$', 1) AS key, count(*) AS n FROM files GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, key) AS place FROM c) WHERE place <= 5", "files"))
def group_by_ext(spark, d):
    found = view(spark, d, "files").select((F.col("size") % 3).alias("id"), F.col("path").alias("line"))
    return T.by_key(found, F.regexp_extract("line", r"\.([^./]+)$", 1), 5)


_HITS = "hits AS (SELECT id % 4 AS id, id * 1000 + pos AS pos, concat('src/f', (id * 7 + pos) % 23, '.py:', pos, ':', line) AS line FROM lines)"


@query("grep_summary", sql(f"WITH {_HITS}, f AS (SELECT *, regexp_extract(line, '^([^:]*[./][^:]*):', 1) AS file FROM hits), c AS (SELECT id, file, count(*) AS n FROM f WHERE file <> '' GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, file) AS place FROM c), e AS (SELECT *, row_number() OVER (PARTITION BY id, file ORDER BY pos) AS nth FROM f WHERE file <> '') SELECT e.id, place, e.file, n, nth, line FROM e JOIN b ON b.id = e.id AND b.file = e.file WHERE place <= 10 AND nth <= 5", "lines"))
def grep_summary(spark, d):
    lines = view(spark, d, "lines")
    line = F.concat(F.lit("src/f"), ((F.col("id") * 7 + F.col("pos")) % 23).cast("string"), F.lit(".py:"), F.col("pos").cast("string"), F.lit(":"), "line")
    return T.grep_summary(lines.select((F.col("id") % 4).alias("id"), (F.col("id") * 1000 + F.col("pos")).alias("pos"), line.alias("line")))


_DIFF = "diff AS (SELECT id, pos, CASE pos % 9 WHEN 0 THEN '@@ ' WHEN 3 THEN '+' WHEN 4 THEN '-' ELSE ' ' END || line AS line FROM lines)"


@query("diff_context_budget", sql(f"WITH {_DIFF}, m AS (SELECT *, left(line, 1) IN ('+', '-') OR starts_with(line, '@@') AS keeps, count(*) FILTER (left(line, 1) IN ('+', '-')) OVER (PARTITION BY id) AS total FROM diff), r AS (SELECT *, count(*) FILTER (keeps) OVER (PARTITION BY id ORDER BY pos) AS run FROM m), a AS (SELECT *, row_number() OVER (PARTITION BY id, run ORDER BY pos) AS k FROM r) SELECT id, pos, line FROM a WHERE keeps OR (run > 0 AND k - 1 <= CASE WHEN total > 200 THEN 0 WHEN total > 50 THEN 1 ELSE 2 END)", "lines"))
def diff_context_budget(spark, d):
    mark = F.when(F.col("pos") % 9 == 0, "@@ ").when(F.col("pos") % 9 == 3, "+").when(F.col("pos") % 9 == 4, "-").otherwise(" ")
    return T.diff_context(view(spark, d, "lines").select("id", "pos", F.concat(mark, "line").alias("line")))


@query("output_paths", sql("SELECT id, concat(path, '|', path, ' x|', path) AS paths FROM files", "files"))
def output_paths(spark, d):
    text = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n+modified\n\tmodified:   "), "path", F.lit(" x\r\n  new file: "), "path", F.lit("\n"))
    return view(spark, d, "files").select("id", F.array_join(S.output_paths(text), "|").alias("paths"))


@query("rewrite_command", "SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'lodeline proxy git status' WHEN 1 THEN 'lodeline proxy ls -la && lodeline proxy cargo test; echo x' END AS rewritten FROM events")
def rewrite_command(spark, d):
    commands = ["git status", " ls -la && cargo test;echo x ", "cd /tmp", "git log $(date)", "lodeline proxy git diff", "echo a && cd b"]
    command = F.get(F.array(*map(F.lit, commands)), (F.col("event_id") % 6).cast("int"))
    return read(spark, d, "events").select(F.col("event_id").alias("id"), T.rewrite(command).alias("rewritten"))


_GAIN = "sum(raw_tokens) - sum(filtered_tokens)"


@query("gain_totals", sql(f"SELECT count(*) AS commands, CAST(sum(raw_tokens) AS BIGINT) AS raw, CAST(sum(filtered_tokens) AS BIGINT) AS filtered, CAST({_GAIN} AS BIGINT) AS saved, round(CAST({_GAIN} AS DOUBLE) / sum(raw_tokens) * 100, 6) AS pct FROM tracking", "tracking"))
def gain_totals(spark, d):
    return T.gain_totals(view(spark, d, "tracking"))


@query("gain_top_commands", sql(f"SELECT command, count(*) AS runs, CAST({_GAIN} AS BIGINT) AS saved, round(avg(CAST(raw_tokens - filtered_tokens AS DOUBLE) / raw_tokens * 100), 6) AS pct FROM tracking GROUP BY 1 ORDER BY saved DESC, command LIMIT 10", "tracking"))
def gain_top(spark, d):
    return T.gain_top(view(spark, d, "tracking"))


_DAILY = f"SELECT CAST(CAST(tracking.at AS DATE) AS VARCHAR) AS day, count(*) AS runs, CAST({_GAIN} AS BIGINT) AS saved FROM tracking GROUP BY 1"


@query("gain_daily", sql(f"SELECT * FROM ({_DAILY}) ORDER BY day DESC LIMIT 14", "tracking"))
def gain_daily(spark, d):
    return T.gain_daily(view(spark, d, "tracking")).withColumn("day", F.col("day").cast("string"))


# Lines of documents as outputs of three tools; every 9th line or so begins a section, every 13th is a marker that may end one.
_OUTPUT = """outs AS (SELECT id, CASE id % 3 WHEN 0 THEN 'go test' WHEN 1 THEN 'pytest' ELSE 'jest' END AS tool, pos, trim(replace(concat(
    CASE WHEN (id * 7 + pos) % 9 = 0 THEN CASE id % 3 WHEN 0 THEN '--- FAIL: ' WHEN 1 THEN CASE WHEN pos % 2 = 0 THEN 'FAILED ' ELSE '___ ' END ELSE '● ' END
         WHEN (id + pos) % 13 = 0 THEN CASE WHEN pos % 2 = 0 THEN '=== RUN ' ELSE '--- PASS: ' END ELSE '' END, line), chr(9), ' ')) AS line FROM lines)"""
_BEGINS = "CASE tool WHEN 'go test' THEN starts_with(line, '--- FAIL:') WHEN 'pytest' THEN starts_with(line, 'FAILED ') OR starts_with(line, '___') ELSE starts_with(line, '● ') OR starts_with(line, 'FAIL ') END"


@query(
    "failure_sections",
    sql(
        f"""WITH {_OUTPUT}, marked AS (SELECT *, {_BEGINS} AS begins, tool = 'go test' AND (starts_with(line, '--- ') OR starts_with(line, '=== ')) AS ends FROM outs),
numbered AS (SELECT *, count(*) FILTER (begins) OVER w AS section, max(CASE WHEN begins OR ends THEN pos * 2 + CASE WHEN begins THEN 1 ELSE 0 END END) OVER w AS mark FROM marked WINDOW w AS (PARTITION BY id ORDER BY pos)),
inside AS (SELECT *, row_number() OVER (PARTITION BY id, section ORDER BY pos) AS nth, row_number() OVER (PARTITION BY id ORDER BY pos) AS of_all FROM numbered WHERE mark % 2 = 1)
SELECT id, section, CAST(nth AS INT) AS nth, pos, line FROM inside WHERE nth <= CASE tool WHEN 'pytest' THEN 15 WHEN 'jest' THEN 11 ELSE 1000000 END AND (begins OR tool <> 'go test' OR of_all <= 30)""",
        "lines",
    ),
)
def failure_sections(spark, d):
    own, pos, even = F.col("id") % 3, F.col("pos"), F.col("pos") % 2 == 0
    begin = F.when(own == 0, "--- FAIL: ").when(own == 1, F.when(even, "FAILED ").otherwise("___ ")).otherwise("● ")
    mark = F.when((F.col("id") * 7 + pos) % 9 == 0, begin).when((F.col("id") + pos) % 13 == 0, F.when(even, "=== RUN ").otherwise("--- PASS: ")).otherwise("")
    tool = F.when(own == 0, "go test").when(own == 1, "pytest").otherwise("jest")
    return T.failure_sections(view(spark, d, "lines").select("id", tool.alias("tool"), "pos", F.concat(mark, "line").alias("line")))


@query("handler_outputs")
def handler_outputs(spark, d):
    """Documents as the output of a few programs."""
    command = F.get(F.array(*(F.lit(c) for c in ("git status", "grep -rn x", "cat f.py", "kubectl logs p", "pytest", "find ."))), (F.col("doc_id") % 6).cast("int"))
    runs = read(spark, d, "documents").select("doc_id", command.alias("command"), F.col("text").alias("stdout"), F.lit("").alias("stderr"), (F.col("doc_id") % 2).cast("int").alias("exit_code"))
    return handlers.apply(runs).select("doc_id", "handler", F.length("output").alias("length"), F.md5("output").alias("output_md5"))


@query("tier_precision", "WITH p AS (SELECT l.doc_id, n_chars % 4 AS tier, quality = 1 AS correct FROM labels l JOIN documents d ON d.doc_id = l.doc_id) SELECT tier, count(*) FILTER (correct) AS correct, count(*) FILTER (NOT correct) AS wrong, round(CAST(count(*) FILTER (correct) AS DOUBLE) / count(*), 6) AS precision FROM p GROUP BY tier")
def tier_precision(spark, d):
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    judged = labels.join(docs.select("doc_id", (F.col("n_chars") % 4).alias("tier")), "doc_id").select("tier", (F.col("quality") == 1).alias("correct"))
    return E.by_tier(judged)


@query("scip_summary", sql("SELECT count(DISTINCT doc) AS documents, count(*) AS occurrences, count(*) FILTER (roles & 1 = 0) AS ref_candidates, count(*) FILTER (roles & 1 = 1) AS definitions, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM occurrences", "occurrences"))
def scip_summary(spark, d):
    return E.summary(view(spark, d, "occurrences"))


@query("scip_names", sql("SELECT doc, line, lower(substr(symbol, strpos(symbol, '/') + 1, 3)) AS name FROM occurrences WHERE regexp_matches(substr(symbol, strpos(symbol, '/') + 1, 3), '^[a-z]{3}$')", "occurrences"))
def scip_names(spark, d):
    named = view(spark, d, "occurrences").select("doc", "line", S.scip_name(F.col("symbol")).alias("name"))
    return named.where(F.col("name").rlike("^[a-z]{3}$"))


@query("truth_join", sql("WITH t AS (SELECT doc, line, symbol, roles, row_number() OVER (PARTITION BY doc, line ORDER BY symbol) AS k FROM occurrences), p AS (SELECT doc, line, line % 2 AS guess FROM occurrences) SELECT p.doc, p.line, t.symbol, (t.roles & 1 = p.guess) AS correct FROM p JOIN t ON t.doc = p.doc AND t.line = p.line AND t.k = 1", "occurrences"))
def truth_join(spark, d):
    truth = view(spark, d, "occurrences")
    guesses = truth.select("doc", "line", (F.col("line") % 2).alias("guess"))
    joined = E.first_match(guesses, truth, ["doc", "line"], "symbol")
    return joined.select("doc", "line", "symbol", (F.col("roles").bitwiseAND(1) == F.col("guess")).alias("correct"))


@query("latency_percentiles", "WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (k = greatest(1, CAST(ceil(n * 0.5) AS BIGINT))) AS p50, max(value) FILTER (k = greatest(1, CAST(ceil(n * 0.95) AS BIGINT))) AS p95, max(value) FILTER (k = greatest(1, CAST(ceil(n * 0.99) AS BIGINT))) AS p99 FROM o GROUP BY 1")
def latency_percentiles(spark, d):
    return E.percentiles(read(spark, d, "events"), "event_type", "value")
