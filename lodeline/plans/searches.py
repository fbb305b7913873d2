"""Search queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.catalog import query
from lodeline.operators import search as S
from lodeline.operators import vectors as V
from lodeline.tables import cut
from lodeline.views import read, sql, view

_TOKENS = "list_filter(regexp_split_to_array(lower(concat_ws(' ', content, scope)), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


def _bm25(terms: list[str]) -> str:
    tests = [f"x = '{t}'" for t in terms[:-1]] + [f"starts_with(x, '{terms[-1]}')"]
    tf = ", ".join(f"len(list_filter(t, lambda x: {c})) AS tf{i}" for i, c in enumerate(tests))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    part = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), CAST(0.000001 AS DOUBLE)) * tf{i} * 2.2 / (tf{i} + CAST(1.2 AS DOUBLE) * (1 - CAST(0.75 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))" for i in range(len(terms)))
    hit = " AND ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"tok AS (SELECT id, {_TOKENS} AS t FROM chunks), counted AS (SELECT id, len(t) AS dl, {tf} FROM tok), totals AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {df} FROM counted), bm AS (SELECT id, {part} AS score FROM counted, totals WHERE {hit})"


_FULL = "fullt AS (SELECT b.id, round(score * CASE WHEN c.path ILIKE '%_test.%' OR c.path ILIKE '%.test.%' OR c.path ILIKE '%/test%' OR c.path ILIKE '%/\\_\\_tests\\_\\_/%' ESCAPE '\\' THEN CAST(0.5 AS DOUBLE) ELSE 1 END * CASE WHEN kind = 'import' THEN CAST(0.3 AS DOUBLE) ELSE 1 END * (1 + 2 * coalesce(centrality, 0)), 9) AS score FROM bm b JOIN chunks c ON c.id = b.id)"
TEXT, TERMS = "the Of an", ["the", "of", "an"]


@query("bm25_search", sql(f"WITH {_bm25(TERMS)} SELECT id, round(score, 9) AS score FROM bm", "chunks"))
def bm25_search(spark, d):
    return S.bm25(view(spark, d, "chunks"), TEXT).select("id", F.round("score", 9).alias("score"))


# Phrases of two terms; of the second, the last term is a prefix.
_PHRASES = [["of", "the"], ["the", "an"]]
_PAIRS = ", ".join(f"len([1 FOR i IN range(1, len(t)) IF t[i] = '{a}' AND {f"starts_with(t[i + 1], '{b}')" if n == len(_PHRASES) - 1 else f"t[i + 1] = '{b}'"}]) AS tf{n}" for n, (a, b) in enumerate(_PHRASES))
_SPLIT = lambda column: f"list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


@query(
    "phrase_search",
    sql(
        f"""WITH tok AS (SELECT id, list_concat({_SPLIT('content')}, [''], {_SPLIT('scope')}) AS t FROM chunks), counted AS (SELECT id, len(t) - 1 AS dl, {_PAIRS} FROM tok),
totals AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, count(*) FILTER (tf0 > 0) AS df0, count(*) FILTER (tf1 > 0) AS df1 FROM counted)
SELECT id, round({" + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), CAST(0.000001 AS DOUBLE)) * tf{i} * 2.2 / (tf{i} + CAST(1.2 AS DOUBLE) * (1 - CAST(0.75 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))" for i in range(2))}, 9) AS score FROM counted, totals WHERE tf0 > 0 AND tf1 > 0""",
        "chunks",
    ),
)
def phrase_search(spark, d):
    chunks = view(spark, d, "chunks")
    return S.bm25(chunks, '"of the" "the an"', cut(S.postings(chunks), "postings")).select("id", F.round("score", 9).alias("score"))


def _top(source: str, n: int) -> str:
    return f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {source} ORDER BY score DESC, id LIMIT {n}"


@query("fulltext_search", sql(f"WITH {_bm25(TERMS)}, {_FULL} {_top('fullt', 30)}", "chunks"))
def fulltext_search(spark, d):
    return S.fulltext(view(spark, d, "chunks"), TEXT, 30)


_NAMES = "names AS (SELECT id, concat(upper(substr(scope, 1, 1)), substr(scope, 2), '_', kind, '_', id) AS name FROM chunks)"
_SYMBOLS = f"{_NAMES}, sym AS (SELECT id, CAST(CASE WHEN name = 'src1' THEN 1.0 WHEN starts_with(lower(name), 'src1') THEN 0.8 WHEN contains(lower(name), 'src1') THEN 0.5 END AS DOUBLE) AS score FROM names), syms AS (SELECT * FROM sym WHERE score IS NOT NULL)"


def _names(spark, d):
    return view(spark, d, "chunks").select("id", F.concat(F.upper(F.substring("scope", 1, 1)), F.expr("substring(scope, 2)"), F.lit("_"), F.col("kind"), F.lit("_"), F.col("id").cast("string")).alias("name"))


@query("symbol_search_tiers", sql(f"WITH {_SYMBOLS} {_top('syms', 30)}", "chunks"))
def symbol_search(spark, d):
    return S.symbols(_names(spark, d), "src1", 30)


_KNN = "q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 3), near AS (SELECT vec_id AS id, round(1 / (1 + sqrt(list_sum([(CAST(embedding[i] AS DOUBLE) - CAST(v[i] AS DOUBLE)) * (CAST(embedding[i] AS DOUBLE) - CAST(v[i] AS DOUBLE)) FOR i IN range(1, 65)]))), 9) AS score FROM embeddings, q)"


def _vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _wanted(spark, d):
    return [float(x) for x in _vectors(spark, d).where("id = 3").first().embedding]


@query("vector_knn", sql(f"WITH {_KNN} {_top('near', 30)}"))
def vector_knn(spark, d):
    return S.knn(_vectors(spark, d), _wanted(spark, d), 30)


# Every vector whose id is divisible by 100, against all of them.
_ALL_PAIRS = "SELECT q.vec_id AS query, e.vec_id AS id, round(1 / (1 + list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 9) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0"


def _indexed(spark, d):
    vectors = _vectors(spark, d)
    centres = V.fit(vectors)
    return V.build(vectors, centres), centres, vectors.where("id % 100 = 0")


@query("vector_knn_all", f"SELECT query, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM ({_ALL_PAIRS})) WHERE rank <= 30")
def vector_knn_all(spark, d):
    return V.search(*_indexed(spark, d), limit=30, exact=True)


@query("vector_knn_probed")
def vector_knn_probed(spark, d):
    index, centres, wanted = _indexed(spark, d)
    return V.search(index, centres, wanted, limit=30, probes=max(8, 3 * len(centres) // 4), exact=False)


_FUSED = f"""{_bm25(TERMS)}, {_FULL}, {_SYMBOLS}, {_KNN}, lists AS (SELECT id, 1.0 / (60 + rank) AS term, 'fulltext' AS source FROM ({_top('fullt', 30)}) UNION ALL SELECT id, 1.2 / (60 + rank), 'symbol' FROM ({_top('syms', 30)}) UNION ALL SELECT id, 0.8 / (60 + rank), 'semantic' FROM ({_top('near', 30)})),
summed AS (SELECT id, sum(CAST(term AS DOUBLE)) AS score, string_agg(source, ',' ORDER BY source) AS sources FROM lists GROUP BY id),
penalty AS (SELECT id, CASE WHEN contains(path, '_test.') OR contains(path, '.test.') OR contains(path, '/test/') OR contains(path, '/__tests__/') OR contains(path, '/tests/') THEN CAST(0.1 AS DOUBLE) ELSE 1 END * CASE WHEN kind = 'import' THEN CAST(0.1 AS DOUBLE) ELSE 1 END * (1 + 5 * coalesce(centrality, 0)) AS f FROM chunks)"""


@query("rrf_fusion", sql(f"WITH {_FUSED} SELECT id, round(score * f, 9) AS score, sources FROM summed JOIN penalty USING (id) ORDER BY round(score * f, 9) DESC, id LIMIT 10", "chunks"))
def rrf_fusion(spark, d):
    chunks = view(spark, d, "chunks")
    lists = {"fulltext": S.fulltext(chunks, TEXT, 30), "symbol": S.symbols(_names(spark, d), "src1", 30), "semantic": S.knn(_vectors(spark, d), _wanted(spark, d), 30)}
    return S.fuse(lists, chunks, 10)


@query("file_penalty", sql(f"WITH {_FUSED} SELECT id, round(f, 9) AS factor FROM penalty", "chunks"))
def file_penalty(spark, d):
    return view(spark, d, "chunks").select("id", F.round(S.file_penalty(), 9).alias("factor"))


@query("unembedded_chunks", sql("SELECT id FROM chunks WHERE kind <> 'import' AND len(list_filter(regexp_split_to_array(content, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) >= 8 AND id NOT IN (SELECT vec_id FROM embeddings)", "chunks"))
def unembedded_chunks(spark, d):
    from lodeline.functions.scalars import whitespace_tokens

    chunks = view(spark, d, "chunks").withColumn("language", F.lit("python")).withColumn("token_count", whitespace_tokens(F.col("content")))
    return S.unembedded(chunks, _vectors(spark, d)).select("id")
