"""Search: BM25 full text, tiered symbol match, vector neighbours, rank fusion, penalties."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions.paths import is_test_fulltext, is_test_fusion
from lodeline.tables import cut

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
TEST_FACTOR, IMPORT_FACTOR, CENTRALITY_FACTOR = 0.5, 0.3, 2.0
FUSION_FACTOR, FUSION_CENTRALITY = 0.1, 5.0
RRF_K = 60
#: Bytes of text to a task that makes postings, and the least worth a task of their own.
TASK_BYTES, LEAST_BYTES = 16_000_000, 1_000_000
WEIGHTS = {"fulltext": 1.0, "symbol": 1.2, "semantic": 0.8}


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def parse_query(text: str) -> list[str]:
    """Terms of a query: all must occur, the last one as a prefix."""
    return [t for clause in parse_clauses(text) for t in clause]


def parse_clauses(text: str) -> list[list[str]]:
    """What a query asks for: all clauses must occur, each as its terms in a row; of the last clause, the last term is a prefix.

    A text in double quotes is one clause, and so is a word with one of ``"*()``
    in it; other words give a clause for each of their terms.
    """
    clauses: list[list[str]] = []
    for quoted, word in re.findall(r'"([^"]*)"|([^\s"]+|")', text):
        terms = [t for t in re.split(r"[\W_]+", (quoted or word).lower()) if t]
        clauses += [terms] if terms and (quoted or re.search("[*()]", word)) else [[t] for t in terms]
    return clauses


def bm25(chunks: DataFrame, text: str, postings: DataFrame | None = None) -> DataFrame:
    """id, score (higher is better) of the chunks with all clauses, over content and scope together; a phrase counts as a term.

    With ``postings`` only the query's terms are read; without, every statistic is a
    sum over one scan of token arrays.
    """
    clauses = parse_clauses(text)
    if not clauses:
        return chunks.select("id", F.lit(0.0).alias("score")).limit(0)
    if postings is not None:
        counted, totals = _from_postings(postings, clauses)
        return _scored(counted, totals, len(clauses))
    # The empty token between content and scope keeps phrases from running over.
    body = F.concat(tokens(F.coalesce("content", F.lit(""))), F.array(F.lit("")), tokens(F.coalesce("scope", F.lit(""))))
    count = lambda i: _occurrences(F.col("t"), clauses[i], i == len(clauses) - 1)
    counted = chunks.select("id", body.alias("t")).select("id", (F.size("t") - 1).alias("dl"), *(count(i).alias(f"tf{i}") for i in range(len(clauses))))
    counted = cut(counted, "counts")  # texts are taken apart once; what is read twice is a few numbers a chunk
    totals = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(clauses))))
    return _scored(counted, totals, len(clauses))


def _occurrences(tokens: Column, clause: list[str], prefix: bool) -> Column:
    fits = lambda x, j: x.startswith(clause[j]) if prefix and j == len(clause) - 1 else x == clause[j]
    if len(clause) == 1:
        return F.size(F.filter(tokens, lambda x: fits(x, 0)))
    at = lambda p, j: F.coalesce(fits(F.get(tokens, p + j), j), F.lit(False))
    starts = F.filter(F.transform(tokens, lambda x, p: F.when(x == clause[0], p)), lambda p: p.isNotNull())
    return F.size(F.filter(starts, lambda p: reduce(lambda a, b: a & b, (at(p, j) for j in range(1, len(clause))))))


def postings(chunks: DataFrame) -> DataFrame:
    """term, id, tf, dl, positions of every term and chunk, and a row of term '' for each chunk; a task's are sorted by term, so that a query's filters skip the rest.

    Positions of the scope's terms begin two after the content's last, so that no phrase runs over.
    Texts are dealt once, some ``TASK_BYTES`` to a task, which groups and sorts what
    it gets: no posting is shuffled.
    """
    spark = chunks.sparkSession
    size = chunks.agg(F.sum(F.octet_length(F.coalesce("content", F.lit(""))))).first()[0] or 0
    tasks = max(1, -(-size // TASK_BYTES), min(spark.sparkContext.defaultParallelism, size // LEAST_BYTES))
    chunks = chunks.select("id", "content", "scope").repartition(tasks, "id")
    placed = lambda c, start: F.transform(c, lambda t, i: F.struct(t.alias("term"), (i + start).alias("pos")))
    taken = chunks.select("id", tokens(F.coalesce("content", F.lit(""))).alias("c"), tokens(F.coalesce("scope", F.lit(""))).alias("s"))
    every = F.concat(F.array(F.struct(F.lit("").alias("term"), F.lit(-1).alias("pos"))), placed(F.col("c"), F.lit(0)), placed(F.col("s"), F.size("c") + 1))
    counted = taken.select("id", (F.size("c") + F.size("s")).alias("dl"), F.explode(every).alias("x")).groupBy("id", "dl", "x.term").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.sort_array(F.collect_list("x.pos")).alias("positions"))
    return counted.select("term", "id", "tf", "dl", "positions").sortWithinPartitions("term", "id")


def _from_postings(postings: DataFrame, clauses: list[list[str]]) -> tuple[DataFrame, DataFrame]:
    """Clause counts from the rows of the query's terms: a phrase is where the terms' positions, each less its place in the phrase, meet."""
    last = len(clauses) - 1
    fit = lambda i, j: (F.col("term") >= clauses[i][j]) & F.col("term").startswith(clauses[i][j]) if (i, j) == (last, len(clauses[last]) - 1) else F.col("term") == clauses[i][j]
    slots = [(i, j) for i, clause in enumerate(clauses) for j in range(len(clause))]
    own = postings.where(reduce(lambda a, b: a | b, (fit(i, j) for i, j in slots)))

    def gathered(i: int, j: int) -> Column:
        if len(clauses[i]) == 1:
            return F.coalesce(F.sum(F.when(fit(i, 0), F.col("tf"))), F.lit(0)).alias(f"tf{i}")
        return F.flatten(F.collect_list(F.when(fit(i, j), F.transform("positions", lambda p: p - j)))).alias(f"at{i}_{j}")

    found = own.groupBy("id").agg(F.max("dl").alias("dl"), *(gathered(i, j) for i, j in slots))
    met = lambda i: F.size(reduce(F.array_intersect, (F.col(f"at{i}_{j}") for j in range(len(clauses[i]))))).alias(f"tf{i}")
    counted = found.select("id", "dl", *(F.col(f"tf{i}") if len(clause) == 1 else met(i) for i, clause in enumerate(clauses)))
    sizes = postings.where("term = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return counted, counted.agg(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(clauses)))).join(F.broadcast(sizes))  # one row each


def _scored(counted: DataFrame, totals: DataFrame, clauses: int) -> DataFrame:
    hit = reduce(lambda a, b: a & b, (F.col(f"tf{i}") > 0 for i in range(clauses)))

    def part(i: int) -> Column:
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    score = reduce(lambda a, b: a + b, map(part, range(clauses)))
    return counted.where(hit).join(F.broadcast(totals)).select("id", score.alias("score"))  # totals: one row


def fulltext(chunks: DataFrame, text: str, limit: int, postings: DataFrame | None = None) -> DataFrame:
    """id, score, rank: BM25 with penalties for tests and imports and a boost by centrality."""
    scored = bm25(chunks, text, postings).join(chunks.select("id", "path", "kind", "centrality"), "id")
    factor = F.when(is_test_fulltext(F.col("path")), TEST_FACTOR).otherwise(1.0) * F.when(F.col("kind") == "import", IMPORT_FACTOR).otherwise(1.0)
    boosted = F.round(F.col("score") * factor * (1 + CENTRALITY_FACTOR * F.coalesce("centrality", F.lit(0.0))), 9)
    return ranked(scored.select("id", boosted.alias("score")), limit)


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` rows with their place; the window sees those rows only."""
    top = scored.orderBy(F.desc("score"), "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def symbols(table: DataFrame, text: str, limit: int) -> DataFrame:
    """id, score, rank: equal names, then names that start with the text, then names that contain it (LIKE ignores case)."""
    name, low = F.col("name"), text.lower()
    lower = F.lower(name)
    score = F.when(name == text, 1.0).when(lower.startswith(low), 0.8).when(F.contains(lower, F.lit(low)), 0.5)
    return ranked(table.select("id", score.alias("score")).where("score is not null"), limit)


def l2(a: Column, b: Column) -> Column:
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(squares)


def knn(vectors: DataFrame, query: list[float] | Column, limit: int) -> DataFrame:
    """id, score, rank: the nearest vectors by distance, as 1 / (1 + distance). A scan with a bounded heap per task."""
    q = query if isinstance(query, Column) else F.array(*map(F.lit, query))
    return ranked(vectors.select("id", F.round(1 / (1 + l2(F.col("embedding"), q)), 9).alias("score")), limit)


def fuse(lists: dict[str, DataFrame], chunks: DataFrame, limit: int) -> DataFrame:
    """id, score, sources: weighted reciprocal ranks summed by chunk, then penalties by file."""
    parts = [df.select("id", F.lit(WEIGHTS[name] / 1.0).alias("w"), "rank", F.lit(name).alias("source")) for name, df in lists.items()]
    every = reduce(DataFrame.unionByName, parts).withColumn("term", F.col("w") / (RRF_K + F.col("rank")))
    summed = every.groupBy("id").agg(F.sum("term").alias("score"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"))
    placed = summed.join(chunks.select("id", "path", "kind", "centrality"), "id")
    return placed.select("id", F.round(F.col("score") * file_penalty(), 9).alias("score"), "sources").orderBy(F.desc("score"), "id").limit(limit)


def file_penalty() -> Column:
    test = F.when(is_test_fusion(F.col("path")), FUSION_FACTOR).otherwise(1.0)
    return test * F.when(F.col("kind") == "import", FUSION_FACTOR).otherwise(1.0) * (1 + FUSION_CENTRALITY * F.coalesce("centrality", F.lit(0.0)))


# Languages whose chunks are embedded.
EMBEDDED = ("rust", "python", "javascript", "typescript", "tsx", "go", "java", "c", "cpp", "bash")


def unembedded(chunks: DataFrame, vectors: DataFrame, least_tokens: int = 8) -> DataFrame:
    """Chunks that should have a vector and don't."""
    wanted = chunks.where(F.col("language").isin(*EMBEDDED) & (F.col("kind") != "import") & (F.col("token_count") >= least_tokens))
    return wanted.join(vectors.select("id"), "id", "left_anti")


def embed(chunks: DataFrame, model, batch: int = 128) -> DataFrame:
    """id, embedding by a callable that maps a list of texts to vectors; loaded once per task."""
    import pandas as pd

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), batch):
            out += [list(map(float, v)) for v in model(texts.iloc[at : at + batch].tolist())]
        return pd.Series(out)

    return chunks.select("id", run("content").alias("embedding"))
