"""Commit history: change coupling, file metrics, hotspots, evolution, code map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fewer commits than this give no coupling at all; larger commits are left out of the pairs.
LEAST_COMMITS, BULK = 50, 50
DAY = 86_400
#: Commits to a task that counts authors.
TASK_COMMITS = 100_000


def coupling(commits: DataFrame, commit_files: DataFrame, least_shared: int = 4, least_commits: int = LEAST_COMMITS, bulk: int = BULK) -> DataFrame:
    """Pairs of files that change together: file_a < file_b, co_changes, total_changes (of file_a), score.

    ``commit_files`` has commit_id and file_path, each pair once. Commits with more
    than ``bulk`` files make no pairs but count in the totals. A commit's files are
    counted first, those of small commits gathered in one array and the pairs made within the row, so
    there is one shuffle by commit, then one by pair that counts before it.
    """
    files = commit_files.select("commit_id", "file_path").distinct()
    small = files.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("commit_id"))).where(F.col("n").between(2, bulk))
    baskets = small.groupBy("commit_id").agg(F.sort_array(F.collect_list("file_path")).alias("f"))
    pair = F.explode(F.flatten(F.transform("f", lambda a, i: F.transform(F.slice(F.col("f"), i + 2, F.size("f")), lambda b: F.struct(a.alias("file_a"), b.alias("file_b"))))))
    shared = baskets.select(pair.alias("p")).groupBy("p.file_a", "p.file_b").agg(F.count(F.lit(1)).alias("co_changes")).where(F.col("co_changes") >= least_shared)
    totals = files.groupBy("file_path").agg(F.count(F.lit(1)).alias("total"))
    enough = commits.agg(F.count(F.lit(1)).alias("commits")).where(F.col("commits") >= least_commits)
    a, b = (totals.select(F.col("file_path").alias(f"file_{x}"), F.col("total").alias(f"total_{x}")) for x in "ab")
    scored = shared.join(a, "file_a").join(b, "file_b").join(F.broadcast(enough))
    score = F.col("co_changes") / F.greatest(F.lit(1), F.least("total_a", "total_b"))
    return scored.select("file_a", "file_b", "co_changes", F.col("total_a").alias("total_changes"), F.round(score, 9).alias("score"))


def top(df: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    """The first rows of a total order."""
    return df.orderBy(*order).limit(limit)


def coupled_with(pairs: DataFrame, file: str, limit: int, distinct: bool = False) -> DataFrame:
    """Both directions of one file's pairs; ``distinct`` as in the context view."""
    one = pairs.where(F.col("file_a") == file).select(F.col("file_b").alias("other"), "score")
    two = pairs.where(F.col("file_b") == file).select(F.col("file_a").alias("other"), "score")
    both = one.unionByName(two)
    return top(both.distinct() if distinct else both, limit, F.desc("score"), "other")


def metrics(base: DataFrame, commits: DataFrame, commit_files: DataFrame, as_of: Column) -> DataFrame:
    """Temporal metrics of the files in ``base`` (file_id, cyclomatic): changes in 30 and 90 days, last change, authors, hotspot score.

    ``commits`` has id, author, at; windows are strict (later than ``as_of`` minus n days).
    """
    ts = F.unix_seconds("at")
    touched = commit_files.join(commits.select(F.col("id").alias("commit_id"), "author", ts.alias("ts")), "commit_id")
    recent = lambda days: F.count_if(F.col("ts") > as_of - days * DAY)
    per_file = _by_commit(touched, F.max("ts").alias("ts")).groupBy("file_id").agg(recent(30).alias("changes_30d"), recent(90).alias("changes_90d"), F.max("ts").alias("last_changed_ts"))
    per_file = per_file.join(_authors(touched, commits), "file_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = base.join(per_file, "file_id", "left")
    rows = joined.select("file_id", "cyclomatic", zero("changes_30d"), zero("changes_90d"), "last_changed_ts", zero("unique_authors"))
    return rows.withColumn("hotspot_score", F.when(F.col("changes_30d") > 0, F.col("changes_30d") * F.col("cyclomatic")).otherwise(F.lit(0.0)))


def _by_commit(touched: DataFrame, *sums: Column) -> DataFrame:
    """One row per file and commit. What a join by commit_id has dealt already isn't shuffled again."""
    return touched.groupBy("file_id", "commit_id").agg(*sums)


def _authors(touched: DataFrame, commits: DataFrame) -> DataFrame:
    """file_id, unique_authors. By itself: several distinct counts in one aggregation would copy every row for each of them.

    Dealt by file to tasks whose number grows with the commits; merged by bytes, well compressed rows would all meet in a few.
    """
    tasks = max(touched.sparkSession.sparkContext.defaultParallelism, -(-commits.count() // TASK_COMMITS))
    return touched.select("file_id", "author").repartition(tasks, "file_id").groupBy("file_id").agg(F.count_distinct("author").alias("unique_authors"))


def change_counts(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """file_id, total_changes (commits) and unique_authors of every file that a known commit touched."""
    touched = commit_files.join(commits.select(F.col("id").alias("commit_id"), "author"), "commit_id")
    changes = _by_commit(touched, F.lit(1).alias("one")).groupBy("file_id").agg(F.count(F.lit(1)).alias("total_changes"))
    authors = _authors(touched, commits).withColumnRenamed("file_id", "same")
    return changes.join(authors, F.col("file_id").eqNullSafe(F.col("same"))).drop("same")  # a file without an id counts as one


def hotspots(measured: DataFrame, limit: int) -> DataFrame:
    return top(measured.where("hotspot_score > 0"), limit, F.desc("hotspot_score"), "file_id")


def churn(commit_files: DataFrame, sizes: DataFrame) -> DataFrame:
    """Changed lines over size in bytes, per file."""
    lines = commit_files.groupBy("file_id").agg(F.sum(F.col("added") + F.col("deleted")).alias("changed"))
    joined = sizes.join(lines, sizes["id"] == lines["file_id"], "left")
    return joined.select(sizes["id"].alias("file_id"), F.round(F.coalesce("changed", F.lit(0)) / F.greatest("size", F.lit(1)), 9).alias("churn_rate"))


def evolution(commits: DataFrame, commit_files: DataFrame, file_id: int, limit: int = 30) -> DataFrame:
    """The latest commits of a file."""
    own = commit_files.where(F.col("file_id") == file_id).select(F.col("commit_id").alias("id"), "added", "deleted")
    return top(commits.join(own, "id"), limit, F.desc("at"), "id").select("id", "author", F.unix_seconds("at").alias("ts"), "message", "added", "deleted")


def symbol_trace(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """symbol_id and the commits (hash, nth) that touched the symbol's own lines, the latest first (nth 1).

    ``symbols``: symbol_id, file_path, first, last (lines now). ``hunks``: file_path,
    hash, pos (smaller is later), old_start, old_lines, new_start, new_lines, as of a
    diff without context. A symbol's range is carried back through the file's
    commits: a hunk before it shifts it, one that overlaps an edge pulls that edge to the
    hunk's old side, and a range that is all new ends the trace. One row holds the
    hunks of one file, in JVM arrays; files are apart.
    """
    by_commit = hunks.groupBy("file_path", "hash").agg(F.min("pos").alias("at"), F.collect_list(F.struct(F.col("old_start").alias("a"), F.col("old_lines").alias("b"), F.col("new_start").alias("c"), F.col("new_lines").alias("d"))).alias("hunks"))
    by_file = by_commit.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("at", "hash", "hunks"))).alias("commits"))
    start = F.struct(F.col("first").cast("int").alias("lo"), F.col("last").cast("int").alias("hi"), F.array().cast("array<string>").alias("touched"))
    traced = symbols.join(by_file, "file_path").select("symbol_id", F.aggregate("commits", start, _carried_back).alias("trace"))
    return traced.select("symbol_id", F.posexplode("trace.touched").alias("nth", "hash")).select("symbol_id", "hash", (F.col("nth") + 1).alias("nth"))


def _carried_back(state: Column, commit: Column) -> Column:
    """The range before a commit, and the commits seen to touch it; (1, 0) is no range."""
    lo, hi, hunks = state["lo"], state["hi"], commit["hunks"]
    last = lambda h: h["c"] + h["d"] - 1  # noqa: E731  last new line of a hunk that has one
    zero = F.lit(0)
    moved = lambda kept: F.aggregate(F.filter(hunks, kept), zero, lambda s, h: s + h["b"] - h["d"])
    edge = lambda line, inside: F.get(F.transform(F.filter(hunks, lambda h: (h["d"] > 0) & (h["c"] <= line) & (last(h) >= line)), inside), zero)
    touched = F.exists(hunks, lambda h: F.when(h["d"] > 0, (h["c"] <= hi) & (last(h) >= lo)).otherwise((h["c"] >= lo) & (h["c"] < hi)))
    before = lambda h: F.when(h["d"] > 0, last(h) < lo).otherwise(h["c"] < lo)
    upto = lambda h: F.when(h["d"] > 0, last(h) < hi).otherwise(h["c"] < hi)
    new_lo = F.coalesce(edge(lo, lambda h: F.when(h["b"] > 0, h["a"]).otherwise(h["a"] + 1)), lo + moved(before))
    new_hi = F.coalesce(edge(hi, lambda h: F.when(h["b"] > 0, h["a"] + h["b"] - 1).otherwise(h["a"])), hi + moved(upto))
    live = lo <= hi
    return F.struct(
        F.when(live & (new_lo <= new_hi), new_lo).otherwise(F.lit(1)).alias("lo"),
        F.when(live & (new_lo <= new_hi), new_hi).otherwise(zero).alias("hi"),
        F.when(live & touched, F.array_append(state["touched"], commit["hash"])).otherwise(state["touched"]).alias("touched"),
    )
