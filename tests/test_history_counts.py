from pyspark.sql import functions as F

from lodeline.operators import history as H


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_are_distinct_without_copies_of_rows(spark):
    # A commit listed twice, a file touched twice by one commit, one file without an id.
    commits = spark.createDataFrame([(1, "a", 10), (1, "b", 10), (2, "a", 99 * H.DAY), (3, None, 70 * H.DAY)], "id long, author string, s long").select("id", "author", F.timestamp_seconds("s").alias("at"))
    touched = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (3, 8), (2, None), (9, 8)], "commit_id long, file_id long")
    counts = H.change_counts(commits, touched)
    assert {(r.file_id, r.total_changes, r.unique_authors) for r in counts.collect()} == {(7, 2, 2), (8, 1, 0), (None, 1, 1)}
    base = spark.createDataFrame([(7, 2.0), (8, 1.0), (9, 1.0)], "file_id long, cyclomatic double")
    made = H.metrics(base, commits, touched, F.lit(100 * H.DAY))
    assert {r.file_id: (r.changes_30d, r.changes_90d, r.last_changed_ts, r.unique_authors, r.hotspot_score) for r in made.collect()} == {7: (1, 1, 99 * H.DAY, 2, 2.0), 8: (0, 1, 70 * H.DAY, 0, 0.0), 9: (0, 0, None, 0, 0.0)}
    assert "Expand" not in plan(counts) + plan(made)
