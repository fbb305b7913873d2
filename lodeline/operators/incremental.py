"""Index maintenance: change sets, upserts, deletions, lookup by path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(found: DataFrame, stored: DataFrame) -> DataFrame:
    """New files and files whose hash differs."""
    return found.join(stored.select("path", "hash"), ["path", "hash"], "left_anti")


def deleted(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored files that a full scan no longer finds. Don't use it on a restricted scan."""
    return stored.join(found.select("path"), "path", "left_anti")


def restrict(found: DataFrame, paths: DataFrame) -> DataFrame:
    """A scan of listed paths only; missing ones drop out."""
    return found.join(paths.select("path"), "path", "left_semi")


def upsert(stored: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """``new`` wins over ``stored`` by key."""
    return new.unionByName(stored.join(new.select(key), key, "left_anti"))


def cascade(table: DataFrame, gone: DataFrame, file_col: str = "file_id") -> DataFrame:
    """Rows of files that are still there."""
    return table.join(gone.select(F.col("id").alias(file_col)), file_col, "left_anti")


def forget_targets(refs: DataFrame, gone: DataFrame) -> DataFrame:
    """Outgoing references of deleted files go; incoming ones lose their target."""
    dead = gone.select(F.col("id").alias("target_file_id"), F.lit(True).alias("dead"))
    kept = cascade(refs, gone, "source_file_id").join(dead, "target_file_id", "left")
    clear = lambda c: F.when(F.col("dead").isNull(), F.col(c)).alias(c)
    return kept.select(*(clear(c) if c in ("target_file_id", "target_symbol_id") else F.col(c) for c in refs.columns))


def without_ignored(files: DataFrame, patterns: list[str]) -> DataFrame:
    return reduce(lambda df, p: df.where(~F.col("path").rlike(p)), patterns, files)


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (t.agg(F.lit(n).alias("item"), F.count(F.lit(1)).alias("n")) for n, t in tables.items()))


def fuzzy(files: DataFrame, wanted: str) -> DataFrame:
    """The file that a path most likely means: equal, then by prefix, then by suffix; the shortest."""
    path = F.col("path")
    bucket = F.when(path == wanted, 0).when(path.startswith(wanted), 1).when(path.endswith(wanted), 2)
    return files.withColumn("bucket", bucket).where("bucket is not null").orderBy("bucket", F.length("path"), "path").limit(1).drop("bucket")
