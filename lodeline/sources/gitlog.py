"""Git log with numstat or hunks: command, text source and parsers.

A log is text of any size: git's output goes to the shared folder in pieces, is
read as lines of byte ranges (blocks), and parsed by a segmented forward fill.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.tables import new_dir

MARK = "@@"
FORMAT = f"{MARK}|%H|%an|%at|%s"
PIECE = 1 << 20


def forward_fill(lines: DataFrame, group: list[str], block: str, pos: str, value: Column, name: str) -> DataFrame:
    """``lines`` with ``name``: the last non-null ``value`` at or before each line, in order of block and position within the group.

    The last value of each block (one row a block) is carried over the blocks before
    it; then each block is filled by itself. No window holds more lines than a block.
    """
    own = lines.withColumn(name, value)
    last = own.groupBy(*group, block).agg(F.max_by(name, F.when(F.col(name).isNotNull(), F.col(pos))).alias("__last"))
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*group, block, F.last("__last", ignorenulls=True).over(before).alias("__before"))
    inside = Window.partitionBy(*group, block).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    filled = own.withColumn(name, F.last(name, ignorenulls=True).over(inside)).join(carried, [*group, block])
    return filled.withColumn(name, F.coalesce(name, "__before")).drop("__before")


def _header() -> Column:
    part = F.split("line", "\\|", 5)
    return F.when(F.col("line").startswith(f"{MARK}|"), F.struct(part[1].alias("hash"), part[2].alias("author"), part[3].cast("long").alias("ts"), part[4].alias("message")))


def parse_numstat(lines: DataFrame, block_col: str, pos_col: str, keep_pos: bool = False, group: list[str] | None = None) -> DataFrame:
    """Lines (block, pos, line) -> hash, author, ts, message, file_path, added, deleted; with ``keep_pos``, the file line's position too.

    A header line starts a commit; the file lines after it, up to the next header,
    belong to it. Binary files have ``-`` for a count and are skipped. With
    ``group`` a commit's lines may go on in later blocks of the group; without, blocks are parsed apart.
    """
    if group is None:
        filled = lines.withColumn("commit", F.last(_header(), ignorenulls=True).over(Window.partitionBy(block_col).orderBy(pos_col).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        filled = forward_fill(lines, group, block_col, pos_col, _header(), "commit")
    numbers = F.split("line", "\t", 3)
    rows = filled.where(F.col("line").rlike("^[0-9]+\t[0-9]+\t") & F.col("commit").isNotNull())
    return rows.select("commit.*", numbers[2].alias("file_path"), numbers[0].cast("long").alias("added"), numbers[1].cast("long").alias("deleted"), *([F.col(pos_col)] if keep_pos else []))


def parse_hunks(lines: DataFrame, block: str, pos: str, group: list[str]) -> DataFrame:
    """Lines of ``git log -p -U0`` -> hash, author, ts, message, file_path, pos and the hunk's old_start, old_lines, new_start, new_lines."""
    commits = forward_fill(lines, group, block, pos, _header(), "commit")
    # A commit's header forgets the path of the commit before; lines of a file begin with +, -, a space or a backslash.
    path = F.when(F.col("line").startswith(f"{MARK}|"), F.struct(F.lit(None).cast("string").alias("path"))).when(F.col("line").startswith("diff --git "), F.struct(F.regexp_extract("line", "^diff --git .* b/(.*)$", 1).alias("path")))
    placed = forward_fill(commits, group, block, pos, path, "__file")
    found = lambda i: F.regexp_extract("line", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", i)
    number = lambda i, name: F.coalesce(F.nullif(found(i), F.lit("")).cast("int"), F.lit(1)).alias(name)
    hunks = placed.where(F.col("line").startswith(f"{MARK} -") & F.col("__file.path").isNotNull())
    return hunks.select("commit.*", F.col("__file.path").alias("file_path"), pos, number(1, "old_start"), number(2, "old_lines"), number(3, "new_start"), number(4, "new_lines"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (byte offset), pos, line of text files; positions grow over the whole file."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), F.col("value").alias("line"))
    # Every line has a byte at least, so offset and place in the block are in order over all blocks.
    first = text.groupBy("file", "block").agg(F.min("nth").alias("first"))
    return text.join(first, ["file", "block"]).select("file", "block", (F.col("block") + F.col("nth") - F.col("first")).alias("pos"), "line")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The commits and files of stored logs (git's output with FORMAT and --numstat), with the positions of the file lines."""
    return parse_numstat(read_lines(spark, path), "block", "pos", keep_pos=True, group=["file"])


def _git(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True)
    return done.stdout if done.returncode == 0 else ""


def _spooled(spark: SparkSession, repo: str, *args: str) -> str:
    """git's output in a file of the shared folder, passed on in pieces; an empty file if git fails."""
    path = f"{new_dir(spark, 'gitlog')}/log.txt"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    with subprocess.Popen(["git", "-C", repo, *args], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as git:
        out = fs.create(target, True)
        while piece := git.stdout.read(PIECE):
            out.write(bytearray(piece))
        out.close()
    if git.returncode:
        fs.create(target, True).close()
    return path


def log(spark: SparkSession, repo: str, days: int = 90) -> DataFrame:
    """The log of a work tree, later commits at smaller positions; empty if git fails."""
    return read_log(spark, _spooled(spark, repo, "log", f"--since={days} days ago", "--numstat", f"--format={FORMAT}"))


def hunks(spark: SparkSession, repo: str, *paths: str) -> DataFrame:
    """The hunks of a work tree's history, or of some of its files; later commits at smaller positions."""
    lines = read_lines(spark, _spooled(spark, repo, "log", "-p", "-U0", "--no-color", "--no-ext-diff", "--no-renames", "--src-prefix=a/", "--dst-prefix=b/", f"--format={FORMAT}", "--", *paths))
    return parse_hunks(lines, "block", "pos", ["file"])


def changed_since(spark: SparkSession, repo: str, ref: str) -> DataFrame:
    """(file_path, deleted) of what changed since a ref."""
    live = [(p, False) for p in _git(repo, "diff", "--name-only", "--diff-filter=AMR", ref).splitlines()]
    gone = [(p, True) for p in _git(repo, "diff", "--name-only", "--diff-filter=D", ref).splitlines()]
    return spark.createDataFrame(live + gone, "file_path string, deleted boolean")


def new_commits(parsed: DataFrame, known: DataFrame, indexed: DataFrame) -> DataFrame:
    """Rows on indexed paths, of commits that are not stored yet."""
    return parsed.join(indexed.select(F.col("path").alias("file_path")), "file_path", "left_semi").join(known.select("hash"), "hash", "left_anti")
