"""Trees of files in shared storage: listing, contents, and layered ignore rules.

The listing is the package's own because Spark's file sources pass over names
that begin with a dot or an underscore, ``__init__.py`` among them. The driver
looks at the first folders until there are ``UNITS`` of them; tasks walk
these, and tasks read contents, by Arrow's file systems.
"""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNITS, READ_BYTES = 64, 8 << 20
#: Rules up to this many are broadcast.
FEW_RULES = 20_000
# Files with ignore rules, those that win over the other at the end.
RULE_FILES = (".gitignore", ".ignore")


def open_fs(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if root.startswith("file:") and not root.startswith("file://"):
        root = root[len("file:") :]
    if "://" not in root:
        return pyarrow.fs.LocalFileSystem(), os.path.abspath(root)
    return pyarrow.fs.FileSystem.from_uri(root)


def _children(fs: pyarrow.fs.FileSystem, base: str, folder: str, pruned: tuple[str, ...]):
    """Folders to enter, and (path, size, mtime) of files, in a folder given relative to the base. Links aren't followed."""
    folders, files = [], []
    for info in fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True)):
        path = f"{folder}/{info.base_name}" if folder else info.base_name
        if isinstance(fs, pyarrow.fs.LocalFileSystem) and os.path.islink(info.path):
            continue
        if info.type == pyarrow.fs.FileType.Directory:
            if info.base_name not in pruned:
                folders.append(path)
        elif info.type == pyarrow.fs.FileType.File:
            files.append((path, info.size, int(info.mtime.timestamp()) if info.mtime else None))
    return folders, files


def listing(spark: SparkSession, root: str, pruned: tuple[str, ...] = ()) -> DataFrame:
    """path (relative to the root), size, mtime of every file; folders called one of ``pruned`` aren't entered."""
    fs, base = open_fs(root)
    folders, files = [""], []
    while folders and len(folders) < UNITS:
        found = [_children(fs, base, f, pruned) for f in folders]
        files += [x for _, listed in found for x in listed]
        folders = [x for inner, _ in found for x in inner]
    schema = "path string, size long, mtime long"
    first = spark.createDataFrame(files, schema)
    if not folders:
        return first

    def walk(batches):
        fs, base = open_fs(root)
        for batch in batches:
            todo = batch.column(0).to_pylist()
            while todo:
                inner, listed = _children(fs, base, todo.pop(), pruned)
                todo += inner
                if listed:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*listed), (pa.string(), pa.int64(), pa.int64()))], names=["path", "size", "mtime"])

    units = spark.createDataFrame([(f,) for f in folders], "path string").repartition(min(len(folders), 4 * UNITS), "path")
    return first.unionByName(units.mapInArrow(walk, schema))


def contents(listed: DataFrame, root: str) -> DataFrame:
    """``listed`` with ``content`` (binary); files that can't be read any more are left out."""
    schema = T.StructType([*listed.schema.fields, T.StructField("content", T.BinaryType())])
    place = listed.columns.index("path")

    def read(batches):
        fs, base = open_fs(root)
        for batch in batches:
            low = held = 0
            bodies: list[bytes | None] = []
            for i, path in enumerate(batch.column(place).to_pylist()):
                try:
                    with fs.open_input_stream(f"{base}/{path}", compression=None) as source:
                        bodies.append(source.read())
                except OSError:
                    bodies.append(None)
                held += len(bodies[-1] or b"")
                if held >= READ_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(low, i + 1 - low).columns, pa.array(bodies, pa.binary())], names=schema.names)
                    low, held, bodies = i + 1, 0, []

    return listed.mapInArrow(read, schema).where("content is not null")


def glob_regex(body: Column) -> Column:
    """A glob of ignore files as a regular expression; what a backslash marks stays as it is."""
    e = F.regexp_replace(body, r"\\(.)", "\x01$1")
    e = F.regexp_replace(e, r"(?<!\x01)\[[!^]", "[\x02")
    e = F.regexp_replace(e, r"(?<!\x01)([.+^$(){}|])", "\x01$1")
    e = F.regexp_replace(F.regexp_replace(e, r"(^|/)\*\*/", "$1\x03"), r"/\*\*$", "/\x04")
    e = F.regexp_replace(F.regexp_replace(e, r"(?<!\x01)\?", "[^/]"), r"(?<!\x01)\*+", "[^/]*")
    for mark, text in (("\x02", "^"), ("\x03", "(?:.*/)?"), ("\x04", ".+"), ("\x01", "\\")):
        e = F.replace(e, F.lit(mark), F.lit(text))
    return e


def rules(files: DataFrame) -> DataFrame:
    """dir, rank, line, negated, folders_only, regex of each rule of (path, text): ignore files, where they lie.

    Of ``rank`` (exclude files of the repository or the user 0, .gitignore 1, .ignore 2),
    depth and line, the last rule that matches a path decides.
    """
    name, text = F.element_at(F.split("path", "/"), -1), F.posexplode(F.split("text", "\r?\n"))
    rows = files.select(F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.when(name == ".ignore", 2).when(name == ".gitignore", 1).otherwise(0).alias("rank"), text.alias("line", "text"))
    rows = rows.withColumn("text", F.regexp_replace("text", r"(?<!\\) +$", "")).where("text != '' and not startswith(text, '#')")
    rows = rows.withColumn("negated", F.col("text").startswith("!")).withColumn("text", F.regexp_replace("text", "^!", ""))
    rows = rows.withColumn("folders_only", F.col("text").endswith("/")).withColumn("text", F.regexp_replace("text", "/$", ""))
    # A slash within ties the rule to its folder; without one it is about names at any depth.
    tied = F.contains(F.col("text"), F.lit("/"))
    regex = F.concat(F.when(tied, F.lit("^")).otherwise(F.lit("(^|/)")), glob_regex(F.regexp_replace("text", "^/", "")), F.lit("$"))
    # A bracket that isn't closed matches nothing.
    whole = F.regexp_replace("text", r"\\.", "").rlike(r"^[^\[]*(\[[^\[\]]+\][^\[]*)*$")
    return rows.where(whole & (F.col("text") != "")).select("dir", "rank", "line", "negated", "folders_only", regex.alias("regex"))


def _steps(path: Column) -> Column:
    """A path's folders, from the top, and the path itself."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("step"), (k < n).alias("folder")))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The paths that the rules ignore, or a folder of which they ignore: below it nothing can be taken back.

    Folders are judged once, however many files they hold: each step of a path meets the
    rules of the folders above it, and the last one that matches decides.
    """
    walked = paths.select("path").distinct().select("path", F.explode(_steps(F.col("path"))).alias("s")).select("path", "s.step", "s.folder")
    parts = F.split("step", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, F.lit(1), k), "/")))
    asked = walked.select("step", "folder").distinct().select("step", "folder", F.explode(above).alias("dir"))
    few = F.broadcast(rules) if rules.count() <= FEW_RULES else rules
    within = F.when(F.col("dir") == "", F.col("step")).otherwise(F.expr("substring(step, length(dir) + 2)"))
    met = asked.join(few, "dir").where(F.col("folder") | ~F.col("folders_only")).withColumn("w", within).where(F.expr("w rlike regex"))
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    last = met.groupBy("step", "folder").agg(F.max_by("negated", F.struct("rank", depth, "line")).alias("negated"))
    return walked.join(last.where("not negated"), ["step", "folder"], "left_semi").select("path").distinct()
