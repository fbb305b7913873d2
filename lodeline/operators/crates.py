"""Rust modules across the crates of a workspace, by joins with manifests.

A source folder belongs to the nearest folder above it with a manifest; a
workspace's members are its globs, met with the folders of manifests below. A
path that begins with ``crate`` starts at the source's own crate, one that begins
with a crate's name at that crate of the same workspace, or at the only one of that name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.sources.tree import glob_regex

MANIFEST = "Cargo.toml"


def _under(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def _above(folder: Column) -> Column:
    """The folder and all folders above it, the nearest first, the root last."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda k: F.when(k == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, F.lit(1), k), "/")))


def _table(content: Column, name: str) -> Column:
    """The lines of one table of a manifest."""
    return F.regexp_extract(content, rf"(?s)(?:^|\n)\s*\[{name}\][^\n]*\n(.*?)(?:\n\s*\[[a-z]|\z)", 1)


def crates(manifests: DataFrame) -> DataFrame:
    """folder, name (as paths spell it, null without a package) and workspace (its folder) of each manifest (path, content)."""
    held = manifests.select(F.regexp_replace("path", f"/?{MANIFEST}$", "").alias("folder"), "content")
    named = held.select("folder", F.translate(F.nullif(F.regexp_extract(_table(F.col("content"), "package"), r"(?:^|\n)\s*name\s*=\s*[\"']([^\"']+)", 1), F.lit("")), "-", "_").alias("name"), F.regexp_like("content", F.lit(r"(^|\n)\s*\[workspace\]")).alias("root"))
    listed = F.regexp_extract(_table(F.col("content"), "workspace"), r"(?s)(?:^|\n)\s*members\s*=\s*\[(.*?)\]", 1)
    globs = held.select(F.col("folder").alias("workspace"), F.explode(F.regexp_extract_all(listed, F.lit("[\"']([^\"']+)[\"']"), 1)).alias("glob"))
    rules = globs.select("workspace", F.concat(F.lit("^"), glob_regex(F.regexp_replace("glob", r"^\./|/$", "")), F.lit("$")).alias("regex"))
    asked = held.select("folder", F.posexplode(_above(F.col("folder"))).alias("up", "workspace")).withColumn("inner", F.when(F.col("workspace") == "", F.col("folder")).otherwise(F.expr("substring(folder, length(workspace) + 2)")))
    joined = asked.join(rules, "workspace").where(F.expr("inner rlike regex")).groupBy("folder").agg(F.min_by("workspace", "up").alias("member_of"))
    own = F.when(F.col("root"), F.col("folder"))
    return named.join(joined, "folder", "left").select("folder", "name", F.coalesce(own, "member_of", "folder").alias("workspace"))


def _files(base: Column, rest: Column) -> Column:
    """Files that a module below a folder may be: for the folder itself, its crate roots."""
    joined = F.array_join(rest, "/")
    inner = lambda tail: _under(base, F.concat(joined, F.lit(tail)))
    return F.when(F.size(rest) == 0, F.array(_under(base, F.lit("lib.rs")), _under(base, F.lit("main.rs")))).otherwise(F.array(inner(".rs"), inner("/mod.rs")))


def modules(wanted: DataFrame, files: DataFrame, manifests: DataFrame) -> DataFrame:
    """id, target_file_id of Rust module paths (id, dir, module: without the item) that lead to a file (id, path)."""
    known = crates(manifests)
    segments = F.split("module", "::")
    asked = wanted.select("id", F.regexp_replace("dir", "/$", "").alias("dir"), segments.alias("s")).withColumn("head", F.get("s", F.lit(0)))
    rest = F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0)))
    supers = F.size(F.filter("s", lambda x: x == "super"))
    src = _under(F.col("base"), F.lit("src"))
    # Folders are looked up once, however many paths start there.
    near = asked.select("dir").distinct().select("dir", F.posexplode(_above(F.col("dir"))).alias("up", "folder")).join(known, "folder")
    own = near.select("dir", "up", F.col("folder").alias("base"))
    home = near.groupBy("dir").agg(F.min_by("workspace", "up").alias("workspace"))
    named = known.where("name is not null")
    inside = named.select("workspace", F.col("name").alias("head"), F.col("folder").alias("base"))
    only = named.groupBy(F.col("name").alias("head")).agg(F.min("folder").alias("base"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")

    def spread(rows: DataFrame, order: Column, bases: list[Column], rest: Column) -> DataFrame:
        """id, nth, path: candidates of rows, the lower ``order`` first."""
        every = F.concat(*(_files(b, rest) for b in bases))
        return rows.select("id", order.cast("int").alias("order"), F.posexplode(every).alias("k", "path")).select("id", (F.col("order") * 100 + F.col("k")).alias("nth"), "path")

    crate, root = asked.where("head = 'crate'"), F.lit("")
    bare = asked.where("head not in ('crate', 'super', 'self')")
    up = F.element_at(_above(F.col("dir")), F.least(supers, F.size(_above(F.col("dir")))))
    candidates = [
        spread(crate.join(own, "dir"), F.col("up"), [src, F.col("base")], rest),
        spread(crate, F.lit(10_000), [F.lit("src"), root], rest),
        spread(asked.where("head = 'super'"), F.lit(0), [up], F.slice("s", supers + 1, F.greatest(F.size("s") - supers, F.lit(0)))),
        spread(asked.where("head = 'self'"), F.lit(0), [F.col("dir")], rest),
        spread(bare, F.lit(0), [F.col("dir")], F.col("s")),
        spread(bare.join(home, "dir").join(inside, ["workspace", "head"]), F.lit(1), [src, F.col("base")], rest),
        spread(bare.join(only, "head"), F.lit(2), [src, F.col("base")], rest),
        spread(bare, F.lit(3), [F.lit("src")], F.col("s")),
    ]
    met = reduce(DataFrame.unionByName, candidates).join(files.select("path", F.col("id").alias("target_file_id")), "path")
    return met.groupBy("id").agg(F.min_by("target_file_id", "nth").alias("target_file_id"))
