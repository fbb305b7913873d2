"""Directory scan of source trees."""

from __future__ import annotations

import subprocess
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions import paths as P
from lodeline.sources import tree
from lodeline.tables import cut

# Folders that are never entered, and extensions that are kept.
PRUNED = ("node_modules", ".git", "target", "dist", "build", "__pycache__", ".venv", "venv", ".tox", "vendor")
KEPT = tuple(e for e in P.LANGUAGES if e != "zsh") + ("md",)
MOST_FILES = 50_000


def kept(path: Column) -> Column:
    """Not hidden, not below a pruned folder, and of a known extension."""
    parts = F.split(path, "/")
    hidden = F.exists(parts, lambda s: s.startswith(".") | s.isin(*PRUNED))
    return ~hidden & P.extension(path).isin(*KEPT)


def _outer_rules(root: str) -> list[tuple[str, str]]:
    """Exclude files of the repository and of the user, as (path, text)."""
    found = subprocess.run(["git", "-C", root, "config", "--path", "core.excludesFile"], capture_output=True, text=True) if Path(root).is_dir() else None
    named = found.stdout.strip() if found and found.returncode == 0 else ""
    files = [Path(named or Path.home() / ".config/git/ignore"), Path(root) / ".git/info/exclude"]
    return [("", file.read_text(errors="replace")) for file in files if file.is_file()]


def rules(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """The ignore rules of a tree: those of the user, the repository and every folder."""
    inner = tree.contents(listed.where(F.element_at(F.split("path", "/"), -1).isin(*tree.RULE_FILES)), root).select("path", F.col("content").cast("string").alias("text"))
    # Of the outer files the later win; they come before those of any folder.
    outer = "\n".join(text for _, text in _outer_rules(root))
    return tree.rules(inner.unionByName(spark.createDataFrame([("", outer)], "path string, text string")))


def scan(spark: SparkSession, root: str, ignore: list[str] = ()) -> DataFrame:
    """id, path, content, hash, language, lang_family, dir, generated, size of every kept file below a folder.

    ``ignore`` are regular expressions on the relative path. The tree is listed
    first; only what passes the filters and no ignore rule takes away is read.
    """
    base = root.rstrip("/") or "/"
    listed = cut(tree.listing(spark, base, PRUNED), "listing")
    wanted = listed.where(kept(F.col("path")))
    for pattern in ignore:
        wanted = wanted.where(~F.col("path").rlike(pattern))
    wanted = wanted.join(tree.ignored(wanted, rules(spark, base, listed)), "path", "left_anti")
    rows = tree.contents(wanted.repartition(F.col("path")), base).select("path", F.col("content").cast("string").alias("content"), "size", "mtime")
    lang = P.language(F.col("path"))
    described = rows.select("path", "content", F.sha2("content", 256).alias("hash"), lang.alias("language"), P.family(lang).alias("lang_family"), P.dir_of(F.col("path")).alias("dir"), P.is_generated(F.col("content")).alias("generated"), "size", "mtime")
    return described.withColumn("id", F.xxhash64("path").bitwiseAND((1 << 53) - 1))


def guard(root: str, files: DataFrame, most: int = MOST_FILES) -> None:
    """Refuses a home or root folder, and a tree of very many files that isn't a repository."""
    at = Path(root).resolve()
    if at in (Path.home(), Path("/")):
        raise ValueError(f"{at} is no work tree")
    if not (at / ".git").exists() and files.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} files and no repository in {at}")


def layer_overrides(path: str) -> tuple[list[tuple[str, str, float]], list[str]]:
    """(segment, layer, weight) rules and ignore patterns of a TOML file; a malformed one counts as empty."""
    try:
        found = tomllib.loads(Path(path).read_text())
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError):
        return [], []
    rules = [(segment, r["layer"], float(r.get("weight", 0.5))) for segment, r in found.get("layers", {}).items() if "layer" in r]
    return rules, [p for p in found.get("ignore", {}).get("patterns", []) if isinstance(p, str)]
