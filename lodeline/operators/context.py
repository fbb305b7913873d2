"""What a reader of one file needs: external callers, dependencies, contracts, the map."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.functions.paths import is_test_context

# Kinds of symbols that have callers worth listing, and of references that count as such.
DEFINED = ("function", "method", "struct", "class", "interface", "type")
USES = ("call", "field_access", "type_ref")
GATE = 0.7


def uses(refs: DataFrame, files: DataFrame, file_id: int | None = None) -> DataFrame:
    """References that symbols of a file (of every file by default) may have, counted by name, target_file_id (null: by name alone) and source_file_id.

    sure and unsure by confidence, known (sure or not, with any confidence or none) and test (by the source's path).
    Counted before they meet the symbols: symbols and references of a common name are never paired.
    """
    used = refs.where(F.col("kind").isin(*USES) & F.col("name").isNotNull())
    if file_id is not None:
        used = used.where((F.col("target_file_id") == file_id) | F.col("target_file_id").isNull())
    sure = F.col("confidence") >= GATE
    counted = used.groupBy("name", "target_file_id", "source_file_id").agg(F.count_if(sure).alias("sure"), F.count_if(~sure).alias("unsure"), F.count(F.lit(1)).alias("known"))
    return counted.join(files.select(F.col("id").alias("source_file_id"), is_test_context(F.col("path")).alias("test")), "source_file_id")


def _own(symbols: DataFrame, file_id: int | None) -> DataFrame:
    own = symbols.where(F.col("kind").isin(*DEFINED))
    return own if file_id is None else own.where(F.col("file_id") == file_id)


def external_callers(symbols: DataFrame, refs: DataFrame, files: DataFrame, file_id: int) -> DataFrame:
    """For each symbol of a file that others use: how often, surely and possibly, and from how many files; by line."""
    own = _own(symbols, file_id).groupBy(F.col("id").alias("symbol_id"), "name", "kind", "line").agg(F.count(F.lit(1)).alias("n"))
    by_name = uses(refs, files, file_id).where(F.col("source_file_id") != file_id).groupBy("name").agg(F.sum("sure").alias("sure"), F.sum("unsure").alias("unsure"), F.count_distinct("source_file_id").alias("files"))
    counted = own.join(by_name, "name").select("symbol_id", "name", "kind", "line", (F.col("n") * F.col("sure")).alias("confident"), (F.col("n") * F.col("unsure")).alias("possible"), "files")
    return counted.orderBy("line", "symbol_id").drop("symbol_id")


def dependencies(refs: DataFrame, file_id: int, limit: int = 20) -> DataFrame:
    own = refs.where(F.col("source_file_id") == file_id).select("name", "target_file_id", "kind").distinct()
    return own.orderBy("name", F.col("target_file_id").asc_nulls_last(), "kind").limit(limit)


def contracts(symbols: DataFrame, refs: DataFrame, files: DataFrame, file_id: int | None = None) -> DataFrame:
    """Symbols of one name and kind in a file as one: sure uses by production code and by tests, how many symbols they are, and the first one's line.

    All of them have the same uses: those of the name in the file, and those of the name without
    a target, less the file's own. So sums meet sums, and the work grows with the rows, not with their pairs.
    """
    own = _own(symbols, file_id).groupBy("file_id", "name", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("impls"), F.min("line").alias("first_line"))
    used = uses(refs, files, file_id)
    sums = lambda to: (F.sum(F.when(~F.col("test"), F.col("sure")).otherwise(0)).alias(f"prod_{to}"), F.sum(F.when(F.col("test"), F.col("sure")).otherwise(0)).alias(f"tests_{to}"), F.sum("known").alias(f"known_{to}"))
    known = used.where("source_file_id <> target_file_id").groupBy("name", F.col("target_file_id").alias("file_id")).agg(*sums("file"))
    loose = used.where("target_file_id is null")
    totals = loose.groupBy("name").agg(*sums("name"))
    inside = loose.groupBy("name", F.col("source_file_id").alias("file_id")).agg(*sums("own"))
    met = own.join(known, ["name", "file_id"], "left").join(inside, ["name", "file_id"], "left").join(totals, "name", "left")
    of = lambda what: reduce(lambda a, b: a + b, (sign * F.coalesce(F.col(f"{what}_{to}"), F.lit(0)) for to, sign in (("file", 1), ("name", 1), ("own", -1))))
    found = met.where(F.col("file_id").isNotNull() & (of("known") > 0))
    return found.select("file_id", "name", "kind", (F.col("n") * of("prod")).alias("prod"), (F.col("n") * of("tests")).alias("tests"), "impls", "first_line")


def arch_map(facts: DataFrame, central: int = 10) -> DataFrame:
    """Counts by layer and role, the most central files and the number of files."""
    count = F.count(F.lit(1)).cast("double").alias("value")
    part = lambda name: facts.groupBy(F.lit(name).alias("section"), F.col(name).alias("item")).agg(count)
    top = facts.where("centrality > 0").orderBy(F.desc("centrality"), "path").limit(central).select(F.lit("central").alias("section"), F.col("path").alias("item"), F.col("centrality").alias("value"))
    return part("layer").unionByName(part("role")).unionByName(top).unionByName(facts.agg(F.lit("files").alias("section"), F.lit("all").alias("item"), count))
