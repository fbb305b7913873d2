"""Evaluation against ground truth: precision by tier, SCIP summaries, joins by place, latency percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCIP_SCHEMA = "metadata struct<version: string, project_root: string>, documents array<struct<relative_path: string, language: string, occurrences: array<struct<range: array<int>, symbol: string, symbol_roles: int>>>>"
GATE = 0.7


def read_scip(spark: SparkSession, path: str) -> DataFrame:
    """A SCIP index in JSON, one row per occurrence: doc, language, line, symbol, roles."""
    if not path.endswith((".json", ".jsonl")):
        raise ValueError("only the JSON form of an index can be read")
    docs = spark.read.schema(SCIP_SCHEMA).option("multiLine", True).json(path).select(F.explode("documents").alias("d"))
    rows = docs.select(F.col("d.relative_path").alias("doc"), F.col("d.language").alias("language"), F.explode("d.occurrences").alias("o"))
    return rows.select("doc", "language", F.get("o.range", F.lit(0)).alias("line"), F.col("o.symbol").alias("symbol"), F.coalesce("o.symbol_roles", F.lit(0)).alias("roles"))


def summary(occurrences: DataFrame) -> DataFrame:
    """Documents, occurrences, references, definitions (bit 1 of the roles) and languages."""
    definition = F.col("roles").bitwiseAND(1) == 1
    return occurrences.agg(
        F.count_distinct("doc").alias("documents"),
        F.count(F.lit(1)).alias("occurrences"),
        F.count_if(~definition).alias("ref_candidates"),
        F.count_if(definition).alias("definitions"),
        F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"),
    )


def first_match(predictions: DataFrame, truth: DataFrame, key: list[str], order: str) -> DataFrame:
    """Predictions with the first occurrence at their place."""
    others = [c for c in truth.columns if c not in key]
    first = truth.groupBy(*key).agg(F.min_by(F.struct(*others), F.col(order)).alias("t"))
    return predictions.join(first, key).select(*predictions.columns, "t.*")


def by_tier(judged: DataFrame) -> DataFrame:
    right, wrong = F.count_if("correct"), F.count_if(~F.col("correct"))
    return judged.groupBy("tier").agg(right.alias("correct"), wrong.alias("wrong"), F.round(right / (right + wrong), 6).alias("precision"))


def gated(judged: DataFrame, least: float = GATE) -> DataFrame:
    """Precision and recall of what reaches the gate. ``judged`` has confidence and correct (null: no truth)."""
    known = judged.where("correct is not null")
    shown = F.col("confidence") >= least
    right = F.count_if(shown & F.col("correct"))
    return known.agg(F.round(right / F.count_if(shown), 6).alias("precision"), F.round(right / F.count(F.lit(1)), 6).alias("recall"))


def percentiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """Nearest-rank percentiles: the value at place ceil(p n)."""
    counted = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    so_far = F.sum("n").over(Window.partitionBy(by).orderBy(value))
    total = F.sum("n").over(Window.partitionBy(by))
    placed = counted.select(by, value, so_far.alias("k"), total.alias("total"))
    at = lambda p: F.min(F.when(F.col("k") >= F.greatest(F.lit(1), F.ceil(F.col("total") * p)), F.col(value)))
    return placed.groupBy(by).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))
