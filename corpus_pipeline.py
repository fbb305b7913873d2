"""From raw documents to token ids: quality rules, near-dedup, decontamination, PII masking, BPE.

Each stage reads what its predecessor kept, and its decisions take effect: the
first three drop documents, the fourth masks personal data in the texts, the
last returns every remaining document with its ids.

Edge cases: a null, empty or blank text fails the quality rules; rows without an id
are nobody's near-duplicate and stay; rows that share an id are judged each by
its own text until near-dedup, where they stay or go together; repeated rows beyond
that are exact copies under one id, which near-dedup doesn't tell apart and keeps; of equally good
near-duplicates the smallest id stays; very long texts are worked through whole; an
empty table gives an empty result; further columns are kept up to the last
stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm import bpe, decontam, pii, quality, simhash
from lodeline.llm.storage import new_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.clean(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.clean(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether decoding gives the text's bytes back."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    made = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), ranks, pattern)
    return made.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "round_trip")



STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mask_pii", mask_pii),
    ("encode_bpe", encode_bpe),
]

#: Robust scatter, components and the classifier are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
