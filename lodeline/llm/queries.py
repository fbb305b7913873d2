"""The registered queries: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, compaction, decontam, hpy, lexical, linecrf, periodic, pii, quality, quotes, seekable, simhash, warc
from .storage import new_dir, table
from .oracles import ORACLES


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.deduplicated(_read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table's turns quote nothing; as messages of a list, each quotes the one before.
    mail = table(quotes.replies(_read(spark, sf_dir, "conversations")), "mail")
    found = quotes.conversations(mail)
    return found.select("conv_id", "turn", "role", "n_quotes", "parent_conv", "parent_turn", "root_conv", "root_turn", "depth", F.col("own_text").alias("text"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(quality.statistics(_read(spark, sf_dir, "documents"), keep=["doc_id", *quality.GROUP]), "quality")
    judged = quality.judge(stats, quality.estimates(stats))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 3).alias("distance"))


def op5_seekable_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "tokens")
    seekable.write(_read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return seekable.read(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


#: Batches in which the table arrives.
ARRIVALS = 8


def op6_size_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    store = compaction.Store(spark, new_dir(spark, "shards"), docs.schema)
    store.append(docs, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"), F.octet_length("text").cast("long").alias("n_bytes"))


def op7_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = pii.detect(docs, pii.fit(docs), keep=["doc_id"])
    return found.select("doc_id", *(f"n_{k}" for k in pii.BASE), F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.scan(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), keep=["doc_id"]))


def op9_pitman_yor_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpy.score(_read(spark, sf_dir, "documents"))


def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    decoded = bpe.decode(encoded.drop("text"), ranks, pattern)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.planted(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic.digest(periodic.find(docs, keep=["doc_id"]))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, n = lexical.build(_read(spark, sf_dir, "documents"))
    return lexical.search(index, n, _read(spark, sf_dir, "benchmark"), k=50)


def op13_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = linecrf.fit(docs, _read(spark, sf_dir, "labels").where(~held_out))
    scored = linecrf.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("lines").cast("long").alias("n_lines"))


def queries() -> dict:
    return {name: value for name, value in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
