"""Streaming twins over the events, replayed in order of time; they equal their batch answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.catalog import query
from lodeline.streaming import events as S
from lodeline.tables import new_dir

SLICES = 4


def shared(spark, name: str) -> str:
    """A new folder that driver and executors see."""
    return new_dir(spark, name)


def _replayed(spark, d):
    """The events in time-ordered files, and last a far-future row that lets every window close."""
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).drop("props")
    folder = shared(spark, "events")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    step = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(low))) * SLICES / (F.unix_micros(F.lit(high)) - F.unix_micros(F.lit(low)) + 1))
    for k in range(SLICES):
        events.where(step == k).coalesce(1).write.mode("append").parquet(folder)
    closing = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("2100-01-01").cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    closing.coalesce(1).write.mode("append").parquet(folder)
    return S.source(spark, folder, closing.schema)


def _drained(spark, df):
    return S.drain(df, shared(spark, "sink"), shared(spark, "state"))


@query("daily_window_stream", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS runs, CAST(sum(CAST(floor(value * 40) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1")
def daily_window_stream(spark, d):
    made = S.daily(_replayed(spark, d), "ts", "1 hour", F.count(F.lit(1)).alias("runs"), F.sum(F.floor(F.col("value") * 40)).alias("tokens"))
    return _drained(spark, made).withColumn("day", F.col("day").cast("string"))


@query("dedup_stream", "SELECT DISTINCT user_id, event_type FROM events")
def dedup_stream(spark, d):
    made = S.deduplicated(_replayed(spark, d), "ts", "60 days", "user_id", "event_type").select("user_id", "event_type")
    return _drained(spark, made).where("user_id >= 0")


@query("session_burst_stream", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS begins, max(ts) + INTERVAL 30 MINUTE AS ends, count(*) AS events FROM s GROUP BY user_id, k")
def session_burst_stream(spark, d):
    return _drained(spark, S.bursts(_replayed(spark, d), "ts", "30 minutes", "1 hour", "user_id"))
