"""Structured Streaming twins: daily savings, deduplication, bursts, epochs (ST01-ST06, ST10)."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; timestamps without zone are read as UTC."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    naive = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in naive})


def daily(stream: DataFrame, at: str, late: str, *measures) -> DataFrame:
    """Sums by day, emitted once the watermark has passed the day."""
    windowed = stream.withWatermark(at, late).groupBy(F.window(at, "1 day"))
    return windowed.agg(*measures).select(F.to_date("window.start").alias("day"), "*").drop("window")


def deduplicated(stream: DataFrame, at: str, late: str, *keys: str) -> DataFrame:
    """The first row of each key within the watermark; state is dropped after it."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def bursts(stream: DataFrame, at: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Events of a key with less than ``gap`` between them, as one burst."""
    grouped = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("events")).select(*keys, F.col("s.start").alias("begins"), F.col("s.end").alias("ends"), "events")


def drain(df: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """Runs a query over all there is and returns what it wrote."""
    query = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(sink)


def reindex(stream: DataFrame, apply: Callable[[DataFrame, int], None], events: str, checkpoint: str, every: str = "150 milliseconds", name: str = "reindex"):
    """File changes (path, deleted, at, ...) in bursts: the last one of each path, removals before changes, then an event row per epoch.

    Of a removal and a change at the same time the change counts. An event row also
    has how long its epoch took; a ``files.Reindexed`` listener tells those who wait.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        began = time.monotonic()
        newest = F.max_by(F.struct(*rows.columns), F.struct(F.col("at"), ~F.col("deleted"))).alias("r")
        last = rows.groupBy("path").agg(newest).select("r.*").persist()
        apply(last.where("deleted"), epoch)
        apply(last.where("not deleted"), epoch)
        note = last.agg(F.lit("reindex").alias("event"), F.count(F.lit(1)).alias("files"), F.lit(epoch).alias("epoch"), F.current_timestamp().alias("ts"), F.lit(int(1000 * (time.monotonic() - began))).alias("last_reindex_ms"))
        note.write.mode("append").parquet(events)
        last.unpersist()

    return stream.writeStream.queryName(name).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
