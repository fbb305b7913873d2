"""Intermediate tables and files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

#: Bytes of texts that a pass over texts turns into Python objects at a time.
SLICE = 2 << 20


def base_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a new local folder only where none is set and the session is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = set_dir.get() if set_dir.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named := tempfile.mkdtemp(prefix="lodeline-"))
        named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return named.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder."""
    return f"{base_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that no later plan reads."""
    for path in paths:
        fs, target = _hadoop(spark, path)
        fs.delete(target, True)


def table(df: DataFrame, name: str, path: str | None = None, compression: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage."""
    path = path or new_dir(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a URI, for binary files that Spark has no writer for."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri[len("file:") :]
    return pyarrow.fs.FileSystem.from_uri(uri)


def publish(uri: str, data: bytes) -> None:
    """Writes a whole file under a private name, then renames it: readers see all of it or nothing.

    A task that runs twice renames equal bytes over equal bytes.
    """
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    private = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(private, compression=None) as out:
        out.write(data)
    fs.move(private, path)


def private(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns under names that no operator uses, and these names by the old ones."""
    names = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def sliced(batches):
    """Arrow batches in slices of about SLICE bytes (one row at least), which bounds what Python holds of a batch."""
    for batch in batches:
        rows = max(1, SLICE * batch.num_rows // max(1, batch.nbytes))
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)
        del batch
        pa.default_memory_pool().release_unused()


def parts(spark: SparkSession, gigabytes: float | None = None) -> int:
    """Shuffle partitions of the session, for repartition calls that name a number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
