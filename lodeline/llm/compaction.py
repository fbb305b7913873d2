"""Size-tiered compaction of immutable shards under a versioned manifest (DataFrame operations only).

A store is a folder: ``data/`` holds Parquet shards that never change,
``manifests/`` one file per version that lists the shards of that version.
``append`` writes arrivals as small shards and commits; ``compact`` merges shards
of a tier, once it has ``fan_in`` of them, into files of about ``target_bytes`` and
commits; ``read`` reads a version; ``vacuum`` deletes what no kept version lists.

A version is committed by renaming a complete file to the version's name, which
fails if that version exists: of two writers one wins, the other reads the new
state and tries again. A run that dies leaves files that no manifest lists.

How it scales. A merge is scan, coalesce, write: no shuffle, rows stream from the
shards of a tier into target-sized files, and a job takes ``JOB_FILES`` shards at
most. Every row is rewritten once per tier it climbs, a number logarithmic in
target over shard size. The driver handles lists of files, never rows.

Edge cases: an empty arrival commits a version without new shards; nulls, long
texts and repeated rows are carried as they are; an empty store reads as an
empty table with the store's schema; the arrivals' column gets a name that no
input column has.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import _hadoop, drop

#: Shards that one merge job reads at most.
JOB_FILES = 4096
TARGET_BYTES, FAN_IN, SMALLEST = 64 << 20, 4, 1 << 20
ATTEMPTS = 20


def tier(size: int, fan_in: int = FAN_IN) -> int:
    """0 below SMALLEST bytes, then one more for each factor of ``fan_in``."""
    return 0 if size < SMALLEST else 1 + int(math.log(size / SMALLEST, fan_in))


class Store:
    """A folder of shards with versioned manifests."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def versions(self) -> list[int]:
        fs, path = _hadoop(self.spark, f"{self.folder}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def shards(self, version: int | None = None) -> list[dict]:
        """The shards of a version (the latest by default): path, bytes, rows."""
        known = self.versions()
        if not known:
            return []
        lines = self.spark.read.text(f"{self.folder}/manifests/v{known[-1] if version is None else version:08d}.json")
        return sorted((json.loads(r.value) for r in lines.collect() if r.value), key=lambda s: s["path"])

    def _commit(self, version: int, shards: list[dict]) -> bool:
        jvm = self.spark._jvm
        private = f"{self.folder}/manifests/.{uuid.uuid4().hex}"
        fs, path = _hadoop(self.spark, private)
        out = fs.create(path)
        out.write(bytearray("\n".join(json.dumps(s, sort_keys=True) for s in shards) + "\n", "utf-8"))
        out.close()
        _, final = _hadoop(self.spark, f"{self.folder}/manifests/v{version:08d}.json")
        try:
            none = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri()).rename(path, final, none)
        except Exception as error:
            fs.delete(path, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def commit(self, added: list[dict], removed: set[str] = frozenset()) -> int | None:
        """Commits the next version; None if what it would remove is no longer there."""
        for _ in range(ATTEMPTS):
            known = self.versions()
            now = {s["path"]: s for s in self.shards()}
            if not removed <= now.keys():
                return None
            kept = [s for p, s in now.items() if p not in removed]
            version = known[-1] + 1 if known else 1
            if self._commit(version, [*kept, *added]):
                return version
        raise RuntimeError("other writers kept winning")

    def _written(self, folder: str) -> list[dict]:
        """Path, bytes and rows of the files of a finished write, from their footers."""
        fs, path = _hadoop(self.spark, folder)
        if not fs.exists(path):
            return []
        files = self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(folder)
        meta = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        return [r.asDict() for r in meta.groupBy("path", "bytes").agg(F.count(F.lit(1)).alias("rows")).collect()]

    def append(self, arrivals: DataFrame, batch: Column | None = None) -> list[int]:
        """Writes arrivals as small shards; with ``batch``, a version for each of its values in order."""
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        writer = arrivals.select(*(F.col(c) for c in self.schema.names))
        if batch is None:
            writer.write.option("compression", "zstd").parquet(folder)
            groups = [self._written(folder)]
        else:
            name = "arrival"
            while name in self.schema.names:
                name += "_"
            writer.withColumn(name, batch).write.option("compression", "zstd").partitionBy(name).parquet(folder)
            by_value: dict[str, list[dict]] = {}
            for shard in self._written(folder):
                by_value.setdefault(shard["path"].split("/")[-2], []).append(shard)
            groups = [by_value[k] for k in sorted(by_value)] or [[]]
        return [self.commit(group) for group in groups]

    def compact(self, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> list[int]:
        """Merges until no tier holds ``fan_in`` shards or more; returns the versions it made."""
        made = []
        while True:
            tiers: dict[int, list[dict]] = {}
            for shard in self.shards():
                if shard["bytes"] < target_bytes * 3 // 4:
                    tiers.setdefault(tier(shard["bytes"], fan_in), []).append(shard)
            due = next((v for _, v in sorted(tiers.items()) if len(v) >= fan_in), None)
            if due is None:
                return made
            run = sorted(due, key=lambda s: (s["bytes"], s["path"]))[:JOB_FILES]
            files = max(1, round(sum(s["bytes"] for s in run) / target_bytes))
            if files >= len(run):
                return made
            folder = f"{self.folder}/data/{uuid.uuid4().hex}"
            self._scan(run).coalesce(files).write.option("compression", "zstd").parquet(folder)
            version = self.commit(self._written(folder), {s["path"] for s in run})
            if version is not None:
                made.append(version)

    def _scan(self, shards: list[dict]) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(s["path"] for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        return self._scan(self.shards(version))

    def vacuum(self, keep_versions: int = 1) -> int:
        """Forgets older versions, then deletes the shards that none of the others lists."""
        known = self.versions()
        gone, kept = known[:-keep_versions], known[-keep_versions:]
        listed = {s["path"] for v in kept for s in self.shards(v)}
        dead = {s["path"] for v in gone for s in self.shards(v)} - listed
        drop(self.spark, *(f"{self.folder}/manifests/v{v:08d}.json" for v in gone))
        drop(self.spark, *dead)
        return len(dead)
