"""Session construction and the few settings the operators rely on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, os.environ.get("PYTHONPATH"))))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers that share this file system import the package."""
    env = spark.sparkContext.environment
    parts = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, parts)])
    return spark
