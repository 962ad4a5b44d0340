"""Spark sessions with the settings the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import this package, wherever the driver was started. A cluster ships it by --py-files."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    # Tasks share the machine's cores; each worker's linear algebra keeps to one.
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        environment.setdefault(name, os.environ.get(name, "1"))
    return spark


def build(master: str = "local[8]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session; on a cluster, only the SQL settings below matter."""
    return importable(
        SparkSession.builder.master(master)
        .appName("ablata")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
