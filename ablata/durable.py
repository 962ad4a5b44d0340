"""Results kept in the folder that all executors share, so that a lost executor costs no recomputation."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a folder of our own in a local session; a cluster without it is refused."""
    context = spark.sparkContext
    set_by_cluster = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(set_by_cluster)
        return set_by_cluster.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ablata-"))
    return os.path.dirname(context.getCheckpointDir().rstrip("/"))


def new_path(spark: SparkSession, what: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: its lineage ends there, and its rows stay the same."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again. Unlike after ``cut``, the optimiser carries nothing over from before, so many rounds stay cheap to plan."""
    path = new_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
