"""Marginal counts as a stream: the counts are sums, so batches of new samples merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def counts(inc: DataFrame) -> DataFrame:
    """(subject, feature, sx, sxy) of a batch or a stream."""
    return inc.groupBy("subject", "feature").agg(F.count("*").alias("sx"), F.sum("yhat").alias("sxy"))


def merged(batches: DataFrame) -> DataFrame:
    """Sums of counts of several batches."""
    return batches.groupBy("subject", "feature").agg(F.sum("sx").alias("sx"), F.sum("sxy").alias("sxy"))


def merged_counts(inc: DataFrame, parts: int) -> DataFrame:
    """The counts of all samples from those of ``parts`` batches by sample."""
    batch = F.pmod(F.xxhash64("sample"), F.lit(parts))
    partial = inc.groupBy("subject", "feature", batch.alias("batch")).agg(F.count("*").alias("sx"), F.sum("yhat").alias("sxy"))
    return merged(partial)


def stream_counts(spark: SparkSession, folder: str, schema: str, checkpoint: str, name: str):
    """Starts a query that keeps the counts of incidence files arriving in ``folder`` in a memory table ``name``."""
    arriving = spark.readStream.schema(schema).parquet(folder)
    return counts(arriving).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
