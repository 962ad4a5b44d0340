"""The incidence of features in samples, kept long: one row (subject, sample, feature) for each 1 of the 0/1 matrix.

Set signatures are sums and xors of hashes. They need no order and combine before the shuffle, so that a feature in a thousand
million samples, or a sample with any number of features, is never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_subsets(subsets: DataFrame) -> DataFrame:
    """(subject, sample, features array) to incidence; repeats within a subset count once."""
    return subsets.select("subject", "sample", F.explode(F.array_distinct("features")).alias("feature"))


def set_signature(member: str) -> tuple[Column, Column, Column]:
    """Aggregates that are equal for equal sets of distinct members: count, hash sum, and xor of another hash."""
    return (
        F.count(member).alias("sig_n"),
        F.coalesce(F.sum(F.xxhash64(member).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("sig_sum"),
        F.coalesce(F.bit_xor(F.xxhash64(F.lit("x"), member)), F.lit(0)).alias("sig_xor"),
    )


SIGNATURE = ("sig_n", "sig_sum", "sig_xor")


def wide(inc: DataFrame, samples: DataFrame, features: list[str]) -> DataFrame:
    """The 0/1 matrix: a row for each sample (empty ones too), a column for each feature in sorted order, then yhat and y."""
    names = sorted(features)
    cells = [F.max(F.when(F.col("feature") == f, 1).otherwise(0)).alias(str(f)) for f in names]
    held = inc.groupBy("subject", "sample").agg(*cells)
    rows = samples.join(held, ["subject", "sample"], "left")
    return rows.select("subject", "sample", *(F.coalesce(F.col(f"`{f}`"), F.lit(0)).alias(str(f)) for f in names), "yhat", "y")


def deduplicated(samples: DataFrame, inc: DataFrame, tasks: int | None = None) -> DataFrame:
    """Samples without those that repeat an earlier one of their subject in features, yhat and y; the least sample id stays.

    ``tasks`` deals the samples out by so many, where the session's number of partitions is too low for them."""
    if tasks is not None:
        samples = samples.repartition(tasks, "subject", "sample")
    signed = inc.groupBy("subject", "sample").agg(*set_signature("feature"))
    rows = samples.join(signed, ["subject", "sample"], "left").fillna(0, ["sig_n", "sig_xor"])
    rows = rows.withColumn("sig_sum", F.coalesce("sig_sum", F.lit(0).cast("decimal(38,0)")))
    if tasks is not None:
        rows = rows.repartition(tasks, "subject", *SIGNATURE, "yhat", "y")
    return rows.groupBy("subject", *SIGNATURE, "yhat", "y").agg(F.min("sample").alias("sample")).select("subject", "sample", "yhat", "y")


def unique_features(inc: DataFrame, features: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """(subject, feature) without features in the same samples as an earlier one; the least name stays.

    ``features`` (subject, feature) names features that may be in no sample; they are equal to each other. ``tasks`` deals rows and features
    out by so many: right where features are nearly as many as rows, so that next to nothing combines before the shuffle."""
    if tasks is not None:
        inc = inc.repartition(tasks, "subject", "feature")
    signed = inc.groupBy("subject", "feature").agg(*set_signature("sample"))
    if features is not None:
        signed = features.join(signed, ["subject", "feature"], "left").fillna(0, ["sig_n", "sig_xor"])
        signed = signed.withColumn("sig_sum", F.coalesce("sig_sum", F.lit(0).cast("decimal(38,0)")))
    if tasks is not None:
        signed = signed.repartition(tasks, "subject", *SIGNATURE)
    return signed.groupBy("subject", *SIGNATURE).agg(F.min("feature").alias("feature")).select("subject", "feature")


def few_features(inc: DataFrame, fewer_than: int = 13) -> DataFrame:
    """(subject, n_features) of subjects with few features."""
    counted = inc.groupBy("subject").agg(F.count_distinct("feature").alias("n_features"))
    return counted.filter(F.col("n_features") < fewer_than)


def counts(inc: DataFrame) -> DataFrame:
    """(subject, feature, n_samples, n_positive)."""
    return inc.groupBy("subject", "feature").agg(F.count("*").alias("n_samples"), F.sum("yhat").alias("n_positive"))
