"""The star-schema tables seen as subjects, samples, features and incidence.

Subject: the customer's nation. Sample: an order; yhat says whether it is finished, y whether it is urgent. Feature: a brand; a sample
holds the brands of its lines. Image strata: a document's source is the subject, its language the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a large table that a task joins and groups at a time, some 100 MB of sorts and hash maps.
ROWS = 200_000


def tasks(spark: SparkSession, sf_dir: str, name: str) -> int | None:
    """How many tasks deal a table out by ``ROWS``; none where the session's own number of partitions is enough. The count is in the file's footer."""
    needed = -(-read(spark, sf_dir, name).count() // ROWS)
    return needed if needed > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def spread(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows dealt out by key into so many partitions, which joins and groups by these keys keep; as they are for none."""
    return rows if parts is None else rows.repartition(parts, *keys)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, sample, yhat, y)."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    orders = spread(orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), tasks(spark, sf_dir, "orders"), "o_custkey")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("c_nationkey").alias("subject"),
        F.col("o_orderkey").alias("sample"),
        (F.col("o_orderstatus") == "F").cast("int").alias("yhat"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("y"),
    )


def incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, sample, feature, yhat, y), distinct."""
    lines, part = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), read(spark, sf_dir, "part")
    own, parts = samples(spark, sf_dir), tasks(spark, sf_dir, "lineitem")
    lines = spread(lines, parts, "l_partkey")
    branded = spread(lines.join(part, lines.l_partkey == part.p_partkey).select("l_orderkey", F.col("p_brand").alias("feature")), parts, "l_orderkey")
    return branded.join(own, F.col("l_orderkey") == F.col("sample")).select("subject", F.col("l_orderkey").alias("sample"), "feature", "yhat", "y").distinct()


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, cluster, feature) from documents."""
    return read(spark, sf_dir, "documents").select(F.col("source").alias("subject"), F.col("lang").alias("cluster"), F.col("doc_id").alias("feature"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, item, cluster, vector): all vectors are one subject's."""
    return read(spark, sf_dir, "embeddings").select(F.lit(0).alias("subject"), F.col("vec_id").alias("item"), F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("vector"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, yhat) from labels."""
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), F.col("toxic").alias("yhat"))
