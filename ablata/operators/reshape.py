"""Reports flattened, communities and labels, chunks, and wide results made long."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import cut


def flattened(report: DataFrame, key: str, groups: list[str]) -> DataFrame:
    """(key, group, metric, position, value) from struct columns of arrays and scalars; scalars have position null."""
    out = []
    for group in groups:
        for field in report.schema[group].dataType.fields:
            value = F.col(f"{group}.{field.name}")
            named = (F.lit(group).alias("group"), F.lit(field.name).alias("metric"))
            if field.dataType.typeName() == "array":
                rows = report.select(key, *named, F.posexplode_outer(value).alias("position", "value"))
            else:
                rows = report.select(key, *named, F.lit(None).cast("int").alias("position"), value.alias("value"))
            out.append(rows.withColumn("value", F.col("value").cast("double")))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def communities(labels: DataFrame) -> DataFrame:
    """(subject, item, cluster) to (subject, cluster, items sorted)."""
    return labels.groupBy("subject", "cluster").agg(F.array_sort(F.collect_set("item")).alias("items"))


def community_labels(found: DataFrame) -> DataFrame:
    """(subject, communities array<array>) to (subject, item, cluster)."""
    outer = found.select("subject", F.posexplode("communities").alias("cluster", "items"))
    return outer.select("subject", F.explode("items").alias("item"), "cluster")


def silhouette_curve(sweep: DataFrame) -> DataFrame:
    """(subject, algorithm, linkage, k, score) to curve rows; series that share an algorithm are told apart by linkage.

    A series that has a k more than once is several lists: their names end in -0, -1, ... in the order of ``position``, or of score where there is none."""
    series = F.when(F.col("linkage").isNull(), F.col("algorithm")).otherwise(F.concat_ws("-", "algorithm", "linkage"))
    order = "position" if "position" in sweep.columns else "score"
    named = sweep.select("subject", series.alias("series"), F.col("k").alias("cluster_n"), "score", F.col(order).alias("_order"))
    placed = named.withColumn("_list", F.row_number().over(Window.partitionBy("subject", "series", "cluster_n").orderBy("_order")) - 1)
    several = F.max("_list").over(Window.partitionBy("subject", "series")) > 0
    return placed.select("subject", F.when(several, F.concat_ws("-", "series", F.col("_list").cast("string"))).otherwise(F.col("series")).alias("series"), "cluster_n", "score")


def chunked(subjects: DataFrame, size: int = 10, key: str = "subject") -> DataFrame:
    """(subject, chunk): chunks of so many subjects in key order. Rows are subjects, not samples."""
    return subjects.withColumn("chunk", F.floor((F.row_number().over(Window.orderBy(key)) - 1) / size).cast("int"))


def flat_set(df: DataFrame, nested: str) -> DataFrame:
    """An array of arrays as one sorted array of distinct members."""
    return df.withColumn(nested, F.array_sort(F.array_distinct(F.flatten(nested))))


def columns_joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of both for the same keys; a key that one of them lacks raises ValueError."""
    both = left.select(*keys, F.lit(True).alias("_left")).join(right.select(*keys, F.lit(True).alias("_right")), keys, "full")
    if lost := both.filter("_left is null or _right is null").select(*keys).head(1):
        raise ValueError(f"only one table has the key {tuple(lost[0])}")
    return left.join(right, keys)


def indexed(items: DataFrame, by: str, within: list[str]) -> DataFrame:
    """0-based place of each item in its subject's order."""
    return items.withColumn("position", F.row_number().over(Window.partitionBy(*within).orderBy(by)) - 1)


def numbered(df: DataFrame, group: str, order: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``position``, the 0-based place in its group by ``order``, though a group may hold nearly all rows.

    Rows are dealt out by ranges of (group, order) and numbered within a range; the ranges before a group's part, few in number, are added.
    ``ranges`` is their number, where the session's number of partitions is too low."""
    by_range = df.repartitionByRange(group, order) if ranges is None else df.repartitionByRange(ranges, group, order)
    ranged = cut(by_range.withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n")).select(F.col(group).alias("_group"), F.col("_range").alias("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if ranges is not None:
        ranged = ranged.repartition(ranges, group, "_range")
    inside = ranged.withColumn("_inside", F.row_number().over(Window.partitionBy(group, "_range").orderBy(order)) - 1)
    joined = inside.join(parts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_part")))
    return joined.withColumn("position", F.col("_before") + F.col("_inside")).select(*df.columns, "position")


def unique_columns(df: DataFrame) -> list[str]:
    """Column names without repeats, the first of each."""
    return list(dict.fromkeys(df.columns))


def first_columns(df: DataFrame) -> DataFrame:
    """The first column of each name."""
    placed = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return placed.select(*(F.col(f"_{df.columns.index(name)}").alias(name) for name in unique_columns(df)))


def constant_flags(df: DataFrame) -> DataFrame:
    """(name, constant): a row for each of a table's different column names, and whether it has one value only."""
    own = first_columns(df)
    flags = F.array(*(F.struct(F.lit(c).alias("name"), (F.count_distinct(F.col(f"`{c}`")) == 1).alias("constant")) for c in own.columns))
    return own.agg(F.explode(flags).alias("x")).select("x.*")


def embeddings_long(df: DataFrame, key: str) -> DataFrame:
    """(key, method, x, y) from column pairs ``{METHOD}1``, ``{METHOD}2``."""
    names = [m[1] for c in df.columns if (m := re.fullmatch(r"(.+)1", c)) and f"{m[1]}2" in df.columns]
    pairs = F.array(*(F.struct(F.lit(n).alias("method"), F.col(f"{n}1").cast("double").alias("x"), F.col(f"{n}2").cast("double").alias("y")) for n in names))
    return df.select(key, F.explode(pairs).alias("p")).select(key, "p.*")


def constants(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns with one value only."""
    row = df.agg(*(F.count_distinct(c).alias(c) for c in columns)).first()
    return [c for c in columns if row[c] == 1]
