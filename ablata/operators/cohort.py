"""Subject selection, lookups and key set operations.

Everything is a filter, a hash join or a semi or anti join on keys; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positives(subjects: DataFrame, severity: str = "severity") -> DataFrame:
    """Subjects with the finding; null severity is neither positive nor negative."""
    return subjects.filter(F.col(severity) > 0)


def negatives(subjects: DataFrame, severity: str = "severity") -> DataFrame:
    """Subjects without the finding."""
    return subjects.filter(F.col(severity) <= 0)


def min_items(subjects: DataFrame, least: int = 20, items: str = "items", strict: bool = False) -> DataFrame:
    """Subjects with at least (``strict``: more than) so many items."""
    n = F.size(items)
    return subjects.filter(n > least if strict else n >= least)


def min_count(long_items: DataFrame, least: int = 20, subject: str = "subject", strict: bool = False) -> DataFrame:
    """(subject, n_items) of subjects with enough items, from one row per item."""
    counted = long_items.groupBy(subject).agg(F.count("*").alias("n_items"))
    return counted.filter(F.col("n_items") > least if strict else F.col("n_items") >= least)


def two_classes(samples: DataFrame, subject: str = "subject", label: str = "yhat") -> DataFrame:
    """(subject, n_classes) of the subjects whose label varies."""
    return samples.groupBy(subject).agg(F.count_distinct(label).alias("n_classes")).filter(F.col("n_classes") >= 2)


def keep_two_classes(samples: DataFrame, subject: str = "subject", label: str = "yhat") -> DataFrame:
    """The samples of subjects whose label varies."""
    return samples.join(two_classes(samples, subject, label), subject, "left_semi")


def binarized(label: Column, classes: int = 2) -> Column:
    """Two classes: 1 above 0, else 0. Three classes: 3 becomes 2."""
    if classes not in (2, 3):
        raise ValueError("classes must be 2 or 3")
    return (label > 0).cast("int") if classes == 2 else F.when(label == 3, 2).otherwise(label)


def lookup(keys: DataFrame, table: DataFrame, key: str, order: str, missing: str = "drop") -> DataFrame:
    """Each key's first row (by ``order``) of ``table``. ``missing``: drop the key, keep it with nulls, or ``raise``."""
    first = table.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")
    if missing == "raise" and (lost := keys.join(first, key, "left_anti").limit(1).collect()):
        raise KeyError(lost[0][key])
    return keys.join(first, key, "left" if missing == "keep" else "inner")


def zipped(df: DataFrame, left: str, right: str, names: tuple[str, str]) -> DataFrame:
    """One row for each pair of two equally long arrays; arrays of other lengths raise."""
    pairs = F.when(F.size(left) == F.size(right), F.arrays_zip(F.col(left).alias("a"), F.col(right).alias("b"))).otherwise(F.raise_error(F.lit(f"{left} and {right} differ in length")))
    kept = [c for c in df.columns if c not in (left, right)]
    return df.select(*kept, F.explode(pairs).alias("p")).select(*kept, F.col("p.a").alias(names[0]), F.col("p.b").alias(names[1]))


def not_done(subjects: DataFrame, done: DataFrame, key: str = "subject") -> DataFrame:
    """Subjects without a result yet."""
    return subjects.join(done, key, "left_anti")


def selected(rows: DataFrame, subjects: DataFrame, key: str = "subject") -> DataFrame:
    """Rows of the selected subjects."""
    return rows.join(subjects, key, "left_semi")


def other_pool(items: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """Items outside a pool."""
    return items.join(pool, keys, "left_anti")


def merged(left: DataFrame, right: DataFrame, key: str, prefer: str = "right") -> DataFrame:
    """Two key-value tables (key, value); a key in both takes ``prefer``'s value."""
    both = left.withColumnRenamed("value", "l").join(right.withColumnRenamed("value", "r"), key, "full")
    return both.select(key, (F.coalesce("r", "l") if prefer == "right" else F.coalesce("l", "r")).alias("value"))


def item_path(folder: str, subject: Column, item: Column) -> Column:
    """``folder/subject_item.jpg``."""
    return F.format_string("%s/%s_%s.jpg", F.lit(folder), subject.cast("string"), item.cast("string"))
