"""Significance, ranks, labels, manifests and winners of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The two verdicts.
SIGNIFICANT, INSIGNIFICANT = "SIGNIFICANT", "INSIGNIFICANT"


def p_verdict(p: Column, level: float = 0.05) -> Column:
    """INSIGNIFICANT if p is at least the level; a NaN p is not, and neither is null."""
    return F.when(~F.isnan(p) & (p >= level), F.lit(INSIGNIFICANT)).otherwise(F.lit(SIGNIFICANT))


def interval_verdict(low: Column, high: Column, strict: bool) -> Column:
    """INSIGNIFICANT if 0 is inside the interval; ``strict`` leaves the ends out."""
    inside = (low < 0) & (high > 0) if strict else (low <= 0) & (high >= 0)
    return F.when(inside, F.lit(INSIGNIFICANT)).otherwise(F.lit(SIGNIFICANT))


def split_by(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Significant and insignificant rows."""
    return df.filter(F.col(column) == SIGNIFICANT), df.filter(F.col(column) == INSIGNIFICANT)


def signed(df: DataFrame, value: str) -> DataFrame:
    """Rows with a ``sign`` column, positive or negative; zeros are in neither."""
    return df.withColumn("sign", F.when(F.col(value) > 0, "positive").when(F.col(value) < 0, "negative")).filter("sign is not null")


def ranked(df: DataFrame, value: str, keys: tuple[str, ...] = ("subject",), name: str = "feature") -> DataFrame:
    """1-based ranks: positives from the largest, negatives from the smallest; ties by name."""
    away = F.when(F.col("sign") == "positive", -F.col(value)).otherwise(F.col(value))
    return signed(df, value).withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "sign").orderBy(away, name)))


def top(df: DataFrame, value: str, k: int, keys: tuple[str, ...] = ("subject",), name: str = "feature") -> DataFrame:
    """The k most influential rows of each sign."""
    return ranked(df, value, keys, name).filter(F.col("rank") <= k)


def tone(value: Column, verdict: Column) -> Column:
    """One of five bar colours by sign and significance."""
    sure = verdict == SIGNIFICANT
    return F.when(value == 0, "none").when(value > 0, F.when(sure, "strong-positive").otherwise("weak-positive")).otherwise(F.when(sure, "strong-negative").otherwise("weak-negative"))


def labelled(df: DataFrame, value: str, name: str = "feature", places: int = 2) -> DataFrame:
    """``label``: name and value, rounded half to even."""
    return df.withColumn("label", F.concat(F.col(name).cast("string"), F.lit("_"), F.format_string(f"%.{places}f", F.bround(value, places))))


def manifest(df: DataFrame, value: str, source: str, target: str) -> DataFrame:
    """(src, dest, rank): which picture goes where in a ranked tree. Copying is left to the caller."""
    rows = ranked(df, value)
    src = F.format_string("%s/%s_%s.jpg", F.lit(source), F.col("subject").cast("string"), F.col("feature").cast("string"))
    dest = F.format_string("%s/%s/%s/%d_%s.jpg", F.lit(target), F.col("subject").cast("string"), F.col("sign"), F.col("rank"), F.col("feature").cast("string"))
    return rows.select("subject", "feature", "rank", src.alias("src"), dest.alias("dest"))


def stem_kind(path: Column) -> Column:
    """The part of a file's name before the first underscore."""
    return F.substring_index(F.regexp_extract(path, r"([^/]+?)([.][^./]*)?$", 1), "_", 1)


def grouped_paths(paths: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """(subject, path) to (subject, paths sorted); a subject that ``subjects`` doesn't know raises KeyError."""
    if subjects is not None and (odd := paths.join(subjects, "subject", "left_anti").limit(1).collect()):
        raise KeyError(odd[0]["subject"])
    return paths.groupBy("subject").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def layout_of(columns: list[str]) -> str:
    """Which of three result tables has these columns: coefficients, correlations, or archived correlations."""
    if "Estimate" in columns or "estimate" in columns:
        return "coefficients"
    if "corrs" in columns or "corr" in columns and "corr_se" in columns:
        return "correlations"
    return "archived"


def extremes(scores: DataFrame, keys: tuple[str, ...] = ("subject",), score: str = "score", order: str = "position") -> DataFrame:
    """Best and worst row's ``algorithm`` for each key; of ties the first in order; null and NaN scores don't count."""
    sound = scores.filter(F.col(score).isNotNull() & ~F.isnan(score))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), order))
    worst = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc(score), order))
    both = sound.withColumn("b", best).withColumn("w", worst).filter("b = 1 or w = 1")
    pick = lambda flag, column: F.max(F.when(F.col(flag) == 1, F.col(column)))
    return both.groupBy(*keys).agg(pick("b", "algorithm").alias("best_algorithm"), pick("b", score).alias("best_score"), pick("w", "algorithm").alias("worst_algorithm"), pick("w", score).alias("worst_score"))


def best_k(sweep: DataFrame, least: int, most: int, keys: tuple[str, ...] = ("subject", "algorithm")) -> DataFrame:
    """The first row with the highest score among those with k in range and a score."""
    sound = sweep.filter(F.col("k").between(least, most) & F.col("score").isNotNull() & ~F.isnan("score"))
    return sound.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "k"))).filter("n = 1").drop("n")


def bars(df: DataFrame, value: str, se: str, verdict: str) -> DataFrame:
    """Rows in drawing order with position, tone and a text such as ``0.12±0.034``."""
    place = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc(value), "feature"))
    text = F.format_string("%.2f±%.3f", F.col(value), F.col(se))
    return df.withColumn("position", place).withColumn("tone", tone(F.col(value), F.col(verdict))).withColumn("text", text)
