"""Classification metrics, proportions, folds and bootstrap summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .ranking import interval_verdict


def correctness(df: DataFrame) -> DataFrame:
    """``crt``: whether yhat is y."""
    return df.withColumn("crt", F.col("yhat") == F.col("y"))


def true_positives(df: DataFrame) -> DataFrame:
    """Rows with y and yhat 1."""
    return df.filter((F.col("y") == 1) & (F.col("yhat") == 1))


def confusion(df: DataFrame, *keys: str) -> DataFrame:
    """tn, fp, fn, tp of 0/1 labels; zero where a cell is empty."""
    cell = lambda y, yhat: F.count_if((F.col("y") == y) & (F.col("yhat") == yhat))
    return df.groupBy(*keys).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def accuracy(df: DataFrame, *keys: str) -> DataFrame:
    """Share of rows where yhat is y."""
    return df.groupBy(*keys).agg(F.avg((F.col("yhat") == F.col("y")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def matthews(df: DataFrame, *keys: str) -> DataFrame:
    """Matthews correlation; 0 where a class is absent."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    value = F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return confusion(df, *keys).withColumn("mcc", F.coalesce(value, F.lit(0.0)))


def average_ranks(df: DataFrame, value: str, keys: tuple[str, ...] = (), name: str = "avg_rank") -> DataFrame:
    """(keys, value, n, avg_rank): one row for each distinct value, so that a frequent value is one row in the window.

    The window runs over distinct values of a key; counts are combined before."""
    distinct = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(value)
    below = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return distinct.withColumn(name, below + (F.col("n") + 1) / 2)


def roc_auc(df: DataFrame, score: str, label: str = "y", keys: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve from average ranks; null with one class."""
    by_value = df.groupBy(*keys, score).agg(F.count("*").alias("n"), F.sum(F.col(label)).alias("n1"))
    order = Window.partitionBy(*keys).orderBy(score)
    below = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = by_value.withColumn("rank", below + (F.col("n") + 1) / 2)
    sums = placed.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("n1")).alias("r1"), F.sum("n1").alias("p"), F.sum("n").alias("t"))
    area = F.try_divide(F.col("r1") - F.col("p") * (F.col("p") + 1) / 2, (F.col("p") * (F.col("t") - F.col("p"))).cast("double"))
    return sums.select(*keys, area.alias("auc"), F.col("t").alias("n"))


def spearman(df: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Spearman's rho by average ranks, from one row for each distinct pair of values."""
    pairs = df.groupBy(*keys, a, b).agg(F.count("*").alias("m"))
    ra = average_ranks(df, a, keys, "ra").drop("n")
    rb = average_ranks(df, b, keys, "rb").drop("n")
    joined = pairs.join(ra, [*keys, a]).join(rb, [*keys, b])
    m, x, y = F.col("m"), F.col("ra"), F.col("rb")
    sums = joined.groupBy(*keys).agg(F.sum("m").alias("n"), F.sum(m * x).alias("sx"), F.sum(m * y).alias("sy"), F.sum(m * x * x).alias("sxx"), F.sum(m * y * y).alias("syy"), F.sum(m * x * y).alias("sxy"))
    return sums.select(*keys, stats.pearson_from_sums(*(F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))).alias("rho"), "n")


def proportions(strata: DataFrame) -> DataFrame:
    """(subject, cluster, n, proportion)."""
    counted = strata.groupBy("subject", "cluster").agg(F.count("*").alias("n"))
    return counted.withColumn("proportion", F.col("n") / F.sum("n").over(Window.partitionBy("subject")))


def min_sample_size(strata: DataFrame) -> DataFrame:
    """(subject, n_items, min_size): the least size at which each cluster gives an item, at most the number of items."""
    shares = proportions(strata).groupBy("subject").agg(F.sum("n").alias("n_items"), F.min("proportion").alias("p"))
    return shares.select("subject", "n_items", F.least(F.ceil(F.lit(1.0) / F.col("p")), F.col("n_items")).alias("min_size"))


def size_for(proportion: float | None = None, size: int | None = None) -> int:
    """A sample size from a smallest proportion or as given; exactly one must be."""
    if (proportion is None) == (size is None):
        raise ValueError("give a proportion or a size")
    return math.ceil(1 / proportion) if size is None else size


def folds(samples: DataFrame, label: str = "yhat", most: int = 10) -> DataFrame:
    """(subject, minority, n_splits, adjusted): the minority's size, at most ten, and one less if below ten."""
    counted = samples.groupBy("subject", label).agg(F.count("*").alias("n")).groupBy("subject").agg(F.min("n").alias("minority"))
    splits = F.least(F.col("minority"), F.lit(most)).cast("long")
    return counted.select("subject", "minority", splits.alias("n_splits"), F.when(splits < most, splits - 1).otherwise(splits).alias("adjusted"))


def bootstrap_summary(coefs: DataFrame, estimates: DataFrame, level: float = 0.95, keys: tuple[str, ...] = ("subject", "feature")) -> DataFrame:
    """SE, percentile and SE intervals and verdicts from (keys, replicate, coef) and (keys, estimate).

    The SE interval is 1.96 SE whatever the level; 0 at an end counts as inside for it, and as outside for the percentiles."""
    ends = [(1 - level) / 2, (1 + level) / 2]
    spread = coefs.groupBy(*keys).agg(F.stddev_samp("coef").alias("se"), F.percentile("coef", F.array(*map(F.lit, ends))).alias("q"))
    return _judged(estimates.join(spread, list(keys)), keys)


def summary_of_arrays(blocks: DataFrame, estimates: DataFrame, level: float = 0.95, keys: tuple[str, ...] = ("subject", "feature")) -> DataFrame:
    """``bootstrap_summary`` from (keys, coefs) with a key's coefficients in several arrays; their number is a parameter of the job."""
    pooled = blocks.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("coefs"))).alias("c"), F.count("*").alias("_parts"))
    n = F.size("c")

    def percentile(p: float) -> Column:
        at = (n - 1) * F.lit(p)
        low = F.floor(at).cast("int")
        first, second = F.get("c", low), F.get("c", F.least(low + 1, n - 1))
        return first + (second - first) * (at - low)

    mean = F.aggregate("c", F.lit(0.0), lambda acc, v: acc + v) / n
    with_mean = pooled.withColumn("m", mean)
    squares = F.aggregate(F.transform("c", lambda v: (v - F.col("m")) * (v - F.col("m"))), F.lit(0.0), lambda acc, v: acc + v)
    spread = with_mean.select(*keys, F.when(n > 1, F.sqrt(squares / (n - 1))).alias("se"), F.array(percentile((1 - level) / 2), percentile((1 + level) / 2)).alias("q"))
    return _judged(estimates.join(spread, list(keys)), keys)


def _judged(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    low, high = F.col("estimate") - 1.96 * F.col("se"), F.col("estimate") + 1.96 * F.col("se")
    return rows.select(
        *keys,
        "estimate",
        "se",
        F.col("q")[0].alias("bootstrap_lower"),
        F.col("q")[1].alias("bootstrap_upper"),
        low.alias("se_lower"),
        high.alias("se_upper"),
        interval_verdict(F.col("q")[0], F.col("q")[1], strict=True).alias("bootstrap_verdict"),
        interval_verdict(low, high, strict=False).alias("se_verdict"),
    )


def five_numbers(df: DataFrame, value: str, *keys: str, places: int = 4) -> DataFrame:
    """Minimum, quartiles and maximum, rounded half to even."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = df.groupBy(*keys).agg(F.min(value).alias("lo"), q.alias("q"), F.max(value).alias("hi"))
    named = zip(("minimum", "q1", "median", "q3", "maximum"), (F.col("lo"), F.col("q")[0], F.col("q")[1], F.col("q")[2], F.col("hi")), strict=True)
    return found.select(*keys, *(F.bround(c.cast("double"), places).alias(n) for n, c in named))


def subset_count(n: int, sizes: range) -> int:
    """How many subsets of n items have a size in ``sizes``."""
    return sum(math.comb(n, k) for k in sizes)


def subset_counts(n: Column, least: int, most: int) -> Column:
    """``subset_count`` of a column, for sizes from least to most; exact as long as it fits."""
    choose = lambda k: F.aggregate(F.sequence(F.lit(1), k), F.lit(1).cast("decimal(38,0)"), lambda acc, i: (acc * (n - i + 1) / i).cast("decimal(38,0)"))
    sizes = F.filter(F.sequence(F.lit(least), F.lit(most)), lambda k: k <= n)
    return F.aggregate(F.transform(sizes, choose), F.lit(0).cast("decimal(38,0)"), lambda acc, v: (acc + v).cast("decimal(38,0)")).cast("long")


def middle(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean and median."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.median(value).alias("median"))


def heat_scale(weights: DataFrame, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """Weights by segment with the largest absolute weight of their key, for a symmetric colour scale; null weights are NaN."""
    most = F.max(F.abs("weight")).over(Window.partitionBy(*keys))
    return weights.withColumn("vmax", most).withColumn("weight", F.coalesce("weight", F.lit(float("nan"))))


def nan_to_zero(value: Column) -> Column:
    """0 for null and NaN."""
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
