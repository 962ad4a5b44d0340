"""Subset sampling and enumeration, all keyed: the same seed draws the same subsets on any cluster.

A subset's items are the first k in the order of md5(seed|subject|sample|item), a uniform draw without replacement. Samples are made by
exploding a sequence, so their number is the result's size and nothing more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keyed
from . import metrics, reshape


@dataclass(frozen=True)
class SizeRule:
    """Least and most subset size, as counts or as shares of the items, but not both."""

    min_size: int | None = None
    max_size: int | None = None
    min_share: float | None = None
    max_share: float | None = None

    def __post_init__(self) -> None:
        for size, share, name in ((self.min_size, self.min_share, "min"), (self.max_size, self.max_share, "max")):
            if size is not None and share is not None:
                raise ValueError(f"give {name}_size or {name}_share")
            if size is not None and size < 1:
                raise ValueError(f"{name}_size must be at least 1")
            if share is not None and not 0 < share <= 1:
                raise ValueError(f"{name}_share must be in (0, 1]")
        if self.min_size and self.max_size and self.min_size > self.max_size or self.min_share and self.max_share and self.min_share > self.max_share:
            raise ValueError("the least size is above the most")

    def bounds(self, n: Column) -> tuple[Column, Column]:
        """Least and most size for n items."""
        least = F.ceil(n * self.min_share) if self.min_share else F.lit(self.min_size or 1)
        most = F.floor(n * self.max_share) if self.max_share else F.lit(self.max_size) if self.max_size else n
        most = F.least(F.greatest(most, F.lit(1)), n).cast("long")
        return F.least(least.cast("long"), most), most


def sample_sizes(strata: DataFrame, n_samples: int, seed: int) -> DataFrame:
    """(subject, sample, size): uniform from the least size that reaches every cluster to all items."""
    grid = metrics.min_sample_size(strata).select("subject", "n_items", "min_size", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("sample"))
    return grid.select("subject", "sample", size_of(seed).alias("size"))


def size_of(seed: int, sample: Column | None = None) -> Column:
    """A sample's size from (subject, sample, min_size, n_items)."""
    return keyed.between(F.col("min_size"), F.col("n_items"), seed, F.col("subject"), F.col("sample") if sample is None else sample)


def order_of(seed: int, feature: Column) -> Column:
    """What a sample takes its items by, from (subject, sample)."""
    return keyed.key(seed, F.col("subject"), F.col("sample"), feature)


def stratified(strata: DataFrame, n_samples: int, seed: int = 0) -> DataFrame:
    """(subject, sample, cluster, feature): cluster c gives round-half-even(size * share of c) items, at most all it has."""
    quotas = (
        metrics.proportions(strata)
        .join(sample_sizes(strata, n_samples, seed), "subject")
        .select("subject", "sample", "cluster", F.least(F.bround(F.col("size") * F.col("proportion")).cast("long"), F.col("n")).alias("k"))
    )
    return _first_k(strata.join(quotas, ["subject", "cluster"]), ("subject", "sample", "cluster"), seed).select("subject", "sample", "cluster", "feature")


def _first_k(rows: DataFrame, groups: tuple[str, ...], seed: int) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(order_of(seed, F.col("feature")), "feature")
    return rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= F.col("k")).drop("_r", "k")


def uniform(items: DataFrame, n_samples: int, rule: SizeRule = SizeRule(), seed: int = 0) -> DataFrame:
    """(subject, sample, feature): sizes uniform within the rule, items without replacement."""
    n = items.groupBy("subject").agg(F.count("*").alias("n"))
    least, most = rule.bounds(F.col("n"))
    grid = n.select("subject", least.alias("least"), most.alias("most"), F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("sample"))
    sized = grid.select("subject", "sample", keyed.between(F.col("least"), F.col("most"), seed, F.col("subject"), F.col("sample")).alias("k"))
    return _first_k(items.join(sized, "subject"), ("subject", "sample"), seed).select("subject", "sample", "feature")


def pools(single_scores: DataFrame) -> DataFrame:
    """(subject, feature, pool): whether an item alone is scored right; from (subject, feature, y, yhat)."""
    return single_scores.select("subject", "feature", F.when(F.col("yhat") == F.col("y"), "positive").otherwise("negative").alias("pool"))


def balanced(pooled: DataFrame, n_samples: int | DataFrame, share: float, rule: SizeRule = SizeRule(), seed: int = 0, plain: bool = False) -> DataFrame:
    """(subject, sample, feature, pool): int(size * share) items of the positive pool and the rest of the negative, as far as they go.

    ``n_samples`` is their number for all subjects, or a table (subject, n_samples). With ``plain``, a subject with one pool only gives
    as many items of it as the size says."""
    sizes = pooled.groupBy("subject").agg(F.count("*").alias("n"), F.count_if(F.col("pool") == "positive").alias("np"))
    least, most = rule.bounds(F.col("n"))
    sizes = sizes.withColumn("n_samples", F.lit(n_samples)) if isinstance(n_samples, int) else sizes.join(n_samples, "subject")
    numbers = F.explode(F.sequence(F.lit(0), F.col("n_samples").cast("int") - 1)).alias("sample")
    grid = sizes.filter("n_samples > 0").select("subject", "n", "np", least.alias("least"), most.alias("most"), numbers)
    sized = grid.withColumn("size", keyed.between(F.col("least"), F.col("most"), seed, F.col("subject"), F.col("sample")))
    wanted = F.floor(F.col("size") * share).cast("long")
    if plain:
        wanted = F.when(F.col("np") == F.col("n"), F.col("size")).when(F.col("np") == 0, F.lit(0)).otherwise(wanted)
    quota = sized.select("subject", "sample", F.least(wanted, F.col("np")).alias("kp"), F.least(F.col("size") - wanted, F.col("n") - F.col("np")).alias("kn"))
    rows = pooled.join(quota, "subject").withColumn("k", F.when(F.col("pool") == "positive", F.col("kp")).otherwise(F.col("kn"))).drop("kp", "kn")
    return _first_k(rows, ("subject", "sample", "pool"), seed)


def until_quota(scored: DataFrame, n: int, share: float = 0.5) -> DataFrame:
    """Samples (subject, sample, yhat, y) in order, up to and with the first at which a class reaches its quota.

    A sample is positive if yhat is y; the quotas are int(n * share) positives and the rest negatives. The window runs over one
    subject's samples, whose number is a parameter of the job."""
    quota = int(n * share)
    before = Window.partitionBy("subject").orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)
    right = (F.col("yhat") == F.col("y")).cast("int")
    counted = scored.withColumn("_p", F.coalesce(F.sum(right).over(before), F.lit(0))).withColumn("_n", F.coalesce(F.sum(1 - right).over(before), F.lit(0)))
    return counted.filter((F.col("_p") < quota) & (F.col("_n") < n - quota)).drop("_p", "_n")


def deficits(kept: DataFrame, n: int, share: float = 0.5) -> DataFrame:
    """(subject, need_positive, need_negative) after ``until_quota``: what stage two tops up."""
    right = F.count_if(F.col("yhat") == F.col("y"))
    quota = int(n * share)
    return kept.groupBy("subject").agg(F.greatest(quota - right, F.lit(0)).alias("need_positive"), F.greatest((n - quota) - (F.count("*") - right), F.lit(0)).alias("need_negative"))


def top_up(pooled: DataFrame, needs: DataFrame, strong: float = 0.85, rule: SizeRule = SizeRule(), seed: int = 1) -> DataFrame:
    """(subject, sample, feature, pool, side): subsets rich in one pool, as many as the deficient side of each subject needs.

    A subject with one pool only gets plain subsets of it."""
    sides = []
    for side, share in (("positive", strong), ("negative", 1 - strong)):
        need = needs.select("subject", F.col(f"need_{side}").alias("n_samples"))
        sides.append(balanced(pooled, need, share, rule, seed + (side == "negative"), plain=True).withColumn("side", F.lit(side)))
    return sides[0].unionByName(sides[1])


def until_share(subsets: DataFrame, target: float, threshold: float) -> DataFrame:
    """(subject, sample, positives, size) in order, up to the first sample at which the share of positives so far is near the target."""
    order = Window.partitionBy("subject").orderBy("sample").rowsBetween(Window.unboundedPreceding, 0)
    share = F.try_divide(F.sum("positives").over(order).cast("double"), F.sum("size").over(order).cast("double"))
    marked = subsets.withColumn("share", share).withColumn("_near", (F.abs(share - target) <= threshold).cast("int"))
    reached = F.coalesce(F.sum("_near").over(Window.partitionBy("subject").orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("_r", reached).filter("_r = 0").drop("_near", "_r")


def all_subsets(items: DataFrame, sizes: tuple[int, int] | None = None, most_items: int = 20) -> DataFrame:
    """(subject, mask, size, features): every subset, or those with a size in the range; more than ``most_items`` items raise."""
    listed = items.groupBy("subject").agg(F.array_sort(F.collect_set("feature")).alias("all"))
    n = F.when(F.size("all") <= most_items, F.size("all")).otherwise(F.raise_error(F.lit(f"more than {most_items} items")).cast("int"))
    masks = listed.withColumn("n", n).select("subject", "all", F.explode(F.expr("sequence(1L, shiftleft(1L, n) - 1)")).alias("mask"))
    held = F.expr("filter(all, (x, i) -> (mask & shiftleft(1L, i)) <> 0)")
    sized = masks.withColumn("size", F.bit_count("mask").cast("int")).withColumn("features", held).drop("all")
    return sized if sizes is None else sized.filter(F.col("size").between(*sizes))


def bootstrap_rows(n: int, replicates: Column | int, seed: int, spark) -> DataFrame:
    """(replicate, draw, row): n draws of n rows with replacement in each replicate."""
    grid = spark.range(replicates).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    return grid.withColumn("row", keyed.whole(seed, F.col("replicate"), F.col("draw")) % n)


def minority_top_up(draws: DataFrame, labels: DataFrame, n_splits: int, seed: int) -> DataFrame:
    """Draws (replicate, draw, row) where a replicate's rarer class with fewer than n_splits draws gets the last n_splits ones.

    The replaced draws come from the rarer class's rows in ``labels`` (row, y); replicates with one class draw the absent one."""
    labelled = draws.join(labels, "row")
    counts = labelled.groupBy("replicate").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"), F.max("draw").alias("last"))
    short = counts.select("replicate", "last", F.when(F.col("n0") <= F.col("n1"), 0).otherwise(1).alias("rare"), (F.least("n0", "n1") < n_splits).alias("short"))
    placed = reshape.numbered(labels.select("row", "y"), "y", "row")
    sizes = placed.groupBy("y").agg(F.count("*").alias("of")).withColumnRenamed("y", "rare")
    marked = draws.join(short, "replicate").join(sizes, "rare", "left")
    swap = F.col("short") & (F.col("draw") > F.col("last") - n_splits) & F.col("of").isNotNull()
    place = F.when(swap, keyed.whole(seed, F.col("replicate"), F.col("draw"), "swap") % F.col("of"))
    # Only the few draws that are replaced have a place to look up.
    found = marked.withColumn("place", place).join(placed.select(F.col("y").alias("rare"), F.col("position").alias("place"), F.col("row").alias("other")), ["rare", "place"], "left")
    return found.select("replicate", "draw", F.coalesce("other", "row").alias("row"))


def split(rows: DataFrame, share: float, label: str | None = "y", key: str = "id", seed: int = 42) -> DataFrame:
    """Rows with ``part``: ceil(share * n) of each class (or of all) are test, the others train."""
    groups = [label] if label else []
    order = Window.partitionBy(*groups).orderBy(keyed.key(seed, F.col(key)), key)
    total = F.count("*").over(Window.partitionBy(*groups))
    return rows.withColumn("part", F.when(F.row_number().over(order) <= F.ceil(total * share), "test").otherwise("train"))


def monte_carlo(items: DataFrame, n_samples: int, most_size: int, right_only: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Uniform subsets of up to ``most_size`` items, of those scored right alone if ``right_only`` (subject, feature) is given."""
    pool = items if right_only is None else items.join(right_only, ["subject", "feature"], "left_semi")
    return uniform(pool, n_samples, SizeRule(max_size=most_size), seed)
