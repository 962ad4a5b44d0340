"""Marginal influence: correlation of each feature's presence with the predicted label, and correlations between features or vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import cut
from ..functions import stats
from . import cohort, incidence, ranking


def influence(inc: DataFrame, samples: DataFrame, dof: str = "features", z: float = 1.0, unique: bool = True) -> DataFrame:
    """(subject, feature, n, sx, sxy, corr, se, lower, upper) of every feature of the subjects whose label varies.

    Four counts give r. se is sqrt((1 - r^2) / (k - 2)) with k the number of features (``dof='features'``) or samples; the interval is r
    plus and minus z * se within -1 and 1. A constant feature has r 0, se 1 and the interval -1 to 1. With k <= 2 the se is infinite,
    reported as null, and the interval -1 to 1. ``unique`` drops features equal to an earlier one first."""
    if dof not in ("features", "samples"):
        raise ValueError("dof must be features or samples")
    totals = samples.groupBy("subject").agg(F.count("*").alias("n"), F.sum("yhat").alias("sy"), F.count_distinct("yhat").alias("classes")).filter("classes >= 2")
    # Counts and signatures in one aggregation of the incidence; equal columns have equal counts.
    counted = inc.groupBy("subject", "feature").agg(F.count("*").alias("sx"), F.sum("yhat").alias("sxy"), *incidence.set_signature("sample"))
    if unique:
        counted = counted.groupBy("subject", *incidence.SIGNATURE).agg(F.min("feature").alias("feature"), F.first("sx").alias("sx"), F.first("sxy").alias("sxy"))
    counted = counted.select("subject", "feature", "sx", "sxy")
    rows = counted.join(totals.drop("classes"), "subject").withColumn("k", F.count("*").over(Window.partitionBy("subject")))
    r = stats.pearson_from_counts(F.col("n"), F.col("sx"), F.col("sy"), F.col("sxy"))
    constant = (F.col("sx") == 0) | (F.col("sx") == F.col("n"))
    df = (F.col("k") if dof == "features" else F.col("n")) - 2
    se = F.when(constant, F.lit(1.0)).when(df > 0, F.sqrt(F.try_divide(F.greatest(1 - F.col("corr") * F.col("corr"), F.lit(0.0)), df.cast("double"))))
    low, high = F.greatest(F.col("corr") - z * F.col("se"), F.lit(-1.0)), F.least(F.col("corr") + z * F.col("se"), F.lit(1.0))
    wide = constant | F.col("se").isNull()
    return (
        rows.withColumn("corr", F.when(constant, F.lit(0.0)).otherwise(r))
        .withColumn("se", se)
        .withColumn("lower", F.when(wide, F.lit(-1.0)).otherwise(low))
        .withColumn("upper", F.when(wide, F.lit(1.0)).otherwise(high))
        .select("subject", "feature", "n", "sx", "sxy", "corr", "se", "lower", "upper")
    )


def with_p(rows: DataFrame, level: float = 0.05) -> DataFrame:
    """``influence`` with the two-sided p of r, its verdict, and the interval as one struct."""
    constant = (F.col("sx") == 0) | (F.col("sx") == F.col("n"))
    p = F.when(constant, F.lit(1.0)).otherwise(stats.p_of_r(F.col("corr"), F.col("n").cast("double")))
    return rows.withColumn("p", p).withColumn("verdict", ranking.p_verdict(F.col("p"), level)).withColumn("corr_ci", F.struct(F.col("lower").alias("lo"), F.col("upper").alias("hi")))


def marginal_job(inc: DataFrame, samples: DataFrame, subjects: DataFrame | None = None, dof: str = "features") -> DataFrame:
    """The whole marginal job: selected subjects, repeated rows dropped, label that varies, unique features, correlation, verdict."""
    if subjects is not None:
        samples = cohort.selected(samples, subjects)
    kept = incidence.deduplicated(samples, inc.select("subject", "sample", "feature"))
    held = inc.join(kept.select("subject", "sample"), ["subject", "sample"], "left_semi")
    return with_p(influence(held, kept, dof))


def spearman_influence(inc: DataFrame, samples: DataFrame) -> DataFrame:
    """(subject, feature, rho, p). For 0/1 variables average ranks are affine in the values, so rho is r, with its p."""
    return with_p(influence(inc, samples, dof="samples")).select("subject", "feature", F.col("corr").alias("rho"), "p")


#: Parts of a subject's samples in ``gram``.
PARTS = 16


def gram(inc: DataFrame, value: str | None = None, tasks: int | None = None) -> DataFrame:
    """(subject, a, b, together) for a <= b: samples that hold both features.

    A subject's samples are dealt out in ``PARTS`` parts by hash. A task goes through its parts one after the other, adds each up in one
    matrix and emits it, so it holds one matrix at a time, and at most ``PARTS`` times features squared are shuffled for a subject, not
    the pairs of each sample. A sample's features number at most its subject's features. ``tasks`` deals rows out by so many, where the
    session's number of partitions is too low for them; a subject has as many parts, so that tasks can be as many."""
    parts = PARTS if tasks is None else max(PARTS, tasks)
    dealt = inc.select("subject", "sample", "feature", F.pmod(F.xxhash64("sample"), F.lit(parts)).alias("part"))
    dealt = dealt.repartition("subject", "part") if tasks is None else dealt.repartition(tasks, "subject", "part")
    rows = dealt.groupBy("subject", "part", "sample").agg(F.array_sort(F.collect_set("feature")).alias("held")).sortWithinPartitions("subject", "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, names, total = None, {}, np.zeros((0, 0))

        def emitted() -> pd.DataFrame:
            by_place = list(names)
            pairs = [(*sorted((by_place[i], by_place[j])), int(total[i, j])) for i, j in zip(*np.nonzero(np.triu(total)), strict=True)]
            return pd.DataFrame({"subject": [now[0]] * len(pairs), "a": [p[0] for p in pairs], "b": [p[1] for p in pairs], "n": [p[2] for p in pairs]})

        for batch in batches:
            for key, part in batch.groupby(["subject", "part"], sort=False, dropna=False):
                if key != now:
                    if names:
                        yield emitted()
                    now, names, total = key, {}, np.zeros((0, 0))
                lengths = part["held"].map(len).to_numpy()
                at = [names.setdefault(f, len(names)) for held in part["held"] for f in held]
                x = np.zeros((len(part), len(names)))
                x[np.repeat(np.arange(len(part)), lengths), at] = 1
                grown = len(names) - len(total)
                total = np.pad(total, ((0, grown), (0, grown))) + x.T @ x
        if names:
            yield emitted()

    kinds = {f.name: f.dataType.simpleString() for f in inc.schema.fields}
    partial = rows.select("subject", "part", "held").mapInPandas(run, f"subject {kinds['subject']}, a {kinds['feature']}, b {kinds['feature']}, n long")
    return partial.groupBy("subject", "a", "b").agg(F.sum("n").alias("together"))


def feature_correlations(inc: DataFrame, samples: DataFrame, tasks: int | None = None) -> DataFrame:
    """(subject, a, b, corr) for all pairs a < b of a subject's features, those that never meet too; 0 where one is constant.

    The result is the upper half of the subject's correlation matrix, features squared by definition."""
    # Written once: its diagonal has the samples of each feature.
    counted = cut(gram(inc, tasks=tasks))
    both, alone = counted.filter("a < b"), counted.filter("a = b").select("subject", F.col("a").alias("feature"), F.col("together").alias("s"))
    n = samples.groupBy("subject").agg(F.count("*").alias("n"))
    first, second = alone.toDF("subject", "a", "sa"), alone.toDF("subject", "b", "sb")
    listed = alone.groupBy("subject").agg(F.array_sort(F.collect_list("feature")).alias("all"))
    pairs = first.join(listed, "subject").select("subject", "a", "sa", F.explode(F.filter("all", lambda f: f > F.col("a"))).alias("b"))
    rows = pairs.join(second, ["subject", "b"]).join(both, ["subject", "a", "b"], "left").join(n, "subject")
    r = stats.pearson_from_counts(F.col("n"), F.col("sa"), F.col("sb"), F.coalesce("together", F.lit(0)))
    return rows.select("subject", "a", "b", r.alias("corr"))


#: Vectors in a block, at least; blocks of a subject, at most; vectors compared with a block at a time; cells that sums are kept for.
BLOCK, GRID, SLICE, KEPT = 256, 24, 4096, 1 << 22


def block_pairs(vectors: DataFrame) -> DataFrame:
    """(subject, i, j, block, item, cluster, vector): the rows of each unordered pair of a subject's blocks, i <= j, so that a large subject is on all tasks.

    Blocks are by hash of the item, of about ``BLOCK`` vectors and ``GRID`` in number at most: a vector is sent ``GRID`` times, however
    many there are, and a pair of blocks is compared in slices."""
    n = vectors.groupBy("subject").agg(F.least(F.ceil(F.count("*") / BLOCK), F.lit(GRID)).alias("n_blocks"))
    spread = vectors.join(n, "subject").withColumn("block", F.pmod(F.xxhash64("item"), F.col("n_blocks")))
    other = spread.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    return other.select("subject", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "item", "cluster", "vector")


def compared(vectors: DataFrame, run: Callable[[object, pd.DataFrame, pd.DataFrame, bool], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What ``run`` (subject, rows of block i, rows of block j, whether they are one) makes of each of the ``block_pairs``, one pair at a time in a task."""

    def pair(key: tuple, parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, (subject, i, j) = pd.concat(parts), key
        yield from run(subject, rows[rows["block"] == i], rows[rows["block"] == j], i == j)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for batch in batches:
            for key, part in batch.groupby(["subject", "i", "j"], sort=False):
                if key != now:
                    if held:
                        yield from pair(now, held)
                    now, held = key, []
                held.append(part)
        if held:
            yield from pair(now, held)

    spark = vectors.sparkSession
    # A stated number of partitions is not coalesced: pairs take long for their bytes.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return block_pairs(vectors).repartition(tasks, "subject", "i", "j").sortWithinPartitions("subject", "i", "j").mapInPandas(each, schema)


def slices(n: int, size: int) -> list[slice]:
    return [slice(at, min(at + size, n)) for at in range(0, n, size)]


def vector_correlations(vectors: DataFrame) -> DataFrame:
    """(subject, a, b, corr) of all pairs a < b of a subject's vectors: the result itself is quadratic. Computed block by block."""

    def run(subject: object, left: pd.DataFrame, right: pd.DataFrame, one: bool) -> Iterator[pd.DataFrame]:
        x, y = (_standard(np.stack(side["vector"].to_numpy())) for side in (left, right))
        ia, ib = left["item"].to_numpy(), right["item"].to_numpy()
        for p in slices(len(x), BLOCK):
            for q in slices(len(y), SLICE):
                r = x[p] @ y[q].T
                a, b = np.meshgrid(ia[p], ib[q], indexing="ij")
                keep = a < b if one else a != b
                a, b = a[keep], b[keep]
                yield pd.DataFrame({"subject": subject, "a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "corr": r[keep]})

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return compared(vectors, run, f"subject {kinds['subject']}, a {kinds['item']}, b {kinds['item']}, corr double")


def _standard(x: np.ndarray) -> np.ndarray:
    x = x - x.mean(axis=1, keepdims=True)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances between rows."""
    own = (x**2).sum(1)[:, None]
    squares = own + (y**2).sum(1)[None, :] - 2 * x @ y.T
    apart = np.sqrt(np.maximum(squares, 0))
    for i, j in np.argwhere(squares < 1e-6 * np.maximum(own, 1e-300)):  # where the difference of squares has no digits left
        apart[i, j] = np.sqrt(((x[i] - y[j]) ** 2).sum())
    return apart


def distance_sums(vectors: DataFrame) -> DataFrame:
    """(subject, item, own, cluster, total, n): summed Euclidean distance from each item to each cluster of its subject."""

    def side(rows: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame, np.ndarray, np.ndarray]:
        """Vectors, rows, cluster names and each row's cluster by place, in order of the clusters."""
        rows = rows.sort_values("cluster", kind="stable")
        names, at = np.unique(rows["cluster"].to_numpy(), return_inverse=True)
        return np.stack(rows["vector"].to_numpy()), rows, names, at

    def listed(subject: object, rows: pd.DataFrame, names: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> pd.DataFrame:
        own = {c: np.repeat(rows[c].to_numpy(), len(names)) for c in ("item", "cluster")}
        return pd.DataFrame({"subject": subject, "item": own["item"], "own": own["cluster"], "cluster": np.tile(names, len(rows)), "total": totals.ravel(), "n": np.tile(counts, len(rows))})

    def run(subject: object, left: pd.DataFrame, right: pd.DataFrame, one: bool) -> Iterator[pd.DataFrame]:
        (x, left, lc, la), (y, right, rc, ra) = side(left), side(right)
        # The other side's sums are kept over all of this side, or over a slice of it where there are too many clusters.
        step = len(x) if len(y) * len(lc) <= KEPT else BLOCK
        for whole in slices(len(x), step):
            first, last = la[whole.start], la[whole.stop - 1] + 1
            back = np.zeros((len(y), last - first))
            for p in slices(whole.stop - whole.start, BLOCK):
                p = slice(whole.start + p.start, whole.start + p.stop)
                there = np.zeros((p.stop - p.start, len(rc)))
                starts = np.flatnonzero(np.diff(la[p], prepend=-1))
                for q in slices(len(y), SLICE):
                    d = _apart(x[p], y[q])
                    cuts = np.flatnonzero(np.diff(ra[q], prepend=-1))
                    there[:, ra[q][cuts]] += np.add.reduceat(d, cuts, axis=1)
                    if not one:
                        back[q, la[p][starts] - first] += np.add.reduceat(d, starts, axis=0).T
                yield listed(subject, left.iloc[p], rc, np.bincount(ra), there)
            if not one:
                yield listed(subject, right, lc[first:last], np.bincount(la[whole] - first), back)

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    partial = compared(vectors, run, f"subject {kinds['subject']}, item {kinds['item']}, own {kinds['cluster']}, cluster {kinds['cluster']}, total double, n long")
    return partial.groupBy("subject", "item", "own", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def silhouette(vectors: DataFrame) -> DataFrame:
    """(subject, silhouette, n): mean Euclidean silhouette; an item alone in its cluster counts 0, one cluster only gives null."""
    sums = distance_sums(vectors)
    inner = F.try_divide(F.sum(F.when(F.col("cluster") == F.col("own"), F.col("total"))), F.sum(F.when(F.col("cluster") == F.col("own"), F.col("n") - 1)).cast("double"))
    outer = F.min(F.when(F.col("cluster") != F.col("own"), F.try_divide(F.col("total"), F.col("n").cast("double"))))
    each = sums.groupBy("subject", "item", "own").agg(inner.alias("a"), outer.alias("b"))
    value: Column = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return each.groupBy("subject").agg(F.when(F.count("b") > 0, F.avg(value)).alias("silhouette"), F.count("*").alias("n"))


def edges(items: DataFrame) -> DataFrame:
    """(subject, i, j) for all ordered pairs i <> j of a subject's items: one row for each, as the graph has an edge for each."""
    listed = items.groupBy("subject").agg(F.array_sort(F.collect_set("item")).alias("all"))
    return items.join(listed, "subject").select("subject", F.col("item").alias("i"), F.explode("all").alias("j")).filter("i <> j")
