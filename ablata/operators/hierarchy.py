"""Spanning trees, threshold components and agglomerative hierarchies of all subjects at once, on distance edges.

Edges (subject, a, b, d) with a < b are rows; a subject is spread over all tasks, and a round works on all subjects together, so the number
of rounds follows from the largest subject and not from how many there are. Clusters are named by their least item, and equal distances
are taken in the order of (d, a, b), which makes every result unique. Each round's tables are written; the driver sees a count of each.

Spanning trees go by rounds in which every component takes its least edge to another one. Hierarchies go by rounds in which all pairs that
are each other's nearest merge: for single, complete, average and Ward linkage no merge brings others closer, so that these are the
merges of the plain procedure, in another order. Between clusters only one value is kept for a pair: the least or greatest
distance, or the mean of distances or squared distances by the numbers of items, so that a pair of merged clusters is one aggregate of
the pairs before. Ward's distance follows from the mean square, the clusters' inner squares and their sizes.

A subject with one item has no edges and no merges. Items without edges to others stay alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import stored
from .correlation import BLOCK, SLICE, compared, slices

LINKAGES = ("ward", "complete", "average", "single")


def _compared_edges(vectors: DataFrame, metrics: tuple[str, ...], tree: bool) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    far = ", far double" if tree else ""
    schema = f"subject {kinds['subject']}, metric string, a {kinds['item']}, b {kinds['item']}, d double{far}"

    def run(subject: object, left: pd.DataFrame, right: pd.DataFrame, one: bool) -> Iterator[pd.DataFrame]:
        rows = _edges(subject, left, right, one, metrics)
        yield from _forests(rows) if tree else rows

    return compared(vectors.withColumn("cluster", F.lit(0)), run, schema)


def _forests(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a pair of blocks' edges those of its least spanning forest by metric, in the order of (d, a, b), with its greatest distance on each."""
    kept: dict[str, pd.DataFrame] = {}
    far: dict[str, float] = {}
    for part in rows:
        if not len(part):
            continue
        # Slice by slice: an edge that isn't in the forest of some of the edges isn't in that of all.
        metric = part["metric"].iloc[0]
        far[metric] = max(far.get(metric, -math.inf), float(part["d"].max()))
        kept[metric] = _forest(part if metric not in kept else pd.concat([kept[metric], part]))
    for metric, part in kept.items():
        yield part.assign(far=far[metric])


def _forest(edges: pd.DataFrame) -> pd.DataFrame:
    a, b, d = (edges[c].to_numpy() for c in ("a", "b", "d"))
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.lexsort((b, a, d))
    i, j = ends[: len(a)], ends[len(a) :]
    root, left, taken = list(range(len(names))), len(names) - 1, []

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for at, p, q in zip(order.tolist(), i[order].tolist(), j[order].tolist(), strict=True):
        p, q = top(p), top(q)
        if p != q:
            root[q] = p
            taken.append(at)
            if len(taken) == left:
                break
    return edges.iloc[taken]


def forest_edges(vectors: DataFrame, metrics: tuple[str, ...] = ("euclidean",)) -> DataFrame:
    """(subject, metric, a, b, d, far): edges among which each subject's least spanning tree is: those of the forest of each pair of blocks, with the pair's greatest
    distance. A subject of one block has its tree's edges only, where ``distance_edges`` has all pairs."""
    return _compared_edges(vectors, metrics, True)


def distance_edges(vectors: DataFrame, metrics: tuple[str, ...] = ("euclidean",)) -> DataFrame:
    """(subject, metric, a, b, d) for all pairs a < b of a subject's (subject, item, vector): quadratic by definition, block against block."""
    return _compared_edges(vectors, metrics, False)


def _edges(subject: object, left: pd.DataFrame, right: pd.DataFrame, one: bool, metrics: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    """All edges between two blocks, or within one, in frames of one metric."""
    x, y, others = np.stack(left["vector"].to_numpy()), np.stack(right["vector"].to_numpy()), right["item"].to_numpy()
    lengths = {"x": np.linalg.norm(x, axis=1), "y": np.linalg.norm(y, axis=1)}
    for q in slices(len(y), SLICE):
        for p in slices(len(x), BLOCK):
            found = {metric: [] for metric in metrics}
            ends = []
            for k, item in zip(range(p.start, p.stop), left["item"].to_numpy()[p], strict=True):
                keep = np.flatnonzero(others[q] > item if one else others[q] != item) + q.start
                ends.append((np.minimum(item, others[keep]), np.maximum(item, others[keep])))
                for metric in metrics:
                    if metric == "cosine":
                        d = np.clip(1 - y[keep] @ x[k] / np.maximum(lengths["x"][k] * lengths["y"][keep], 1e-300), 0, 2)
                    else:
                        d = np.sqrt(((y[keep] - x[k]) ** 2).sum(1))
                    found[metric].append(d)
            a, b = (np.concatenate(e) for e in zip(*ends, strict=True))
            for metric in metrics:
                yield pd.DataFrame({"subject": subject, "metric": metric, "a": a, "b": b, "d": np.concatenate(found[metric])})


def _both_ways(edges: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Each edge as seen from either end: (keys, c, edge as (d, a, b), ...)."""
    edge = F.struct("d", "a", "b").alias("edge")
    return edges.select(*keys, F.explode(F.array("a", "b")).alias("c"), edge, *more)


def _roots(parents: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, node, root) of (keys, node, parent), where roots are their own parents, by doubling; ``most`` bounds a path's length."""
    now = stored(parents.select(*keys, "node", F.col("parent").alias("root")))
    for _ in range(max(1, math.ceil(math.log2(max(most, 2))))):
        up = now.select(*keys, F.col("node").alias("root"), F.col("root").alias("_up"))
        # Stored, as each step uses the one before twice.
        now = stored(now.join(up, [*keys, "root"]).select(*keys, "node", F.col("_up").alias("root")))
    return now


def spanning_tree(edges: DataFrame, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """The least spanning forest's edges (keys, a, b, d), by rounds of least edges and contraction."""
    by = list(keys)
    kept = edges.select(*by, "a", "b", "d")
    # Edges between components, each with the items' edge that it is.
    now, found = stored(kept.withColumn("edge", F.struct("d", "a", "b"))), []
    while True:
        ends = now.select(*by, F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("other")), F.struct(F.col("b").alias("c"), F.col("a").alias("other")))).alias("x"), "edge")
        least = ends.groupBy(*by, "x.c").agg(F.min(F.struct("edge", "x.other")).alias("m")).select(*by, "c", "m.edge", "m.other")
        least = stored(least)
        most = least.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if most is None:
            break
        found.append(least.select(*by, "edge.*").distinct())
        # Two components that take the same edge point at each other: the lesser one is the root.
        mutual = least.select(*by, F.col("c").alias("other"), F.col("other").alias("_back"))
        pointed = least.join(mutual, [*by, "other"], "left")
        parent = F.when((F.col("_back") == F.col("c")) & (F.col("c") < F.col("other")), F.col("c")).otherwise(F.col("other"))
        roots = _roots(pointed.select(*by, F.col("c").alias("node"), parent.alias("parent")), by, most)
        ra, rb = roots.select(*by, F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(*by, F.col("node").alias("b"), F.col("root").alias("rb"))
        between = now.join(ra, [*by, "a"]).join(rb, [*by, "b"]).filter("ra <> rb")
        # Of the edges between two components only the least can be in the tree.
        now = stored(between.groupBy(*by, F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min("edge").alias("edge")))
    out = kept.limit(0)
    for part in found:
        out = out.unionByName(part)
    return out


def _value(linkage: Column, weighted: Column, pairs: Column) -> Column:
    return F.when(linkage == "single", F.min("value")).when(linkage == "complete", F.max("value")).otherwise(F.sum(weighted) / pairs)


def merges(edges: DataFrame, linkages: tuple[str, ...] = LINKAGES, keys: tuple[str, ...] = ("subject",), rounds: int | None = None) -> DataFrame:
    """(keys, linkage, a, b, height, size_a, size_b, round): clusters a and b, named by their least items, become a. Ward's heights are squares, as its sums are.

    ``edges`` may be a spanning tree for single linkage; the others need all pairs. ``rounds`` ends early."""
    by = [*keys, "linkage"]
    start = edges.select(*keys, "a", "b", "d", F.explode(F.array(*map(F.lit, linkages))).alias("linkage"))
    one, none = F.lit(1).cast("long"), F.lit(0.0)
    first = start.select(*by, "a", "b", F.when(F.col("linkage") == "ward", F.col("d") * F.col("d")).otherwise(F.col("d")).alias("value"), one.alias("n_a"), one.alias("n_b"), none.alias("inner_a"), none.alias("inner_b"))
    now, found, made = stored(_with_distance(first)), [], 0
    sides = ["n_a", "n_b", "inner_a", "inner_b", "value"]
    while rounds is None or made < rounds:
        nearest = _both_ways(now, by, *sides).groupBy(*by, "c").agg(F.min(F.struct("edge", *sides)).alias("m"))
        pairs = nearest.select(*by, "m.*").groupBy(*by, "edge").agg(F.count("*").alias("ends"), *(F.first(c).alias(c) for c in sides)).filter("ends = 2")
        merged = stored(pairs.select(*by, "edge.a", "edge.b", F.col("edge.d").alias("height"), *sides))
        if merged.isEmpty():
            break
        made += 1
        found.append(merged.select(*by, "a", "b", "height", F.col("n_a").alias("size_a"), F.col("n_b").alias("size_b"), F.lit(made).alias("round")))
        # Both names of a pair lead to the new cluster, with its size and inner square.
        both = F.col("n_a") + F.col("n_b")
        inner = (F.col("n_a") * F.col("n_a") * F.col("inner_a") + F.col("n_b") * F.col("n_b") * F.col("inner_b") + F.col("n_a") * F.col("n_b") * F.col("value")) / (both * both)
        into = merged.select(*by, F.explode(F.array("a", "b")).alias("c"), F.col("a").alias("to"), both.alias("n"), inner.alias("inner"))
        moved = now
        for end in ("a", "b"):
            moved = moved.join(into.select(*by, F.col("c").alias(end), *(F.col(x).alias(f"{x}_new_{end}") for x in ("to", "n", "inner"))), [*by, end], "left")
        count = F.col("n_a") * F.col("n_b")
        new = lambda x, end: F.coalesce(f"{x}_new_{end}", end if x == "to" else f"{x}_{end}")
        ends = {end: F.struct(new("to", end).alias("c"), new("n", end).alias("n"), new("inner", end).alias("inner")) for end in ("a", "b")}
        moved = moved.select(*by, F.least(ends["a"], ends["b"]).alias("lo"), F.greatest(ends["a"], ends["b"]).alias("hi"), "value", count.alias("count")).filter("lo.c <> hi.c")
        grouped = moved.groupBy(*by, "lo", "hi").agg(_value(F.col("linkage"), F.col("value") * F.col("count"), F.sum("count")).alias("value"))
        now = stored(_with_distance(grouped.select(*by, F.col("lo.c").alias("a"), F.col("hi.c").alias("b"), "value", F.col("lo.n").alias("n_a"), F.col("hi.n").alias("n_b"), F.col("lo.inner").alias("inner_a"), F.col("hi.inner").alias("inner_b"))))
    empty = edges.select(*keys, F.lit("").alias("linkage"), "a", "b", F.lit(0.0).alias("height"), F.lit(0).cast("long").alias("size_a"), F.lit(0).cast("long").alias("size_b"), F.lit(0).alias("round")).limit(0)
    for part in found:
        empty = empty.unionByName(part)
    return empty


def _with_distance(pairs: DataFrame) -> DataFrame:
    ward = 2 * F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")) * (F.col("value") - F.col("inner_a") - F.col("inner_b"))
    return pairs.withColumn("d", F.when(F.col("linkage") == "ward", ward).otherwise(F.col("value")))


def labels_at(items: DataFrame, merged: DataFrame, least: int, most: int, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """(keys, linkage, k, item, label): each item's cluster, named by its least item, for every k of ``least`` to ``most`` that the subject can have.

    The first n - k merges in order of height each point from the cluster that is gone to the one that stays; labels are the ends of paths."""
    by = [*keys, "linkage"]
    order = Window.partitionBy(*by).orderBy("height", "a", "b")
    ranked = merged.withColumn("rank", F.row_number().over(order))
    n = items.groupBy(*keys).agg(F.count("*").alias("n"))
    top = n.agg(F.max("n")).first()[0] or 1
    names = merged.select(*by).distinct()
    each = items.join(n, list(keys)).join(names, list(keys)).withColumn("k", F.explode(F.sequence(F.lit(least), F.lit(most)))).filter("k <= n")
    gone = ranked.select(*by, F.col("b").alias("item"), F.col("a").alias("_into"), "rank")
    placed = each.join(gone, [*by, "item"], "left")
    parent = F.when(F.col("rank") <= F.col("n") - F.col("k"), F.col("_into")).otherwise(F.col("item"))
    parents = placed.select(*by, "k", F.col("item").alias("node"), parent.alias("parent"))
    return _roots(parents, [*by, "k"], top).select(*by, "k", F.col("node").alias("item"), F.col("root").alias("label"))


def tree_clusters(items: DataFrame, tree: DataFrame, least: int, most: int, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """``labels_at`` of the tree without its k - 1 heaviest edges."""
    return labels_at(items, merges(tree, ("single",), keys), least, most, keys).drop("linkage")


def threshold_components(items: DataFrame, edges: DataFrame, least: float = 0.15, most: float = 0.97, n: int = 1000) -> DataFrame:
    """(subject, metric, step, threshold, k, label_sum): the components of a subject's items at each of ``n`` similarities, where the similarity of two items
    is one less their distance by the subject's greatest; label_sum adds up every item's label, its component's least item.

    The merges of the spanning tree, in order, say all of it: a threshold's components are the items less the merges so far, and a merge of a
    and b takes (b - a) off the labels of b's items. ``edges`` are all ``distance_edges``, or the ``forest_edges``, which say the greatest distance themselves."""
    keys = ("subject", "metric")
    # Written once: distances aren't made again for each use.
    edges = stored(edges)
    far = edges.groupBy(*keys).agg(F.max("far" if "far" in edges.columns else "d").alias("far"))
    done = merges(spanning_tree(edges, keys), ("single",), keys).join(far, list(keys))
    steps = done.select(*keys, (1 - F.col("height") / F.greatest("far", F.lit(1e-300))).alias("at"), F.lit(0).alias("last"), F.lit(None).cast("int").alias("step"), F.lit(1).alias("merge"), (F.col("size_b") * (F.col("b") - F.col("a"))).cast("long").alias("off"))
    totals = items.groupBy("subject").agg(F.count("*").alias("n"), F.sum("item").cast("long").alias("labels")).join(far.select(*keys), "subject")
    width = (most - least) / max(n - 1, 1)
    asked = totals.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("step"))
    asked = asked.select(*keys, (F.lit(least) + F.col("step") * F.lit(width)).alias("at"), F.lit(1).alias("last"), "step", F.lit(0).alias("merge"), F.lit(0).cast("long").alias("off"))
    # From the greatest similarity down; merges at a threshold count.
    order = Window.partitionBy(*keys).orderBy(F.desc("at"), "last")
    run = steps.unionByName(asked).withColumn("merged", F.sum("merge").over(order)).withColumn("taken", F.sum("off").over(order))
    return run.filter("step is not null").join(totals, list(keys)).select(*keys, "step", F.col("at").alias("threshold"), (F.col("n") - F.col("merged")).cast("int").alias("k"), (F.col("labels") - F.col("taken")).alias("label_sum"))
