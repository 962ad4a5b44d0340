"""Ridge classification from statistics that add up: nothing holds a subject's samples whole.

A subject's samples are dealt into blocks of about ``BLOCK`` rows by their place in their class, so the size of every block and class follows
from three numbers. A block of packed bits gives, for each fold, the counts, sums and co-occurrences of its rows; blocks are added in a
tree of groups of ``FAN``, a fold is left out by subtraction, and the only dense step is a solve of features by features. A held-out fold is
ranked from its packed bits, once for each of ``PARTS`` parts of the grid, so that what is shuffled doesn't go with the number of penalties; a
fold of more than ``FOLD_BYTES`` sends its margins to a rank aggregate instead. A subject of one block ranks them in place.

The bootstrap is an exact multinomial split: a replicate's n draws are divided between the classes and then down a tree of block ranges by
binomial draws keyed by (seed, subject, replicate, range), so that a block knows its own number without the others, draws its rows, and
sends the weighted statistics on. A replicate whose rarer class has fewer than ``TOP_UP`` draws has that many draws, taken from all, replaced by
draws of that class: the classes' counts are known at the root, and how many of the replaced draws were of each class is hypergeometric.

Subjects with one class only, or without features, have a row with the reason in ``error``. Features equal to others are solved as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import cut, stored
from . import linear, metrics, reshape

#: Rows of a block, blocks that one task adds, replicates of a chunk, blocks that a task of the bootstrap is sent.
BLOCK, FAN, CHUNK, SENT = 20_000, 32, 500, 64
#: Sums of whole numbers below this are exact in single precision.
EXACT = 1 << 24
#: Parts of a grid that a fold is sent to, and the most that a fold may take in one task: packed bits and 16 bytes a row.
PARTS, FOLD_BYTES = 4, 32 << 20
#: Samples that a task sorts and joins at a time, where the session's number of partitions is too low for them.
TASK_ROWS = 250_000
#: Draws of the rarer class below which a replicate is topped up: the estimator's default number of folds.
TOP_UP = 10


def blocks(inc: DataFrame, samples: DataFrame, rows: int = BLOCK) -> DataFrame:
    """(subject, block, blocks, n0, n1, k, names, bits, labels, folds): packed rows of each block; n0 and n1 are the subject's rows by class, k its folds.

    Folds deal each class out in turn in the order of its samples. Subjects without features have no names; labels above 0 count as 1."""
    kinds = {f.name: f.dataType.simpleString() for f in inc.schema.fields}
    labelled = samples.select("subject", "sample", (F.col("yhat") > 0).cast("int").alias("y"))
    classes = labelled.groupBy("subject").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    least = F.least("n0", "n1", F.lit(10))
    classes = classes.withColumn("blocks", F.ceil((F.col("n0") + F.col("n1")) / rows)).withColumn("k", F.greatest(F.when(least >= 10, least).otherwise(least - 1), F.lit(2)).cast("int"))
    classes = cut(classes)  # one row for each subject
    total = classes.agg(F.sum(F.col("n0") + F.col("n1"))).first()[0] or 0
    parts = max(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))
    placed = reshape.numbered(labelled.withColumn("_class", F.struct("subject", "y")), "_class", "sample", parts).drop("_class").join(classes, "subject")
    own = F.when(F.col("y") == 1, F.col("n1")).otherwise(F.col("n0"))
    dealt = placed.select("subject", "sample", "y", "blocks", "n0", "n1", "k", (F.col("position") % F.col("k")).cast("int").alias("fold"), F.call_function("div", F.col("position") * F.col("blocks"), own).alias("block"))
    features = inc.select("subject", "feature").distinct()
    names = features.groupBy("subject").agg(F.array_sort(F.collect_list("feature")).alias("names"))
    held = inc.select("subject", "sample", "feature").repartition(parts, "subject", "sample").groupBy("subject", "sample").agg(F.collect_set("feature").alias("held"))
    joined = dealt.repartition(parts, "subject", "sample").join(held, ["subject", "sample"], "left").repartition(parts, "subject", "block")
    # Each block has its subject's names beside it, so that features become places without a join of the incidence.
    beside = names.join(classes.select("subject", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")), "subject")

    def run(group: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({c: [] for c in ("subject", "block", "blocks", "n0", "n1", "k", "width", "bits", "labels", "folds", "names")})
        group = group.sort_values("sample", kind="stable")
        names = list(own["names"].iloc[0]) if len(own) else None
        lists = [() if h is None else h for h in group["held"]]
        place = {} if names is None else {f: i for i, f in enumerate(names)}
        at = np.fromiter((place[f] for h in lists for f in h), int)
        width = 1 + at.max(initial=-1)
        x = np.zeros((len(lists), width), bool)
        x[np.repeat(np.arange(len(lists)), [len(h) for h in lists]), at] = True
        first = group.iloc[0]
        return pd.DataFrame([{"subject": first["subject"], "block": first["block"], "blocks": first["blocks"], "n0": first["n0"], "n1": first["n1"], "k": first["k"], "width": width,
                              "bits": np.packbits(x, axis=1).tobytes(), "labels": group["y"].to_numpy(np.uint8).tobytes(), "folds": group["fold"].to_numpy(np.uint8).tobytes(), "names": names}])

    schema = f"subject {kinds['subject']}, block long, blocks long, n0 long, n1 long, k int, width int, bits binary, labels binary, folds binary, names array<{kinds['feature']}>"
    return cut(joined.groupBy("subject", "block").cogroup(beside.groupBy("subject", "block")).applyInPandas(run, schema))


def _rows(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's 0/1 matrix over all features of its subject, its labels and its folds."""
    y = np.frombuffer(row.labels, np.uint8).astype(int)
    x = np.zeros((len(y), 0 if row.names is None else len(row.names)))
    if row.width:
        x[:, : row.width] = np.unpackbits(np.frombuffer(row.bits, np.uint8).reshape(len(y), -1), axis=1)[:, : row.width]
    return x, y, np.frombuffer(row.folds, np.uint8).astype(int)


def statistics(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each row of ``weights``: the weighted count, sum of targets (-1 or 1), sums of the columns, of columns by target, and of column products.

    Sums are made in the precision of ``weights`` and returned in double."""
    x, (a, b) = np.asarray(x, weights.dtype), np.triu_indices(x.shape[1])
    target = np.where(y > 0, 1.0, -1.0).astype(weights.dtype)
    wide = np.concatenate([np.ones((len(y), 1), weights.dtype), target[:, None], x, x * target[:, None]], axis=1)
    out = [weights @ wide]
    # Products in slices, so that memory is bounded by rows times a slice; by columns, which are each in one piece.
    columns = np.ascontiguousarray(x.T)
    out += [weights @ (columns[a[at : at + 256]] * columns[b[at : at + 256]]).T for at in range(0, len(a), 256)]
    return np.concatenate(out, axis=1).astype(float)


def solved(stats: np.ndarray, d: int, alphas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (statistics by alpha by feature) and intercepts of each row of statistics."""
    n, st, s, xt = stats[:, 0], stats[:, 1], stats[:, 2 : 2 + d], stats[:, 2 + d : 2 + 2 * d]
    a, b = np.triu_indices(d)
    gram = np.zeros((len(stats), d, d))
    gram[:, a, b] = gram[:, b, a] = stats[:, 2 + 2 * d :]
    mean, level = s / n[:, None], st / n
    gram -= n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    right = xt - st[:, None] * mean
    if len(alphas) == 1:
        gram[:, np.arange(d), np.arange(d)] += alphas[0]
        beta = np.linalg.solve(gram, right[:, :, None])[:, None, :, 0]
    else:
        values, vectors = np.linalg.eigh(gram)
        turned = np.einsum("sij,si->sj", vectors, right)
        beta = np.einsum("sij,saj->sai", vectors, turned[:, None, :] / (np.maximum(values, 0)[:, None, :] + alphas[None, :, None]))
    return beta, level[:, None] - np.einsum("sai,si->sa", beta, mean)


def summed(parts: DataFrame, most_blocks: int, keys: tuple[str, ...] = ("subject",), fan: int = FAN) -> DataFrame:
    """(keys, block, payload) with equal-sized payloads of doubles to one row for each key, added in groups of ``fan`` at most."""
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        total = np.sum([np.frombuffer(p, np.float64) for p in group["payload"]], axis=0)
        return group.iloc[:1][[*keys, "block"]].assign(payload=[total.tobytes()])

    while most_blocks > 1:
        dealt = parts.withColumn("block", F.call_function("div", "block", F.lit(fan)))
        parts = dealt.select(*keys, "block", "payload").groupBy(*keys, "block").applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in (*keys, "block", "payload")))
        most_blocks = -(-most_blocks // fan)
    return parts


def _most(packed: DataFrame) -> int:
    return packed.agg(F.max("blocks")).first()[0] or 0


def fold_statistics(packed: DataFrame, fan: int = FAN) -> DataFrame:
    """(subject, k, n0, n1, names, payload): ``statistics`` of each fold, one row for each subject."""
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                x, y, fold = _rows(row)
                payload = statistics(x, y, (fold[None, :] == np.arange(row.k)[:, None]).astype(float))
                yield pd.DataFrame({"subject": [row.subject], "block": [row.block], "payload": [payload.tobytes()]})

    parts = packed.mapInPandas(run, f"subject {kinds['subject']}, block long, payload binary")
    about = packed.filter("block = 0").select("subject", "k", "n0", "n1", "names")
    return about.join(summed(parts, _most(packed), fan=fan).drop("block"), "subject")


def statistic_rows(folded: DataFrame) -> DataFrame:
    """(subject, fold, kind, a, b, value) of ``fold_statistics``: n, target, count, by_target and together, as rows."""
    kinds = {f.name: f.dataType.simpleString() for f in folded.schema.fields}
    item = kinds["names"][6:-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                names = [] if row.names is None else list(row.names)
                a, b = np.triu_indices(len(names))
                cells = [("n", None, None), ("target", None, None), *(("count", f, None) for f in names), *(("by_target", f, None) for f in names), *(("together", names[i], names[j]) for i, j in zip(a, b, strict=True))]
                for fold, values in enumerate(np.frombuffer(row.payload, np.float64).reshape(row.k, -1)):
                    yield pd.DataFrame([(row.subject, fold, *cell, float(v)) for cell, v in zip(cells, values, strict=True)], columns=["subject", "fold", "kind", "a", "b", "value"])

    return folded.mapInPandas(run, f"subject {kinds['subject']}, fold int, kind string, a {item}, b {item}, value double")


def _models(folded: DataFrame, alphas: np.ndarray) -> DataFrame:
    """(subject, error, names, coefs): the coefficients and intercept for each alpha of each fold left out, and of all rows as the last."""
    kinds = {f.name: f.dataType.simpleString() for f in folded.schema.fields}

    def one(row) -> tuple[str | None, bytes]:
        if not row.n0 or not row.n1:
            return "one class only", b""
        if row.names is None or not len(row.names):
            return "no features", b""
        stats = np.frombuffer(row.payload, np.float64).reshape(row.k, -1)
        total = stats.sum(0)
        # A fold that is all there is of its subject has no rest to fit; its rows aren't scored.
        rest = np.concatenate([np.where((total[0] - stats[:, :1]) > 0, total - stats, total), total[None]])
        beta, intercept = solved(rest, len(row.names), alphas)
        return None, np.concatenate([beta, intercept[:, :, None]], axis=2).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [one(row) for row in batch.itertuples(index=False)]
            yield pd.DataFrame({"subject": batch["subject"], "error": [m[0] for m in made], "coefs": [m[1] for m in made]})

    done = folded.select("subject", "k", "n0", "n1", "names", "payload").mapInPandas(run, f"subject {kinds['subject']}, error string, coefs binary")
    return cut(done)


def _scorable(row, fold: int) -> bool:
    """Whether a fold and the rest of its subject have both classes: the class sizes of fold f of k, of n rows dealt out in turn."""
    sizes = [(n - fold + row.k - 1) // row.k for n in (row.n0, row.n1)]
    return min(sizes) > 0 and row.n0 > sizes[0] and row.n1 > sizes[1]


def _margins(x: np.ndarray, coefs: np.ndarray) -> np.ndarray:
    """Rows by settings. Equal rows have equal margins whichever block they are in: their last digits depend on the shape of the product."""
    return np.round(x @ coefs[:, :-1].T + coefs[:, -1], 10) + 0.0


def _fold_aucs(packed: DataFrame, models: DataFrame, n_alphas: int) -> DataFrame:
    """(subject, fold, setting, auc) where the fold and the rest have both classes."""
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema.fields}
    joined = packed.join(models.filter("error is null").select("subject", "coefs"), "subject")
    schema = f"subject {kinds['subject']}, fold int, setting int, auc double"

    def folds(row):
        """(fold, labels, margins by setting) of a block's rows in each fold that can be scored."""
        x, y, fold = _rows(row)
        coefs = np.frombuffer(row.coefs, np.float64).reshape(row.k + 1, n_alphas, -1)
        for f in filter(lambda f: _scorable(row, f), range(row.k)):
            yield f, y[fold == f], _margins(x[fold == f], coefs[f])

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                for f, y, margins in folds(row):
                    yield pd.DataFrame({"subject": row.subject, "fold": f, "setting": np.arange(n_alphas), "auc": [linear.auc(y, m) for m in margins.T]})

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                for f, y, margins in folds(row):
                    for setting, m in enumerate(margins.T):
                        yield pd.DataFrame({"subject": row.subject, "fold": f, "setting": setting, "margin": m, "y": y})

    fold_bytes = (F.col("n0") + F.col("n1")) / F.col("k") * (16 + F.ceil(F.size("names") / 8))
    here = _dealt(joined.filter("blocks = 1")).mapInPandas(whole, schema)
    several = packed.filter("blocks > 1").filter(fold_bytes <= FOLD_BYTES)
    margins = joined.filter("blocks > 1").filter(fold_bytes > FOLD_BYTES).mapInPandas(ranked, f"subject {kinds['subject']}, fold int, setting int, margin double, y int")
    return here.unionByName(_packed_aucs(several, models, n_alphas)).unionByName(metrics.roc_auc(margins, "margin", "y", ("subject", "fold", "setting")).drop("n"))


def _packed_aucs(packed: DataFrame, models: DataFrame, n_alphas: int) -> DataFrame:
    """``_fold_aucs`` from each fold's packed bits, gathered for each part of the grid. Rows equal in features and label are scored as one."""
    kind = packed.schema["subject"].dataType.simpleString()
    grid = np.array_split(np.arange(n_alphas), min(PARTS, n_alphas))

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                y, fold = np.frombuffer(row.labels, np.uint8), np.frombuffer(row.folds, np.uint8)
                # The last features may be in no row of a block: all blocks have the subject's width.
                bits = np.zeros((len(y), -(-len(row.names) // 8)), np.uint8)
                if row.width:
                    bits[:, : -(-row.width // 8)] = np.frombuffer(row.bits, np.uint8).reshape(len(y), -1)
                for f in filter(lambda f: _scorable(row, f), range(row.k)):
                    own = {"subject": row.subject, "fold": f, "d": len(row.names), "cells": np.column_stack([bits, y])[fold == f].tobytes()}
                    yield pd.DataFrame([own | {"part": part} for part in range(len(grid))])

    def coefficients(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                coefs = np.frombuffer(row.coefs, np.float64).reshape(row.k + 1, n_alphas, -1)
                yield pd.DataFrame([{"subject": row.subject, "fold": f, "part": part, "coefs": coefs[f, own].tobytes()} for f in range(row.k) for part, own in enumerate(grid)])

    def scored(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(model):
            return pd.DataFrame({"subject": [], "fold": [], "setting": [], "auc": []})
        first = rows.iloc[0]
        d, settings = int(first["d"]), grid[int(first["part"])]
        coefs = np.frombuffer(model["coefs"].iloc[0], np.float64).reshape(len(settings), d + 1)
        cells = np.frombuffer(b"".join(rows["cells"]), np.uint8).reshape(-1, -(-d // 8) + 1)
        different, counts = np.unique(cells.view(f"V{cells.shape[1]}").ravel(), return_counts=True)
        different = different.view(np.uint8).reshape(-1, cells.shape[1])
        x, y = different[:, :-1], different[:, -1].astype(int)
        # In slices, so that neither the dense rows nor the margins of all settings are held at once.
        at = range(0, len(x), BLOCK)
        aucs = []
        for some in np.array_split(coefs, -(-len(settings) // 5)):
            margins = np.concatenate([_margins(np.unpackbits(x[i : i + BLOCK], axis=1)[:, :d].astype(float), some) for i in at])
            aucs += [linear.auc_of_groups(y, counts, m) for m in margins.T]
        return pd.DataFrame({"subject": first["subject"], "fold": first["fold"], "setting": settings, "auc": aucs})

    rows = packed.filter("size(names) > 0").mapInPandas(dealt, f"subject {kind}, fold int, part int, d int, cells binary")
    sound = models.filter("error is null").join(packed.filter("block = 0").select("subject", "k"), "subject")
    model = sound.mapInPandas(coefficients, f"subject {kind}, fold int, part int, coefs binary")
    keys = ("subject", "fold", "part")
    return rows.groupBy(*keys).cogroup(model.groupBy(*keys)).applyInPandas(scored, f"subject {kind}, fold int, setting int, auc double")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    return linear._dealt(rows, *(keys or ("subject", "block")))


def fit_blocks(packed: DataFrame, alphas: np.ndarray = linear.RIDGE_GRID, fan: int = FAN) -> DataFrame:
    """(subject, feature, estimate, intercept, alpha, mix, mean_auc, max_fold_auc, error): the alpha with the best mean AUC over folds, the first of ties."""
    alphas = np.asarray(alphas, float)
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema.fields}
    models = _models(fold_statistics(packed, fan), alphas)
    by_setting = _fold_aucs(packed, models, len(alphas)).groupBy("subject", "setting").agg(F.avg("auc").alias("mean_auc"), F.max("auc").alias("max_fold_auc"))
    top = by_setting.groupBy("subject").agg(F.max("mean_auc").alias("top"))
    # Equal scores of neighbouring settings differ in their last digits only.
    near = by_setting.join(top, "subject").filter(F.col("mean_auc") >= F.col("top") - 1e-12)
    best = near.groupBy("subject").agg(F.min(F.struct("setting", "mean_auc", "max_fold_auc")).alias("b")).select("subject", "b.*")
    names = packed.filter("block = 0").select("subject", "names", "k")
    rows = models.join(names, "subject").join(best, "subject", "left")
    item = kinds["names"][6:-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["subject", "feature", "estimate", "intercept", "alpha", "mix", "mean_auc", "max_fold_auc", "error"]
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.error is not None:
                    yield pd.DataFrame([(row.subject, *[None] * 7, row.error)], columns=columns)
                    continue
                at = 0 if row.setting is None or math.isnan(row.setting) else int(row.setting)
                coefs = np.frombuffer(row.coefs, np.float64).reshape(row.k + 1, len(alphas), -1)[-1, at]
                rest = (float(coefs[-1]), float(alphas[at]), 0.0, row.mean_auc, row.max_fold_auc, None)
                yield pd.DataFrame([(row.subject, name, float(c), *rest) for name, c in zip(row.names, coefs, strict=False)], columns=columns)

    schema = f"subject {kinds['subject']}, feature {item}, estimate double, intercept double, alpha double, mix double, mean_auc double, max_fold_auc double, error string"
    return rows.select("subject", "error", "names", "k", "coefs", "setting", "mean_auc", "max_fold_auc").mapInPandas(run, schema)


def fit(inc: DataFrame, samples: DataFrame, alphas: np.ndarray = linear.RIDGE_GRID) -> DataFrame:
    """``fit_blocks`` of the samples' blocks."""
    return fit_blocks(blocks(inc, samples), alphas)


def class_draws(key: list[int], n0: int, n1: int, top_up: int = TOP_UP) -> tuple[int, int]:
    """How many of a replicate's n0 + n1 draws are of each class, topped up."""
    draw = np.random.default_rng([*key, 0])
    n = n0 + n1
    one = int(draw.binomial(n, n1 / n))
    zero = n - one
    rare, common = (zero, one) if zero <= one else (one, zero)
    if rare < min(top_up, n) and n0 and n1:
        gone = int(draw.hypergeometric(rare, common, min(top_up, n)))
        rare, common = rare - gone + min(top_up, n), common - (min(top_up, n) - gone)
        zero, one = (rare, common) if zero <= one else (common, rare)
    return zero, one


def block_size(n: int, blocks: int, lo: int, hi: int) -> int:
    """How many of a class's n places are in blocks lo to hi - 1, place p being in block p * blocks // n."""
    before = lambda b: -(-b * n // blocks)
    return before(hi) - before(lo)


def block_draws(key: list[int], draws: int, n: int, blocks: int, block: int, known: dict | None = None) -> int:
    """How many of a class's draws fall into a block: binomial splits of ranges of blocks, keyed by the range. ``known`` keeps splits for other blocks."""
    lo, hi = 0, blocks
    known = {} if known is None else known
    while hi - lo > 1:
        mid = (lo + hi) // 2
        taken = known.get((*key, lo, hi))
        if taken is None:
            left, total = block_size(n, blocks, lo, mid), block_size(n, blocks, lo, hi)
            taken = known[*key, lo, hi] = int(np.random.default_rng([*key, 1, lo, hi]).binomial(draws, left / total)) if total else 0
        lo, hi, draws = (lo, mid, taken) if block < mid else (mid, hi, draws - taken)
    return draws


def block_counts(key: list[int], y: np.ndarray, n0: int, n1: int, blocks: int, block: int, top_up: int = TOP_UP) -> np.ndarray:
    """How often a replicate draws each row of a block."""
    counts = np.zeros(len(y))
    for label, (n, draws) in enumerate(zip((n0, n1), class_draws(key, n0, n1, top_up), strict=True)):
        at = np.flatnonzero(y == label)
        own = block_draws([*key, 2 + label], draws, n, blocks, block)
        if len(at):
            counts[at] = np.bincount(np.random.default_rng([*key, 4 + label, block]).integers(0, len(at), own), minlength=len(at))
    return counts


def chunk_statistics(key: list[int], replicates: range, x: np.ndarray, y: np.ndarray, n0: int, n1: int, blocks: int, block: int, known: dict) -> np.ndarray:
    """``statistics`` of a block's rows, each as often as ``block_counts`` has it, for each replicate. ``known`` keeps the splits of one group of blocks."""
    places = [np.flatnonzero(y == label) for label in (0, 1)]
    counts, ends = np.zeros((len(replicates), len(y)), np.float32), (0, len(places[0]), len(y))
    most = 0
    for i, r in enumerate(replicates):
        draws = known.get(r)
        if draws is None:
            draws = known[r] = class_draws([*key, r], n0, n1)
        own = [block_draws([*key, r, 2 + label], draws[label], n, blocks, block, known) for label, n in enumerate((n0, n1))]
        most = max(most, sum(own))
        for label, at in enumerate(places):
            if len(at):
                counts[i, ends[label] : ends[label + 1]] = np.bincount(np.random.default_rng([*key, r, 4 + label, block]).integers(0, len(at), own[label]), minlength=len(at))
    order = np.concatenate(places)
    return statistics(x[order], y[order], counts if most < EXACT else counts.astype(float))


def bootstrap_arrays(packed: DataFrame, settings: DataFrame, replicates: int, seed: int = 0, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(subject, first, feature, coefs): each feature's coefficients in ``chunk`` replicates from ``first`` on, at the subject's chosen alpha."""
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema.fields}
    chosen = settings.filter("error is null").groupBy("subject").agg(F.first("alpha").alias("alpha"))
    work = packed.join(chosen, "subject").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // chunk))))

    def weighted(row, known: dict) -> np.ndarray:
        x, y, _ = _rows(row)
        first = int(row.chunk) * chunk
        return chunk_statistics([seed, linear.hash_key(row.subject)], range(first, min(first + chunk, replicates)), x, y, row.n0, row.n1, row.blocks, row.block, known)

    def refitted(subject, at: int, names, alpha: float, stats: np.ndarray) -> pd.DataFrame:
        coefs = solved(stats, len(names), np.array([alpha]))[0][:, 0, :].T
        return pd.DataFrame({"subject": subject, "first": at * chunk, "feature": list(names), "coefs": list(coefs)})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield refitted(row.subject, int(row.chunk), row.names, row.alpha, weighted(row, {}))

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # One group of blocks after the other, added as they come: only their sum goes on.
        now, total, known = None, None, {}
        made = lambda: pd.DataFrame({"subject": [now[0]], "chunk": [now[1]], "block": [now[2]], "payload": [total.tobytes()]})
        for batch in batches:
            for row in batch.itertuples(index=False):
                key = (row.subject, row.chunk, row.part)
                if key != now:
                    if now is not None:
                        yield made()
                    now, total, known = key, 0.0, {}
                total = total + weighted(row, known)
        if now is not None:
            yield made()

    def from_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                d = len(row.names)
                yield refitted(row.subject, int(row.chunk), row.names, row.alpha, np.frombuffer(row.payload, np.float64).reshape(-1, 2 + 2 * d + d * (d + 1) // 2))

    schema = f"subject {kinds['subject']}, first int, feature {kinds['names'][6:-1]}, coefs array<double>"
    here = _dealt(work.filter("blocks = 1"), "subject", "chunk").mapInPandas(whole, schema)
    by = ("subject", "chunk", "part")
    n_blocks, most = packed.agg(F.count("*"), F.max("blocks")).first()
    spark = packed.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-n_blocks * (1 + (replicates - 1) // chunk) // SENT))
    dealt = work.filter("blocks > 1").withColumn("part", F.call_function("div", "block", F.lit(fan))).repartition(tasks, *by).sortWithinPartitions(*by, "block")
    several = dealt.mapInPandas(parts, f"subject {kinds['subject']}, chunk int, block long, payload binary")
    sums = summed(several, -(-(most or 0) // fan), ("subject", "chunk"), fan).join(chosen, "subject").join(packed.filter("block = 0").select("subject", "names"), "subject")
    return here.unionByName(sums.select("subject", "chunk", "names", "alpha", "payload").mapInPandas(from_sums, schema))


def coefficient_path(packed: DataFrame, alphas: list[float]) -> DataFrame:
    """(subject, alpha, feature, coef) along a grid, without cross-validation."""
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema.fields}
    grid = np.asarray(alphas, float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.names is not None and len(row.names):
                    beta, _ = solved(np.frombuffer(row.payload, np.float64).reshape(row.k, -1).sum(0)[None], len(row.names), np.append(grid, 1.0))
                    yield pd.DataFrame({"subject": row.subject, "alpha": np.repeat(grid, len(row.names)), "feature": np.tile(np.asarray(row.names), len(grid)), "coef": beta[0, :-1].ravel()})

    return fold_statistics(packed).mapInPandas(run, f"subject {kinds['subject']}, alpha double, feature {kinds['names'][6:-1]}, coef double")


def job(inc: DataFrame, samples: DataFrame, replicates: int = 250, alphas: np.ndarray = linear.RIDGE_GRID, seed: int = 0, tasks: int | None = None) -> DataFrame:
    """The whole conditional job: repeated rows dropped, unique features, fit, bootstrap and summary. Subjects that fail have no row; ``fit`` says why.

    ``tasks`` deals the samples out by so many, where the session's number of partitions is too low for them."""
    from . import incidence

    # Both are used several times: written, so that the incidence isn't joined again for each use.
    rows = stored(incidence.deduplicated(samples, inc.select("subject", "sample", "feature"), tasks))
    held = inc.select("subject", "sample", "feature").join(rows.select("subject", "sample"), ["subject", "sample"], "left_semi")
    held = stored(held)
    kept = held.join(incidence.unique_features(held), ["subject", "feature"], "left_semi")
    packed = blocks(kept, rows)
    fitted = cut(fit_blocks(packed, alphas))
    sound = fitted.filter("error is null").select("subject", "feature", "estimate")
    return metrics.summary_of_arrays(bootstrap_arrays(packed, fitted, replicates, seed), sound)
