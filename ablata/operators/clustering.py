"""Clustering sweeps of a subject's items and low-dimensional embeddings, in numpy within each subject.

A subject's items are images, tens to hundreds; each subject is one group. Random starts follow the subject's key.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .linear import hash_key

#: Where sweeps begin, and the score of no result.
MIN_CLUSTERS, NO_SCORE = 3, -100.0
LINKAGES = ("ward", "complete", "average", "single")


def pairwise(x: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distances between rows."""
    if metric == "cosine":
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return np.clip(1 - u @ u.T, 0, 2)
    squares = (x**2).sum(1)
    d = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    return d


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette from distances; NaN unless there are 2 to n - 1 clusters."""
    names, back, counts = np.unique(labels, return_inverse=True, return_counts=True)
    if not 2 <= len(names) <= len(labels) - 1:
        return float("nan")
    sums = np.stack([d[:, back == c].sum(1) for c in range(len(names))], axis=1)
    own = counts[back]
    a = sums[np.arange(len(back)), back] / np.maximum(own - 1, 1)
    means = sums / counts
    means[np.arange(len(back)), back] = np.inf
    b = means.min(1)
    return float(np.where(own == 1, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300)).mean())


def relabel(labels: np.ndarray) -> np.ndarray:
    """Labels 0, 1, … in order of first appearance."""
    _, first, back = np.unique(labels, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[back]


def connected(linked: np.ndarray) -> np.ndarray:
    """Component labels of a boolean adjacency matrix."""
    n, labels, now = len(linked), np.full(len(linked), -1), 0
    for start in range(n):
        if labels[start] < 0:
            edge = [start]
            while edge:
                i = edge.pop()
                if labels[i] < 0:
                    labels[i] = now
                    edge += np.flatnonzero(linked[i] & (labels < 0)).tolist()
            now += 1
    return labels


def spanning_tree(d: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges of a minimum spanning tree, from the lightest (Prim)."""
    n, out = len(d), []
    best, source, inside = d[0].copy(), np.zeros(n, int), np.zeros(n, bool)
    inside[0] = True
    for _ in range(n - 1):
        j = int(np.where(inside, np.inf, best).argmin())
        out.append((float(best[j]), int(source[j]), j))
        inside[j] = True
        closer = d[j] < best
        best, source = np.where(closer, d[j], best), np.where(closer, j, source)
    return sorted(out)


def tree_clusters(d: np.ndarray, k: int) -> np.ndarray:
    """k components of the spanning tree without its k - 1 heaviest edges."""
    linked = np.zeros(d.shape, bool)
    for _, i, j in spanning_tree(d)[: len(d) - k]:
        linked[i, j] = linked[j, i] = True
    return connected(linked)


def agglomerative(x: np.ndarray, linkage: str, d: np.ndarray | None = None) -> list[np.ndarray]:
    """Labels for every number of clusters: element k - 1 has k. Lance-Williams updates of ``d`` (or Euclidean distances)."""
    n = len(x)
    work = (pairwise(x) if d is None else d).astype(float).copy()
    if linkage == "ward":
        work = work**2
    np.fill_diagonal(work, np.inf)
    sizes, labels, out = np.ones(n), np.arange(n), [np.arange(n)]
    for _ in range(n - 1):
        i, j = sorted(np.unravel_index(work.argmin(), work.shape))
        a, b, between = work[i], work[j], work[i, j]
        if linkage == "single":
            new = np.minimum(a, b)
        elif linkage == "complete":
            new = np.maximum(np.where(np.isinf(a), -np.inf, a), np.where(np.isinf(b), -np.inf, b))
        elif linkage == "average":
            new = (sizes[i] * a + sizes[j] * b) / (sizes[i] + sizes[j])
        else:
            new = ((sizes + sizes[i]) * a + (sizes + sizes[j]) * b - sizes * between) / (sizes + sizes[i] + sizes[j])
        gone = np.isinf(a) & np.isinf(b)
        new = np.where(gone, np.inf, new)
        work[i, :], work[:, i] = new, new
        work[i, i] = np.inf
        work[j, :], work[:, j] = np.inf, np.inf
        sizes[i] += sizes[j]
        labels = np.where(labels == labels[j], labels[i], labels) if labels[j] != labels[i] else labels
        out.append(labels.copy())
    return [relabel(v) for v in reversed(out)]


def _first_centres(x: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """k-means++: each centre drawn by its squared distance from those before."""
    places, near = [int(draw.integers(len(x)))], None
    while len(places) < k:
        apart = ((x - x[places[-1]]) ** 2).sum(1)
        near = apart if near is None else np.minimum(near, apart)
        if near.sum() > 0:
            shares = (near / near.sum()).cumsum()
            places.append(int((shares / shares[-1]).searchsorted(draw.random(), side="right")))
        else:
            places.append(int(draw.integers(len(x))))
    return x[places]


def _settled(x: np.ndarray, centres: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres of several runs of k-means at once, one for each element of ``centres``; a run that has settled is left alone."""
    n, (runs, k, _) = len(x), centres.shape
    labels, moving = np.zeros((runs, n), int), np.arange(runs)
    for _ in range(rounds):
        now = centres[moving]
        labels[moving] = own = ((x[None, :, None, :] - now[:, None]) ** 2).sum(3).argmin(2)
        cell = (own + k * np.arange(len(moving))[:, None]).ravel()
        order = np.argsort(cell, kind="stable")
        starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
        new, counts = now.copy(), np.diff(starts, append=len(order))
        new.reshape(len(moving) * k, -1)[cell[order[starts]]] = np.add.reduceat(x[order % n], starts, axis=0) / counts[:, None]
        far = (np.abs(new - now) > 1e-8 + 1e-5 * np.abs(now)).any((1, 2))
        moving = moving[far]
        if not len(moving):
            break
        centres[moving] = new[far]
    return labels, centres


#: Cells of the differences between rows and centres that runs of k-means are made together for.
TOGETHER = 1 << 19


def kmeans(x: np.ndarray, k: int, seed: int, tries: int = 4, rounds: int = 100) -> np.ndarray:
    """Labels of the best of several k-means++ runs."""
    best, least = np.zeros(len(x), int), np.inf
    starts = np.stack([_first_centres(x, k, np.random.default_rng([seed, k, attempt])) for attempt in range(tries)])
    step = max(TOGETHER // max(x.size * k, 1), 1)
    for at in range(0, tries, step):
        for labels, c in zip(*_settled(x, starts[at : at + step], rounds), strict=True):
            cost = ((x - c[labels]) ** 2).sum()
            if cost < least:
                best, least = labels, cost
    return best


def affinity(s: np.ndarray, damping: float = 0.9, rounds: int = 400) -> np.ndarray:
    """Affinity propagation on similarities, with the median as preference."""
    n = len(s)
    s = s.copy()
    np.fill_diagonal(s, np.median(s[~np.eye(n, dtype=bool)]) if n > 1 else 0)
    r, a, at = np.zeros((n, n)), np.zeros((n, n)), np.arange(n)
    for _ in range(rounds):
        both = a + s
        top = both.argmax(1)
        most = both[at, top]
        both[at, top] = -np.inf
        second = both.max(1)
        new = s - most[:, None]
        new[at, top] = s[at, top] - second
        r = damping * r + (1 - damping) * new
        up = np.maximum(r, 0)
        np.fill_diagonal(up, r.diagonal())
        new = up.sum(0)[None, :] - up
        own = new.diagonal().copy()
        new = np.minimum(new, 0)
        np.fill_diagonal(new, own)
        a = damping * a + (1 - damping) * new
    heads = np.flatnonzero((a + r).diagonal() > 0)
    if not len(heads):
        return np.zeros(n, int)
    labels = s[:, heads].argmax(1)
    labels[heads] = np.arange(len(heads))
    return labels


def spectral_vectors(x: np.ndarray, kind: str) -> np.ndarray:
    """Eigenvectors of the normalised Laplacian of a nearest-neighbour (5) or rbf graph, from the smoothest."""
    d = pairwise(x)
    if kind == "rbf":
        w = np.exp(-(d**2) / x.shape[1])
    else:
        near = np.argsort(d, axis=1)[:, : min(6, len(x))]
        w = np.zeros_like(d)
        w[np.arange(len(x))[:, None], near] = 1
        w = (w + w.T) / 2
    root = 1 / np.sqrt(np.maximum(w.sum(1), 1e-12))
    return np.linalg.eigh(np.eye(len(x)) - root[:, None] * w * root[None, :])[1]


def spectral(x: np.ndarray, k: int, kind: str, seed: int = 0, vectors: np.ndarray | None = None) -> np.ndarray:
    """Spectral clustering on the graph's ``spectral_vectors``, which all k share."""
    low = (spectral_vectors(x, kind) if vectors is None else vectors)[:, :k]
    return kmeans(low / np.maximum(np.linalg.norm(low, axis=1, keepdims=True), 1e-12), k, seed)


def louvain(w: np.ndarray) -> np.ndarray:
    """Communities by greedy modularity (Louvain) of non-negative weights."""
    w = np.maximum(w, 0).astype(float)
    np.fill_diagonal(w, 0)
    members = [[i] for i in range(len(w))]
    while w.sum() > 0:
        n, total, degree = len(w), w.sum(), w.sum(1)
        label, moved = np.arange(n), True
        while moved:
            moved = False
            for i in range(n):
                own = label[i]
                label[i] = -1
                names = np.unique(label[(w[i] > 0) & (label >= 0)])
                gain = {c: w[i, label == c].sum() - degree[i] * degree[label == c].sum() / total for c in {*names.tolist(), own}}
                best = max(sorted(gain), key=gain.get)
                label[i] = best if gain[best] > gain[own] + 1e-12 else own
                moved |= label[i] != own
        names = np.unique(label)
        if len(names) == n:
            break
        members = [sum((members[i] for i in np.flatnonzero(label == c)), []) for c in names]
        fold = (label[:, None] == names[None, :]).astype(float)
        w = fold.T @ w @ fold
    out = np.zeros(sum(map(len, members)), int)
    for c, own in enumerate(members):
        out[own] = c
    return relabel(out)


def candidates(x: np.ndarray, seed: int, adjacency: np.ndarray | None = None, most: int | None = None):
    """(algorithm, linkage, k, labels, seconds) of the whole sweep; k runs from ``MIN_CLUSTERS + 1`` to n - 3. The seconds that all k of
    a hierarchy take together are at its first."""
    top = max(len(x) - 3, MIN_CLUSTERS) if most is None else most
    ks, d = range(MIN_CLUSTERS + 1, top + 1), pairwise(x)
    w = np.corrcoef(x) if adjacency is None else adjacency

    def hierarchy(name: str, linkage: str, of: np.ndarray, far: np.ndarray | None):
        began = time.perf_counter()
        levels = agglomerative(of, linkage.split("-")[0], far)
        took = time.perf_counter() - began
        for k in ks:
            if k <= len(levels):
                yield name, linkage, k, levels[k - 1], took
                took = 0.0

    def timed(name: str, kind: str | None, k: int | None, run: Callable[[], np.ndarray]):
        began = time.perf_counter()
        labels = run()
        return name, kind, len(np.unique(labels)) if k is None else k, labels, time.perf_counter() - began

    for linkage in LINKAGES:
        yield from hierarchy("agglomerative", linkage, x, None)
    for metric in ("euclidean", "cosine"):
        far = pairwise(w, metric)
        for linkage in ("single", "average", "complete"):
            yield from hierarchy("hierarchical", f"{linkage}-{metric}", w, far)
    shared: dict[str, np.ndarray] = {}

    def by_graph(kind: str, k: int) -> np.ndarray:
        if kind not in shared:
            shared[kind] = spectral_vectors(x, kind)
        return spectral(x, k, kind, vectors=shared[kind])

    for k in ks:
        yield timed("kmeans", None, k, lambda: kmeans(x, k, seed))  # noqa: B023
        yield timed("tree-embedding", None, k, lambda: tree_clusters(d, k))  # noqa: B023
        yield timed("tree-adjacency", None, k, lambda: tree_clusters(1 - w, k))  # noqa: B023
        for kind in ("nearest_neighbors", "rbf"):
            yield timed("spectral", kind, k, lambda: by_graph(kind, k))  # noqa: B023
    yield timed("affinity", None, None, lambda: affinity(-(d**2)))
    yield timed("louvain", None, None, lambda: louvain(w))


def threshold_components(x: np.ndarray, metric: str, n: int = 1000):
    """(threshold, labels) for thresholds 0.15 to 0.97 of scaled similarity."""
    d = pairwise(x, metric)
    similar = 1 - d / max(float(d.max()), 1e-300)
    for threshold in np.linspace(0.15, 0.97, n):
        yield float(threshold), connected(similar >= threshold)


def sweep(vectors: DataFrame, most: int | None = None) -> DataFrame:
    """(subject, algorithm, linkage, k, score, position, labels): silhouettes of a sweep; a score out of range is null."""
    return timed_sweep(vectors, most).drop("seconds")


def timed_sweep(vectors: DataFrame, most: int | None = None) -> DataFrame:
    """``sweep`` with the seconds that each result took."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", kind="stable")
        x, subject, out = np.stack(rows["vector"].to_numpy()), rows["subject"].iloc[0], []
        d = pairwise(x)
        top = max(len(x) - 3, MIN_CLUSTERS) if most is None else most
        for position, (name, linkage, k, labels, seconds) in enumerate(candidates(x, hash_key(subject), None, most) if len(x) > MIN_CLUSTERS else []):
            value = silhouette(d, labels) if MIN_CLUSTERS <= k <= top else float("nan")
            out.append((subject, name, linkage, int(k), None if np.isnan(value) else value, position, relabel(labels).tolist(), seconds))
        return pd.DataFrame(out, columns=["subject", "algorithm", "linkage", "k", "score", "position", "labels", "seconds"])

    schema = f"subject {kinds['subject']}, algorithm string, linkage string, k int, score double, position int, labels array<int>, seconds double"
    # A sweep is long and its input small: a stated number of partitions is not coalesced.
    spark = vectors.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return vectors.select("subject", "item", "vector").repartition(n, "subject").groupBy("subject").applyInPandas(run, schema)


def runtimes(timed: DataFrame) -> DataFrame:
    """(subject, algorithm, results, seconds): how many results each algorithm of a ``timed_sweep`` has, and what they took."""
    from pyspark.sql import functions as F

    return timed.groupBy("subject", "algorithm").agg(F.count("*").alias("results"), F.sum("seconds").alias("seconds"))


def components_by_threshold(vectors: DataFrame, metric: str = "euclidean", n: int = 1000) -> DataFrame:
    """(subject, threshold, k, labels) of ``threshold_components`` for each subject."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", kind="stable")
        found = threshold_components(np.stack(rows["vector"].to_numpy()), metric, n)
        return pd.DataFrame([(rows["subject"].iloc[0], t, int(labels.max()) + 1, relabel(labels).tolist()) for t, labels in found], columns=["subject", "threshold", "k", "labels"])

    return vectors.select("subject", "item", "vector").groupBy("subject").applyInPandas(run, f"subject {kinds['subject']}, threshold double, k int, labels array<int>")


def leaderboard(swept: DataFrame) -> DataFrame:
    """Best and worst algorithm of each subject, each algorithm at its best k."""
    from .ranking import best_k, extremes

    return extremes(best_k(swept, MIN_CLUSTERS, 1 << 30)).distinct()


def pca(x: np.ndarray, dims: int = 2) -> np.ndarray:
    """Principal components; the sign makes the largest entry positive."""
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    return _signed(u[:, :dims] * s[:dims])


def kernel_pca(x: np.ndarray, dims: int = 2) -> np.ndarray:
    """Kernel PCA with an rbf kernel of width 1 / columns."""
    return _from_kernel(np.exp(-(pairwise(x) ** 2) / x.shape[1]), dims)


def classical_mds(d: np.ndarray, dims: int = 2) -> np.ndarray:
    """Classical scaling of distances."""
    return _from_kernel(-0.5 * d**2, dims)


def _apart(y: np.ndarray) -> np.ndarray:
    """``pairwise`` of each element of a stack."""
    squares = (y**2).sum(2)
    d = np.sqrt(np.maximum(squares[:, :, None] + squares[:, None, :] - 2 * y @ y.transpose(0, 2, 1), 0))
    d[:, np.arange(y.shape[1]), np.arange(y.shape[1])] = 0
    return d


def iterative_mds(d: np.ndarray, dims: int = 2, starts: int = 4, rounds: int = 300, tol: float = 1e-6, seed: int = 0) -> np.ndarray:
    """Scaling by majorising the raw stress (SMACOF); the best of several random starts, which go together until each has settled."""
    n = len(d)
    y = np.stack([np.random.default_rng([seed, start]).random((n, dims)) for start in range(starts)])
    stress, moving, same = np.full(starts, np.inf), np.arange(starts), np.arange(n)
    now = _apart(y)
    for _ in range(rounds):
        ratio = d / np.maximum(now, 1e-12)
        ratio[:, same, same] = 0.0
        step = -ratio
        step[:, same, same] = ratio.sum(2)
        y[moving] = made = step @ y[moving] / n
        now = _apart(made)
        after = ((now - d) ** 2).reshape(len(moving), -1).sum(1) / 2
        falling = ~(stress[moving] - after < tol * np.maximum(after, 1e-300))
        stress[moving] = after
        moving, now = moving[falling], now[falling]
        if not len(moving):
            break
    best = y[int(stress.argmin())]
    return _signed(best - best.mean(0))


def isomap(x: np.ndarray, dims: int = 2, neighbours: int = 5) -> np.ndarray:
    """Classical scaling of shortest paths in the nearest-neighbour graph."""
    d = pairwise(x)
    paths = np.full_like(d, np.inf)
    near = np.argsort(d, axis=1)[:, : neighbours + 1]
    rows = np.arange(len(d))[:, None]
    paths[rows, near] = d[rows, near]
    paths = np.minimum(paths, paths.T)
    for k in range(len(d)):
        paths = np.minimum(paths, paths[:, k : k + 1] + paths[k : k + 1, :])
    paths[np.isinf(paths)] = 2 * paths[np.isfinite(paths)].max()
    return classical_mds(paths, dims)


def lle(x: np.ndarray, dims: int = 2, neighbours: int = 5) -> np.ndarray:
    """Locally linear embedding."""
    n, d = len(x), pairwise(x)
    w = np.zeros((n, n))
    for i in range(n):
        near = np.argsort(d[i])[1 : neighbours + 1]
        z = x[near] - x[i]
        g = z @ z.T
        g += np.eye(len(near)) * 1e-3 * max(np.trace(g), 1e-12)
        v = np.linalg.solve(g, np.ones(len(near)))
        w[i, near] = v / v.sum()
    m = (np.eye(n) - w).T @ (np.eye(n) - w)
    return _signed(np.linalg.eigh(m)[1][:, 1 : dims + 1])


def modified_lle(x: np.ndarray, dims: int = 2, neighbours: int = 5) -> np.ndarray:
    """Locally linear embedding with several weight vectors for each point: its neighbourhood's directions of least variance."""
    n, d, k = len(x), pairwise(x), min(neighbours, len(x) - 1)
    near, values, vectors, plain = [], [], [], []
    for i in range(n):
        at = np.argsort(d[i], kind="stable")[1 : k + 1]
        z = x[at] - x[i]
        g = z @ z.T
        v, u = np.linalg.eigh(g)
        w = np.linalg.solve(g + np.eye(k) * 1e-3 * max(np.trace(g), 1e-12), np.ones(k))
        near.append(at), values.append(np.maximum(v, 0)), vectors.append(u), plain.append(w / w.sum())
    # How much of the variance the weights may leave out: the median over points of what lies beyond the wanted dimensions.
    spare = lambda v, s: v[:s].sum() / max(v[s:].sum(), 1e-300)
    allowed = np.median([spare(v, max(k - dims, 1)) for v in values])
    m = np.zeros((n, n))
    for i in range(n):
        s = max([c for c in range(1, max(k - dims, 1) + 1) if spare(values[i], c) < allowed], default=1)
        low = vectors[i][:, :s]
        sums = low.sum(0)
        alpha = np.linalg.norm(sums) / np.sqrt(s)
        h = alpha - sums
        length = np.linalg.norm(h)
        h = h / length if length > 1e-10 else np.zeros(s)
        w = (1 - alpha) * plain[i][:, None] + low - 2 * np.outer(low @ h, h)
        full = np.zeros((n, s))
        full[near[i]] = w
        full[i] -= w.sum(0)
        m += full @ full.T
    return _signed(np.linalg.eigh(m)[1][:, 1 : dims + 1])


def tsne(x: np.ndarray, dims: int = 2, perplexity: float = 30.0, rounds: int = 500, seed: int = 0) -> np.ndarray:
    """t-distributed neighbour embedding, exact, from the principal components."""
    n, squares = len(x), pairwise(x) ** 2
    perplexity = min(perplexity, max((n - 1) / 3, 1.0))
    p = np.zeros((n, n))
    for i in range(n):  # each point's width by bisection on the entropy
        low, high, beta, others = 0.0, np.inf, 1.0, np.arange(n) != i
        shifted = squares[i, others] - squares[i, others].min()
        for _ in range(60):
            e = np.exp(-shifted * beta)
            q = e / e.sum()
            entropy = -(q * np.log(np.maximum(q, 1e-300))).sum()
            if abs(entropy - np.log(perplexity)) < 1e-6:
                break
            low, high = (beta, high) if entropy > np.log(perplexity) else (low, beta)
            beta = beta * 2 if np.isinf(high) else (low + high) / 2
        p[i, others] = q
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = pca(x, dims)
    y = y / max(y[:, 0].std(), 1e-12) * 1e-4 + np.random.default_rng(seed).normal(0, 1e-6, (n, y.shape[1]))
    speed, gains, rate = np.zeros_like(y), np.ones_like(y), max(n / 48, 50.0)
    for step in range(rounds):
        kernel = 1 / (1 + pairwise(y) ** 2)
        np.fill_diagonal(kernel, 0)
        q = np.maximum(kernel / kernel.sum(), 1e-12)
        force = ((12.0 if step < 250 else 1.0) * p - q) * kernel
        slope = 4 * (np.diag(force.sum(1)) - force) @ y
        gains = np.maximum(np.where(np.sign(slope) != np.sign(speed), gains + 0.2, gains * 0.8), 0.01)
        speed = (0.5 if step < 250 else 0.8) * speed - rate * gains * slope
        y = y + speed
    return _signed(y - y.mean(0))


def _codes(x: np.ndarray, atoms: np.ndarray, penalty: float, start: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Sparse codes: min |x - codes atoms|^2 / 2 + penalty |codes|_1, by proximal steps."""
    gram, step = atoms @ atoms.T, 1 / max(np.linalg.norm(atoms, 2) ** 2, 1e-12)
    codes, fixed, most = start, x @ atoms.T, step * penalty
    for _ in range(rounds):
        raw = codes - step * (codes @ gram - fixed)
        # What is left beyond the penalty, with its sign.
        new = raw - np.minimum(np.maximum(raw, -most), most)
        if (new == codes).all():
            break  # the other rounds would leave it so
        codes = new
    return codes


def dictionary(x: np.ndarray, dims: int = 2, penalty: float = 1.0, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(codes, atoms) of centred rows: sparse codes over atoms of length one at most, in turn, from the principal components."""
    x = x - x.mean(0)
    u, s, v = np.linalg.svd(x, full_matrices=False)
    codes, atoms = u[:, :dims] * s[:dims], v[:dims]
    for _ in range(rounds):
        codes = _codes(x, atoms, penalty, codes)
        for j in range(len(atoms)):
            rest = x - codes @ atoms + np.outer(codes[:, j], atoms[j])
            atom = codes[:, j] @ rest
            if np.any(codes[:, j]):
                atoms[j] = atom / max(np.linalg.norm(atom), 1e-12)
    return codes, atoms


def dictionary_codes(x: np.ndarray, dims: int = 2) -> np.ndarray:
    """Sparse codes of the rows over a learned dictionary."""
    return _signed(dictionary(x, dims)[0])


def sparse_pca(x: np.ndarray, dims: int = 2, penalty: float = 1.0, ridge: float = 0.01) -> np.ndarray:
    """Scores on sparse components: the dictionary of the transposed rows, whose codes are the components; scores by ridge regression."""
    centred = x - x.mean(0)
    components = dictionary(centred.T, dims, penalty)[0].T
    return _signed(np.linalg.solve(components @ components.T + ridge * np.eye(dims), components @ centred.T).T)


def _strongest(x: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """All squared singular values, from the largest, and the first ``dims`` right singular vectors, from the smaller of the two products of x with itself."""
    if len(x) >= x.shape[1]:
        squares, vectors = np.linalg.eigh(x.T @ x)
        return squares[::-1], vectors[:, ::-1][:, :dims].T
    squares, vectors = np.linalg.eigh(x @ x.T)
    right = vectors[:, ::-1][:, :dims].T @ x
    return squares[::-1], right / np.maximum(np.linalg.norm(right, axis=1, keepdims=True), 1e-300)


def factor_analysis(x: np.ndarray, dims: int = 2, rounds: int = 500, tol: float = 1e-6) -> np.ndarray:
    """Factor scores of the maximum-likelihood factor model with one noise variance a column (expectation maximisation)."""
    centred, n = x - x.mean(0), len(x)
    variances = centred.var(0)
    noise, before = np.maximum(variances, 1e-12), -np.inf
    for _ in range(rounds):
        squares, v = _strongest(centred / np.sqrt(noise * n), dims)
        kept = np.maximum(squares[:dims] - 1, 0)
        loadings = np.sqrt(kept)[:, None] * v * np.sqrt(noise)
        fit = -(np.log(np.maximum(squares[:dims], 1e-12)).sum() + squares[dims:].sum() + np.log(noise).sum())
        if fit - before < tol:
            break
        before, noise = fit, np.maximum(variances - (loadings**2).sum(0), 1e-12)
    weighted = loadings / noise
    return _signed(np.linalg.solve(np.eye(len(loadings)) + weighted @ loadings.T, weighted @ centred.T).T)


def nmf(x: np.ndarray, dims: int = 2, rounds: int = 200, seed: int = 0) -> np.ndarray:
    """Non-negative factors of the rows, shifted to be non-negative."""
    v = x - min(0.0, float(x.min()))
    draw = np.random.default_rng(seed)
    w, h = draw.random((len(v), dims)) + 0.1, draw.random((dims, v.shape[1])) + 0.1
    for _ in range(rounds):
        h *= (w.T @ v) / np.maximum(w.T @ w @ h, 1e-12)
        w *= (v @ h.T) / np.maximum(w @ h @ h.T, 1e-12)
    return w


def topics(vectors: DataFrame, k: int = 2, seed: int = 0) -> DataFrame:
    """(subject, item, weights): latent Dirichlet allocation of vectors made non-negative, one model for all subjects."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.sql import functions as F

    held = vectors.select("subject", "item", array_to_vector(F.transform("vector", lambda v: F.abs(v))).alias("features"))
    model = LDA(k=k, seed=seed, maxIter=10).fit(held)
    return model.transform(held).select("subject", "item", vector_to_array("topicDistribution").alias("weights"))


def _from_kernel(k: np.ndarray, dims: int) -> np.ndarray:
    centre = np.eye(len(k)) - 1 / len(k)
    values, vectors = np.linalg.eigh(centre @ k @ centre)
    order = np.argsort(values)[::-1][:dims]
    return _signed(vectors[:, order] * np.sqrt(np.maximum(values[order], 0)))


def _signed(y: np.ndarray) -> np.ndarray:
    return y * np.where(y[np.abs(y).argmax(0), np.arange(y.shape[1])] < 0, -1, 1)


METHODS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "PCA": pca,
    "KPCA": kernel_pca,
    "MDS": lambda x: iterative_mds(pairwise(x)),
    "CMDS": lambda x: classical_mds(pairwise(x)),
    "ISOMAP": isomap,
    "LLE": lle,
    "MLLE": modified_lle,
    "NMF": nmf,
    "TSNE": tsne,
    "SPARSEPCA": sparse_pca,
    "FA": factor_analysis,
    "DICT": dictionary_codes,
}


def reduced(vectors: DataFrame, methods: tuple[str, ...] = tuple(METHODS)) -> DataFrame:
    """(subject, item, method, x, y): two dimensions by each method."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", kind="stable")
        x, out = np.stack(rows["vector"].to_numpy()), []
        for name in methods:
            low = METHODS[name](x)
            out.append(pd.DataFrame({"subject": rows["subject"], "item": rows["item"], "method": name, "x": low[:, 0], "y": low[:, 1] if low.shape[1] > 1 else 0.0}))
        return pd.concat(out)

    spark = vectors.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return vectors.select("subject", "item", "vector").repartition(n, "subject").groupBy("subject").applyInPandas(run, f"subject {kinds['subject']}, item {kinds['item']}, method string, x double, y double")
