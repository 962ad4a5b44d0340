"""Trees and hierarchies of several subjects against the plain versions of one."""

import numpy as np
import pytest

from ablata.operators import clustering, hierarchy


def vectors_of(ties=False):
    draw = np.random.default_rng(8)
    sizes = {0: 14, 1: 9, 2: 2, 3: 1}
    return {s: (draw.integers(0, 3, (n, 3)).astype(float) if ties else draw.normal(size=(n, 4))) for s, n in sizes.items()}


def frame(spark, vectors):
    return spark.createDataFrame([(s, 100 * s + i, v.tolist()) for s, x in vectors.items() for i, v in enumerate(x)], "subject int, item long, vector array<double>")


@pytest.mark.parametrize("ties", [False, True])
def test_spanning_trees(spark, ties):
    """As heavy as the plain tree, ties or not, and without circles."""
    vectors = vectors_of(ties)
    tree = hierarchy.spanning_tree(hierarchy.distance_edges(frame(spark, vectors))).toPandas()
    for s, x in vectors.items():
        own = tree[tree.subject == s]
        assert len(own) == len(x) - 1
        assert own.d.sum() == pytest.approx(sum(w for w, _, _ in clustering.spanning_tree(clustering.pairwise(x))), abs=1e-6)
        linked = np.zeros((len(x), len(x)), bool)
        for a, b in zip(own.a - 100 * s, own.b - 100 * s, strict=True):
            linked[a, b] = linked[b, a] = True
        assert len(set(clustering.connected(linked))) == 1


def test_blocks_give_the_same_edges(spark, monkeypatch):
    from ablata.operators import correlation

    df = frame(spark, vectors_of())
    both = ("euclidean", "cosine")
    listed = lambda: sorted((r["subject"], r["metric"], r["a"], r["b"], round(r["d"], 9)) for r in hierarchy.distance_edges(df, both).collect())
    whole = listed()
    monkeypatch.setattr(correlation, "BLOCK", 4)
    assert listed() == whole and len(whole) == 2 * (14 * 13 // 2 + 36 + 1)
    x = vectors_of()[0]
    want = {m: clustering.pairwise(x, m) for m in both}
    assert all(abs(d - want[m][a, b]) < 1e-6 for s, m, a, b, d in whole if s == 0)


def relabelled(labels):
    return clustering.relabel(np.asarray(labels)).tolist()


def test_four_linkages(spark):
    """The same clusters as the plain procedure for every linkage and every k, all subjects and linkages in the same rounds."""
    vectors = vectors_of()
    df = frame(spark, vectors)
    merged = hierarchy.merges(hierarchy.distance_edges(df))
    got = hierarchy.labels_at(df.select("subject", "item"), merged, 1, 14).toPandas()
    assert merged.groupBy("subject", "linkage").count().filter("subject = 0 and count <> 13").count() == 0
    assert merged.agg({"round": "max"}).first()[0] < 13
    for s in (0, 1, 2):
        for linkage in hierarchy.LINKAGES:
            levels = clustering.agglomerative(vectors[s], linkage)
            for k in range(1, len(vectors[s]) + 1):
                own = got[(got.subject == s) & (got.linkage == linkage) & (got.k == k)].sort_values("item")
                assert len(own) == len(vectors[s]) and relabelled(own.label) == relabelled(levels[k - 1]), (s, linkage, k)


def test_tree_clusters(spark):
    vectors = vectors_of()
    df = frame(spark, vectors)
    tree = hierarchy.spanning_tree(hierarchy.distance_edges(df))
    got = hierarchy.tree_clusters(df.select("subject", "item"), tree, 2, 6).toPandas()
    d = clustering.pairwise(vectors[0])
    for k in range(2, 7):
        own = got[(got.subject == 0) & (got.k == k)].sort_values("item")
        assert relabelled(own.label) == relabelled(clustering.tree_clusters(d, k))


@pytest.mark.parametrize("ties", [False, True])
def test_thresholds(spark, ties):
    vectors = vectors_of(ties)
    df = frame(spark, vectors)
    got = hierarchy.threshold_components(df.select("subject", "item"), hierarchy.distance_edges(df, ("euclidean", "cosine")), n=40).toPandas()
    assert len(got) == 3 * 2 * 40
    for s in (0, 1, 2):
        for metric in ("euclidean", "cosine"):
            own = got[(got.subject == s) & (got.metric == metric)].sort_values("step")
            for (threshold, labels), k, total in zip(clustering.threshold_components(vectors[s], metric, 40), own.k, own.label_sum, strict=True):
                d = clustering.pairwise(vectors[s], metric)
                if abs(1 - d / d.max() - threshold).min() > 1e-9:
                    least = [100 * s + min(np.flatnonzero(labels == c)) for c in labels]
                    assert (k, total) == (labels.max() + 1, sum(least))


def test_empty(spark):
    df = frame(spark, {3: np.zeros((1, 2))})
    edges = hierarchy.distance_edges(df)
    assert hierarchy.spanning_tree(edges).count() == 0 and hierarchy.merges(edges).count() == 0


@pytest.mark.parametrize("block", [256, 4])
def test_forest_edges_say_the_thresholds(spark, monkeypatch, block):
    """A subject of one block sends its tree's edges and its greatest distance instead of all pairs; one of several blocks, each pair's forest. The tree and the greatest distance are the same."""
    from ablata.operators import correlation

    df, both = frame(spark, vectors_of()), ("euclidean", "cosine")
    whole = hierarchy.distance_edges(df, both).toPandas()
    monkeypatch.setattr(correlation, "BLOCK", block)
    rows = hierarchy.forest_edges(df, both).toPandas()
    assert len(rows) == 2 * (13 + 8 + 1) if block == 256 else len(rows) < len(whole)
    for (_, own), (_, all_pairs) in zip(rows.groupby(["subject", "metric"]), whole.groupby(["subject", "metric"]), strict=True):
        tree, want = (sorted(map(tuple, hierarchy._forest(e)[["a", "b"]].to_numpy().tolist())) for e in (own, all_pairs))
        assert tree == want and own["far"].max() == pytest.approx(all_pairs["d"].max())
