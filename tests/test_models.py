"""Solvers for many settings against the plain ones, the conditional job, low dimensions, and sampling without caps."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from ablata.operators import clustering, correlation, linear, metrics, reshape, sampling, scoring
from ablata.sources.readers import list_literal


def data(n=150, d=7, seed=0):
    draw = np.random.default_rng(seed)
    x = draw.integers(0, 2, (n, d)).astype(float)
    return x, (draw.random(n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1])))).astype(int)


def test_ridge_grid():
    x, y = data()
    coef, intercept = linear.ridge_grid(x, y, [0.01, 0.5, 1.0])
    for i, alpha in enumerate((0.01, 0.5, 1.0)):
        want = linear.solve_ridge(x, y, alpha)
        assert np.allclose(coef[:, i], want[0]) and intercept[i] == pytest.approx(want[1])


def test_ridge_replicates():
    x, y = data()
    counts = np.array([np.bincount(np.random.default_rng(i).integers(0, len(y), len(y)), minlength=len(y)) for i in range(5)], float)
    got = linear._ridges(x, y, 0.7, counts)
    assert all(np.allclose(got[:, i], linear.solve_ridge(x, y, 0.7, c)[0]) for i, c in enumerate(counts))
    wide = np.tile(x, 10)[:, :66]
    assert np.allclose(linear._ridges(wide, y, 0.7, counts)[:, 2], linear.solve_ridge(wide, y, 0.7, counts[2])[0])


def test_elastic_nets_are_optimal():
    x, y = data()
    penalties, mixes = np.array([0.01, 0.02, 0.05, 0.2]), np.array([1.0, 0.5, 0.0, 0.9])
    w = linear.elastic_nets(x, y, penalties, mixes, rounds=20_000, tol=1e-10)
    for i in range(4):
        assert linear.kkt_residual(x, y, penalties[i], mixes[i], w[:-1, i], w[-1, i]) < 1e-6
    counts = np.bincount(np.random.default_rng(1).integers(0, len(y), len(y)), minlength=len(y))
    at = np.repeat(np.arange(len(y)), counts)
    weighted = linear.elastic_nets(x, y, [0.02], [0.5], rounds=20_000, tol=1e-10, weights=counts[:, None].astype(float))
    assert np.allclose(weighted, linear.elastic_nets(x[at], y[at], [0.02], [0.5], rounds=20_000, tol=1e-10), atol=1e-6)


def test_paths():
    x, y = data()
    penalties = linear.penalty_path(x, y, np.array([0.5, 1.0]), 30)
    w = linear.path_nets(x, y, penalties, np.array([0.5, 1.0]), np.ones((len(y), 2)), 10_000)
    assert np.abs(w[0, :-1]).max() < 1e-4 and np.abs(w[-1, :-1]).max() > 0.5
    assert linear.kkt_residual(x, y, penalties[15, 1], 1.0, w[15, :-1, 1], w[15, -1, 1]) < 1e-3
    best = linear.choose("path_net", x, y, {"mixes": [0.5, 1.0], "path": 20, "last_path": 40})
    assert best["mix"] in (0.5, 1.0) and best["mean_auc"] > 0.6 and linear.kkt_residual(x, y, best["alpha"], best["mix"], best["coef"], best["intercept"]) < 1e-5
    out = linear.held_out_part(y, 0.05)
    assert {0, 1} == set(y[out]) and out.sum() == sum(-(-int((y == c).sum()) // 20) for c in (0, 1))


def test_choice_by_every_setting():
    x, y = data()
    grid = {"cs": [0.01, 1.0, 100.0], "mixes": [0.0, 0.5, 1.0]}
    best = linear.choose("elastic_net", x, y, grid)
    k, fold, means = linear.splits_for(y), None, {}
    fold = linear.fold_numbers(y, k)
    for c in grid["cs"]:
        for m in grid["mixes"]:
            scores = []
            for f in range(k):
                train, test = fold != f, fold == f
                coef, b = linear.solve_elastic_net(x[train], y[train], 1 / (c * train.sum()), m, rounds=5000)
                scores.append(linear.auc(y[test], x[test] @ coef + b))
            means[c, m] = np.mean(scores)
    assert best["mean_auc"] == pytest.approx(max(means.values()), abs=0.01)


@pytest.mark.parametrize("name, grid", [("elastic_net", {"cs": [0.01, 1.0], "mixes": [0.0, 0.5, 1.0]}), ("path_net", {"mixes": [0.5, 1.0], "path": 10, "last_path": 20})])
def test_repeated_rows_are_solved_once(monkeypatch, name, grid):
    """Thirty copies of the rows are no more rows for the solver, and the choice is that of the rows one by one."""
    x, y = data(60, 4)
    x, y, seen = np.tile(x, (30, 1)), np.tile(y, 30), []
    solve = linear.elastic_nets
    monkeypatch.setattr(linear, "elastic_nets", lambda x, *more, **how: (seen.append(len(x)), solve(x, *more, **how))[1])
    best = linear.choose(name, x, y, grid)
    assert max(seen) <= 32
    monkeypatch.setattr(linear, "grouped", lambda x, y, weights: (x, y, weights))
    plain = linear.choose(name, x, y, grid)
    assert max(seen) > 1500
    assert {k: best[k] for k in ("alpha", "mix")} == {k: plain[k] for k in ("alpha", "mix")}
    assert np.allclose(best["coef"], plain["coef"], atol=1e-6) and best["mean_auc"] == pytest.approx(plain["mean_auc"], abs=1e-9)


def test_area_of_groups():
    draw = np.random.default_rng(2)
    y, counts, score = draw.integers(0, 2, 30), draw.integers(1, 5, 30), draw.integers(0, 9, 30) / 8
    assert linear.auc_of_groups(y, counts, score) == pytest.approx(linear.auc(np.repeat(y, counts), np.repeat(score, counts)))


@pytest.fixture
def frames(spark):
    x, y = data(80, 5, 3)
    held = [(0, i, f"f{j}") for i in range(80) for j in range(5) if x[i, j]]
    inc = spark.createDataFrame(held, "subject int, sample long, feature string")
    samples = spark.createDataFrame([(0, i, int(y[i]), 0) for i in range(80)], "subject int, sample long, yhat int, y int")
    return inc.join(samples, ["subject", "sample"]), samples, x, y


def test_job_drops_repeated_rows(frames):
    """Adding every row once more changes nothing."""
    inc, samples, _, _ = frames
    again = samples.unionByName(samples.withColumn("sample", F.col("sample") + 1000))
    more = inc.unionByName(inc.withColumn("sample", F.col("sample") + 1000))
    kept = lambda i, s: sorted(map(tuple, linear.conditional_job(i, s, "ridge", 40, {"alphas": [0.5, 1.0]}, block=15).collect()))
    assert kept(inc, samples) == kept(more, again)


def test_summary_of_arrays_is_the_summary_of_rows(spark):
    rows = [(0, "a", i, float(np.sin(i * 7.0) + 0.3)) for i in range(41)] + [(0, "b", 0, 2.0)]
    coefs = spark.createDataFrame(rows, "subject int, feature string, replicate int, coef double")
    estimates = spark.createDataFrame([(0, "a", 0.3), (0, "b", 2.0)], "subject int, feature string, estimate double")
    blocks = coefs.groupBy("subject", "feature", F.floor(F.col("replicate") / 10)).agg(F.collect_list("coef").alias("coefs"))
    one, other = (sorted(df.collect()) for df in (metrics.bootstrap_summary(coefs, estimates), metrics.summary_of_arrays(blocks, estimates)))
    for a, b in zip(one, other, strict=True):
        assert [v if v is None or isinstance(v, str) else pytest.approx(v, abs=1e-12) for v in a] == list(b)


def test_surrogates(frames):
    inc, samples, x, y = frames
    signs = np.where(y > 0, 1.0, -1.0)
    coef, intercept = linear.sgd(x, signs)
    ones = np.column_stack([x, np.ones(len(y))])
    loss = lambda w: ((ones @ w - signs) ** 2).mean()
    assert loss(np.append(coef, intercept)) < 1.05 * loss(np.linalg.lstsq(ones, signs, rcond=None)[0])
    w, b = linear.squared_elastic_net(x, signs, 0.05, 0.5)
    slope = (x - x.mean(0)).T @ (signs - x @ w - b) / len(y) - 0.05 * 0.5 * w
    assert all(abs(s - 0.025 * np.sign(v)) < 1e-6 if v else abs(s) <= 0.025 + 1e-6 for s, v in zip(slope, w, strict=True))
    for kind in linear.SURROGATES:
        rows = linear.explain_each(inc, samples, kind, 3).orderBy("rank").collect()
        assert [r["rank"] for r in rows] == [1, 2, 3] and abs(rows[0]["weight"]) >= abs(rows[2]["weight"])


def test_low_dimensions_keep_neighbours():
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.normal(c, 0.3, (12, 6)) for c in (0, 4, 8)])
    own = np.repeat(np.arange(3), 12)
    for name, method in clustering.METHODS.items():
        y = method(x)
        assert y.shape == (36, 2) and np.isfinite(y).all(), name
        near = clustering.pairwise(y) + np.diag(np.full(36, np.inf))
        assert np.mean(own[near.argmin(1)] == own) > 0.9, name


def test_iterative_scaling_beats_its_start_and_factor_model():
    d = clustering.pairwise(np.random.default_rng(2).normal(size=(20, 5)))
    stress = lambda y: ((clustering.pairwise(y) - d) ** 2).sum()
    assert stress(clustering.iterative_mds(d)) < stress(clustering.classical_mds(d))
    flat = np.random.default_rng(3).normal(size=(15, 2))
    assert np.allclose(clustering.pairwise(clustering.iterative_mds(clustering.pairwise(flat), rounds=3000, tol=1e-12)), clustering.pairwise(flat), atol=0.05)
    draw = np.random.default_rng(4)
    hidden = draw.normal(size=(400, 1))
    seen = hidden @ np.array([[2.0, -1.0, 1.5, 0.5]]) + draw.normal(size=(400, 4)) * 0.3
    assert abs(np.corrcoef(clustering.factor_analysis(seen, 1)[:, 0], hidden[:, 0])[0, 1]) > 0.98


def test_top_up_gives_what_is_needed(spark):
    pooled = spark.createDataFrame([(s, i, "positive" if i % 3 else "negative") for s in (0, 1) for i in range(9)] + [(2, 0, "positive")], "subject int, feature int, pool string")
    needs = spark.createDataFrame([(0, 1500, 0), (1, 0, 7), (2, 4, 0)], "subject int, need_positive long, need_negative long")
    got = {(r["subject"], r["side"]): r["n"] for r in sampling.top_up(pooled, needs).groupBy("subject", "side").agg(F.count_distinct("sample").alias("n")).collect()}
    assert got == {(0, "positive"): 1500, (1, "negative"): 7, (2, "positive"): 4}


def test_numbered(spark):
    rows = [("a", i * 7 % 101) for i in range(101)] + [("b", i) for i in range(5)] + [(None, 3)]
    got = reshape.numbered(spark.createDataFrame(rows, "g string, v int").repartition(5), "g", "v").collect()
    assert sorted((str(r["g"]), r["v"], r["position"]) for r in got) == sorted([("a", i, i) for i in range(101)] + [("b", i, i) for i in range(5)] + [("None", 3, 0)])


def test_block_pairs_cover_all(spark, monkeypatch):
    monkeypatch.setattr(correlation, "BLOCK", 4)
    draw = np.random.default_rng(1)
    vectors = [(0, i, i % 3, draw.normal(size=4).tolist()) for i in range(23)] + [(1, i, 0, [1.0, 2.0, 3.0, float(i)]) for i in range(2)]
    df = spark.createDataFrame(vectors, "subject int, item int, cluster int, vector array<double>")
    got = {(r["subject"], r["a"], r["b"]): r["corr"] for r in correlation.vector_correlations(df).collect()}
    assert len(got) == 23 * 22 // 2 + 1
    assert all(r == pytest.approx(np.corrcoef(vectors[a][3], vectors[b][3])[0, 1]) for (s, a, b), r in got.items() if s == 0)
    sums = {(r["item"], r["cluster"]): (r["total"], r["n"]) for r in correlation.distance_sums(df).filter("subject = 0").collect()}
    for i in range(23):
        for c in range(3):
            d = [np.linalg.norm(np.subtract(vectors[i][3], vectors[j][3])) for j in range(23) if j % 3 == c]
            assert sums[i, c][0] == pytest.approx(sum(d)) and sums[i, c][1] == len(d)


def test_pairs_that_never_meet_are_correlated(spark):
    inc = spark.createDataFrame([(0, i, "a" if i < 3 else "b") for i in range(6)], "subject int, sample int, feature string")
    samples = spark.createDataFrame([(0, i, 0, 0) for i in range(6)], "subject int, sample int, yhat int, y int")
    assert [r["corr"] for r in correlation.feature_correlations(inc, samples).collect()] == [-1.0]
    gram = {(r["a"], r["b"]): r["together"] for r in correlation.gram(inc).collect()}
    assert gram == {("a", "a"): 3, ("b", "b"): 3}


def test_batched_scorer(spark):
    subsets = spark.createDataFrame([(0, i, list(range(i))) for i in range(9)], "subject int, sample int, features array<int>")
    assert [r["yhat"] for r in scoring.score(subsets, lambda lists: lists.map(len), batched=True).orderBy("sample").collect()] == list(range(9))
    assert np.allclose(scoring.normalised(np.zeros((1, 1, 3)))[0, 0], [-0.485 / 0.229, -0.456 / 0.224, -0.406 / 0.225])


def test_list_literals(spark):
    cells = ["['a', 'b']", "[\"it's\", 'x']", "['it\\'s', 3, true]", "[]", " [ 'a,b' , c d ] ", "no list", None, "['é\n']"]
    got = [r["x"] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").orderBy("i").select(list_literal(F.col("c")).alias("x")).collect()]
    assert got == [["a", "b"], ["it's", "x"], ["it's", "3", "true"], [], ["a,b", "c d"], None, None, ["é\n"]]


def test_threshold_components_and_times(spark):
    vectors = spark.createDataFrame([(0, i, [float(i // 5) * 10 + i * 0.1, 0.0]) for i in range(10)], "subject int, item int, vector array<double>")
    found = clustering.components_by_threshold(vectors, n=9).orderBy("threshold").collect()
    assert found[0]["k"] <= found[-1]["k"] and 2 in {r["k"] for r in found}
    times = clustering.runtimes(clustering.timed_sweep(vectors)).collect()
    assert {"kmeans", "louvain", "spectral", "agglomerative"} <= {r["algorithm"] for r in times} and all(r["seconds"] >= 0 for r in times)


def test_vectors_are_sent_a_bounded_number_of_times(spark, monkeypatch):
    """Ten times the blocks send a vector no more often, and the sums stay as they are, with many clusters too."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(90, 4))
    df = spark.createDataFrame([(0, i, i % 30, v.tolist()) for i, v in enumerate(x)], "subject int, item long, cluster int, vector array<double>")
    whole = sorted((r["item"], r["cluster"], r["own"], r["n"], round(r["total"], 9)) for r in correlation.distance_sums(df).collect())
    silhouette = correlation.silhouette(df).first()["silhouette"]
    assert silhouette == pytest.approx(clustering.silhouette(clustering.pairwise(x), np.arange(90) % 30), abs=1e-9)
    monkeypatch.setattr(correlation, "BLOCK", 3)
    monkeypatch.setattr(correlation, "SLICE", 4)
    monkeypatch.setattr(correlation, "GRID", 5)
    assert correlation.block_pairs(df).count() == 5 * 90
    for kept in (1 << 22, 1):
        monkeypatch.setattr(correlation, "KEPT", kept)
        assert sorted((r["item"], r["cluster"], r["own"], r["n"], round(r["total"], 9)) for r in correlation.distance_sums(df).collect()) == whole
    assert correlation.vector_correlations(df).distinct().count() == 90 * 89 // 2


def weak(n: int, d: int = 25) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(3)
    return (draw.random((n, d)) < 0.15).astype(float), (draw.random(n) < 0.35).astype(int)


def test_elastic_nets_are_near_the_optimum_at_their_own_tolerance():
    x, y = weak(700)
    penalties = np.geomspace(0.3, 1e-4, 20)
    w = None
    for penalty in penalties:
        w = linear.elastic_nets(x, y, np.full(3, penalty), np.array([0.01, 0.5, 1.0]), w)
        exact = [linear.solve_elastic_net(x, y, penalty, m, rounds=20_000, tol=1e-12) for m in (0.01, 0.5, 1.0)]
        assert np.abs(w - np.array([[*c, b] for c, b in exact]).T).max() < 2e-4 * max(1e-2, np.abs(w).max())


def test_elastic_nets_take_memory_by_rows_not_by_rows_and_settings():
    x, y = weak(60_000, 10)
    tracemalloc.start()
    linear.elastic_nets(x, y, np.full(50, 0.01), np.linspace(0, 1, 50), rounds=5, weights=np.ones((len(y), 1)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60_000 * 50 * 8  # one matrix of rows by settings


def test_scores_of_many_settings_are_the_plain_ones():
    draw = np.random.default_rng(4)
    scores, y = draw.integers(0, 9, (200, 7)).astype(float), draw.integers(0, 2, 200)
    counts = draw.integers(1, 5, 200).astype(float)
    at = np.repeat(np.arange(200), counts.astype(int))
    assert linear.aucs_of_groups(y, counts, scores).tolist() == [linear.auc(y[at], s) for s in scores[at].T]


def test_surrogates_ridge_takes_little_more_than_its_rows():
    x, y = weak(200_000, 20)
    own = np.random.default_rng(5).random(len(y))
    tracemalloc.start()
    got = linear.solve_ridge(x.astype(np.uint8), y, 1.0, own)[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < x.nbytes / 2
    ones = np.column_stack([x, np.ones(len(y))]) * np.sqrt(own)[:, None]
    want = np.linalg.solve(ones.T @ ones + np.diag([1.0] * 20 + [0.0]), ones.T @ (np.sqrt(own) * np.where(y > 0, 1.0, -1.0)))
    assert np.allclose(got, want[:20])


def test_packed_matrices(spark):
    inc = spark.createDataFrame([(1, s, f) for s, f in ((30, "b"), (30, "a"), (10, "c"), (20, "b"))], "subject int, sample long, feature string")
    samples = spark.createDataFrame([(1, 10, 1), (1, 20, 0), (1, 30, 1), (1, 40, 1), (2, 5, 0)], "subject int, sample long, yhat int")
    one, none = linear.packed(inc, samples).orderBy("subject").collect()
    x, y, names = linear._unpacked(one)
    assert names == ["a", "b", "c"] and y.tolist() == [1, 0, 1, 1] and x.tolist() == [[0, 0, 1], [0, 1, 0], [1, 1, 0], [0, 0, 0]]
    assert linear._unpacked(none)[0].shape == (1, 0) and list(none.names) == [] and x.dtype == np.uint8
