"""Hand-made fixtures with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ablata.functions import stats
from ablata.operators import clustering, cohort, correlation, incidence, linear, metrics, ranking, reshape, sampling, scoring
from ablata.sources import readers, sinks
from ablata.streaming import incremental

SAMPLES = [(0, 1, 1, 1), (0, 2, 1, 1), (0, 3, 0, 0), (0, 4, 0, 0), (0, 5, 0, 1), (0, 6, 1, 0)]
HELD = {"A": [1, 2, 5], "B": [2, 3, 5], "C": [1, 2, 5], "D": [1, 2, 3, 4, 5, 6]}


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(SAMPLES, "subject int, sample long, yhat int, y int")


@pytest.fixture(scope="module")
def inc(spark, samples):
    pairs = spark.createDataFrame([(0, s, f) for f, held in HELD.items() for s in held], "subject int, sample long, feature string")
    return pairs.join(samples, ["subject", "sample"])


def test_rows_with_other_labels_are_kept(inc, samples):
    assert incidence.deduplicated(samples, inc).count() == 6


def test_equal_rows_go(spark, inc, samples):
    twice = samples.unionByName(spark.createDataFrame([(0, 7, 1, 1)], samples.schema))
    more = inc.select("subject", "sample", "feature").unionByName(spark.createDataFrame([(0, 7, f) for f in "ABCD"], "subject int, sample long, feature string"))
    kept = incidence.deduplicated(twice, more)
    assert 7 not in [r["sample"] for r in kept.collect()]


def test_unique_columns_keep_the_first(inc):
    assert {r["feature"] for r in incidence.unique_features(inc).collect()} == {"A", "B", "D"}


def test_unheld_features_are_equal(spark, inc):
    named = spark.createDataFrame([(0, f) for f in "ABCDYZ"], "subject int, feature string")
    assert {r["feature"] for r in incidence.unique_features(inc, named).collect()} == {"A", "B", "D", "Y"}


def test_marginal_influence(inc, samples):
    rows = {r["feature"]: r for r in correlation.with_p(correlation.influence(inc, samples)).collect()}
    assert set(rows) == {"A", "B", "D"}
    assert rows["A"]["corr"] == pytest.approx(1 / 3) and rows["A"]["se"] == pytest.approx(0.942809, abs=1e-6)
    assert (rows["A"]["lower"], rows["A"]["upper"]) == (pytest.approx(-0.609476, abs=1e-6), 1.0)
    assert rows["A"]["p"] == pytest.approx(14 / 27) and rows["A"]["verdict"] == "INSIGNIFICANT"
    assert [rows["D"][c] for c in ("corr", "se", "lower", "upper", "p")] == [0, 1, -1, 1, 1]
    by_samples = {r["feature"]: r for r in correlation.influence(inc, samples, dof="samples").collect()}
    assert by_samples["A"]["se"] == pytest.approx(0.471405, abs=1e-6)


def test_one_class_is_skipped(spark, inc, samples):
    same = samples.withColumn("yhat", F.lit(1))
    assert correlation.influence(inc.withColumn("yhat", F.lit(1)), same).count() == 0


def test_two_features_have_no_finite_se(inc, samples):
    rows = correlation.influence(inc.filter("feature in ('A', 'B')"), samples).collect()
    assert all(r["se"] is None and (r["lower"], r["upper"]) == (-1, 1) for r in rows)


def test_confusion_and_accuracy(samples):
    row = metrics.confusion(samples, "subject").first()
    assert (row["tp"], row["fn"], row["tn"], row["fp"]) == (2, 1, 2, 1)
    assert metrics.accuracy(samples, "subject").first()["accuracy"] == pytest.approx(4 / 6)


def test_proportions_and_min_size(spark):
    strata = spark.createDataFrame([(0, 0, "A"), (0, 0, "B"), (0, 1, "C")], "subject int, cluster int, feature string")
    assert sorted(r["proportion"] for r in metrics.proportions(strata).collect()) == [pytest.approx(1 / 3), pytest.approx(2 / 3)]
    assert metrics.min_sample_size(strata).first()["min_size"] == 3
    drawn = sampling.stratified(strata, 5)
    assert drawn.groupBy("sample", "cluster").count().filter("cluster = 0").select(F.min("count"), F.max("count")).first() == (2, 2)


def test_float_ceil_is_clamped(spark):
    strata = spark.createDataFrame([(0, i, i) for i in range(49)], "subject int, cluster int, feature int")
    assert math.ceil(1 / (1 / 49)) == 50 and metrics.min_sample_size(strata).first()["min_size"] == 49


def test_subsets_repeat_nothing_and_rerun_alike(spark):
    strata = spark.createDataFrame([(s, i % 3, i) for s in range(2) for i in range(20)], "subject int, cluster int, feature int")
    a = sampling.stratified(strata, 10).collect()
    assert len(a) == len({(r["subject"], r["sample"], r["feature"]) for r in a})
    assert sorted(a) == sorted(sampling.stratified(strata.repartition(7), 10).collect())


def test_bootstrap_summary_rules_disagree(spark):
    coefs = spark.createDataFrame([(0, "A", float(v)) for v in (1, 2, 4, 10)], "subject int, feature string, coef double")
    row = metrics.bootstrap_summary(coefs, spark.createDataFrame([(0, "A", 4.0)], "subject int, feature string, estimate double")).first()
    assert row["se"] == pytest.approx(4.031129, abs=1e-6)
    assert (row["bootstrap_lower"], row["bootstrap_upper"]) == (pytest.approx(1.075), pytest.approx(9.55))
    assert (row["bootstrap_verdict"], row["se_verdict"]) == ("SIGNIFICANT", "INSIGNIFICANT")


def test_ridge_known_answer():
    coef, intercept = linear.solve_ridge(np.array([[1.0], [1], [0], [0]]), np.array([1, 1, 0, 1]), 1.0)
    assert coef[0] == pytest.approx(0.5) and intercept == pytest.approx(0.25)


def test_elastic_net_is_optimal():
    draw = np.random.default_rng(0)
    x = draw.integers(0, 2, (200, 6)).astype(float)
    y = (draw.random(200) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(int)
    for penalty, mix in ((0.02, 0.0), (0.02, 0.5), (0.05, 1.0)):
        w, b = linear.solve_elastic_net(x, y, penalty, mix, rounds=20000, tol=1e-13)
        assert linear.kkt_residual(x, y, penalty, mix, w, b) < 1e-6


def test_auc_by_pairs():
    draw = np.random.default_rng(1)
    y, s = draw.integers(0, 2, 60), draw.integers(0, 9, 60)
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert linear.auc(y, s) == pytest.approx(np.mean(pairs))


def test_fit_reports_failures(spark, inc, samples):
    one = samples.withColumn("yhat", F.lit(1))
    assert linear.fit(inc, one).first()["error"] == "one class only"
    fitted = linear.fit(inc, samples, "ridge", {"alphas": [1.0]})
    assert fitted.filter("error is null").count() == 4
    boot = linear.bootstrap(inc, samples, fitted, replicates=10, block=4)
    assert boot.select("replicate").distinct().count() == 10
    assert sorted(boot.collect()) == sorted(linear.bootstrap(inc, samples, fitted, replicates=10, block=4).collect())


def test_regression_summary():
    draw = np.random.default_rng(2)
    x = draw.random((50, 2))
    y = x @ [1.0, -2.0] + 0.3 + 0.1 * draw.standard_normal(50)
    beta = np.linalg.lstsq(np.column_stack([np.ones(50), x]), y, rcond=None)[0]
    table = linear.regression_summary(x, y, beta[1:], beta[0], ["a", "b"], standard=True)
    raw = y - np.column_stack([np.ones(50), x]) @ beta
    cov = (raw @ raw) / 47 * np.linalg.inv(np.column_stack([np.ones(50), x]).T @ np.column_stack([np.ones(50), x]))
    assert np.allclose(table["se"], np.sqrt(np.diag(cov)), atol=1e-6)
    assert abs(linear.residuals(x, y, beta[1:], beta[0], "standardized").std() - 1) < 1e-9
    assert np.isfinite(linear.residuals(x, y, beta[1:], beta[0], "studentized")).all()
    assert np.allclose(linear.huber(x, y)[0], [1, -2], atol=0.1)


def test_t_distribution():
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert stats.t_two_sided(0.0, 5) == pytest.approx(1.0) and stats.t_two_sided(1.0, 1) == pytest.approx(0.5)


def test_silhouette_is_euclidean(spark):
    points = spark.createDataFrame([(0, i, c, [float(v)]) for i, (c, v) in enumerate([(0, 0), (0, 1), (1, 5), (1, 7)])], "subject int, item int, cluster int, vector array<double>")
    assert correlation.silhouette(points).first()["silhouette"] == pytest.approx(0.720299, abs=1e-6)
    x = np.array([[0.0], [1], [5], [7]])
    assert clustering.silhouette(clustering.pairwise(x), np.array([0, 0, 1, 1])) == pytest.approx(0.720299, abs=1e-6)


@pytest.mark.parametrize("linkage", clustering.LINKAGES)
def test_agglomerative_by_brute_force(linkage):
    x = np.random.default_rng(3).random((12, 3))
    clusters = [[i] for i in range(12)]

    def apart(a, b):
        d = np.linalg.norm(x[a][:, None] - x[b][None], axis=2)
        if linkage == "ward":
            return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        return {"single": d.min(), "complete": d.max(), "average": d.mean()}[linkage]

    levels = clustering.agglomerative(x, linkage)
    while len(clusters) > 1:
        assert {frozenset(c) for c in clusters} == {frozenset(np.flatnonzero(levels[len(clusters) - 1] == v).tolist()) for v in set(levels[len(clusters) - 1])}
        i, j = min(((i, j) for i in range(len(clusters)) for j in range(i)), key=lambda p: apart(clusters[p[0]], clusters[p[1]]))
        clusters[j] += clusters.pop(i)


def test_clusterings_find_separate_blobs():
    draw = np.random.default_rng(4)
    x = np.concatenate([draw.normal(c, 0.1, (8, 2)) for c in ((0, 0), (5, 5), (0, 6))])
    truth = np.repeat([0, 1, 2], 8)
    same = lambda labels: np.array_equal(clustering.relabel(labels), truth)
    assert same(clustering.kmeans(x, 3, 0)) and same(clustering.tree_clusters(clustering.pairwise(x), 3))
    assert same(clustering.spectral(x, 3, "rbf")) and same(clustering.spectral(x, 3, "nearest_neighbors"))
    assert same(clustering.affinity(-(clustering.pairwise(x) ** 2)))
    near = (clustering.pairwise(x) < 1).astype(float)
    assert same(clustering.louvain(near)) and same(clustering.connected(near > 0))
    assert any(same(labels) for _, labels in clustering.threshold_components(x, "euclidean", 50))


def test_reductions():
    x = np.random.default_rng(5).random((30, 4))
    d = clustering.pairwise(x)
    assert np.allclose(clustering.pairwise(clustering.classical_mds(d, 4)), d, atol=1e-6)
    assert np.allclose(np.abs(clustering.pca(x)), np.abs(clustering.classical_mds(d)), atol=1e-6)
    assert all(f(x).shape[0] == 30 for f in clustering.METHODS.values())


def test_enumeration(spark):
    items = spark.createDataFrame([(0, c) for c in "abc"], "subject int, feature string")
    assert sampling.all_subsets(items).count() == 7
    toy = spark.createDataFrame([(0, v) for v in (1, 3, 7, 9, 11, 13)], "subject int, feature int")
    counts = {r["size"]: r["count"] for r in sampling.all_subsets(toy).groupBy("size").count().collect()}
    assert counts == {1: 6, 2: 15, 3: 20, 4: 15, 5: 6, 6: 1}
    assert metrics.subset_count(6, range(1, 7)) == 63


def test_rank_ties_and_zero(spark):
    df = spark.createDataFrame([(0, "b", 0.5), (0, "a", 0.5), (0, "c", 0.0), (0, "d", -0.2)], "subject int, feature string, v double")
    assert {(r["feature"], r["sign"], r["rank"]) for r in ranking.ranked(df, "v").collect()} == {("a", "positive", 1), ("b", "positive", 2), ("d", "negative", 1)}


def test_first_best_k_wins(spark):
    sweep = spark.createDataFrame([(0, "x", 4, 0.5), (0, "x", 5, 0.5), (0, "x", 6, 0.4), (0, "x", 7, float("nan"))], "subject int, algorithm string, k int, score double")
    assert ranking.best_k(sweep, 3, 9).first()["k"] == 4


def test_nan_p_is_not_insignificant(spark):
    df = spark.createDataFrame([(float("nan"),), (0.05,), (0.04,), (None,)], "p double")
    assert [r[0] for r in df.select(ranking.p_verdict(F.col("p"))).collect()] == ["SIGNIFICANT", "INSIGNIFICANT", "SIGNIFICANT", "SIGNIFICANT"]


def test_half_even(spark):
    assert [r[0] for r in spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "v double").select(F.bround("v")).collect()] == [0, 2, 2]


def test_folds(spark):
    rows = [(n, i < n) for n in (12, 8, 2) for i in range(40)]
    got = {r["subject"]: (r["n_splits"], r["adjusted"]) for r in metrics.folds(spark.createDataFrame(rows, "subject int, yhat boolean")).collect()}
    assert got == {12: (10, 10), 8: (8, 7), 2: (2, 1)}


def test_scorer_contract():
    with pytest.raises(TypeError):
        scoring.check(lambda x: 0.5, [1])
    with pytest.warns(UserWarning):
        with pytest.raises(TypeError):
            scoring.check(lambda a, b: 1, [1])
    scoring.check(lambda x: 1, [1])


def test_lookup_and_zip(spark):
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    table = spark.createDataFrame([(1, 5, "x"), (1, 3, "y")], "k int, o int, v string")
    assert cohort.lookup(keys, table, "k", "o").collect()[0]["v"] == "y"
    with pytest.raises(KeyError):
        cohort.lookup(keys, table, "k", "o", missing="raise")
    bad = spark.createDataFrame([(0, [1, 2], [1])], "s int, a array<int>, b array<int>")
    with pytest.raises(Exception, match="differ in length"):
        cohort.zipped(bad, "a", "b", ("x", "y")).collect()


def test_top_up_after_quota(spark, samples):
    kept = sampling.until_quota(samples, 2)
    need = sampling.deficits(kept, 4).first()
    assert kept.count() >= 1 and need["need_positive"] >= 0


def test_minority_top_up(spark):
    labels = spark.createDataFrame([(i, int(i == 0)) for i in range(50)], "row long, y int")
    got = sampling.minority_top_up(sampling.bootstrap_rows(50, 8, 1, spark), labels, 3, 1).groupBy("replicate").agg(F.count("*").alias("n"), F.count_if(F.col("row") == 0).alias("k")).collect()
    assert all(r["n"] == 50 and r["k"] >= 3 for r in got)


def test_size_rule():
    with pytest.raises(ValueError):
        sampling.SizeRule(min_size=1, min_share=0.5)
    with pytest.raises(ValueError):
        sampling.SizeRule(max_share=1.5)
    with pytest.raises(ValueError):
        metrics.size_for()


def test_readers_and_sinks(spark, tmp_path, inc, samples):
    (tmp_path / "meta.csv").write_text("subject_id,severity,feature_list\ns1,2,\"['a', 'b']\"\n")
    meta = readers.read_csv(spark, str(tmp_path / "meta.csv"), readers.SUBJECTS, required=("subject_id",))
    assert meta.select(readers.list_literal(F.col("feature_list"))).first()[0] == ["a", "b"]
    with pytest.raises(ValueError):
        readers.require_columns(meta, "nope")
    for s in ("s1", "s2"):
        (tmp_path / "runs" / s).mkdir(parents=True)
        (tmp_path / "runs" / s / "pred.csv").write_text("sample,feature\n1,a\n")
    assert {r["subject_id"] for r in readers.read_keyed(spark, str(tmp_path / "runs"), "pred.csv", "sample long, feature string").collect()} == {"s1", "s2"}
    sinks.write_matrices(inc, samples, 0, ["A", "B", "C", "D"], str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out/pred_results"), header=True, inferSchema=True)
    assert back.columns == ["subject", "sample", "A", "B", "C", "D", "yhat", "y"] and back.count() == 6
    sinks.write_by_subject(inc, str(tmp_path / "by"))
    assert (tmp_path / "by" / "subject=0").exists()
    with pytest.raises(ValueError):
        readers.JobConfig("t", encoder="none")
    assert readers.JobConfig(" t ").subject_table == "t" and readers.JobConfig("t").width == 1024


def test_report_flattening(spark):
    df = spark.sql("select 1 as id, struct(array(1, 2) as s, 0.5 as b) as alg")
    assert {(r["metric"], r["position"], r["value"]) for r in reshape.flattened(df, "id", ["alg"]).collect()} == {("s", 0, 1.0), ("s", 1, 2.0), ("b", None, 0.5)}


def test_stream_counts(spark, inc, tmp_path):
    inc.select("subject", "sample", "feature", "yhat").write.parquet(str(tmp_path / "in"))
    run = incremental.stream_counts(spark, str(tmp_path / "in"), "subject int, sample long, feature string, yhat int", str(tmp_path / "cp"), "arrived")
    run.awaitTermination()
    got = {r["feature"]: (r["sx"], r["sxy"]) for r in spark.table("arrived").collect()}
    assert got["A"] == (3, 2) and got["D"] == (6, 3)
