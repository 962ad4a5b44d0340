"""Small operators at their edges."""

import pytest
from pyspark.sql import functions as F

from ablata.operators import clustering, correlation, reshape
from ablata.sources.readers import list_literal


def test_columns_joined_needs_the_same_keys(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    right = spark.createDataFrame([(1, 0.5), (3, 0.1)], "k int, z double")
    with pytest.raises(Exception, match="only one table has the key"):
        reshape.columns_joined(left, right, ["k"]).collect()
    whole = reshape.columns_joined(left, right.replace(3, 2, "k"), ["k"])
    assert whole.columns == ["k", "x", "z"] and sorted(map(tuple, whole.collect())) == [(1, "a", 0.5), (2, "b", 0.1)]


def test_list_literal_escapes(spark):
    cells = [r"['a\nb', 'it\'s', 'x\\ny']", r'["q\"t", "\x41é", "\d"]', r"['tab\there', 3]", "['\\\\']"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = [r[0] for r in df.orderBy("i").select(list_literal(F.col("c"))).collect()]
    assert got == [["a\nb", "it's", "x\\ny"], ['q"t', "Aé", "\\d"], ["tab\there", "3"], ["\\"]]


def test_curves_of_repeated_lists(spark):
    rows = [(1, "kmeans", None, 4, 0.1, 0), (1, "kmeans", None, 5, 0.2, 1), (1, "kmeans", None, 4, 0.3, 2), (1, "agg", "ward", 4, 0.4, 3), (2, "kmeans", None, 4, 0.5, 0)]
    df = spark.createDataFrame(rows, "subject int, algorithm string, linkage string, k int, score double, position int")
    got = sorted((r["subject"], r["series"], r["cluster_n"], r["score"]) for r in reshape.silhouette_curve(df).collect())
    assert got == [(1, "agg-ward", 4, 0.4), (1, "kmeans-0", 4, 0.1), (1, "kmeans-0", 5, 0.2), (1, "kmeans-1", 4, 0.3), (2, "kmeans", 4, 0.5)]


def test_constant_flags_with_repeated_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    joined = df.join(df.select(F.col("k").alias("k2"), "v"), F.col("k") == F.col("k2"))
    assert reshape.unique_columns(joined) == ["k", "v", "k2"]
    assert {(r["name"], r["constant"]) for r in reshape.constant_flags(joined).collect()} == {("k", False), ("v", True), ("k2", False)}


def test_feature_correlations_by_the_diagonal(spark):
    """One scan of the incidence, and pairs that never meet."""
    inc = spark.createDataFrame([(0, s, f) for s, held in enumerate(["a", "ab", "b", "c", ""]) for f in held], "subject int, sample int, feature string")
    samples = spark.createDataFrame([(0, s, s % 2, 0) for s in range(5)], "subject int, sample int, yhat int, y int")
    got = {(r["a"], r["b"]): r["corr"] for r in correlation.feature_correlations(inc, samples).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert got["a", "b"] == pytest.approx(1 / 6) and got["a", "c"] == pytest.approx(-0.408248, abs=1e-6)


def test_runtimes_count_results(spark):
    timed = spark.createDataFrame([(0, "kmeans", 0.5), (0, "kmeans", 0.25), (0, "affinity", 1.0)], "subject int, algorithm string, seconds double")
    assert {tuple(r) for r in clustering.runtimes(timed).collect()} == {(0, "kmeans", 2, 0.75), (0, "affinity", 1, 1.0)}
