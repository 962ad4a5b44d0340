"""Sources, sinks and reshaping that no query covers."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ablata.operators import clustering, cohort, incidence, linear, metrics, ranking, reshape, sampling
from ablata.sources import readers, sinks


def test_json_scan(spark, tmp_path):
    doc = {"mi_id": "s1", "img_id_list": ["a", "b"], "agglomerative": {"best_cluster_labels": [0, 1], "best_silhouette_score": 0.5, "n_clusters": [4], "silhouette_scores": [0.5]}}
    (tmp_path / "s1.json").write_text(json.dumps(doc, indent=1))
    row = readers.read_json(spark, str(tmp_path / "*.json"), readers.CLUSTERINGS).first()
    assert row["img_id_list"] == ["a", "b"] and row["agglomerative"]["best_cluster_labels"] == [0, 1]
    assert [tuple(r) for r in readers.discover(spark, str(tmp_path / "*.json")).select("stem").collect()] == [("s1",)]


def test_images(spark, tmp_path):
    (tmp_path / "s1_img_7.jpg").write_bytes(b"x")
    row = readers.read_images(spark, str(tmp_path / "*.jpg")).first()
    assert (row["subject_id"], row["feature_id"], bytes(row["content"])) == ("s1", "img_7", b"x")


def test_versions_do_not_overwrite(spark, tmp_path):
    df = spark.range(3)
    a = sinks.write_version(df, str(tmp_path), datetime(2024, 1, 2, 3, 4, 5))
    b = sinks.write_version(df, str(tmp_path), datetime(2024, 1, 2, 3, 4, 6))
    assert a.endswith("01-02-2024-03-04-05") and spark.read.parquet(a).count() == spark.read.parquet(b).count() == 3
    sinks.write_table(df, str(tmp_path / "t"))
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_nan_to_zero(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (2.0,)], "v double")
    assert [r[0] for r in df.select(metrics.nan_to_zero(F.col("v"))).collect()] == [0, 0, 2]


def test_curves_and_sets(spark):
    sweep = spark.createDataFrame([(0, "agglomerative", "ward", 4, 0.5), (0, "kmeans", None, 4, 0.4)], "subject int, algorithm string, linkage string, k int, score double")
    assert {r["series"] for r in reshape.silhouette_curve(sweep).collect()} == {"agglomerative-ward", "kmeans"}
    nested = spark.createDataFrame([([[1, 2], [2, 3]],)], "n array<array<int>>")
    assert reshape.flat_set(nested, "n").first()[0] == [1, 2, 3]
    assert reshape.unique_columns(spark.range(1).select("id", "id")) == ["id"]


def test_columns_side_by_side(spark):
    a, b = spark.createDataFrame([(1, 2), (2, 3)], "k int, a int"), spark.createDataFrame([(1, 5), (2, 5)], "k int, b int")
    assert reshape.columns_joined(a, b, ["k"]).count() == 2
    assert reshape.constants(b, ["k", "b"]) == ["b"]
    with pytest.raises(ValueError):
        reshape.columns_joined(a, b.limit(1), ["k"])


def test_cohort_variants(spark):
    df = spark.createDataFrame([(1, [1] * 20), (2, [1] * 19), (3, None)], "s int, items array<int>")
    assert [r["s"] for r in cohort.min_items(df).collect()] == [1] and cohort.min_items(df, strict=True).count() == 0
    with pytest.raises(ValueError):
        cohort.binarized(F.col("s"), 4)
    left = spark.createDataFrame([("a", 1), ("b", 2)], "k string, value int")
    right = spark.createDataFrame([("b", 9)], "k string, value int")
    assert {tuple(r) for r in cohort.merged(left, right, "k", "left").collect()} == {("a", 1), ("b", 2)}
    rows = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "subject int, yhat int")
    assert cohort.keep_two_classes(rows).count() == 2


def test_layouts():
    assert ranking.layout_of(["Estimate", "SE"]) == "coefficients"
    assert ranking.layout_of(["corrs", "corr_stds"]) == "correlations"
    assert ranking.layout_of(["x"]) == "archived"


def test_margins_predict(spark):
    samples = spark.createDataFrame([(0, 1, 1, 1), (0, 2, 0, 0)], "subject int, sample long, yhat int, y int")
    inc = spark.createDataFrame([(0, 1, "A")], "subject int, sample long, feature string")
    coefs = spark.createDataFrame([(0, "A", 2.0, -1.0)], "subject int, feature string, estimate double, intercept double")
    got = {r["sample"]: (r["margin"], r["predicted"]) for r in linear.margins(inc, samples, coefs).collect()}
    assert got == {1: (1.0, 1), 2: (-1.0, 0)}


def test_empty_tables(spark):
    samples = spark.createDataFrame([], "subject int, sample long, yhat int, y int")
    inc = spark.createDataFrame([], "subject int, sample long, feature string")
    assert incidence.deduplicated(samples, inc).count() == 0 and incidence.unique_features(inc).count() == 0
    assert linear.fit(inc, samples).count() == 0
    vectors = spark.createDataFrame([], "subject int, item int, cluster int, vector array<double>")
    assert clustering.sweep(vectors).count() == 0 and clustering.reduced(vectors).count() == 0
    assert sampling.stratified(spark.createDataFrame([], "subject int, cluster int, feature int"), 3).count() == 0


def test_shared_folder(spark):
    """A local session gets a folder of its own; a cluster that names none is refused, and one that names one is heard."""
    from types import SimpleNamespace

    from ablata import durable

    assert durable.cut(spark.range(3)).count() == 3 and durable.new_path(spark, "x") != durable.new_path(spark, "x")

    def session(master, folder):
        held = []
        context = SimpleNamespace(master=master, getConf=lambda: {}, getCheckpointDir=lambda: held[-1] if held else None, setCheckpointDir=held.append)
        return SimpleNamespace(sparkContext=context, conf={"spark.checkpoint.dir": folder} if folder else {}), held

    with pytest.raises(ValueError, match="checkpoint"):
        durable.shared_dir(session("spark://host:7077", None)[0])
    named, held = session("spark://host:7077", "/shared/folder/")
    assert durable.shared_dir(named) == "/shared/folder" and held == ["/shared/folder/"]
