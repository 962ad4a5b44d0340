"""Large tables are dealt out by their rows, not by the session's number of partitions, with the same results."""

import pytest

from ablata.operators import incidence
from ablata.plans import queries
from ablata.sources import adapters


def plain(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(adapters, "ROWS", 300)


@pytest.fixture
def nothing_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_partitions_follow_the_rows(spark, sf_dir, small_tasks, nothing_broadcast):
    lines = adapters.read(spark, sf_dir, "lineitem").count()
    assert adapters.tasks(spark, sf_dir, "lineitem") == -(-lines // 300)
    assert adapters.tasks(spark, sf_dir, "nation") is None
    for rows in (adapters.incidence(spark, sf_dir), queries._part_incidence(spark, sf_dir)):
        assert rows.rdd.getNumPartitions() >= lines // 300


@pytest.mark.parametrize("name", ["row_dedup", "unique_columns", "incidence_counts"])
def test_same_rows(spark, sf_dir, monkeypatch, name):
    before = plain(queries.QUERIES[name](spark, sf_dir))
    monkeypatch.setattr(adapters, "ROWS", 300)
    assert plain(queries.QUERIES[name](spark, sf_dir)) == before


def test_operators_by_tasks(spark):
    inc = spark.createDataFrame([(s, i, f) for s in "ab" for i in range(6) for f in ("x", "y", "z")[: 1 + i % 3]], "subject string, sample int, feature string")
    samples = spark.createDataFrame([(s, i, 1, 0) for s in "ab" for i in range(7)], "subject string, sample int, yhat int, y int")
    assert plain(incidence.deduplicated(samples, inc, tasks=9)) == plain(incidence.deduplicated(samples, inc)) == [(s, i, 1, 0) for s in "ab" for i in (0, 1, 2, 6)]
    assert plain(incidence.unique_features(inc, tasks=9)) == plain(incidence.unique_features(inc))


def test_last_steps_by_tasks(spark, nothing_broadcast):
    """The last group of ``deduplicated`` and the sort of ``gram`` are dealt out by tasks too."""
    from ablata.operators import correlation

    inc = spark.createDataFrame([("a", i, f) for i in range(40) for f in ("x", "y", "z")[: 1 + i % 3]], "subject string, sample int, feature string")
    samples = spark.createDataFrame([("a", i, 1, 0) for i in range(40)], "subject string, sample int, yhat int, y int")
    assert incidence.deduplicated(samples, inc, tasks=37).rdd.getNumPartitions() == 37
    dealt = correlation.gram(inc, tasks=37)
    assert "RepartitionByExpression [subject#" in (logical := dealt._jdf.queryExecution().optimizedPlan().toString()) and "], 37" in logical
    assert plain(dealt) == plain(correlation.gram(inc)) == [("a", "x", "x", 40), ("a", "x", "y", 26), ("a", "x", "z", 13), ("a", "y", "y", 26), ("a", "y", "z", 13), ("a", "z", "z", 13)]
