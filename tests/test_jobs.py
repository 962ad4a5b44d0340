"""The sampling job under kills, and the writers of all subjects at once."""

import csv
import glob

import pytest
from pyspark.sql import functions as F

from ablata.operators import incidence, jobs, sampling
from ablata.sources import sinks


@pytest.fixture
def strata(spark):
    rows = [(f"s{s}", c, 100 * s + i) for s in range(12) for i, c in enumerate("aabbbcc"[: 2 + s % 6])]
    return spark.createDataFrame(rows, "subject string, cluster string, feature long")


def score():
    return F.size("features") % 2


def listed(df):
    return sorted((r["subject"], r["sample"], tuple(r["features"]), r["yhat"]) for r in df.collect())


def run(strata, path, **how):
    done = jobs.sampling_job(strata, score(), str(path), 20, seed=3, commits=4, **how)
    return done, jobs.sampled(strata.sparkSession, str(path), "string", "bigint")


def test_a_job_that_runs_through(strata, tmp_path):
    done, rows = run(strata, tmp_path)
    got = {r["subject"]: r for r in done.collect()}
    assert len(got) == 12 and all(r["n_samples"] == 20 for r in got.values())
    found = listed(rows)
    assert len(found) == 240 and all(list(f) == sorted(set(f)) and y == len(f) % 2 for _, _, f, y in found)
    assert all(r["label_sum"] == sum(y for s, _, _, y in found if s == k) for k, r in got.items())


@pytest.mark.parametrize("where", ["before the rows", "between rows and manifest", "between commits"])
def test_killed_and_run_again(strata, tmp_path, monkeypatch, where):
    """Killed in the second group; the rerun adds what lacks, and every subject is there once, as in a job that ran through."""
    whole = listed(run(strata, tmp_path / "whole")[1])
    path, commits, original = tmp_path / "killed", [], jobs._commit

    def dies(*args):
        commits.append(args)
        if len(commits) == 2 and where == "before the rows":
            raise KeyboardInterrupt
        if len(commits) == 2 and where == "between rows and manifest":
            monkeypatch.setattr(jobs.F, "count", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        original(*args)
        if len(commits) == 2:
            raise KeyboardInterrupt

    monkeypatch.setattr(jobs, "_commit", dies)
    with pytest.raises(KeyboardInterrupt):
        run(strata, path)
    monkeypatch.undo()
    first = jobs.committed(strata.sparkSession, str(path), "string")
    before = {r["subject"]: r["part"] for r in first.collect()}
    assert 0 < len(before) < 12
    assert listed(jobs.sampled(strata.sparkSession, str(path), "string", "bigint")) == [r for r in whole if r[0] in before]
    done, rows = run(strata, path)
    assert listed(rows) == whole
    after = {r["subject"]: r["part"] for r in done.collect()}
    assert len(after) == 12 and all(after[s] == part for s, part in before.items())
    again, _ = run(strata, path)
    assert {r["subject"]: r["part"] for r in again.collect()} == after


def test_two_runs_that_commit_the_same_subjects(strata, tmp_path):
    """Parts of both are there; readers take one of each subject."""
    _, rows = run(strata, tmp_path)
    jobs._commit(strata.filter("subject < 's3'"), score(), str(tmp_path), 20, 3, "string", "bigint", {})
    assert len(listed(rows)) == 240
    assert jobs.committed(strata.sparkSession, str(tmp_path), "string").count() == 12


def test_no_subjects(strata, tmp_path):
    done, rows = run(strata.limit(0), tmp_path)
    assert done.count() == 0 and rows.count() == 0


def test_matrices_of_all_subjects(spark, tmp_path):
    """25 subjects with columns of their own in one write, and every cell read back; names that need quotes, samples without features."""
    held = [(s, n, f'f{s % 4}{k}{","*(s == 3)}{chr(34)*(s == 4)}') for s in range(25) for n in range(7) for k in range(s % 5 + 1) if (s + n * k) % 3]
    inc = spark.createDataFrame(held, "subject int, sample int, feature string")
    samples = spark.createDataFrame([(s, n, (s + n) % 2, None if s == 6 else 1) for s in range(25) for n in range(8)], "subject int, sample int, yhat int, y int")
    sinks.write_all_matrices(inc, samples, f"{tmp_path}/m", file_rows=5)
    for s in range(25):
        own = sorted({f for x, _, f in held if x == s})
        for table, more in (("design_matrix", []), ("pred_results", ["yhat", "y"])):
            files = glob.glob(f"{tmp_path}/m/table={table}/subject={s}/chunk=*/*.txt")
            assert len(files) == 2
            found = {}
            for name in files:
                with open(name, newline="") as file:
                    reader = csv.reader(file)
                    assert next(reader) == ["sample", *own, *more]
                    found |= {int(r[0]): r[1:] for r in reader}
            labels = lambda n: [str((s + n) % 2), "" if s == 6 else "1"] if more else []  # noqa: B023, E731
            assert found == {n: [str(int((s, n, f) in set(held))) for f in own] + labels(n) for n in range(8)}


def test_matrices_equal_the_wide_table(spark, tmp_path):
    inc = spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (1, 3, "c"), (1, 3, "c")], "subject int, sample int, feature string")
    samples = spark.createDataFrame([(1, n, n % 2, 0) for n in (1, 2, 3)], "subject int, sample int, yhat int, y int")
    sinks.write_all_matrices(inc, samples, f"{tmp_path}/m")
    got = spark.read.option("recursiveFileLookup", True).csv(f"{tmp_path}/m/table=pred_results/subject=1", header=True, inferSchema=True)
    want = incidence.wide(inc, samples, ["a", "b", "c"]).drop("subject")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns


def test_archives(spark, tmp_path):
    inc = spark.createDataFrame([(1, 1, "b"), (2, 1, "a")], "subject int, sample int, feature string")
    samples = spark.createDataFrame([(1, 1, 1, 0), (2, 1, 0, 0)], "subject int, sample int, yhat int, y int")
    long = spark.createDataFrame([(1, "b", 0.5), (2, "a", 0.1)], "subject int, feature string, corr double")
    sinks.write_all_archives(f"{tmp_path}/a", inc, samples, long, long, long)
    for name in ("corr_results", "sampling_corr", "encoded_img_corr"):
        assert len(glob.glob(f"{tmp_path}/a/{name}/subject=*/*.csv")) == 2
    assert len(glob.glob(f"{tmp_path}/a/matrices/table=*/subject=*")) == 4


def test_subsets_are_the_stratified_draws(spark):
    """One subject's samples are on several tasks."""
    rows = [(s, c, f) for s, n in (("a", 70), ("b", 3), (None, 4)) for f in range(n) for c in (None, "x", "y", "z")[f % 4 :][:1]]
    strata = spark.createDataFrame(rows, "subject string, cluster string, feature bigint")
    want = sampling.stratified(strata, 120, 5).groupBy("subject", "sample").agg(F.array_sort(F.collect_list("feature")).alias("features"))
    assert sorted(map(tuple, jobs.subsets(strata, 120, 5).collect())) == sorted(map(tuple, want.collect()))
    one = jobs.subsets(strata.filter("subject = 'a'"), 1000, 5).withColumn("task", F.spark_partition_id())
    assert one.select("task").distinct().count() > 1


def test_first_items_are_parted_by_their_whole_digests():
    class Known:
        """A digest that is the name itself."""

        def __init__(self, name=b""):
            self.name = name

        copy, update, digest = lambda s: Known(), lambda s, n: setattr(s, "name", n), lambda s: s.name

    names = [i.to_bytes(8, "big") + j.to_bytes(8, "big") for i in (9, 1, 5) for j in (7, 3, 2**63, 8)]
    for k in range(1, 13):
        assert sorted(jobs._first(Known(), names, k).tolist()) == sorted(sorted(range(12), key=names.__getitem__)[:k])
