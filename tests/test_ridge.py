"""Ridge from added statistics against the plain solver, and the split bootstrap against the multinomial it stands for."""

import numpy as np
import pytest

from ablata.operators import linear, ridge


@pytest.fixture
def frames(spark):
    """Subjects of 90, 25 and 12 samples, one with one class, one without features."""
    draw = np.random.default_rng(4)
    held, rows = [], []
    for s, n in enumerate((90, 25, 12, 8, 9)):
        for i in range(n):
            x = draw.integers(0, 2, 6)
            y = int(draw.random() < 1 / (1 + np.exp(-(1.5 * x[0] - x[1])))) if s != 3 else 1
            held += [(s, 7 * i % 101, f"f{j}") for j in range(6) if x[j] and s != 4]
            rows.append((s, 7 * i % 101, y, 0))
    return spark.createDataFrame(held, "subject int, sample long, feature string"), spark.createDataFrame(rows, "subject int, sample long, yhat int, y int")


def plain(frames, subject):
    inc, samples = (f.filter(f"subject = {subject}").toPandas() for f in frames)
    samples = samples.sort_values("sample")
    names = sorted(inc["feature"].unique())
    x = np.array([[float(((inc["sample"] == s) & (inc["feature"] == f)).any()) for f in names] for s in samples["sample"]]).reshape(len(samples), len(names))
    return x, samples["yhat"].to_numpy(), names


@pytest.mark.parametrize("rows", [20_000, 11])
def test_fit_equals_the_plain_solver(frames, monkeypatch, rows):
    """One block, and blocks of eleven rows added two at a time with margins ranked in Spark."""
    got = ridge.fit_blocks(ridge.blocks(*frames, rows=rows), fan=2).toPandas()
    for s in range(3):
        x, y, names = plain(frames, s)
        want, own = linear.choose("ridge", x, y), got[got.subject == s].set_index("feature").loc[names]
        assert np.allclose(own.estimate, want["coef"], atol=1e-8)
        for column in ("intercept", "alpha", "mean_auc", "max_fold_auc"):
            assert np.allclose(own[column], want[column], atol=1e-8)
    assert got[got.subject == 3].error.tolist() == ["one class only"] and got[got.subject == 4].error.tolist() == ["no features"]


def test_path_equals_the_plain_solver(frames):
    got = ridge.coefficient_path(ridge.blocks(*frames, rows=11), [0.1, 0.7]).toPandas()
    x, y, names = plain(frames, 0)
    for alpha in (0.1, 0.7):
        own = got[(got.subject == 0) & (got.alpha == alpha)].set_index("feature").loc[names]
        assert np.allclose(own.coef, linear.solve_ridge(x, y, alpha)[0], atol=1e-8)


def test_block_sizes():
    for n in range(40):
        for blocks in range(1, 12):
            place = [p * blocks // n for p in range(n)]
            for lo in range(blocks):
                for hi in range(lo, blocks + 1):
                    assert ridge.block_size(n, blocks, lo, hi) == sum(lo <= b < hi for b in place)


def counts_of(n0, n1, blocks, replicate, top_up=10, seed=1):
    """A replicate's counts of all rows, block by block, as tasks that know nothing of each other make them."""
    y = np.r_[np.zeros(n0, int), np.ones(n1, int)]
    block = np.r_[np.arange(n0) * blocks // max(n0, 1), np.arange(n1) * blocks // max(n1, 1)]
    out = np.zeros(n0 + n1)
    for b in range(blocks):
        at = np.flatnonzero(block == b)
        out[at] = ridge.block_counts([seed, 5, replicate], y[at], n0, n1, blocks, b, top_up)
    return out


@pytest.mark.parametrize("blocks", [1, 2, 7])
def test_draws_are_multinomial(blocks):
    """Counts sum to n; totals, variances and covariances are those of n draws with replacement, by chi-square and five standard errors."""
    n0, n1, times = 40, 20, 3000
    counts = np.array([counts_of(n0, n1, blocks, r, top_up=0) for r in range(times)])
    n = n0 + n1
    assert (counts.sum(1) == n).all()
    chi = ((counts.sum(0) - times) ** 2 / times).sum()
    assert abs(chi - (n - 1)) < 5 * np.sqrt(2 * (n - 1))
    assert counts.var(0).mean() == pytest.approx(1 - 1 / n, rel=0.02)
    between = np.cov(counts.T)
    assert between[~np.eye(n, dtype=bool)].mean() == pytest.approx(-1 / n, rel=0.1)
    assert counts[:, n0:].sum(1).var() == pytest.approx(n * (n1 / n) * (n0 / n), rel=0.1)


@pytest.mark.parametrize("blocks", [1, 5])
def test_top_up(blocks):
    """Draws below ten of the rarer class become at least ten, and the number of draws stays; the law is that of replacing ten of the draws."""
    got = np.array([counts_of(90, 6, blocks, r) for r in range(1500)])
    assert (got.sum(1) == 96).all() and (got[:, 90:].sum(1) >= 10).all()
    draw, want = np.random.default_rng(0), []
    for _ in range(6000):
        y = (draw.integers(0, 96, 96) >= 90).astype(int)
        if y.sum() < 10:
            y[-10:] = 1
        want.append(y.sum())
    assert got[:, 90:].sum(1).mean() == pytest.approx(np.mean(want), abs=0.3)
    assert got[:, 90:].sum(1).std() == pytest.approx(np.std(want), rel=0.15)


@pytest.mark.parametrize("rows", [20_000, 25])
def test_replicates_equal_the_plain_solver(frames, rows):
    """Refits of a subject in one block, and of one spread over four blocks and several chunks."""
    packed = ridge.blocks(*frames, rows=rows)
    settings = ridge.fit_blocks(packed)
    got = ridge.bootstrap_arrays(packed, settings, 7, seed=2, chunk=3, fan=2).filter("subject = 0").toPandas()
    x, y, names = plain(frames, 0)
    alpha = settings.filter("subject = 0").first()["alpha"]
    n0, n1, blocks = int((y == 0).sum()), int((y == 1).sum()), 1 if rows > 90 else 4
    place = np.where(y == 1, np.cumsum(y == 1) - 1, np.cumsum(y == 0) - 1)
    block = place * blocks // np.where(y == 1, n1, n0)
    for r in range(7):
        counts = np.zeros(len(y))
        for b in range(blocks):
            at = np.flatnonzero(block == b)
            counts[at] = ridge.block_counts([2, linear.hash_key(0), r], y[at], n0, n1, blocks, b)
        want = linear.solve_ridge(x, y, alpha, counts)[0]
        own = got[got["first"] == r // 3 * 3].set_index("feature").loc[names]["coefs"]
        assert np.allclose([c[r % 3] for c in own], want, atol=1e-8)


def test_job(frames):
    rows = ridge.job(*frames, replicates=60).toPandas()
    assert set(rows.subject) == {0, 1, 2} and (rows.bootstrap_lower <= rows.bootstrap_upper).all() and (rows.se > 0).all()
    first = rows[(rows.subject == 0) & (rows.feature == "f0")].iloc[0]
    assert first.bootstrap_lower < first.estimate < first.bootstrap_upper


def test_empty(frames):
    inc, samples = (f.limit(0) for f in frames)
    assert ridge.fit(inc, samples).count() == 0


def test_large_folds_rank_the_same(frames, monkeypatch):
    """Folds ranked from packed bits, and those too large for it, whose margins are ranked as rows, give the same fit."""
    packed = ridge.blocks(*frames, rows=11)
    models = ridge._models(ridge.fold_statistics(packed), linear.RIDGE_GRID[:7])
    keys = ["subject", "fold", "setting"]
    own = ridge._fold_aucs(packed, models, 7).toPandas().sort_values(keys)
    assert set(own[keys].drop_duplicates()["subject"]) == {0, 1, 2} and (own["setting"].value_counts() == own["setting"].value_counts().iloc[0]).all()
    monkeypatch.setattr(ridge, "FOLD_BYTES", 0)
    rows = ridge._fold_aucs(packed, models, 7).toPandas().sort_values(keys)
    assert own[keys].values.tolist() == rows[keys].values.tolist() and np.allclose(own["auc"], rows["auc"], atol=1e-12)


def test_folds_shuffle_bits_not_margins(frames):
    """No row leaves Python for a sample and a penalty: what is shuffled for a fold is its packed bits."""
    plan = ridge.fit_blocks(ridge.blocks(*frames, rows=11))._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "cells#" in plan


def test_tasks_go_with_rows(frames, monkeypatch):
    """Blocks are joined in more tasks than the session has partitions where there are more samples, and stay the same."""
    want = ridge.blocks(*frames, rows=11).orderBy("subject", "block").toPandas()
    monkeypatch.setattr(ridge, "TASK_ROWS", 9)
    seen, numbered = [], ridge.reshape.numbered
    monkeypatch.setattr(ridge.reshape, "numbered", lambda *a: seen.append(a[3]) or numbered(*a))
    got = ridge.blocks(*frames, rows=11).orderBy("subject", "block").toPandas()
    assert seen == [16] and got.drop(columns="names").equals(want.drop(columns="names"))
    assert [None if n is None else list(n) for n in got["names"]] == [None if n is None else list(n) for n in want["names"]]


def test_chunks_draw_as_single_replicates_do():
    """A chunk's statistics are those of its replicates' counts one by one, to the last digit, and a split is drawn once for all blocks of a group."""
    draw, known = np.random.default_rng(4), {}
    for block in range(4):
        x, y = (draw.random((50, 6)) < 0.4).astype(float), draw.integers(0, 2, 50)
        counts = np.array([ridge.block_counts([3, 8, r], y, 101, 99, 4, block) for r in range(5, 12)])
        got = ridge.chunk_statistics([3, 8], range(5, 12), x, y, 101, 99, 4, block, known)
        assert got.dtype == float and np.array_equal(got, ridge.statistics(x, y, counts))
    # Seven replicates: the class draws, and two classes by the three ranges of four blocks.
    assert len(known) == 7 * (1 + 2 * 3)


def test_blocks_of_a_replicate_are_added_before_the_shuffle(frames):
    """What is shuffled for a chunk is one sum for each ``fan`` blocks, not one for each block."""
    packed = ridge.blocks(*frames, rows=11)
    settings = ridge.fit_blocks(packed)
    plan = ridge.bootstrap_arrays(packed, settings, 7, chunk=3, fan=32)._jdf.queryExecution().toString()
    assert "part" in plan and "FlatMapGroupsInPandas" not in plan
    one, other = (ridge.bootstrap_arrays(packed, settings, 7, chunk=3, fan=fan).orderBy("subject", "first", "feature").collect() for fan in (2, 32))
    assert one == other
