"""Sweeps do shared work once and runs of k-means together, with the results of one run after the other."""

import numpy as np
import pytest

from ablata.operators import clustering


def plain_kmeans(x, k, seed, tries=4, rounds=100):
    best, least = np.zeros(len(x), int), np.inf
    for attempt in range(tries):
        draw = np.random.default_rng([seed, k, attempt])
        centres = [x[draw.integers(len(x))]]
        while len(centres) < k:
            near = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
            centres.append(x[draw.choice(len(x), p=near / near.sum()) if near.sum() > 0 else draw.integers(len(x))])
        c = np.array(centres)
        for _ in range(rounds):
            labels = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[labels == i].mean(0) if (labels == i).any() else c[i] for i in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = ((x - c[labels]) ** 2).sum()
        if cost < least:
            best, least = labels, cost
    return best


def items():
    draw = np.random.default_rng(6)
    return {"apart": draw.normal(size=(25, 64)), "ties": draw.integers(0, 2, (30, 3)).astype(float), "copies": np.repeat(draw.normal(size=(4, 5)), 5, 0), "equal": np.zeros((9, 2))}


@pytest.mark.parametrize("kind", list(items()))
@pytest.mark.parametrize("together", [1, 1 << 19])
def test_runs_together(monkeypatch, kind, together):
    monkeypatch.setattr(clustering, "TOGETHER", together)
    x = items()[kind]
    for k in (2, 4, 7):
        assert np.array_equal(clustering.kmeans(x, k, 3), plain_kmeans(x, k, 3))


def test_a_graph_is_solved_once(monkeypatch):
    """One eigendecomposition for each kind of graph, not one for each number of clusters."""
    seen, solve = [], np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda m: (seen.append(len(m)), solve(m))[1])
    found = [c for c in clustering.candidates(items()["apart"], 1) if c[0] == "spectral"]
    assert len(found) == 2 * len(range(4, 23)) and seen == [25, 25]
    monkeypatch.undo()
    for _, kind, k, labels, _ in found[:6]:
        assert np.array_equal(labels, clustering.spectral(items()["apart"], k, kind))


def plain_mds(d, dims=2, starts=4, rounds=300, tol=1e-6):
    best, least, n = np.zeros((len(d), dims)), np.inf, len(d)
    for start in range(starts):
        y, before = np.random.default_rng([0, start]).random((n, dims)), np.inf
        for _ in range(rounds):
            ratio = np.where(np.eye(n, dtype=bool), 0.0, d / np.maximum(clustering.pairwise(y), 1e-12))
            y = (np.diag(ratio.sum(1)) - ratio) @ y / n
            stress = float(((clustering.pairwise(y) - d) ** 2).sum() / 2)
            if before - stress < tol * max(stress, 1e-300):
                break
            before = stress
        if stress < least:
            best, least = y, stress
    return clustering._signed(best - best.mean(0))


@pytest.mark.parametrize("kind", ["apart", "ties", "copies"])
def test_scaling_starts_together(monkeypatch, kind):
    d = clustering.pairwise(items()[kind])
    want, seen, pairwise = plain_mds(d), [], clustering.pairwise
    monkeypatch.setattr(clustering, "pairwise", lambda *a: (seen.append(1), pairwise(*a))[1])
    assert np.allclose(clustering.iterative_mds(d), want, atol=1e-9) and not seen


@pytest.mark.parametrize("kind", ["apart", "ties", "copies"])
def test_codes_of_settled_rounds(kind):
    x = items()[kind]
    x = x - x.mean(0)
    atoms = np.linalg.svd(x, full_matrices=False)[2][:2]
    codes = plain = np.ones((len(x), 2))
    step = 1 / np.linalg.norm(atoms, 2) ** 2
    for _ in range(400):
        raw = plain - step * (plain @ (atoms @ atoms.T) - x @ atoms.T)
        plain = np.sign(raw) * np.maximum(np.abs(raw) - step * 0.5, 0)
    assert np.array_equal(clustering._codes(x, atoms, 0.5, codes, 400), plain)


@pytest.mark.parametrize("shape", [(25, 64), (64, 25), (5, 5)])
def test_factors_from_the_smaller_product(monkeypatch, shape):
    """No decomposition of the rows themselves; squares and directions are those of one."""
    x = np.random.default_rng(1).normal(size=shape)
    squares, right = clustering._strongest(x, 2)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(squares, s**2) and np.allclose(np.abs((right * v[:2]).sum(1)), 1)
    monkeypatch.setattr(np.linalg, "svd", None)
    assert clustering.factor_analysis(x).shape == (shape[0], 2)
