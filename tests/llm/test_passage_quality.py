"""The multiple-instance classifier: features and gradients against plain versions, edges, and accuracy on held-out documents."""

from __future__ import annotations

import numpy as np
import pytest

from ablata.llm import passage_quality as pq

TEXTS = ["", " \n ", "a", "One two  two\nTHREE 4%% | | é日本 " * 9, "x" * 300 + " y", "  lead and trail \t", "word " * 1000]


def model(seed: int = 3) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    shapes = {"w": (pq.DIMS, pq.CODES), "b": pq.CODES, "v": (pq.CODES, pq.GATES), "u": (pq.CODES, pq.GATES), "a": pq.GATES, "c": pq.CODES, "d": 1}
    return {k: draw.normal(0, 0.3, s) for k, s in shapes.items()}


@pytest.mark.parametrize("text", TEXTS)
def test_shape_by_hand(text):
    """Passages, kinds of characters and repeated words, word by word."""
    words = [w for w in text.replace("\n", " ").replace("\t", " ").split(" ") if w]
    x = np.concatenate(list(pq.passage_blocks(text)))
    assert x.shape == (max(1, -(-len(words) // pq.PASSAGE)), pq.DIMS)
    if not words:
        assert not x.any()
    for row, at in zip(x[:, pq.PAIR_DIMS + pq.WORD_DIMS :], range(0, len(words), pq.PASSAGE), strict=False):
        own = words[at : at + pq.PASSAGE]
        raw = "".join(own).encode()
        upper, lower = sum(65 <= c < 91 for c in raw) / len(raw), sum(97 <= c < 123 for c in raw) / len(raw)
        assert row[0] == pytest.approx(lower, abs=1e-5) and row[1] == pytest.approx(upper, abs=1e-5)
        assert row[4] == pytest.approx(sum(c > 127 for c in raw) / len(raw), abs=1e-5)
        assert row[7] == pytest.approx(sum(a == b for a, b in zip(own, own[1:], strict=False)) / len(own), abs=1e-5)
        assert row[8] == pytest.approx(len(set(own)) / len(own), abs=1e-5)
        assert row[13] == pytest.approx(len(own) / pq.PASSAGE)


def test_blocks_give_the_same_passages(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(pq.PASSAGE * 7 + 5)) + " end."
    whole = np.concatenate(list(pq.passage_blocks(text)))
    monkeypatch.setattr(pq, "BLOCK_WORDS", pq.PASSAGE * 2)
    parts = np.concatenate(list(pq.passage_blocks(text)))
    # The byte pair that spans two blocks and the spaces at a block's end are not in either.
    assert np.abs(whole - parts).max() < 0.1 and np.array_equal(whole[:, pq.PAIR_DIMS : -pq.SHAPES], parts[:, pq.PAIR_DIMS : -pq.SHAPES])


def test_gradients_by_differences():
    draw, p = np.random.default_rng(1), model()
    x, bags = draw.normal(0, 0.2, (9, pq.DIMS)), np.array([0, 1, 4, 8])
    labels, weights = np.array([0.0, 1, 1, 0]), np.array([1.0, 2, 0.5, 1])
    loss, slopes = pq.loss_and_slopes(p, x, bags, labels, weights)
    for k in p:
        for _ in range(4):
            at = tuple(draw.integers(n) for n in p[k].shape)
            moved = {name: v.copy() for name, v in p.items()}
            moved[k][at] += 1e-6
            assert slopes[k][at] == pytest.approx((pq.loss_and_slopes(moved, x, bags, labels, weights)[0] - loss) / 1e-6, abs=1e-5)


def test_score_is_attention_over_all_passages(monkeypatch):
    """The running sums over blocks against one softmax over the whole text."""
    p, text = model(), " ".join(f"w{i * i % 89}" for i in range(pq.PASSAGE * 6))
    monkeypatch.setattr(pq, "BLOCK_WORDS", pq.PASSAGE * 2)
    x = np.concatenate(list(pq.passage_blocks(text)))
    h, _, _, logits = pq._attend(p, x)
    share = np.exp(logits) / np.exp(logits).sum()
    assert pq.Model(p).score(text) == pytest.approx(1 / (1 + np.exp(-(share @ h @ p["c"] + p["d"][0]))))


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate([None, *TEXTS])] + [(None, "no id", "s"), (1, "again", "s")], "doc_id long, text string, score string")


def test_edges_without_labels(spark, rows):
    labels = "doc_id long, quality int"
    for made, expected in (([], 0.5), ([(1, 1), (3, None)], 1.0), ([(1, 0)], 0.0)):
        got = pq.judge(rows, spark.createDataFrame(made, labels)).collect()
        assert len(got) == 10 and {r["score"] for r in got} == {expected}
    assert pq.judge(rows.limit(0), spark.createDataFrame([], labels)).count() == 0


def test_edges_with_labels(spark, rows, monkeypatch):
    monkeypatch.setattr(pq, "EPOCHS", 2)
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(1, 0), (None, 1), (99, 1)], "doc_id long, quality int")
    model = pq.fit(rows, labels)
    got = pq.score(rows, model).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if not (r["text"] or "").strip()}) == 1
    assert [r["score"] for r in pq.score(rows, pq.fit(rows, labels)).collect()] == [r["score"] for r in got]


def test_held_out_documents(spark):
    """Accuracy and ranking on labelled documents that were held out."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    judged = pq.judge(spark.read.parquet(f"{sf}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id").toPandas()
    good, bad = judged[judged.quality == 1].score.to_numpy(), judged[judged.quality == 0].score.to_numpy()
    assert len(good) > 40 and len(bad) > 5
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (judged.predicted == judged.quality).mean() > 0.93 and (good >= 0.3).mean() > 0.98
