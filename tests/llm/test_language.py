"""Language identification: held-out accuracy, and the edges."""

import numpy as np
from pyspark.sql import functions as F

from ablata.llm import language


def test_ngrams_by_brute_force():
    text = "Ab, c\nÉ1b"
    at, counts = language.ngram_counts(text)
    letters = " ab c é b "
    grams = [letters[i : i + n] for n in (1, 2, 3) for i in range(len(letters) - n + 1)]

    def column(gram):
        h = 0
        for i, c in enumerate(gram):
            h = (h * 0x9E3779B1 + (0 if c == " " else ord(c)) + i + 1) & 0xFFFFFFFF
        return (h * 2654435761 & 0xFFFFFFFF) >> 17

    want = np.bincount([column(g) for g in grams], minlength=language.DIMS)
    assert at.tolist() == np.flatnonzero(want).tolist() and counts.tolist() == want[want > 0].tolist()
    assert not len(language.ngram_counts("1234 !!")[0]) and not len(language.ngram_counts(None)[0])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out")
    right = held.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert held.count() > 100 and right >= 0.97
    assert found.filter("score < 0 or score > 1").count() == 0


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(i, ("the cat and the dog " if i % 2 else "le chat et la souris ") * 3, "en" if i % 2 else "fr", "x") for i in range(60)]
    odd = [(100, None, "en", "x"), (101, "", "fr", "x"), (102, "12 !", None, "x"), (None, "the dog", None, "x"), (103, "la souris " * 50_000, None, "x")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(spark.createDataFrame(rows + odd, schema)).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[None][0] == "en" and got[103][0] == "fr"
    nothing = spark.createDataFrame([(1, "text", None, "x")], schema)
    assert language.identify(nothing).first()["lang_pred"] == "und"
    assert language.identify(nothing.filter("doc_id > 5")).count() == 0


def test_ftrl_by_brute_force(monkeypatch):
    """The classifier against its update rule, written out one coordinate at a time, and the temperature against its own loss."""
    import math
    import random

    monkeypatch.setattr(language, "DIMS", 12)
    draw, classes = random.Random(3), 3
    samples, labels = [], []
    for _ in range(25):
        at = sorted(draw.sample(range(12), 4))
        samples.append((np.array(at), np.array([draw.random() for _ in at])))
        labels.append(draw.randrange(classes))
    got, bias = language.fit_ftrl(samples, labels, classes)
    z, n = [[0.0] * classes for _ in range(13)], [[0.0] * classes for _ in range(13)]

    def weight(i, k):
        if abs(z[i][k]) <= language.L1:
            return 0.0
        return -(z[i][k] - math.copysign(language.L1, z[i][k])) / ((language.BETA + math.sqrt(n[i][k])) / language.ALPHA + language.L2)

    for _ in range(language.EPOCHS):
        for (at, x), label in zip(samples, labels, strict=True):
            row = [*zip(at.tolist(), x.tolist(), strict=True), (12, 1.0)]
            w = {(i, k): weight(i, k) for i, _ in row for k in range(classes)}
            margins = [sum(v * w[i, k] for i, v in row) for k in range(classes)]
            total = sum(map(math.exp, margins))
            for k in range(classes):
                off = math.exp(margins[k]) / total - (k == label)
                for i, v in row:
                    g = off * v
                    sigma = (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / language.ALPHA
                    z[i][k] += g - sigma * w[i, k]
                    n[i][k] += g * g
    want = np.array([[weight(i, k) for k in range(classes)] for i in range(13)])
    assert np.allclose(got, want[:-1]) and np.allclose(bias, want[-1])

    margins = np.array([[draw.gauss(0, 3) for _ in range(classes)] for _ in range(40)])
    said = np.array([int(m.argmax()) if draw.random() < 0.6 else draw.randrange(classes) for m in margins])

    def loss(t):
        return -sum(math.log(math.exp(m[y] / t) / sum(math.exp(v / t) for v in m)) for m, y in zip(margins.tolist(), said.tolist(), strict=True))

    t = language.fit_temperature(margins, said)
    assert all(loss(t) <= loss(t * f) + 1e-9 for f in (2 ** (1 / 8), 2 ** (-1 / 8)))


def test_repeated_ids_are_rows_of_their_own(spark):
    """One doc_id on many rows: each is a candidate for the sample, and none is multiplied."""
    rows = [(7, f"the cat and the dog {i}", "en") for i in range(300)] + [(8, f"le chat et la souris {i}", "fr") for i in range(300)]
    found = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(found) == 600
