"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters in lower case, everything else a space; n-grams of 1 to ``LONGEST`` characters are hashed into ``DIMS`` columns. Document
frequencies count every training document. The classifier is fitted on a bounded sample of them, ``PER_LANGUAGE`` for each language
(those with the least hash of doc_id), by follow-the-regularised-leader with L1 and L2 penalties; a fifth of the sample is held back to
fit the softmax temperature. The model is ``DIMS`` numbers a language; prediction is a scan without a shuffle.

A text that is null or has no letters is ``und`` with score 0. Rows with null lang are not learned from; without any training row
every text is ``und``. A doc_id's remainder decides what is held out; null counts as the empty text, whose remainder is 0. Repeated
rows are predicted row by row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

DIMS, LONGEST, FOLDS = 1 << 15, 3, 5
PER_LANGUAGE, MOST_SAMPLED = 400, 8_000
#: The table of languages is broadcast if it has so many rows at most; beyond that it is joined by shuffles.
BROADCAST_LANGUAGES = 10_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 2e-3, 1e-3, 4
UNKNOWN = "und"
_MULTIPLY = np.uint32(2654435761)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Columns and counts of a text's n-grams; both empty if it has no letters."""
    none = np.zeros(0, np.int64), np.zeros(0, np.float64)
    if not text:
        return none
    lowered = text.lower()
    if not any(map(str.isalpha, lowered)):
        return none
    codes = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), "<u4")
    points, back = np.unique(codes, return_inverse=True)
    letter = np.array([chr(p).isalpha() for p in points])
    codes = np.concatenate([[0], np.where(letter[back], codes, 0), [0]]).astype(np.uint32)
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]  # one space for several
    total, grown = np.zeros(DIMS, np.int64), np.zeros(len(codes), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(codes) < n:
            break
        grown = grown[: len(codes) - n + 1] * np.uint32(0x9E3779B1) + codes[n - 1 :] + np.uint32(n)
        total += np.bincount((grown * _MULTIPLY) >> np.uint32(17), minlength=DIMS)
    at = np.flatnonzero(total)
    return at, total[at].astype(np.float64)


@dataclass(frozen=True)
class Model:
    """Weights (DIMS x languages), bias, inverse document frequencies and temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def features(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """TF-IDF values of unit length."""
        x = (1 + np.log(counts)) * self.idf[at]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def margins(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability."""
        at, counts = ngram_counts(text)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        p = _softmax(self.margins(at, self.features(at, counts)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit_ftrl(samples: list[tuple[np.ndarray, np.ndarray]], labels: list[int], n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal with elastic net, in the samples' order."""
    z, n = np.zeros((DIMS + 1, n_classes)), np.zeros((DIMS + 1, n_classes))

    def weights(rows):
        shrunk = np.sign(z[rows]) * np.maximum(np.abs(z[rows]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[rows])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for (at, x), label in zip(samples, labels, strict=True):
            rows, values = np.append(at, DIMS), np.append(x, 1.0)
            w = weights(rows)
            slope = _softmax(values @ w)
            slope[label] -= 1
            g = values[:, None] * slope
            grown = n[rows] + g * g
            z[rows] += g - (np.sqrt(grown) - np.sqrt(n[rows])) / ALPHA * w
            n[rows] = grown
    everything = weights(slice(None))
    return everything[:-1], everything[-1]


def fit_temperature(margins: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, on a grid of powers."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        z = margins / t
        top = z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z - top).sum(axis=1)) + top[:, 0] - z[np.arange(len(labels)), labels]).mean())

    return min((2.0 ** (k / 8) for k in range(-40, 25)), key=loss)


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen, n = np.zeros(DIMS + 1, np.int64), 0
    for batch in batches:
        for text in batch["text"]:
            at, _ = ngram_counts(text)
            if len(at):
                seen[at] += 1
                n += 1
    seen[DIMS] = n
    at = np.flatnonzero(seen)
    yield pd.DataFrame({"column": at, "n": seen[at]})


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch[at : at + 256]
            pairs = [ngram_counts(text) for text in part["text"]]
            yield pd.DataFrame({"lang": part["lang"], "rank": part["rank"], "k": part["k"], "at": [a.tolist() for a, _ in pairs], "counts": [c.tolist() for _, c in pairs]})


def fit(training: DataFrame) -> Model:
    """A model from (doc_id, text, lang)."""
    named = training.filter("lang is not null")
    frequencies = named.select("text").mapInPandas(_frequencies, "column int, n long").groupBy("column").agg(F.sum("n").alias("n")).collect()  # DIMS rows at most
    seen = np.zeros(DIMS + 1)
    for row in frequencies:
        seen[row["column"]] = row["n"]
    idf = np.log((1 + seen[DIMS]) / (1 + seen[:DIMS])) + 1
    order = Window.partitionBy("lang").orderBy("rank", "doc_id", "text")
    # Hashes are uniform, so of a language's n rows about 4 * PER_LANGUAGE are below this share of the range: however frequent the
    # language, the window orders few rows, and the least PER_LANGUAGE hashes are among them.
    n = cut(named.groupBy("lang").agg(F.count("*").alias("n")))
    n = F.broadcast(n) if n.count() <= BROADCAST_LANGUAGES else n
    ranked = named.select("doc_id", "text", "lang", F.xxhash64("doc_id").alias("rank")).join(n, "lang")
    few = ranked.filter((F.col("rank") / F.lit(2.0**64) + 0.5) * F.col("n") <= 4 * PER_LANGUAGE + 40)
    first = few.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= PER_LANGUAGE)
    # Features of the sample, at most DIMS a text, go to the driver; texts stay. Rows of a repeated doc_id are candidates of their own.
    made = first.select("text", "lang", "rank", "k").mapInPandas(_counted, "lang string, rank long, k int, at array<int>, counts array<double>")
    rows = made.orderBy("k", "lang").limit(MOST_SAMPLED).collect()
    rows = sorted((r for r in rows if r["at"]), key=lambda r: (r["rank"], r["lang"], r["k"]))
    languages = sorted({r["lang"] for r in rows})
    model = Model(languages, np.zeros((DIMS, len(languages))), np.zeros(len(languages)), idf)
    pairs = [(at := np.array(r["at"]), model.features(at, np.array(r["counts"]))) for r in rows]
    labels = [languages.index(r["lang"]) for r in rows]
    back = [i for i in range(len(rows)) if i % 5 == 4]
    learned = [i for i in range(len(rows)) if i % 5 != 4]
    if not learned:
        return model
    weights, bias = fit_ftrl([pairs[i] for i in learned], [labels[i] for i in learned], len(languages))
    raw = Model(languages, weights, bias, idf)
    margins = np.array([raw.margins(*pairs[i]) for i in back]).reshape(len(back), len(languages))
    return Model(languages, weights.astype(np.float32), bias, idf, fit_temperature(margins, np.array([labels[i] for i in back], int)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def own(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.predict(text) for text in texts]
        return pd.DataFrame({"lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    # The struct takes the place of any lang_pred there was, then its fields do; no other name is used.
    others = [f"`{c}`" for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*others, F.pandas_udf(own, "lang_pred string, score double")(F.col("text")).alias("lang_pred")).select(*others, "lang_pred.*")


def held_out():
    """Whether crc32 of doc_id as text has remainder 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents that aren't held out, predicted for all."""
    model = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
