"""Quality scores by attention-based multiple-instance learning over passages.

A document is a bag of passages, its successive stretches of ``PASSAGE`` words. A passage becomes ``DIMS`` numbers: shares of hashed byte
pairs, shares of hashed words, and shape (kinds of characters, word lengths, repeated words). A learned layer encodes them; gated
attention, tanh times sigmoid of two learned projections, gives each passage a weight, the weights of a document sum up to one, and the
weighted sum of the passages' codes is scored by a logistic layer. Only the document has a label; all layers are fitted together by
Adam on the log loss.

The training sample is bounded: of each label at most ``PER_LABEL`` documents, those with the least hash of doc_id, and of these the ones
with up to ``SAMPLE_CHARS`` characters. Each label weighs as all its labelled documents, so that scores are probabilities. The model is
about ``DIMS`` times ``CODES`` numbers; scoring is a scan of whole texts without a shuffle, a document's passages in blocks of
``BLOCK_WORDS`` words under one running maximum, so memory does not grow with a text's number of passages.

Null, empty and wordless texts are one passage of zeros and are scored like any other. Without labelled documents, or with one label only,
every score is the share of label 1, 0.5 without any. Several labels of a doc_id count as the greatest; null labels as none; repeated rows
are scored row by row; an empty table gives no rows; columns called score and predicted are replaced, others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE, PAIR_DIMS, WORD_DIMS, SHAPES = 64, 512, 256, 16
DIMS = PAIR_DIMS + WORD_DIMS + SHAPES
CODES, GATES = 32, 16
#: The training sample: documents of a label, and characters of a document.
PER_LABEL, SAMPLE_CHARS = 2_000, 20_000
EPOCHS, BATCH, RATE, DECAY, HELD_BACK = 30, 64, 3e-3, 1e-4, 5
BLOCK_WORDS = PASSAGE * 512
FOLDS, THRESHOLD = 5, 0.3
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Kinds of bytes: lower case, upper case, digit, other ASCII sign, beyond ASCII.
_KIND = np.full(256, 4, np.uint8)
_KIND[33:128] = 3
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a text's bytes."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[raw], [True]]).view(np.int8)))
    return edges[::2], edges[1::2]


def _passages(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Features of the passages that the words of ``starts`` and ``ends`` make."""
    n = -(-len(starts) // PASSAGE)
    out = np.zeros((n, DIMS), np.float32)
    of_word = np.arange(len(starts)) // PASSAGE
    first, last = int(starts[0]), int(ends[-1])
    part = raw[first:last]
    lengths = ends - starts
    # Which passage a byte is in; the spaces after a passage belong to it.
    of_byte = np.searchsorted(starts[::PASSAGE] - first, np.arange(len(part)), "right") - 1
    kinds = _KIND[part]
    inside = ~_SPACE[part]
    pair = part[:-1].astype(np.uint32) * 257 + part[1:]
    pair = (pair * np.uint32(2654435761)) >> np.uint32(32 - PAIR_DIMS.bit_length() + 1)
    sizes = np.bincount(of_byte, minlength=n).astype(np.float32)
    out[:, :PAIR_DIMS] = np.bincount(of_byte[:-1] * PAIR_DIMS + pair, minlength=n * PAIR_DIMS).reshape(n, PAIR_DIMS) / np.maximum(sizes, 1)[:, None]
    # A word's hash is a sum over its bytes, each times a power of an odd number by its place in the word.
    place = np.arange(len(part)) - np.repeat(starts - first, np.diff(np.append(starts, last)))
    weighed = (part.astype(np.uint64) + np.uint64(1)) * _powers(int(place.max()) + 1)[place]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(inside, weighed, np.uint64(0)), dtype=np.uint64)])
    hashes = sums[ends - first] - sums[starts - first]
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (hashes >> np.uint64(64 - WORD_DIMS.bit_length() + 1)).astype(np.int64)
    words = np.bincount(of_word, minlength=n).astype(np.float32)
    out[:, PAIR_DIMS : PAIR_DIMS + WORD_DIMS] = np.bincount(of_word * WORD_DIMS + bucket, minlength=n * WORD_DIMS).reshape(n, WORD_DIMS) / words[:, None]
    shape = out[:, PAIR_DIMS + WORD_DIMS :]
    chars = np.bincount(of_word, lengths, n)
    for k in range(5):
        shape[:, k] = np.bincount(of_byte, inside & (kinds == k), n) / chars
    shape[:, 5] = np.log1p(chars / words)
    shape[:, 6] = np.sqrt(np.maximum(np.bincount(of_word, lengths.astype(float) ** 2, n) / words - (chars / words) ** 2, 0)) / 8
    again = np.append((hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1]), False)
    shape[:, 7] = np.bincount(of_word, again, n) / words
    distinct = np.unique(of_word.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    shape[:, 8] = np.bincount((distinct >> np.uint64(40)).astype(int), minlength=n) / words
    shape[:, 9] = np.bincount(of_word, kinds[starts - first] == 1, n) / words
    shape[:, 10] = np.bincount(of_word, kinds[ends - 1 - first] == 3, n) / words
    shape[:, 11] = np.bincount(of_word, (lengths == 1) & (kinds[starts - first] == 3), n) / words
    shape[:, 12] = np.bincount(of_byte, part == 10, n) / words
    shape[:, 13] = words / PASSAGE
    shape[:, 14] = 1.0
    # The shares of hashes are small beside the shape's.
    out[:, :PAIR_DIMS] = np.sqrt(out[:, :PAIR_DIMS])
    out[:, PAIR_DIMS : PAIR_DIMS + WORD_DIMS] = np.sqrt(out[:, PAIR_DIMS : PAIR_DIMS + WORD_DIMS])
    return out


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, 0x9E3779B97F4A7C15, np.uint64)]), dtype=np.uint64)


def passage_blocks(text: str | None):
    """The features of a whole text's passages, in blocks of ``BLOCK_WORDS`` words; one passage of zeros without words."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends = word_bounds(raw)
    if not len(starts):
        yield np.zeros((1, DIMS), np.float32)
    for at in range(0, len(starts), BLOCK_WORDS):
        yield _passages(raw, starts[at : at + BLOCK_WORDS], ends[at : at + BLOCK_WORDS])


@dataclass(frozen=True)
class Model:
    """The layers: encoder (w, b), attention (v, u, a), score (c, d); without an encoder the score is d."""

    layers: dict[str, np.ndarray]

    def score(self, text: str | None) -> float:
        """The probability of label 1."""
        p = self.layers
        if "w" not in p:
            return float(p["d"][0])
        most, total, held = -np.inf, 0.0, np.zeros(CODES)
        for x in passage_blocks(text):
            h, _, _, logits = _attend(p, x)
            grown = max(most, float(logits.max()))
            e, shrink = np.exp(logits - grown), np.exp(most - grown)
            total, held, most = total * shrink + e.sum(), held * shrink + e @ h, grown
        return float(_sigmoid(held / total @ p["c"] + p["d"][0]))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _attend(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h = np.tanh(x @ p["w"] + p["b"])
    t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    return h, t, g, (t * g) @ p["a"]


def loss_and_slopes(p: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The weighted log loss of documents, and its gradient. ``bags`` are the first passages of each document."""
    sizes = np.diff(np.append(bags, len(x)))
    of = np.repeat(np.arange(len(bags)), sizes)
    h, t, g, logits = _attend(p, x)
    e = np.exp(logits - np.maximum.reduceat(logits, bags)[of])
    share = e / np.add.reduceat(e, bags)[of]
    z = np.add.reduceat(share[:, None] * h, bags)
    margin = z @ p["c"] + p["d"][0]
    total = weights.sum()
    loss = float((weights * (np.logaddexp(0, margin) - labels * margin)).sum() / total)
    dm = weights * (_sigmoid(margin) - labels) / total
    dz = dm[:, None] * p["c"]
    dshare = (dz[of] * h).sum(1)
    dlogit = share * (dshare - np.add.reduceat(share * dshare, bags)[of])
    dtg = dlogit[:, None] * p["a"]
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    dh = (share[:, None] * dz[of] + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
    return loss, {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ dlogit, "c": z.T @ dm, "d": np.array([dm.sum()])}


def fit_layers(bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """All layers by Adam over shuffled batches of documents; the epoch with the least loss on a held-back fifth stays."""
    draw = np.random.default_rng(seed)
    p = {k: draw.normal(0, s, shape) for k, s, shape in (("w", 0.3, (DIMS, CODES)), ("v", 0.2, (CODES, GATES)), ("u", 0.2, (CODES, GATES)), ("a", 0.2, GATES), ("c", 0.2, CODES))}
    p |= {"b": np.zeros(CODES), "d": np.zeros(1)}
    mean, square, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    order = draw.permutation(len(bags))
    back = order[: len(bags) // HELD_BACK] if len(bags) >= 50 else order
    learned = order[len(bags) // HELD_BACK :] if len(bags) >= 50 else order

    def gathered(at: np.ndarray):
        sizes = np.array([len(bags[i]) for i in at])
        return np.concatenate([bags[i] for i in at]).astype(np.float64), np.cumsum(sizes) - sizes, labels[at], weights[at]

    best, kept = np.inf, p
    for _ in range(EPOCHS):
        draw.shuffle(learned)
        for at in range(0, len(learned), BATCH):
            _, slopes = loss_and_slopes(p, *gathered(learned[at : at + BATCH]))
            step += 1
            for k, slope in slopes.items():
                slope = slope + DECAY * p[k]
                mean[k] = 0.9 * mean[k] + 0.1 * slope
                square[k] = 0.999 * square[k] + 0.001 * slope * slope
                p[k] = p[k] - RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        parts = [back[at : at + 256] for at in range(0, len(back), 256)]
        now = sum(loss_and_slopes(p, *gathered(part))[0] * weights[part].sum() for part in parts) / weights[back].sum()
        if now < best:
            best, kept = now, {k: v.copy() for k, v in p.items()}
    return kept


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, quality). At most 2 * ``PER_LABEL`` texts of ``SAMPLE_CHARS`` characters reach the driver."""
    marked = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).filter("quality in (0, 1)")
    counts = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return Model({"d": np.array([float(next(iter(counts), 0.5))])})
    least = [marked.filter(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_LABEL) for k in (0, 1)]
    chosen = F.broadcast(least[0].union(least[1]))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").filter(F.length(F.coalesce("text", F.lit(""))) <= SAMPLE_CHARS)
    rows = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * PER_LABEL).collect()
    held = {k: sum(r["quality"] == k for r in rows) for k in (0, 1)}
    if not all(held.values()):
        return Model({"d": np.array([counts[1] / sum(counts.values())])})
    bags = [np.concatenate(list(passage_blocks(r["text"]))) for r in rows]
    y = np.array([r["quality"] for r in rows], float)
    weights = np.where(y == 1, counts[1] / held[1], counts[0] / held[0])
    layers = fit_layers(bags, y, weights / weights.mean())
    return Model({k: v.astype(np.float32) for k, v in layers.items()})


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(text) for text in texts], dtype="float64")

    others = [f"`{c}`" for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(*others, F.pandas_udf(run, "double")(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text has remainder 0; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from labelled documents that aren't held out, scored for all."""
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))).select("doc_id", "quality"))
    return score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model, threshold).drop("text")
