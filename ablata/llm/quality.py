"""Quality rules: surface counts and a hashed n-gram log-likelihood ratio. DataFrame functions only.

Tokens are runs of letters and digits, and runs of other signs, in lower case; unigrams and bigrams are hashed into ``BUCKETS``. Two
multinomials are estimated with add-one smoothing: the raw corpus from every document, the trusted target from documents whose label
says good quality. A document's score is the mean log ratio over its n-grams, and it is kept if the score reaches a fixed threshold,
so the verdict depends on nothing but its text and the two models.

The target is a classifier's training sample: at most ``TARGET_ROWS`` labelled documents, those with the least hash of doc_id. The
corpus counts cover all documents, and both models together are ``BUCKETS`` numbers, whatever the size of the corpus. Texts are not
shuffled: counting aggregates in place, and scoring looks the ratios up in an array.

Null, empty and wordless texts have no words and fail the base rules. A document without n-grams scores 0. Without labels the ratio
is 0 everywhere and only the base rules decide. Repeated rows are judged row by row; an empty table gives no rows; columns named like
a result are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, guarded

BUCKETS = 1 << 16
TARGET_ROWS = 20_000
THRESHOLD = -0.25
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
SYMBOLS = r"[#*$%&|<>]"
_TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"


def token_hashes(text: Column) -> Column:
    """Hashes of a text's tokens in order."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _bucket(h: Column) -> Column:
    """The hash's remainder; ``BUCKETS`` is a power of two."""
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _grams(hashes: Column) -> Column:
    """Buckets from token hashes: each token's, and each pair's."""
    pairs = F.zip_with(hashes, F.slice(hashes, 2, 1 << 30), lambda a, b: F.when(b.isNotNull(), _bucket(F.xxhash64(a, b))))
    return F.concat(F.transform(hashes, _bucket), pairs)


def gram_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, raw, target): n-gram counts over all documents and over the labelled target."""
    good = labels.filter("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_ROWS)
    marked = docs.select("doc_id", "text").join(F.broadcast(good.withColumn("good", F.lit(1))), "doc_id", "left")
    hashed = marked.select(F.col("good"), token_hashes(F.col("text")).alias("h"))
    grams = hashed.select("good", F.explode(_grams(F.col("h"))).alias("bucket")).filter("bucket is not null")
    return grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target"))


def ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """The log ratio of every bucket: ``BUCKETS`` numbers, the only ones that reach the driver."""
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for row in gram_counts(docs, labels).collect():  # one row for each bucket at most
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not sum(target):
        return [0.0] * BUCKETS
    n_raw, n_target = sum(raw) + BUCKETS, sum(target) + BUCKETS
    return [math.log((t + 1) / n_target) - math.log((r + 1) / n_raw) for r, t in zip(raw, target, strict=True)]


def _constant(values: list[float]) -> Column:
    """An array that the optimiser folds into one constant."""
    return F.split(F.lit(",".join(f"{v:.9g}" for v in values)), ",").cast("array<double>")


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``BASE``."""
    return guarded(docs, _counted, BASE)


def _counted(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.withColumn("_w", F.array_remove(F.split(text, WORD_GAP), ""))
    # Windows by 64-bit hash first. Equal windows have equal hashes, so a text whose hashes are distinct has no repeat. A window's hash is made of
    # its words' by pairs, which are shared by the windows that hold them; those that the text's end cuts off are left out.
    beside = lambda a, b, apart: F.zip_with(a, F.slice(b, apart + 1, 1 << 30), lambda x, y: F.xxhash64(x, y))
    positions = F.sequence(F.lit(0), F.size("_w") - WINDOW)
    words = split.withColumn("_x", F.when(F.size("_w") > WINDOW, F.transform("_w", lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))
    fours = words.withColumn("_h", beside("_x", "_x", 1)).withColumn("_h", beside("_h", "_h", 2))
    hashed = fours.withColumn("_h", F.slice(beside("_h", "_x", WINDOW - 1), 1, F.greatest(F.size("_x") - WINDOW + 1, F.lit(0))))
    # Only the others compare the windows themselves.
    spelled = F.transform(positions, lambda i: F.struct(F.array_join(F.slice("_w", i + 1, WINDOW), " ").alias("s"), i.alias("i")))
    seen = hashed.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(spelled)))
    same = lambda i, j: F.coalesce(F.get("_s", i)["s"] == F.get("_s", j)["s"], F.lit(False))
    twice = F.filter("_s", lambda x, i: same(i, i - 1) | same(i, i + 1))
    at = seen.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_p", lambda p, i: F.least(F.coalesce(F.get("_p", i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda acc, n: acc + n)
    lines = at.withColumn("_l", F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    return (
        lines.withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .drop("_w", "_x", "_h", "_s", "_p", "_l")
    )


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base columns, ``score`` and ``kept``."""
    model = _constant(ratios(docs, labels))
    return guarded(docs, lambda numbered: _judged(numbered, model, threshold), ["score", *BASE, "kept"])


def _judged(docs: DataFrame, model: Column, threshold: float) -> DataFrame:
    ratio = lambda h: F.get(model, _bucket(h))
    # One pass over the tokens: each one's unigram, and the bigram that it ends.
    both = F.transform("_t", lambda h, i: ratio(h) + F.when(i > 0, ratio(F.xxhash64(F.get("_t", i - 1), h))).otherwise(F.lit(0.0)))
    total = F.aggregate(both, F.lit(0.0), lambda acc, v: acc + v)
    hashed = docs.withColumn("_t", token_hashes(F.col("text")))
    scored = hashed.withColumn("score", F.when(F.size("_t") > 0, total / (2 * F.size("_t") - 1)).otherwise(F.lit(0.0))).drop("_t")
    # Always true, but not foldable: without it the optimiser moves filters on the verdict below the projections and inlines them into
    # each other's lambdas, so that whole arrays are rebuilt for every element.
    opaque = F.monotonically_increasing_id() >= 0
    return _counted(scored).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold) & opaque)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns as they were."""
    model = _constant(ratios(docs, labels))
    # Numbers for names, as results must not take the place of columns either.
    names = {c: c if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)}
    numbered = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    return _judged(numbered, model, threshold).filter("kept").select(*(F.col(n).alias(c) for c, n in names.items()))
