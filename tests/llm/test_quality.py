"""Quality rules against plain Python."""

import math
import re
from collections import Counter

import xxhash

from ablata.llm import quality

DOCS = [
    (1, "the cat sat on the mat and the dog lay by the door all day"),
    (2, None),
    (3, ""),
    (4, "# $ % junk || <> ** ## && $$ %% !! ?? ++ -- == ~~"),
    (5, "a b c d e\na b c d e\n\na b c d e\nx"),
    (6, "one\ttwo\x0bthree\x0cfour five six seven eight nine ten eleven"),
    (7, "w " * 3000),
    (8, "Ünï cödé wörds äre fïne ïn ëvery lïne öf thë tëxt"),
    (8, "Ünï cödé wörds äre fïne ïn ëvery lïne öf thë tëxt"),
    (9, "p q r s t u v p q r s t u v w x y z aa bb cc dd ee ff gg hh ii jj kk ll mm nn oo pp qq rr ss tt uu vv ww xx yy zz"),
]
LABELS = [(1, 1, 0), (8, 1, 0), (4, 0, 0), (77, 1, 0), (None, 1, 0)]


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def signed(h):
    return h - (1 << 64) * (h >> 63)


def grams(text):
    tokens = re.findall(r"[^\W_]+|(?:(?![^\W_])[^\x20\x09-\x0D])+", (text or "").lower())
    hashes = [xxhash.xxh64_intdigest(t.encode(), 42) for t in tokens]
    out = [signed(h) % quality.BUCKETS for h in hashes]
    for a, b in zip(hashes, hashes[1:], strict=False):
        first = xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)
        out.append(signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little"), first)) % quality.BUCKETS)
    return out


def test_judge(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = quality.judge(docs, labels).collect()
    assert len(rows) == len(DOCS)
    raw, target = Counter(), Counter()
    for d, t in DOCS:
        raw.update(grams(t))
        if d in (1, 8):
            target.update(grams(t))
    ratio = lambda g: math.log((target[g] + 1) / (target.total() + quality.BUCKETS)) - math.log((raw[g] + 1) / (raw.total() + quality.BUCKETS))
    by_text = {(r["doc_id"], r["text"]): r for r in rows}
    for d, t in DOCS:
        r, g = by_text[d, t], grams(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(t)
        assert r["base_failed"] == (base(t)[0] < 10 or 100 * base(t)[4] > 20 * base(t)[0])
        score = sum(map(ratio, g)) / len(g) if g else 0.0
        assert abs(r["score"] - score) < 1e-6
        assert r["kept"] == (not r["base_failed"] and score >= quality.THRESHOLD)


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["score"] == 0 for r in quality.judge(docs, labels).collect())
    assert quality.judge(docs.filter("doc_id > 99"), labels).count() == 0
    named = docs.selectExpr("doc_id", "text", "doc_id as kept", "'mine' as score", "1 as _w")
    got = quality.keep_good(named, labels)
    assert got.columns == named.columns
    assert sorted((r["doc_id"], r["kept"], r["score"], r["_w"]) for r in got.collect()) == [(d, d, "mine", 1) for d in (1, 4, 6, 8, 8)]


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, DOCS[0][1], 2, 3, 4, 5)], "doc_id long, text string, _w int, _h int, _t int, n_words int")
    for row in (quality.base_counts(docs).first(), quality.judge(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).first()):
        assert (row["_w"], row["_h"], row["_t"], row["n_words"]) == (2, 3, 4, base(DOCS[0][1])[0])


def test_window_hashes_share_pairs(spark):
    """Windows at the ends of short texts are counted, and no lambda reads five words by place for each window."""
    texts = [" ".join("abcdefghi"[:n]) for n in range(10)] + ["a b c d e a b c d e", "a a a a a", "a a a a a a", "x a b c d e y a b c d e", "a b c d x a b c d"]
    counted = quality.base_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: r["n_repeat_words"] for r in counted.collect()}
    assert [got[i] for i in range(len(texts))] == [0] * 10 + [10, 0, 6, 10, 0]
    assert "+ 4)" not in counted._jdf.queryExecution().analyzed().toString()
