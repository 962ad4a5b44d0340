"""SimHash classes against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from ablata.llm import components, simhash


def brute(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(fps):
    """doc_id -> least doc_id reachable, all pairs."""
    root = {d: d for d in fps}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in fps}


TEXTS = ["", None, "One", "one two", "Ünï CODE ÄB", "a b c d e", "A B C D E", "  a\tb\nc\x0bd\x0ce ", "x y z " * 500]


def test_fingerprints():
    for text in [*TEXTS, "word soup " + " ".join(map(str, range(9000)))]:
        assert simhash.fingerprint(text) == brute(text)


def test_classes(spark):
    draw = random.Random(1)
    base = [draw.choice("the of and to in a is that for it on with".split()) + str(draw.randrange(40)) for _ in range(400)]
    docs = []
    for i in range(140):
        words = list(base)
        for _ in range(draw.randrange(3)):
            words[draw.randrange(len(words))] = str(draw.random())
        docs.append((i, " ".join(words if i % 3 else [str(draw.random()) for _ in range(30)])))
    docs += [(200 + i, t) for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: r for r in simhash.simhash_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    fps = {d: brute(t) for d, t in docs}
    assert {d: int(r["fingerprint"], 16) for d, r in got.items()} == fps and all(len(r["fingerprint"]) == 16 for r in got.values())
    assert {d: r["component_id"] for d, r in got.items()} == classes(fps)


@pytest.mark.parametrize("bucket", [0, 3, 1000])
def test_crowded_entries_lose_no_link(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    draw = random.Random(2)
    centre = draw.getrandbits(64)
    fps = {centre}
    for _ in range(60):
        fp = draw.choice(sorted(fps))
        for _ in range(draw.randrange(1, 5)):
            fp ^= 1 << draw.randrange(64)
        fps.add(fp)
    signed = [f - (1 << 64) * (f >> 63) for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    numbered = {f: f & (1 << 64) - 1 for f in signed}
    want = classes(numbered)
    assert {f: got.get(f, f) for f in signed} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 51), (51, 50), (60, 60), (None, 4)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50, 51: 50}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_without_id_and_copies(spark):
    docs = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (2, "a b c", "t"), (None, "q r s", "u")], "doc_id long, text string, fp string")
    rows = simhash.simhash_components(docs).collect()
    assert len(rows) == 4 and sorted(str(r["component_id"]) for r in rows) == ["1", "1", "1", "None"]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "None"]
    assert simhash.simhash_components(docs.filter("doc_id > 9")).count() == 0


def test_one_row_of_each_component(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, "a b c", "t"), (None, "a b c", "s"), (None, "a b c", "s"), (5, long, "x"), (5, long, "y"), (None, "q r s", "u"), (None, "q r s", "u"), (9, None, "n"), (8, "", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = simhash.keep_one_row(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r["doc_id"]), r["text"]) for r in kept.collect())
    assert got == [("1", "a b c"), ("5", long), ("8", ""), ("None", "q r s")]
    assert sorted(map(str, simhash.keep_one_row(docs.repartition(7)).collect())) == sorted(map(str, kept.collect()))
    assert simhash.keep_one_row(docs.filter("doc_id > 99")).count() == 0


def test_kept_rows_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one two three four", "x", 1), (2, "one two three four", "y", 2), (None, "five", "z", 3)], "doc_id long, text string, _head string, `a.b` int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["_head"] for r in kept.collect()) == ["x", "z"]


def test_exploded_rows_are_not_broadcast(spark, monkeypatch):
    planned = []
    monkeypatch.setattr(simhash, "cut", lambda df: planned.append(df) or df)
    planned.append(simhash.links(spark.range(1000).select(F.xxhash64("id").alias("fp"))))
    # Spark takes the 33 or 65 rows of a fingerprint for one, so these joins look small whatever they hold.
    assert len(planned) == 2
    for df in planned:
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
