"""Mixing: targets by the iterative definition, rounding by its guarantees."""

import random
from collections import defaultdict

import pytest

from ablata.llm import mixture


def brute_targets(sizes):
    """Share by weight, stop at the limit, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixture.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        stopped = {s for s in free if share[s] >= 2 * sizes[s]}
        if not stopped:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in stopped}
        left -= sum(2 * sizes[s] for s in stopped)
        free -= stopped
    return target


def documents(n=1500):
    draw = random.Random(5)
    rows = []
    for i in range(n):
        source = "hot" if draw.random() < 0.4 else draw.choice(["a", "b", "É", "z", None, "q", "r"])
        rows.append((i, " ".join(["w"] * draw.choice([0, 1, 5, 30, 200])) if i % 50 else None, source))
    return rows


@pytest.fixture(scope="module")
def mixed(spark):
    docs = spark.createDataFrame([(*r, 0.5) for r in documents()], "doc_id long, text string, source string, target double").repartition(5)
    return docs, mixture.mix(docs).collect()


def test_targets_and_taken(mixed):
    _, rows = mixed
    docs = documents()
    assert len(rows) == len(docs)
    sizes, want = defaultdict(int), {d: (len((t or "").split()), s) for d, t, s in docs}
    for n, s in want.values():
        sizes[s] += n
    targets, taken = brute_targets(sizes), defaultdict(int)
    for r in rows:
        assert (r["size"], r["source"]) == want[r["doc_id"]]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - targets[s]) <= 200
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_reruns_agree(spark, mixed):
    docs, rows = mixed
    again = mixture.mix(docs.repartition(9)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_copies(spark, mixed):
    docs, rows = mixed
    got = defaultdict(int)
    out = mixture.take_copies(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r["doc_id"]] += 1
    assert got == {r["doc_id"]: r["copies"] for r in rows if r["copies"]}


def test_expected_shares_are_kept(spark):
    """Over many groups, a document's chance follows its source's ratio whatever its size."""
    rows = [(i, "w " * (1 if i % 2 else 9), s) for i in range(4000) for s in ("a",)] + [(i, "w " * 10, "b") for i in range(5000, 9000)]
    out = mixture.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in ("a", "b"):
        own = [r for r in out if r["source"] == source]
        for size in {r["size"] for r in own}:
            same = [r["copies"] for r in own if r["size"] == size]
            assert abs(sum(same) / len(same) - own[0]["target"] / own[0]["source_size"]) < 0.06


def test_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mixture.mix(spark.createDataFrame([], schema)).count() == 0
    nothing = mixture.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], schema)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in nothing] == [(0, 0.0, 0)] * 2
    same = spark.createDataFrame([(1, "a b", "x")] * 7 + [(None, "a b", "x")] * 3, schema)
    rows = mixture.mix(same).collect()
    assert len(rows) == 10 and abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 2
    named = same.selectExpr("*", "7 as copies", "8 as size", "9 as _key")
    got = mixture.take_copies(named)
    assert got.columns == named.columns and got.count() == sum(r["copies"] for r in rows)
    assert {(r["copies"], r["size"], r["_key"]) for r in got.collect()} == {(7, 8, 9)}


def test_copies_go_to_their_own_source(spark):
    """Equal ids and texts in two sources, and rows that differ in another column only."""
    draw = random.Random(8)
    rows = [(i % 40, "w " * (1 + i % 40), s, i % 3) for i in range(400) for s in ("a", "b", None)] + [(1000 + i, "v " * draw.randrange(9), "c", 0) for i in range(300)]
    rows += [(7, None, "a", 0), (7, "a", None, 0), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    planned, got = defaultdict(int), defaultdict(int)
    for r in mixture.mix(docs).collect():
        planned[r["doc_id"], r["source"], r["size"]] += r["copies"]
    first = mixture.take_copies(docs).collect()
    for r in first:
        got[r["doc_id"], r["source"], len((r["text"] or "").split())] += 1
    assert got == {k: n for k, n in planned.items() if n}
    again = mixture.take_copies(docs.repartition(7)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    per_row = defaultdict(int)
    for r in first:
        per_row[tuple(r)] += 1
    held = defaultdict(int)
    for r in rows:
        held[r] += 1
    assert all(n <= 2 * held[r] for r, n in per_row.items())


def test_many_equal_rows_are_rounded_in_parts(spark):
    docs = spark.range(3000).selectExpr("5L as doc_id", "'a b c' as text", "'x' as source").unionByName(spark.range(100).selectExpr("id as doc_id", "'d e' as text", "'y' as source"))
    rows = mixture.mix(docs).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert len(rows) == 3100 and all(abs(taken[s] - target[s]) <= 3 for s in target)
    assert mixture.take_copies(docs).count() == sum(r["copies"] for r in rows)


def test_targets_of_many_sources(spark):
    draw = random.Random(6)
    sizes = {f"s{draw.randrange(10**6)}": draw.choice([0, 1, 3, 50, 4000]) for _ in range(700)} | {None: 17}
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long").repartition(6)
    want, got = brute_targets(sizes), {r["source"]: r["target"] for r in mixture.source_targets(frame).collect()}
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)
