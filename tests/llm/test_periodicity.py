"""Periodic runs against a brute-force search."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from ablata.llm import periodicity


def brute(words: list[str]) -> list[tuple[int, int, int]]:
    """Every maximal stretch by its smallest period, straight from the definition."""
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            e = i
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e - i + q >= max(6, 4 * q) and e > i:
                stretch = words[i : e + q]
                smallest = next(p for p in range(1, len(stretch) + 1) if all(stretch[j] == stretch[j + p] for j in range(len(stretch) - p)))
                if smallest == q:
                    out.add((i, e - i + q, q))
            i = e + 1
    return sorted(out)


def made(draw: random.Random) -> list[str]:
    words = []
    for _ in range(draw.randint(0, 5)):
        part = [draw.choice("abc") for _ in range(draw.randint(1, 9))]
        words += part * draw.randint(1, 7) + part[: draw.randint(0, len(part))]
        words += [draw.choice("abcdefgh") for _ in range(draw.randint(0, 12))]
    return words


def test_runs_by_brute_force():
    draw = random.Random(5)
    for _ in range(600):
        words = made(draw)
        assert periodicity.find_runs(periodicity.word_ids(words)) == brute(words), words


def test_ranges_of_lags_give_the_same_runs():
    draw = random.Random(6)
    for _ in range(200):
        words = made(draw) + ["z"] * draw.randint(0, 40)
        ids, cuts = periodicity.word_ids(words), [1, 2, 3, 5, 8, 13, 1000]
        known = periodicity.find_runs(ids, 1, 2)
        parts = [run for lo, hi in zip(cuts, cuts[1:], strict=False) for run in periodicity.find_runs(ids, lo, hi, known if lo > 1 else None)]
        least = {}
        for s, length, q in parts:
            least[s, length] = min(q, least.get((s, length), q))
        assert sorted((s, length, q) for (s, length), q in least.items()) == brute(words)


def test_summary_by_hand():
    words = "x a b a b a b a b y y y y y y y".split()
    runs = periodicity.find_runs(periodicity.word_ids(words))
    assert runs == [(1, 8, 2), (9, 7, 1)]
    assert periodicity.summary(words, runs) == (16, 2, 9, 7, 1, 7000, [1, 8, 2, 9, 7, 1], "x a b y")


def test_ties_take_the_first_run():
    words = ["a"] * 6 + ["b"] * 6
    assert periodicity.summary(words, periodicity.find_runs(periodicity.word_ids(words)))[2:5] == (0, 6, 1)


def test_a_long_text_of_one_word_is_quick():
    assert periodicity.find_runs(np.zeros(200_000, np.int32)) == [(0, 200_000, 1)]


@pytest.fixture
def odd_rows(spark):
    texts = [None, "", " \t\n", "a", "a " * 40, "x y " * 300 + "z", "x y " * 300 + "z", "one two three four", "b c " * 8]
    rows = [(i, t, "c", 1) for i, t in enumerate(texts)] + [(None, "q " * 9, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, _result string, period int")


@pytest.mark.parametrize("long_chars", [periodicity.LONG_CHARS, 30])
def test_edges_and_both_ways(odd_rows, long_chars):
    """Nulls, empty texts, repeated rows and clashing names; texts dealt out by lags give the same rows."""
    got = {(r["doc_id"], r["text"]): r for r in periodicity.collapse(odd_rows, long_chars=long_chars).collect()}
    assert len(got) == 10
    for (_, text), row in got.items():
        words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        expected = periodicity.summary(words, brute(words))
        assert (row["n_words"], row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == expected[:6]
        assert [v for r in row["runs"] for v in r] == expected[6]
        assert row["collapsed"] == expected[7]
        assert row["_result"] in ("c", None)


def test_an_empty_table(spark, odd_rows):
    assert periodicity.collapse(odd_rows.limit(0)).count() == 0


def test_long_texts_by_ranges(spark, monkeypatch):
    """Ranges of several lags, with runs of periods above the short ones."""
    draw = random.Random(7)
    part = [f"w{draw.randint(0, 10**6)}" for _ in range(150)]
    words = ["u", "v"] + part * 5 + part[:17] + ["k"] * 50
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words))], "doc_id long, text string")
    rows = periodicity.collapse(docs, long_chars=10).collect()
    assert [[tuple(x) for x in r["runs"]] for r in rows] == [[(2, 767, 150), (769, 50, 1)]] * 2


def test_digests(spark):
    docs = spark.createDataFrame([(1, "a a a a a a b")], "doc_id long, text string")
    row = periodicity.digests(periodicity.collapse(docs)).first()
    assert row["runs_sha256"] == hashlib.sha256(b"0,6,1\n").hexdigest()
    assert row["collapsed_sha256"] == hashlib.sha256(b"a b").hexdigest()
