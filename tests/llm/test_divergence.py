"""The divergence audit against its definition, in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ablata.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, p int"


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows: list[tuple]) -> set[tuple]:
    docs = [(lang or "", source or "", TERM.findall(lowered(text or ""))) for _, text, lang, source, *_ in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= 3)
        sources = sorted({d[1] for d in own})
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if seen[t] >= 3) for s in sources}
        total = sum(counts.values(), Counter())

        def share(c: Counter, t: str) -> int:
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))  # noqa: B023

        f = lambda p, q: (p - q) * (p - q) // q
        for a in sources:
            pairs = [(sum(f(share(counts[a], t), share(counts[b], t)) for t in kept), b) for b in sources if b != a]
            terms = [(f(p, q), t) for t in kept if counts[a][t] and (p := share(counts[a], t)) > (q := share(total, t))]
            for part, values in (("pair", pairs), ("term", terms)):
                ranked = sorted(values, key=lambda v: (-v[0], v[1].encode()))
                out |= {(lang, a, part, item, value, i) for i, (value, item) in enumerate(ranked, 1) if part == "pair" or i <= 200}
    return out


def found(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def drawn(n: int, seed: int) -> list[tuple]:
    draw, out = random.Random(seed), []
    for i in range(n):
        words = [draw.choice(["Ab", "ab", "x1y", "ß", "ÄÖ", "äö", "über", "the", "THE", "z\u0000z", "日本", "é", "q" * draw.randint(1, 4)]) for _ in range(draw.randint(0, 30))]
        out.append((i, draw.choice([" ", "\n", "-", "_"]).join(words), draw.choice(["en", "de", "", None]), draw.choice(["a", "b", "c", "Ü", None, ""]), "t", 1))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_by_brute_force(spark, seed):
    rows = drawn(120, seed)
    got = found(divergence.audit(spark.createDataFrame(rows, SCHEMA), shard_rows=20))
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_groups_without_terms(spark):
    """A language without kept terms has pairs of value 0; null text, repeated rows."""
    rows = [(1, None, "fr", "a", None, None), (2, "one", "fr", "b", None, None), (2, "one", "fr", "b", None, None), (3, "w w w", "en", "a", None, None), (4, "w", "en", "a", None, None), (5, "w v", "en", None, None, None), (6, "12", "en", "c", None, None)]
    got = found(divergence.audit(spark.createDataFrame(rows, SCHEMA)))
    assert set(got) == brute(rows) and ("fr", "a", "pair", "b", 0, 1) in got


def test_more_terms_than_ranks(spark):
    names = ["".join(chr(97 + int(c)) for c in f"{i:03d}") for i in range(300)]
    rows = [(k, " ".join(names), "en", "a", None, None) for k in range(3)] + [(k, "other " * 500, "en", "b", None, None) for k in range(3, 6)]
    got = found(divergence.audit(spark.createDataFrame(rows, SCHEMA)))
    assert set(got) == brute(rows)
    assert max(r[5] for r in got) == 200


def test_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_are_batches_of_their_own(spark, monkeypatch):
    rows = [(i, "one two " * 400, "en", s, None, None) for i, s in enumerate("aabbc")]
    monkeypatch.setattr(divergence, "BATCH_CHARS", 100)
    assert set(found(divergence.audit(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)


def test_large_counts_stay_exact(spark):
    """10^9 times a count passes 64 bits."""
    n = 3 * 10**16 + 7
    share = spark.range(1).select(divergence._share(F.lit(n), F.lit(10**17), F.lit(1000)).alias("p")).first()["p"]
    assert share == 1 + 10**9 * (n + 1) // (10**17 + 1000)
