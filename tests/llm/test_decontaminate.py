"""Decontamination against brute force, and re-parameterised questions."""

import re
from collections import defaultdict

from ablata.llm import decontaminate as d

BENCH = [
    (1, "What is the total price of 3 apples and 12 pears when Alice pays 5 dollars each day in June"),
    (2, "tiny item"),
    (3, None),
    (4, ""),
    (5, "one"),
    (6, "the quick brown fox jumps over the lazy dog and runs away from the angry farmer"),
    (7, "the quick brown fox jumps over the lazy dog and runs away from the angry farmer"),
    (8, "If Tom has 3 coins and gives 3 coins to Ann then Tom has 0 coins left now"),
]
DOCS = [
    (10, "Quiz: what is the total price of 7 apples and 40 pears when Robert pays 9 euros each day in May"),
    (11, "What is the total price of 3 apples and 12 pears when Alice pays 5 dollars each day in June"),
    (12, "nothing here at all about 5 dollars and the total price of anything"),
    (13, "well, The Quick, brown fox jumps -- over the lazy dog; and runs away from the angry farmer!"),
    (14, "the quick brown fox jumps over a fence"),
    (15, "a tiny item"),
    (16, "tiny item"),
    (17, None),
    (18, ""),
    (19, "so if Tom has 9 coins and gives 9 coins to Sue then Tom has 2 coins left now"),
    (None, "the quick brown fox jumps over the lazy dog and runs away from the angry farmer"),
    (20, "x " * 20_000 + "the quick brown fox jumps over the lazy dog and runs away from the angry farmer"),
    (20, "some other text under the same id"),
]


def tokens(text):
    """(template, slot) of each token, in plain Python."""
    text = re.sub(r"(?<=[^\W_] )[A-ZÀ-Ý][a-zà-ÿ]+|(?<=[,;] )[A-ZÀ-Ý][a-zà-ÿ]+", lambda m: "\u0001" + m[0], text or "")
    out, number = [], False
    for t in re.findall(r"[0-9]+(?:[.,][0-9]+)*|\u0001?[^\W_]+", text.lower()):
        kind = "<name>" if t[0] == "\u0001" else "<number>" if t[0].isdigit() else "<unit>" if number and t in d.UNITS else None
        number = t[0].isdigit()
        out.append((kind or t, t if kind else None))
    return out


def windows(text):
    found = tokens(text)
    if len(found) < 2:
        return {}
    width, out = min(5, len(found)), defaultdict(set)
    for i in range(len(found) - width + 1):
        part = found[i : i + width]
        slots = tuple(s for _, s in part)
        if slots.count(None) >= 2:
            out[tuple(t for t, _ in part)].add(slots)
    return out


def brute():
    hits = {}
    for item, text in BENCH:
        own = windows(text)
        for doc in {x for x, _ in DOCS}:
            held = defaultdict(set)
            for other, t in DOCS:
                if other == doc:
                    for w, slots in windows(t).items():
                        held[w] |= slots
            same = [w for w in own if w in held]
            pairs = {(a, b) for w in same for x in own[w] for y in held[w] for a, b in zip(x, y, strict=True) if a is not None}
            consistency = len({a for a, _ in pairs}) / len(pairs) if pairs else 1.0
            if same and len(same) >= 0.5 * len(own) and consistency >= 0.5:
                hits[doc, item] = (len(same), len(own), len(pairs), round(consistency, 6))
    return hits


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(*r, 1) for r in DOCS], "doc_id long, text string, h int")
    bench = spark.createDataFrame([(*r, "x") for r in BENCH], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): (r["n_matched"], r["n_windows"], r["n_slots"], round(r["consistency"], 6)) for r in d.contaminated(docs, bench).collect()}
    assert got == brute()
    assert {(10, 1), (11, 1), (13, 6), (13, 7), (16, 2), (None, 6), (20, 7)} <= set(got) and not {12, 14, 15, 17, 18} & {k for k, _ in got}
    kept = d.keep_clean(docs, bench)
    assert kept.columns == docs.columns and {12, 14, 15, 17, 18} <= {r["doc_id"] for r in kept.collect()} and 10 not in {r["doc_id"] for r in kept.collect()}


def test_blocks_change_nothing(spark, monkeypatch):
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")
    whole = sorted(map(str, d.contaminated(docs, bench).collect()))
    monkeypatch.setattr(d, "BLOCK_WINDOWS", 7)
    assert sorted(map(str, d.contaminated(docs, bench).collect())) == whole


def test_empty(spark):
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")
    assert d.contaminated(docs.filter("doc_id > 99"), bench).count() == 0
    assert d.contaminated(docs, bench.filter("item_id > 99")).count() == 0
