"""Items that share a preamble, texts that repeat a window, and clashing names."""

import random
import time

from ablata.llm import decontaminate as d

PREAMBLE = "read the following passage with great care and then choose the one answer that best fits what the writer wanted to say about"


def frames(spark, docs, items):
    return spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_a_shared_preamble_is_no_item(spark):
    """1,000 items that share 23 words: documents of these words alone hold none, one with an item's own words only that."""
    draw = random.Random(2)
    own = [" ".join(f"{draw.choice('bdfgklmnprst')}{draw.choice('aeiou')}{draw.choice('bdgkmnrst')}{draw.randrange(97, 99)}".translate({57: "q", 55: "w", 56: "y"}) for _ in range(10)) for _ in range(1000)]
    items = [f"{PREAMBLE} {words}" for words in own]
    docs = [f"{k * 'word '}{PREAMBLE} nothing at all" for k in range(20)] + [f"so {items[77]} then"]
    rows = d.found_classes(*frames(spark, docs, items)).collect()
    assert [(r["doc_id"], r["item_id"]) for r in rows] == [(20, 77)]
    assert rows[0]["n_matched"] == rows[0]["n_windows"]


def test_an_item_made_of_shared_windows(spark):
    """An item whose every window is in other items, too, is found where it is whole."""
    items = ["one two three four five six seven eight", "five six seven eight nine ten", "one two three four five six seven eight nine ten eleven"]
    rows = d.found_classes(*frames(spark, [items[1], f"so {items[0]}", "one two three four five"], items)).collect()
    assert {(0, 1), (1, 0)} <= {(r["doc_id"], r["item_id"]) for r in rows}
    assert not any(r["doc_id"] == 2 for r in rows)


def test_repeats_are_not_multiplied(spark):
    """A word a hundred thousand times against an item of three hundred: the time of one pass, not of a product."""
    docs, items = frames(spark, ["rose " * 100_000, "rose " * 300, "rose red " * 50_000], ["rose " * 300])
    began = time.time()
    rows = d.found_classes(docs, items).collect()
    assert sorted((r["doc_id"], r["n_matched"], r["n_windows"]) for r in rows) == [(0, 1, 1), (1, 1, 1)]
    assert time.time() - began < 90


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog", "a", 1, "x"), (2, "some clean text of its own", "b", 2, "y"), (None, "the quick brown fox jumps over the lazy dog", "c", 3, "z")], "doc_id long, text string, _caught string, `_doc` int, `a.b` string")
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    kept = d.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r["_caught"] for r in kept.collect()) == ["b", "c"]
