"""Items without words, names without capitals, hot templates and windows, large benchmarks, and documents without an id."""

import random

import pytest

from ablata.llm import decontaminate as d


def caught(spark, docs, items, **how):
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs, items, **how).collect()}


def test_items_without_words_are_found_word_for_word(spark):
    items = ["12 + 37 = ?", "7 * 8", "42", "3 apples, 4 pears, 5 plums, 6 figs: 18?", "?!"]
    docs = ["so what is 12 + 37 = ? asked the man", "12 37", "it is 7 * 8 then", "42", "the answer is 42 again", "he had 3 apples, 4 pears, 5 plums, 6 figs: 18? no", "12 + 38 = ? and 7 * 9", "?!", "what?!"]
    assert caught(spark, docs, items) == {(0, 0), (2, 1), (3, 2), (5, 3), (7, 4)}


def test_names_without_capitals(spark):
    item = "When Sam has 3 apples and gives 2 apples to Ann how many apples does Sam have left"
    other = item.replace("Sam", "Robert").replace("Ann", "Jill").replace("3", "9")
    docs = [other, other.lower(), other.upper(), item.lower(), "when sam goes to town and gives 2 talks to all how many people does ann have left"]
    assert caught(spark, docs, [item]) == {(0, 0), (1, 0), (2, 0), (3, 0)}
    assert {(2, 0), (3, 0)} <= caught(spark, [*docs[:2], item.upper(), item.lower()], [item.lower()])


def test_consistency_runs_both_ways(spark):
    item = "pay 3 now and then 4 at noon and then 5 at dusk and then 6 at night"
    docs = ["pay 1 now and then 1 at noon and then 1 at dusk and then 1 at night", "pay 7 now and then 8 at noon and then 9 at dusk and then 10 at night"]
    assert caught(spark, docs, [item]) == {(1, 0)}


def test_documents_without_an_id_are_judged_one_by_one(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from the angry farmer"
    words = text.split()
    parts = [" ".join(words[i : i + 7]) for i in range(0, 11, 4)]
    docs = spark.createDataFrame([(None, p) for p in parts], "doc_id long, text string")
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert d.contaminated(docs, bench).count() == 0
    assert d.contaminated(docs.selectExpr("5L as doc_id", "text"), bench).count() == 1
    whole = spark.createDataFrame([(None, text), (None, text + " today"), (None, parts[0])], "doc_id long, text string")
    assert [r["doc_id"] for r in d.contaminated(whole, bench).collect()] == [None, None]


STORY = "the {} of {} sold {} carts to a {} near the {} gate before the {} bell rang {} times that evening"
THINGS = "king queen baker miller smith sailor farmer weaver potter mason cook clerk piper ferryman shepherd tinker".split()


def planted(n, seed):
    """Items that share a few templates, some of them verbatim but for a word, and documents with re-parameterised ones."""
    draw = random.Random(seed)
    fill = lambda: STORY.format(draw.choice(THINGS), draw.choice(["Rome", "Paris", "Oslo"]), draw.randrange(100), draw.choice(THINGS), draw.choice(THINGS), draw.choice(THINGS), draw.randrange(30))
    questions = [f"How many coins does {draw.choice(['Tom', 'Ann', 'Sue'])} have after {draw.randrange(90)} days if each day brings {draw.randrange(90)} coins more" for _ in range(n // 2)]
    return questions + [fill() for _ in range(n - n // 2)]


@pytest.mark.parametrize("blocks", [1 << 18, 50])
def test_hot_templates_and_many_windows(spark, monkeypatch, blocks):
    """600 items, half of them of one template, the others of common windows; broadcast, and by shuffles. The same classes as by pairs."""
    monkeypatch.setattr(d, "BLOCK_WINDOWS", blocks)
    items = planted(600, 1)
    other = "How many coins does Joe have after 95 days if each day brings 91 coins more"
    docs = ["well then. " + other + ". Who knows?", items[400], items[450] + " and so on", "the king of Rome sold nothing", "How many days does Joe have", *planted(40, 9)]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = d.found_classes(frame, bench).collect()
    hot = {r["doc_id"]: r for r in rows if r["n_items"] > 200}
    assert 0 in hot and set(range(5, 25)) <= set(hot) and not {1, 2, 3, 4} & set(hot)
    assert not hot[0]["same_slots"] and len([r for r in rows if r["doc_id"] == 0]) <= 3  # classes, not items
    members = {r["item_id"]: r["class_item_id"] for r in d.item_classes(bench).collect()}
    assert len(members) == 600 and all(members[c] == c for c in members.values())
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert {(1, members[400]), (2, members[450])} <= got
    # Every pair of classes that shares half of the class's windows, by brute force over plain windows.
    windows = lambda df, key: {(r["id"], r["base"]) for r in d._listed(d._hashed(df, key, "text"), lambda h: d.F.lit(True)).filter("h = base").collect()}
    own, held = {}, {}
    for i, h in windows(bench, "item_id"):
        own.setdefault(i, set()).add(h)
    for i, h in windows(frame, "doc_id"):
        held.setdefault(i, set()).add(h)
    want = {(doc, members[i]) for doc in held for i in own if 2 * len(own[i] & held[doc]) >= len(own[i])}
    assert got <= want and {p for p in want if p not in got} <= {p for p in want if p[0] != 1 and p[0] != 2}


def test_reparameterised_items(spark):
    """Of 200 planted questions with other numbers and names, at least nine in ten are found, and no other document."""
    draw = random.Random(3)
    words = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "ran sel tin vor".split()]
    names = "Alice Bruno Clara David Emma Felix Greta Henri".split()
    shape = [[draw.choice(words) for _ in range(22)] for _ in range(200)]

    def said(k):
        out, who = list(shape[k]), draw.sample(names, 2)
        for at, what in ((2, who[0]), (6, draw.randrange(2, 999)), (9, who[1]), (13, draw.randrange(2, 999)), (17, who[0])):
            out[at] = str(what)
        return " ".join(out)

    items = [said(k) for k in range(200)]
    docs = [" ".join(draw.choice(words) for _ in range(draw.randrange(30))) + f" {said(k)} " + " ".join(draw.choice(words) for _ in range(9)) for k in range(200)]
    docs += [" ".join(draw.choice(words) for _ in range(60)) for _ in range(200)]
    got = caught(spark, docs, items)
    assert sum((k, k) in got for k in range(200)) >= 180 and all(a == b for a, b in got)
