"""Base patterns against the plain regular expressions; the field on repeated and similar candidates."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ablata.llm import private_data as p


def brute(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and p.luhn(digits(m[0]))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(found)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "x.y@", "@", "a", ".", "1.2.3.4", "255", "256", "0", ".0001.", "4111 1111 1111 1111", "4111-1111", "+1 (988) 555-2485", "+", " ", "-", "(", "é", "\n", "1", "@b", "com"]), max_size=14))
def test_base(parts):
    text = "".join(parts)
    assert p.base_spans(text) == brute(text)


def test_long_texts_are_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+" * 200_000, "a@" * 100_000, "1 " * 150_000):
        p.base_spans(text)


def test_finding_is_linear(weights):
    """All of the search, on runs without white space and on texts that are nothing but candidates."""
    runs = ["Zm9vYmFy0+/9" * 25_000, "漢字1" * 100_000, "a" * 300_000 + "@b1", "a@" * 150_000, "x at y.z" * 40_000, "1." * 150_000, "((at))" * 50_000, "a at " * 60_000, "@" * 300_000, "a.b@c.d " * 3_000, "12345678x " * 3_000]
    for text in runs:
        start = time.time()
        p.find(text, weights)
        assert time.time() - start < 15, text[:20]


def corpus(n, seed):
    draw = random.Random(seed)
    words = "the a lake stone over runs very green under house slowly bread paper with".split()
    said = lambda k: " ".join(draw.choice(words) for _ in range(k))

    def card():
        body = "".join(str(draw.randrange(10)) for _ in range(15))
        return next(body + c for c in "0123456789" if p.luhn(body + c))

    def personal():
        return draw.choice([lambda: f"{draw.choice(words)}.{draw.randrange(99)}@mail{draw.randrange(9)}.example.com", lambda: ".".join(str(draw.randrange(256)) for _ in range(4)), card, lambda: f"+1 ({draw.randrange(200, 999)}) {draw.randrange(200, 999)}-{draw.randrange(1000, 9999)}"])()

    return [" ".join(f"{said(draw.randrange(5, 40))} {personal()}" for _ in range(draw.randrange(1, 4))) + f" {said(9)} item {draw.randrange(10**7, 10**8)} {said(9)}." for _ in range(n)]


@pytest.fixture(scope="module")
def weights():
    return p.train([p.training_view(t, random.Random(i)) for i, t in enumerate(corpus(300, 1))])


def test_skip_weights_are_learned(weights):
    """From zero: mentions that resemble each other agree, most of all where a spelling alone can't tell (phone numbers)."""
    same = np.diag(weights.skip)[1:]
    assert (same > 0.5).all() and same[3] == same.max() and weights.skip[0, 4] < 0


def test_variants_of_unseen_texts(weights):
    """Spellings that no base pattern matches, repeated, split or told by a word before them, beside as many look-alikes."""
    wanted, caught, wrong = Counter(), Counter(), 0
    for i, text in enumerate(corpus(300, 2)):
        whole, labels = p.with_variants(text, random.Random(-i - 1), 1)
        base, spans = p.find(whole, weights)
        assert base == brute(whole) and set(base) <= set(spans)
        found = {(a, b): k for a, k, b in spans}
        for span, k in labels.items():
            if k >= 0:
                wanted[k] += 1
                caught[k] += found.get(span) == k
        wrong += sum(labels.get((a, b), -1) < 0 for a, k, b in set(spans) - set(base))
    assert all(caught[k] >= 0.9 * wanted[k] for k in range(4)) and wrong <= 0.02 * sum(wanted.values())


def test_similar_candidates_agree(weights):
    text = "call +1 (988) 555-2485 now, " + "word " * 300 + "or 988 555 2485 later; mail bob.42@mail.example.com, that is bob.42 (at) mail.example.com. Lot 7654321 of 1234567890."
    base, spans = p.find(text, weights)
    assert base == brute(text) and set(base) <= set(spans)
    added = {(p.KINDS[k], text[a:b]) for a, k, b in spans if (a, k, b) not in base}
    assert added == {("phone", "988 555 2485"), ("email", "bob.42 (at) mail.example.com")}


def test_all_of_many_repetitions_hear_of_it(weights):
    text = "ring +1 (988) 555-2485 " + "".join(f"and the 988 555 2485 with {9_000_000 + i} bread " for i in range(60))
    base, spans = p.find(text, weights)
    assert len(base) == 1 and len(spans) == 61


def test_messages_equal_enumeration_on_a_tree(weights):
    import itertools

    w = weights
    f = p.Field([(0, 1), (2, 3), (4, 5)], p.training_view(corpus(1, 1)[0], random.Random(0)).features[:3], [(0, 1)], [(1, 2)], [-1, -1, 3])
    got, k = p.marginals(f, w), len(p.KINDS) + 1
    want = np.zeros((3, k))
    for labels in itertools.product(range(k), repeat=3):
        if labels[2] != 4:
            continue
        score = sum(w.node[c].sum(axis=0)[y] for c, y in zip(f.features, labels, strict=True)) + w.chain[labels[0], labels[1]] + w.skip[labels[1], labels[2]]
        for i, y in enumerate(labels):
            want[i, y] += np.exp(score)
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-3)


def test_frame(spark):
    rows = [(i, f"mail u{i}@x.org or +1 (300) 555-{1000 + i}", "s") for i in range(20)] + [(50, None, "s"), (51, "", "s"), (52, "clean text only", "s"), (None, "é 4111 1111 1111 1111 10.0.0.1", "s")]
    got = {r["doc_id"]: r for r in p.detect(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    for d, text, _ in rows:
        base, r = brute(text or ""), got[d]
        assert [r[c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{p.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert r["spans"] == ",".join(f"{p.KINDS[k]}:{a}:{b}" for a, k, b in base)
    assert p.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0
