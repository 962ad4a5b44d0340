"""Names, unclosed markup and length: what may be dropped, and the line blocks by definition."""

import random
import time

import pytest

from ablata.llm.main_text import SURGE, WINDOW, between_points, main_text

LONG = "This sentence belongs to the article and it is long enough to be a surge of its own on any page of this test."


@pytest.mark.parametrize("name", "share-price related-work alert side tags social-history reply widget menu-item-recipe".split())
def test_names_alone_drop_no_paragraph_of_an_article(name):
    for attribute in ("class", "id"):
        got = main_text(f"<body><article><h1>Title</h1><p {attribute}='{name}'>Kept text.</p><p>{LONG}</p></article></body>")
        assert got == f"Title\n\nKept text.\n\n{LONG}"
    assert "Kept text" in main_text(f"<body><article><div class='{name}'><p>Kept text.</p></div><p>{LONG}</p></article></body>")


def test_what_goes_inside_an_article():
    went = ["<div class='ad'>Buy</div>", f"<div class='ad-slot-3'>{LONG[::-1]}</div>", f"<section id='comments'><p>{LONG[::-1]}</p></section>", "<ul class='share-links'><li><a href='/t'>Tweet</a></li></ul>", "<form><input><p>Mail</p></form>", "<nav>Contents</nav>", "<aside>Aside</aside>", "<footer>Foot</footer>", "<header>By line</header>", "<script>x</script>", "<div class='newsletter-signup'>Join us</div>", "<div role='complementary'>Beside</div>"]
    for part in went:
        assert main_text(f"<body><article><h1>Title</h1>{part}<p>{LONG}</p></article></body>") == f"Title\n\n{LONG}", part
    assert main_text(f"<body><article><header><h1>Title</h1></header><p>{LONG}</p></article></body>") == f"Title\n\n{LONG}"


def test_outside_of_the_article():
    other = LONG[::-1] * 2
    assert main_text(f"<body><div class='x'><p>{other}</p></div><article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article></body>") == "\n\n".join([LONG] * 3)
    # An article that is but a teaser doesn't take the place of the page's text.
    teaser = main_text(f"<body><article><p>Teaser</p></article><div><p>{other}</p></div></body>")
    assert teaser == f"Teaser\n\n{other}"
    assert main_text(f"<body><article><h1>T</h1><p>{LONG}</p></article><article class='comment'><p>{LONG[::-1]}</p></article></body>") == f"T\n\n{LONG}"
    assert main_text(f"<form id='page'><article><p>{LONG}</p><input></article></form>") == LONG


def test_unclosed_markup():
    three = f"<p>{LONG}</p>" * 3
    want = "\n\n".join([LONG] * 3)
    assert main_text(f"<body><article><a name='top'>{three}</article></body>") == want
    assert main_text(f"<body><article><div class='ad'>Buy{three}</article></body>") == want
    assert main_text(f"<body><div class='ad'>Buy<article>{three}</article></body>") == want
    assert main_text(f"<head><title>Open<body><article>{three}</article></body>") == want
    assert main_text(f"<body><nav><ul><li>Menu<article>{three}</article>") == want
    assert main_text(f"<body><article><textarea>{three}</article>") == want
    assert main_text(f"<body><article><p title='it's'>{LONG}</p><p title=\"x>{LONG}</p></article>").startswith(LONG)


def brute(sizes):
    """Line blocks by their definition, one stretch after the other."""
    n = len(sizes)
    sums = [sum(sizes[max(0, i - WINDOW + 1) : i + 1]) for i in range(n)]
    kept = [False] * n
    for surge in range(n):
        if sums[surge] and (surge == 0 or not sums[surge - 1]):
            dive = next((j for j in range(surge, n) if not sums[j]), n)
            if max(sums[surge:dive]) >= min(SURGE, max(sums)):
                kept[surge:dive] = [True] * (dive - surge)
    return kept


def test_line_blocks_by_brute_force():
    draw = random.Random(4)
    for _ in range(500):
        sizes = [draw.choice([0, 0, 0, 0, 1, 20, 40, 90, 300]) for _ in range(draw.randrange(40))]
        assert between_points(sizes) == brute(sizes)


def test_large_pages_take_time_in_proportion():
    n = 20_000
    pages = ["<div class='side'>" * n + LONG + "</div>" * n, "<title>" * n + LONG, "<a href='" * n, "<p title=\"x'>" * n, "<div class='ad'><p>" * n, "<nav><aside>" * n, "<!--" * n, "<" * 10 * n, "<article><div class='ad'>x" * n, "<li><a href=x>y" * n, "</div>" * n, "&amp;" * 10 * n]
    for page in pages:
        start = time.time()
        main_text(page)
        assert time.time() - start < 10, page[:30]


ANCHORS = "navigation advertising comments banner subscription notice signup newsletter cookies nav modal promotion login overlay consent".split()


@pytest.mark.parametrize("name", ANCHORS)
def test_sections_named_by_their_subject(name):
    """An id of a section with a heading and prose is an anchor; a box of that class, or with fields, links or replies in it, is none."""
    whole = f"<body><article><h1>Title</h1><p>{LONG}</p><section id='{name}'><h2>On {name}</h2><p>{LONG[::-1]}</p></section><p>Short end.</p></article></body>"
    assert main_text(whole) == f"Title\n\n{LONG}\n\nOn {name}\n\n{LONG[::-1]}\n\nShort end."


@pytest.mark.parametrize("name", ["comments", "newsletter", "notice", "cookies", "nav"])
def test_boxes_inside_an_article_still_go(name):
    boxes = [
        f"<section class='{name}'><h3>Box</h3><p>{LONG[::-1]}</p></section>",
        f"<section id='{name}'><h3>Box</h3><p>{LONG[::-1]}</p><form><input name=a></form></section>",
        f"<section id='{name}'><h3>Box</h3><p><a href='/x'>{LONG[::-1]}</a></p></section>",
        f"<section id='{name}'><h3>Box</h3><div class='comment'><p>{LONG[::-1]}</p></div><div class='comment'><p>{LONG}</p></div></section>",
    ]
    if name in ("cookies", "nav", "newsletter", "notice", "comments"):
        for box in boxes:
            assert main_text(f"<body><article><h1>Title</h1><p>{LONG}</p>{box}</article></body>") == f"Title\n\n{LONG}", box


def test_text_goes_on_behind_an_advert():
    assert main_text(f"<body><div><p>{LONG}</p><div class='ad-box'>Buy now</div><p>Short end.</p></div></body>") == f"{LONG}\n\nShort end."


@pytest.mark.parametrize("page", ["<b class=x><article>{0}{1}", "<b class=x><article>{0}{1}</article>", "<head>{0}<article>", "{2}"])
def test_end_tags_that_find_nothing_are_linear(page):
    """20,000 open elements and as many end tags of an element beyond a landmark, or heads among them."""
    n = 20_000
    began = time.time()
    main_text(page.format("<div>" * n, "</b>" * n, "<div><head><article>" * n))
    assert time.time() - began < 5
