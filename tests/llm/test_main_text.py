"""Main text on pages with known articles."""

from ablata.llm import main_text

NOISE_TOP = '<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies, please accept them all now, thank you very much indeed for it.</div>'
NOISE_END = '<div id="comments"><p>Great article, I liked it very much and will come back again for more of the same.</p></div><form><label>Mail</label><input></form><footer>&copy; x &middot; A sentence that is long enough to look like the main text of a page, really.</footer>'
LONG = "Words of the article go on and on, and they are long enough to make a surge of text in any window of lines."


def test_article():
    page = f"<!DOCTYPE html><html><head><title>T</title><script>var a='<p>no</p>';</script></head><body>{NOISE_TOP}<article><h1>Head &amp; line</h1><p>{LONG}<br>\n  more&nbsp;text</p><div class='ad'>buy</div><p>Short.</p></article>{NOISE_END}</body></html>"
    assert main_text.main_text(page) == f"Head & line\n\n{LONG} more text\n\nShort."


def test_without_landmarks():
    page = f"<body>{NOISE_TOP}<div><p>{LONG}</p><p>And <b>then</b> some.</p></div><aside>{LONG}</aside><p><a href='/x'>more links here</a></p>{NOISE_END}"
    assert main_text.main_text(page) == f"{LONG}\n\nAnd then some."


def test_short_and_broken():
    assert main_text.main_text(None) == "" and main_text.main_text("") == "" and main_text.main_text("<nav>x</nav>") == ""
    assert main_text.main_text("<body><article><p>Tiny.") == "Tiny."
    assert main_text.main_text("<article><p>a &lt; b &am</p><!-- open <p>x</p>") == "a < b &am"
    assert main_text.main_text("<article><p>a</p><script>open <p>x</p>") == "a"
    assert main_text.main_text("plain text, no markup") == "plain text, no markup"
    assert len(main_text.main_text("<p>" + "word " * 200_000 + "</p>")) == 999_999


def test_frame(spark):
    pages = spark.createDataFrame([(1, "u", f"<article><p>{LONG}</p></article>", "old"), (1, "u", None, "old"), (None, None, "<p>é</p>", "old")], "page_id long, url string, html string, text string")
    got = sorted((r["text"], r["n_chars"]) for r in main_text.extract(pages).collect())
    assert got == sorted([(LONG, len(LONG)), ("", 0), ("é", 1)])
    assert main_text.extract(pages.filter("page_id > 9")).count() == 0
