"""Article text that must not be dropped."""

from ablata.llm.main_text import main_text

LONG = "This sentence belongs to the article and it is long enough to be a surge of its own on any page of this test."


def test_link_only_items_in_an_article():
    items = "".join(f"<li><a href='/{i}'>Source number {i}</a></li>" for i in range(6))
    got = main_text(f"<body><article><p>{LONG}</p><ul>{items}</ul><p>Short end.</p></article></body>")
    assert all(f"Source number {i}" in got for i in range(6)) and got.endswith("Short end.")


def test_anchors_and_unclosed_links():
    assert LONG in main_text(f"<body><a id='x'/><p>{LONG}</p></body>")
    for end in ("</p>", ""):
        assert LONG in main_text(f"<body><div><p><a href='/y'>More{end}<p>{LONG}</p></div></body>")


def test_hinted_elements_that_hold_the_page():
    for name in ("class='content has-sidebar'", "id='header-and-content'"):
        assert LONG in main_text(f"<body><div {name}><h1>Title</h1><p>{LONG}</p></div></body>")
        assert LONG in main_text(f"<body><div {name}><p>{LONG}</p></div><p>Imprint</p></body>")
    assert "The title" in main_text(f"<body><h1 class='article-header'>The title</h1><p>{LONG}</p></body>")


def test_hinted_elements_still_go():
    got = main_text(f"<body><article><h1>Title</h1><p>{LONG}</p></article><div class='comments'><p>{'Nice one. ' * 90}</p></div></body>")
    assert "Nice" not in got and LONG in got
    assert main_text(f"<body><div class='links'><a href='/z'><div>{LONG}</div></a></div></body>") == ""
