"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element. Elements that never hold article text (menus, headers, footers, asides,
forms, scripts, styles, and elements whose class or id names an advert, a side bar, a notice, reader comments and the like) become
blank lines; an advert becomes none, as the text goes on behind it. Text lengths, without link text, are summed over windows of ``WINDOW`` lines: where the sums rise from zero is a surge
point, where they fall to zero again a dive point. The text between the two is kept if a window in between sums up to ``SURGE``
characters, or to as much as the page's largest window if that is less.

``article`` elements (``main``, if the page has none) are content: link text counts there as any other, and a dropped element leaves no
blank lines, so content is one stretch from its first line to its last. It is always kept, and if it holds at least half of what is
kept, the text outside it goes.

What names drop. A heading is never dropped for its names, nor is an element that holds content, an ``h1``, or most of the page's text
while the rest has neither. Inside content only containers are, if one name says nothing but what is surely no article (``SURE``), or
if a name has any of ``HINTS`` and at least half of the text is links; so a paragraph of class "alert" or "share-price" stays. An id alone is
an anchor that readers jump to: a section of content stays, whatever its id, if it has a heading and prose, and no fields or named boxes.
Elsewhere a container is dropped for any of ``HINTS``, and other elements if a name has no other word or half of the text is links.
A header inside content stays if it holds a heading, a form if it holds content.

Unclosed elements end where a block of the same level, a landmark or the page ends. An unclosed element that would be dropped for its names ends
where the next block begins, one that would be for its kind at the next paragraph, heading or landmark, a title at the next markup. Null, empty and textless pages
give the empty string; whole pages are read once, in proportion to their length; repeated rows are read row by row; an empty table gives
no rows. Columns called text and n_chars are replaced, others stay.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SURGE = 3, 86
#: Elements that are dropped with all they hold.
DROPPED = frozenset("head title nav header footer aside form button select option textarea input label fieldset iframe object embed svg canvas template noscript menu dialog audio video map".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe xmp".split())
#: Elements that begin and end lines.
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr table thead tbody tfoot caption blockquote pre article section main body html figure figcaption details summary address hr center nav header footer aside form fieldset".split())
LANDMARKS = frozenset("article main body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a form is made of.
FIELDS = frozenset("form input textarea select button label fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks that another of the same name ends.
SIBLINGS = frozenset("p li dt dd tr option".split())
CONTAINERS = frozenset("div section ul ol dl span article center".split())
#: Words in class or id of what is surely no part of an article.
SURE = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar comment comments commentlist disqus respond cookie cookies consent notice notices popup modal overlay nav navbar navigation breadcrumb breadcrumbs masthead newsletter subscribe subscription signup login pagination pager complementary contentinfo".split())
#: Those of adverts, which stand in the middle of a text.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split())
#: Words in class or id that mark an element to drop.
HINTS = SURE | frozenset("side aside reply alert menu header footer colophon copyright share sharing social related recommended widget toolbar tags".split())
#: Words that say nothing beside these.
FILLERS = frozenset("box wrapper wrap container list section area block slot unit item items inner outer top bottom left right site page bar".split())
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STYLED = re.compile(r"(?:^|[\s\"'/])(?:class|role)\s*=", re.I)
_HREF = re.compile(r"(?:^|[\s\"'/])href\s*=", re.I)


@dataclass
class Element:
    """An element: its first and last item of the page, and whether it has an end tag of its own."""

    name: str
    attributes: str
    start: int
    end: int = -1
    closed: bool = False


@dataclass
class Page:
    """A page's items in order: texts, and elements that open (True) and end (False). ``links`` tells which texts are in a link."""

    items: list[str | tuple[Element, bool]] = field(default_factory=list)
    links: list[bool] = field(default_factory=list)

    def add(self, item: str | tuple[Element, bool], linked: bool = False) -> None:
        self.items.append(item)
        self.links.append(linked)


def parse(page: str) -> Page:
    """The page as items, each element with its end."""
    out, opened, at = Page(), [], 0
    in_link, unclosed = 0, set()  # blocks open around the link, and one
    names: dict[str, list[int]] = {}  # where those of a name are open
    landmarks: list[int] = []  # where landmarks are open

    def end(upto: int, closed: bool = False) -> None:
        while len(opened) > upto:
            x = opened.pop()
            names[x.name].pop()
            if x.name in LANDMARKS:
                landmarks.pop()
            x.end, x.closed = len(out.items), closed and len(opened) == upto
            out.add((x, False))

    while at < len(page):
        m = _MARKUP.search(page, at)
        if m is None:
            out.add(page[at:], bool(in_link))
            break
        if m.start() > at:
            out.add(page[at : m.start()], bool(in_link))
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            # An end tag goes no further up than a landmark, unless it is one's own.
            if names.get(name) and (name in LANDMARKS or not landmarks or landmarks[-1] < names[name][-1]):
                end(names[name][-1], True)
            if name == "a" or in_link > len(opened) + 1:
                in_link = 0
            continue
        if name in RAW:
            if name not in unclosed:
                if m[3].endswith("/") and name not in ("script", "style", "title"):
                    continue
                if close := re.compile(rf"</{name}(?![A-Za-z0-9:-])[^>]*>?", re.I).search(page, at):
                    at = close.end()
                    continue
                unclosed.add(name)
            if name == "title":
                found = page.find("<", at)
                at = found if found >= 0 else len(page)
            elif name in ("script", "style", "xmp"):
                at = len(page)
            continue
        if name in BLOCKS:
            while opened and (opened[-1].name == "p" or (opened[-1].name == name and name in SIBLINGS)):
                end(len(opened) - 1)
            if name in LANDMARKS and names.get("head"):
                end(names["head"][0])
            if in_link > len(opened) + 1:
                in_link = 0  # it was never closed
        if name == "a":
            in_link = len(opened) + 1 if _HREF.search(m[3]) else 0
        if name in VOID or m[3].endswith("/") and name not in BLOCKS and name not in DROPPED:
            x = Element(name, m[3], len(out.items), len(out.items), True)
            out.add((x, True))
        elif name in BLOCKS or name in DROPPED or _NAMED.search(m[3]):
            # Other elements have no bearing on the lines.
            x = Element(name, m[3], len(out.items))
            names.setdefault(name, []).append(len(opened))
            if name in LANDMARKS:
                landmarks.append(len(opened))
            opened.append(x)
            out.add((x, True))
        elif name in ("td", "th"):
            out.add(" ")
    end(0)
    return out


def _hint(attributes: str) -> int:
    """What class, id and role say: 3 a name of sure and filling words only, 2 of hints and filling words only, 1 any hint, 0 none."""
    found = 0
    for m in _NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in _WORDS.findall(name)]
            if any(w in HINTS for w in words):
                pure = all(w in HINTS or w in FILLERS for w in words)
                found = max(found, 3 if pure and any(w in SURE for w in words) else 2 if pure else 1)
    return found


def _advert(attributes: str) -> bool:
    """Whether class, id or role name an advert."""
    names = [next(filter(None, m.groups()), "") for m in _NAMED.finditer(attributes)]
    return any(w.lower() in ADVERTS for name in names for w in _WORDS.findall(name))


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    """The page's lines in order: text, its length without link text, and whether it is content; dropped elements are ``WINDOW`` lines without text."""
    parsed = parse(page)
    items = parsed.items
    opens = lambda names: [0, *accumulate(not isinstance(x, str) and x[1] and x[0].name in names for x in items)]
    chars = [len("".join(x.split())) if isinstance(x, str) else 0 for x in items]
    seen, linked = [0, *accumulate(chars)], [0, *accumulate(n * k for n, k in zip(chars, parsed.links, strict=True))]
    articles, mains, tops, headings, paragraphs = opens({"article"}), opens({"main"}), opens({"h1"}), opens(HEADINGS), opens({"p"})
    landmark = "article" if articles[-1] else "main"
    landmarks = articles if articles[-1] else mains

    fields = opens(FIELDS)
    hints = [0, *accumulate(not isinstance(x, str) and x[1] and bool(x[0].attributes) and x[0].name in CONTAINERS and _hint(x[0].attributes) > 0 for x in items)]

    def inside(sums: list[int], x: Element) -> int:
        return sums[x.end] - sums[x.start + 1]

    def anchored(x: Element) -> bool:
        """Whether the name is but an anchor of a section of the text: an id alone, over a heading and prose without links, fields or names of their own."""
        if not x.closed or _STYLED.search(x.attributes) or not inside(headings, x) or inside(fields, x) or inside(hints, x):
            return False
        prose = inside(seen, x) - inside(linked, x)
        return bool(inside(paragraphs, x)) and prose >= SURGE // 2 and 2 * inside(linked, x) < inside(seen, x)

    def dropped(x: Element, in_content: int) -> bool:
        if x.name in DROPPED:
            if x.name == "form":
                return not inside(landmarks, x) and not inside(tops, x)
            return not (x.name == "header" and in_content and inside(headings, x))
        if x.name in HEADINGS or x.name in ("main", "body", "html"):
            return False
        hint = _hint(x.attributes) if x.attributes else 0
        if not hint:
            return False
        if x.closed:
            held, all_held = inside(seen, x), seen[-1]
            if inside(landmarks, x) or inside(mains, x) or inside(tops, x):
                return False
            rest = landmarks[-1] + tops[-1] - (x.name == landmark)
            if not rest and 2 * held > all_held:
                return False
        links = 2 * inside(linked, x) >= max(inside(seen, x), 1)
        if x.name == "article":
            return hint == 3 and landmarks[-1] > 1
        if in_content:
            return x.name in CONTAINERS and (hint == 3 or links) and not anchored(x)
        return x.name in CONTAINERS or hint >= 2 or links

    def last(x: Element) -> int:
        """The last item of a dropped element."""
        if x.closed or x.end == x.start:
            return x.end
        for k in range(x.start + 1, x.end):
            if not isinstance(items[k], str):
                name = items[k][0].name
                if (name in LANDMARKS or name in HEADINGS or name in ("p", x.name)) if x.name in DROPPED else name in BLOCKS:
                    return k - 1
        return x.end

    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    in_link_chars = in_content = 0

    def end_line() -> None:
        nonlocal in_link_chars
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                lines.append((text, max(0, len(text) - in_link_chars), in_content > 0))
            parts.clear()
        in_link_chars = 0

    def blank() -> None:
        if not in_content:
            lines.extend([("", 0, False)] * WINDOW)

    at = 0
    while at < len(items):
        item = items[at]
        if isinstance(item, str):
            parts.append(item)
            if parsed.links[at] and not in_content:
                in_link_chars += len(" ".join(html.unescape(item).split()))
            at += 1
            continue
        x, opening = item
        if opening and x.name not in VOID and dropped(x, in_content):
            if x.name in BLOCKS or x.name in CONTAINERS or x.name in DROPPED:
                end_line()
                if x.name in DROPPED or not _advert(x.attributes):
                    blank()
            at = last(x) + 1
            continue
        if x.name in BLOCKS:
            end_line()
            if x.name == landmark:
                if opening:
                    blank()
                in_content = max(0, in_content + (1 if opening else -1))
                if not opening:
                    blank()
        elif x.name == "br":
            parts.append(" ")
        at += 1
    end_line()
    return lines


def between_points(sizes: list[int]) -> list[bool]:
    """Which lines stand between a surge and a dive point with enough text in between."""
    before = [0, *accumulate(sizes)]
    sums = [before[i + 1] - before[max(0, i - WINDOW + 1)] for i in range(len(sizes))]
    enough, kept, run, most = max(1, min(SURGE, max(sums, default=0))), [False] * len(sizes), [], 0
    for i, total in enumerate([*sums, 0]):
        if total == 0:  # a dive, or still before the surge
            if most >= enough:
                for k in run:
                    kept[k] = True
            run, most = [], 0
        else:
            run.append(i)
            most = max(most, total)
    return kept


def main_text(page: str | None) -> str:
    """Blocks of the article joined by blank lines; the empty string if there are none."""
    lines = page_lines(page or "")
    kept = [text and (content or between) for (text, _, content), between in zip(lines, between_points([n for _, n, _ in lines]), strict=True)]
    within = sum(len(text) for (text, _, content), k in zip(lines, kept, strict=True) if k and content)
    outside = sum(len(text) for (text, _, content), k in zip(lines, kept, strict=True) if k and not content)
    return "\n\n".join(text for (text, _, content), k in zip(lines, kept, strict=True) if k and (content or within < outside or not within))


def _main_texts(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(page) for page in pages], dtype="object")


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``."""
    return pages.withColumn("text", F.pandas_udf(_main_texts, "string")(F.col(html_col))).withColumn("n_chars", F.length("text").cast("long"))
