"""Personal data by a skip-chain conditional random field.

Candidates are the parts of a text that could be personal data: addresses around an ``@`` or a spelled-out one, and groups of digits
with up to ``GAP`` separators between digits. They form a chain in text order, and candidates that repeat or resemble each other (the
same digits, the same last nine, the same address in another spelling), however far apart, share a skip edge: all mentions of a key are
linked to its first observed mention, or to its first. So any two of them are two edges apart, with as many edges as mentions. Labels are
the kinds of ``KINDS`` or none. Node potentials weigh features of the candidate and its neighbouring words, chain and skip edges weigh
pairs of labels; loopy belief propagation passes messages along all edges until they settle (``ROUNDS`` at most; what passes along the
chain fades with each edge), so what is certain at one place settles its repetitions elsewhere.

All weights, those of skip edges too, start at zero and are trained here by pseudo-likelihood, on whole texts: the ``SAMPLE`` texts with
the least hash of those that may hold a candidate and have at most ``SAMPLE_CHARS`` characters. These two bounds hold for training only.
Labels come from the base patterns and, as those say nothing of other spellings, from variants put into the training texts
(``with_variants``): other spellings of the base matches with their kind as label, and look-alikes with label none. Base matches are
observed: they stay as they are, and the field adds the spans it is sure of (``SURE``) that don't overlap one. Whole texts are scanned
once, in proportion to their length and without a shuffle; the weights are the only thing broadcast.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Repeated rows are scanned row by row; an empty table
gives no rows; without base matches to learn from, only base matches are reported.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SAMPLE, SAMPLE_CHARS, SEED = 2_000, 20_000, 7
SURE, ROUNDS, DAMPING = 0.9, 100, 0.3
FEATURES, GAP = 1 << 12, 3
#: Variants of each base match in a training text.
VARIANTS = 3

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match takes a run of digits to its end, so a match can begin only where a run begins.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_DOT = r"(?:\.| dot | ?[\[({] ?(?:dot|\.) ?[\])}] ?)"
#: What stands for the @ of an address: itself, a bracketed "at", or the word before something with a dot.
_AT = re.compile(rf"@| ?[\[({{] ?at ?[\])}}] ?| at (?=[A-Za-z0-9-]+{_DOT})", re.I)
_HOST = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*", re.I)
_DOTS = re.compile(_DOT, re.I)
_NUMBERS = re.compile(rf"[+(]?[0-9](?:[\x20\n().\-/\[\]]{{0,{GAP}}}[0-9])+")
_DIGIT_OR_AT = re.compile(r"[0-9@]|\bat\b", re.I)
#: Words that announce a phone number in training variants.
CUES = ("call", "phone", "tel", "mobile", "ring", "fax")

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost e-mail matches: before each @ in turn, the longest local part after the last match."""
    least, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > least and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            least = m.end()
        at = text.find("@", max(at + 1, least))


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns, by start, then kind."""
    if not _DIGIT_OR_AT.search(text):
        return []
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 12 <= len(digits := re.sub(r"[^0-9]", "", m[0])) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


@dataclass
class Field:
    """The graph of one text: candidates, feature columns, chain and skip edges, and base labels (-1 where none)."""

    spans: list[tuple[int, int]]
    features: list[np.ndarray]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    observed: list[int]


def _shape(s: str) -> str:
    return re.sub(r"9{5,}", "9*", re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]", "9", s)))[:40]


@lru_cache(maxsize=1 << 15)
def _column(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % FEATURES


def _is_ip(groups: list[str]) -> bool:
    return len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)


def _features(text: str, start: int, end: int) -> np.ndarray:
    own = text[start:end]
    groups = re.findall(r"[0-9]+", own)
    n = sum(map(len, groups))
    at = _AT.search(own)
    kind = "" if at is None else at[0].strip().lower() if at[0] == "@" or "at" != at[0].strip().lower() else "word"
    names = ["bias", f"digits={min(n, 24)}", f"groups={min(len(groups), 8)}", f"plus={'+' in own}", f"at={kind}", f"brackets={'(' in own}", f"hyphens={min(own.count('-'), 4)}"]
    names += [f"{kind and 'mail '}dots={min(own.count('.'), 5)}", f"dot words={kind != '' and ' dot' in own.lower()}", f"luhn={12 <= n <= 19 and luhn(''.join(groups))}", f"ip={_is_ip(groups)},{'[' in own},{own.count('.') == 3}"]
    if not kind:
        names += [f"shape={_shape(own)}"]
    names += [f"start={text[start - 1 : start].isalnum()}", f"end={text[end : end + 1].isalnum()}"]
    before, after = text[max(0, start - 40) : start].split(), text[end : end + 40].split()
    names += [f"before={w.lower().strip('.,:;')}" for w in before[-1:]] + [f"after={w.lower().strip('.,:;')}" for w in after[:1]]
    return np.unique([_column(x) for x in names])


def _keys(own: str) -> list[str]:
    """Keys that repeated or similar candidates have in common."""
    if _AT.search(own):
        local, host = _AT.split(own, maxsplit=1)
        return [f"{local}@{_DOTS.sub('.', host)}".lower()]
    groups = re.findall(r"[0-9]+", own)
    if _is_ip(groups):
        return [".".join(groups)]
    digits = "".join(groups)
    return [f"#{digits}", *([f"~{digits[-9:]}"] if len(digits) >= 9 else [])]


def candidates(text: str) -> list[tuple[int, int]]:
    """Parts that could be personal data, in order, not overlapping. Each part of a text is looked at a bounded number of times."""
    found: list[tuple[int, int]] = []
    least = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > least and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _HOST.match(text, m.end()) if start < m.start() else None
        if host:
            found.append((start, host.end()))
            least = host.end()
    numbers, i = [], 0
    for m in _NUMBERS.finditer(text):
        while i < len(found) and found[i][1] <= m.start():
            i += 1
        digits = sum(c.isdigit() for c in m[0])
        if (digits >= 7 or len(re.findall(r"[0-9]+", m[0])) == 4) and (i == len(found) or found[i][0] >= m.end()):
            numbers.append(m.span())
    return sorted(found + numbers)


def field_of(text: str, base: list[Span]) -> Field:
    """The graph of a text."""
    spans = {(a, b): k for a, k, b in reversed(base)}
    covered: list[list[int]] = []  # base spans, overlapping ones as one
    for a, b in sorted(spans):
        if covered and a < covered[-1][1]:
            covered[-1][1] = max(b, covered[-1][1])
        else:
            covered.append([a, b])
    i = 0
    for a, b in candidates(text):
        while i < len(covered) and covered[i][1] <= a:
            i += 1
        if i == len(covered) or covered[i][0] >= b:
            spans[a, b] = -1
    ordered = sorted(spans)
    groups: dict[str, list[int]] = defaultdict(list)
    for n, (a, b) in enumerate(ordered):
        for key in _keys(text[a:b]):
            groups[key].append(n)
    skip = set()
    for group in groups.values():
        hub = next((n for n in group if spans[ordered[n]] >= 0), group[0])
        skip |= {(min(hub, n), max(hub, n)) for n in group if n != hub}
    chain = [(n, n + 1) for n in range(len(ordered) - 1)]
    return Field(ordered, [_features(text, a, b) for a, b in ordered], chain, sorted(skip), [spans[s] for s in ordered])


def variant(kind: int, own: str, draw: random.Random) -> str:
    """Another spelling of a base match."""
    if kind == 0:
        local, host = own.split("@", 1)
        at, dot = draw.choice([(" (at) ", "."), ("(at)", "."), (" [at] ", "."), (" [at] ", " [dot] "), (" at ", " dot "), ("[at]", "[dot]")])
        return local + at + host.replace(".", dot)
    digits = re.findall(r"[0-9]", own)
    if kind == 1:
        return draw.choice(["[.]", " . ", "(.)"]).join(own.split("."))
    if kind == 2:
        gap = draw.choice([".", "/", "\n", " - "])
        return gap.join("".join(digits[i : i + 4]) for i in range(0, len(digits), 4))
    a, b, c = "".join(digits[:-7][-3:]), "".join(digits[-7:-4]), "".join(digits[-4:])
    return draw.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}{b}{c}", f"({a})\n{b}-{c}"])


def look_alike(kind: int, own: str, draw: random.Random) -> str:
    """What is spelled like a variant and is no personal data."""
    if kind == 0:
        return f"{draw.choice(['look', 'meet', 'sold', own.split('@')[0]])} at {own.split('@')[1]}"
    if kind == 1:
        parts = own.split(".")
        parts[draw.randrange(4)] = str(draw.randrange(256, 1000))
        return variant(1, ".".join(parts), draw)
    while True:
        other = re.sub(r"[0-9]", lambda _: str(draw.randrange(10)), own)
        if kind == 3 or not luhn(re.sub(r"[^0-9]", "", other)):
            return variant(kind, other, draw)


def with_variants(text: str, draw: random.Random, times: int = VARIANTS) -> tuple[str, dict[tuple[int, int], int]]:
    """The text with ``times`` variants of each base match and as many look-alikes, put in at random places as far as there are, and their labels by span (-1: none).

    Half of the variants of phone numbers stand alone after a word of ``CUES``, with other digits. Half of the others, whose spelling
    can tell them, stand alone too, with other digits or another name. The rest repeat the match."""
    base = base_spans(text)
    # Between words only, not inside or beside numbers.
    places = [m.start() for m in re.finditer(r"(?<=[^\s0-9)])\s(?=[^\s0-9(+])", text)]
    places = [x for x in places if not any(a <= x < b for a, _, b in base)]
    places = draw.sample(places, min(len(places), 2 * times * len(base)))
    put: list[tuple[int, str, str, int]] = []  # place, what stands before, piece, label
    for a, k, b in base * times:
        if len(places) < 2:
            break  # no room
        own = text[a:b]
        alone = draw.random() < 0.5
        if alone and k == 0:
            own = f"{draw.choice('abcdefgh')}{draw.randrange(1000)}.{own}"
        elif alone and k == 1:
            own = ".".join(str(draw.randrange(256)) for _ in range(4))
        elif alone and k == 2:
            body = "".join(str(draw.randrange(10)) for _ in range(15))
            own = next(body + c for c in "0123456789" if luhn(body + c))
        elif alone:
            own = re.sub(r"[0-9]", lambda _: str(draw.randrange(10)), own)
        put.append((places.pop(), f" {draw.choice(CUES)} " if alone and k == 3 else " ", variant(k, own, draw), k))
        put.append((places.pop(), " ", look_alike(k, text[a:b], draw), -1))
    made, at, length, labels = [], 0, 0, {}
    for place, before, piece, label in sorted(put):
        made += [text[at:place], before]
        length += place - at + len(before)
        labels[length, length + len(piece)] = label
        made += [piece, " "]
        length, at = length + len(piece) + 1, place
    return "".join([*made, text[at:]]), labels


def training_view(text: str, draw: random.Random) -> Field:
    """The graph of a text with variants; all labels known."""
    whole, labels = with_variants(text, draw)
    f = field_of(whole, base_spans(whole))
    f.observed = [k if k >= 0 else labels.get(s, -1) for s, k in zip(f.spans, f.observed, strict=True)]
    return f


@dataclass
class Weights:
    """Node weights (features x labels) and pair weights of chain and skip edges; label 0 is none."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def train(fields: list[Field], epochs: int = 30, rate: float = 0.3, l2: float = 1e-4) -> Weights:
    """Pseudo-likelihood ascent from zero: each label given its features and its neighbours' labels; -1 is none."""
    n = len(KINDS) + 1
    w = Weights(np.zeros((FEATURES, n)), np.zeros((n, n)), np.zeros((n, n)))
    # Each candidate once: its columns, its label, and views of the pair weights that its neighbours' labels select.
    seen: list[tuple[np.ndarray, int, list[np.ndarray]]] = []
    for f in fields:
        labels = [k + 1 for k in f.observed]
        near: list[list[np.ndarray]] = [[] for _ in labels]
        for pair, edges in ((w.chain, f.chain), (w.skip, f.skip)):
            for x, y in edges:
                near[y].append(pair[labels[x]])
                near[x].append(pair[:, labels[y]])
        seen += zip(f.features, labels, near, strict=True)
    for epoch in range(epochs):
        step = rate / (1 + 0.3 * epoch)
        for columns, own, rows in seen:
            held = w.node[columns]
            scores = held.sum(axis=0)
            for row in rows:
                scores += row
            slope = -_normal(scores)
            slope[own] += 1
            w.node[columns] = (held + step * slope) * (1 - step * l2)
            for row in rows:
                row += step * (slope - l2 * row)
    return w


def _normal(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max())
    return e / e.sum()


def marginals(f: Field, w: Weights) -> np.ndarray:
    """Label marginals by loopy sum-product; observed candidates keep their label."""
    n, k = len(f.spans), len(KINDS) + 1
    local = np.array([w.node[c].sum(axis=0) for c in f.features]).reshape(n, k)
    local -= local.max(axis=1, keepdims=True)
    for i, label in enumerate(f.observed):
        if label >= 0:
            local[i] = -50.0
            local[i, label + 1] = 0.0
    edges = [(x, y, w.chain) for x, y in f.chain] + [(x, y, w.skip) for x, y in f.skip]
    if not edges:
        return np.array([_normal(row) for row in local]).reshape(n, k)
    ends = np.array([(x, y) for x, y, _ in edges])
    pairs = np.array([p for _, _, p in edges])
    sources, targets = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
    both = np.concatenate([pairs, pairs.transpose(0, 2, 1)])
    m, messages = len(edges), np.zeros((2 * len(edges), k))
    reverse = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    for _ in range(ROUNDS):
        belief = local.copy()
        np.add.at(belief, targets, messages)
        scores = (belief[sources] - messages[reverse])[:, :, None] + both
        top = scores.max(axis=1)
        new = top + np.log(np.exp(scores - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        change = np.abs(new - messages).max()
        messages = DAMPING * messages + (1 - DAMPING) * new
        if change < 1e-4:
            break
    belief = local.copy()
    np.add.at(belief, targets, messages)
    e = np.exp(belief - belief.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def find(text: str | None, w: Weights | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text."""
    if not text or not _DIGIT_OR_AT.search(text):
        return [], []
    base = base_spans(text)
    if w is None:
        return base, base
    f = field_of(text, base)
    if all(label >= 0 for label in f.observed):
        return base, base
    sure = marginals(f, w)
    added = [(a, int(p.argmax()) - 1, b) for (a, b), label, p in zip(f.spans, f.observed, sure, strict=True) if label < 0 and p.argmax() > 0 and p.max() >= SURE]
    return base, sorted([*base, *added])


def written(spans: list[Span]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def fit(docs: DataFrame) -> Weights | None:
    """Weights from a bounded sample of the texts that may hold a candidate."""
    small = docs.filter(F.length("text") <= SAMPLE_CHARS)
    likely = small.filter(F.col("text").rlike(r"@|[0-9][0-9\x20().-]{5}")).select("text", F.xxhash64("doc_id", "text").alias("hash"))
    n = likely.count()
    # Only the texts of a share of all hashes, about a quarter more than wanted, reach the sort.
    share = min(1.0, 1.25 * SAMPLE / max(n, 1))
    few = likely if share == 1 else likely.filter(F.pmod("hash", F.lit(1 << 32)) < int(share * (1 << 32)))
    texts = [r["text"] for r in few.distinct().orderBy("hash", "text").limit(SAMPLE).collect()]
    fields = [training_view(text, random.Random(f"{SEED}|{i}")) for i, text in enumerate(texts)]
    fields = [f for f in fields if f.spans]
    return train(fields) if any(k >= 0 for f in fields for k in f.observed) else None


def detect(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(docs.select("doc_id", "text")))

    def scanned(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, spans = find(text, shared.value)
            kinds = [k for _, k, _ in base]
            rows.append((*map(kinds.count, range(len(KINDS))), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    kind = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select("doc_id", F.pandas_udf(scanned, kind)(F.col("text")).alias("f")).select("doc_id", "f.*")
