"""Pre-tokens of a word-level BPE vocabulary, split as its library splits them.

Latin-1 characters are split on bytes, with character classes asked from the library itself, one character at a time, when the
vocabulary is loaded. White space always ends a pre-token and nothing passes over it, so a run of other characters between spaces that
holds a character outside these is a piece of its own, which the library encodes. A text whose runs are mostly of that kind, and any
text that may hold a special string, goes through the library whole.
"""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Fixed value: the split pattern for which the byte split below is written.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Fixed value: the contractions of that pattern, in its order.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Fixed value: the suffix that marks the end of a word in the vocabulary.
WORD_END = "</w>"
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")


class WordSplitter:
    """Splits texts into pieces: normalised pre-tokens (bytes in Latin-1), and runs for the library (str)."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.specials = [token["content"] for token in spec["added_tokens"]]
        self.pattern = self._pattern(spec)

    def _pattern(self, spec: dict) -> re.Pattern[bytes] | None:
        splits = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        if SPLIT_PATTERN not in splits or spec["model"].get("end_of_word_suffix") != WORD_END:
            return None
        normal, split = self.library.normalizer.normalize_str, lambda s: len(self.library.pre_tokenizer.pre_tokenize_str(s))
        table, letters, numbers, others, foreign = bytearray(range(256)), [], [], [], []
        for code in range(256):
            image = normal(chr(code))
            if len(image) != 1 or ord(image) > 255:
                foreign.append(chr(code))
                continue
            table[code] = ord(image)
            if normal(image) != image:
                foreign.append(chr(code))
            elif split(image) == 0:
                continue  # white space
            elif split("a" + image) == 1:
                letters.append(image)
            elif split(image + image) == 2:
                numbers.append(image)
            else:
                others.append(image)
        self.table, self.foreign = bytes(table), re.compile("[" + "".join(map(re.escape, foreign)) + "\u0100-\U0010ffff]")
        group = lambda chars: "[" + "".join(sorted({f"\\x{ord(c):02x}" for c in chars})) + "]"
        return re.compile("|".join([*map(re.escape, CONTRACTIONS), group(letters) + "+", group(numbers), group(others) + "+"]).encode())

    def split(self, text: str) -> list[bytes | str] | None:
        """The pieces, or None if only the library may split this text."""
        if self.pattern is None or any(s in text for s in self.specials):
            return None
        if not self.foreign.search(text):
            return self.pattern.findall(text.encode("latin-1").translate(self.table))
        runs = _SPACE.split(text)
        odd = [i for i, run in enumerate(runs) if self.foreign.search(run)]
        if 2 * len(odd) > len(runs):
            return None
        pieces, at = [], 0
        for i in [*odd, len(runs)]:
            if at < i:
                pieces += self.pattern.findall(" ".join(runs[at:i]).encode("latin-1").translate(self.table))
            pieces += runs[i : i + 1]
            at = i + 1
        return pieces

    @cached_property
    def word_final(self) -> np.ndarray:
        """Whether an id ends a word."""
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        return ends

    def piece(self, piece: bytes | str) -> list[int]:
        """Ids of one piece."""
        return self.encode(piece if isinstance(piece, str) else piece.decode("latin-1"))

    def encode_pieces(self, pieces: list[bytes | str]) -> list[bytes]:
        """Each piece's ids as little-endian 32-bit bytes, many pre-tokens to a call: a word-final id ends each. Runs are encoded one by one."""
        if any(isinstance(p, str) for p in pieces):
            words = iter(self.encode_pieces(own) if (own := [p for p in pieces if isinstance(p, bytes)]) else [])
            return [np.array(self.encode(p), "<u4").tobytes() if isinstance(p, str) else next(words) for p in pieces]
        ids = np.array(self.encode(b" ".join(pieces).decode("latin-1")), "<u4")
        ends = np.flatnonzero(self.word_final[ids]) + 1 if len(ids) else ids
        if len(ends) != len(pieces) or ends[-1] != len(ids):
            return [np.array(self.encode(p.decode("latin-1")), "<u4").tobytes() for p in pieces]
        raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def encode(self, text: str) -> list[int]:
        """Ids by the library, without added special tokens."""
        return self.library.encode(text, add_special_tokens=False).ids


class Memo(dict):
    """Results by pre-token; full memos stop learning, long pre-tokens are never kept."""

    def __init__(self, make, limit: int = 400_000, longest: int = 48) -> None:
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key: bytes):
        value = self.make(key)
        if len(self) < self.limit and len(key) <= self.longest:
            self[key] = value
        return value


@lru_cache(maxsize=2)
def splitter(path: str) -> WordSplitter:
    """One splitter for each Python worker and vocabulary."""
    return WordSplitter(path)


def whole_tokens(path: str) -> frozenset[bytes]:
    """The pre-tokens that encode alone as exactly one token: proved by encoding every word-final vocabulary string."""
    own = splitter(path)
    found = []
    for token in own.library.get_vocab(with_added_tokens=False):
        if not token.endswith(WORD_END):
            continue
        text = _text_of(token.removesuffix(WORD_END))
        if text is None or (pieces := own.split(text)) is None or len(pieces) != 1:
            continue
        if len(own.encode(text)) == 1:
            found.append(pieces[0])
    return frozenset(found)


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """Byte-level alphabets show printable bytes as themselves and the others, in order, from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _text_of(token: str) -> str | None:
    try:
        return bytes(_byte_of()[c] for c in token).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None
