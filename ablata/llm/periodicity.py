"""Periodic runs of words by an all-lag scan.

A text's words are numbered by equality. For a lag p the word-id array is compared with itself shifted by p: a stretch of L equal places
is a run of period p and L + p words, and one of ``min_exp`` periods or more counts. Lags go up to n / ``min_exp``. Any such stretch holds
``min_exp`` - 1 successive multiples of p, so all lags of a range are first compared at the multiples of the lag only, in one vectorised
step of about n log n places; the whole shift is compared, and its stretches measured, for the lags that pass. A stretch at a multiple
of its smallest period is the same stretch, so of equal stretches the least lag stays, and places within a known run of a divisor are
not compared again.

Texts of up to ``LONG_CHARS`` characters are scanned where they are, as one range of lags. Longer ones are numbered once, equal texts
together, and their ranges of ``LAGS`` lags or more, ``MOST_RANGES`` at most, are dealt out over all tasks; a range holds the text's ids,
four bytes a word. Both give the same runs.

Null, empty and wordless texts have no words, no runs, and collapse to the empty string. Repeated rows are judged row by row; an empty
table gives no rows; other columns stay, those named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import count, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, guarded, words

MIN_EXP, MIN_LENGTH = 4, 6
#: Characters beyond which a text's lags are dealt out, the least number of lags in a range, and the most ranges of a text.
LONG_CHARS, LAGS, MOST_RANGES = 1 << 16, 1 << 12, 16
#: Lags that are scanned before the ranges of a long text, so that each of them knows the runs of short periods.
SHORT = 64
#: Places compared in one vectorised step.
BLOCK = 1 << 20
_WORD = re.compile(WORD)
RESULTS = ["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]
_RESULT = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<bigint>, collapsed string"

Run = tuple[int, int, int]


def word_ids(listed: list[str]) -> np.ndarray:
    """Numbers that are equal where the words are."""
    known: dict[str, int] = {}
    return np.fromiter(map(known.setdefault, listed, count()), np.int32, len(listed))


def _passing(ids: np.ndarray, lo: int, hi: int, min_exp: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, first place) where the ids at ``min_exp`` successive multiples of a lag are equal, for lags of lo to hi - 1."""
    n, lags, places = len(ids), [], []
    while lo < hi:
        # About n / lo places a lag, so a block of lags is bounded.
        upto = min(hi, lo + max(1, BLOCK * lo // max(n, 1)))
        lag = np.arange(lo, upto)
        each = np.maximum((n - 1) // lag - min_exp + 2, 0)
        p = np.repeat(lag, each)
        at = (np.arange(len(p)) - np.repeat(np.cumsum(each) - each, each)) * p
        for k in range(1, min_exp):
            same = ids[at + (k - 1) * p] == ids[at + k * p]
            at, p = at[same], p[same]
        lags.append(p)
        places.append(at)
        lo = upto
    return (np.concatenate(lags), np.concatenate(places)) if lags else (np.zeros(0, np.int64),) * 2


def find_runs(ids: np.ndarray, lo: int = 1, hi: int | None = None, known: list[Run] | None = None, min_exp: int = MIN_EXP, min_length: int = MIN_LENGTH) -> list[Run]:
    """(start, length, period) of the runs with a lag of lo to hi - 1, each with its least lag; ``known`` runs of smaller lags are not found again."""
    n = len(ids)
    hi = n // min_exp + 1 if hi is None else min(hi, n // min_exp + 1)
    lags, places = _passing(ids, lo, hi, min_exp)
    found: dict[tuple[int, int], int] = {}
    before = list(known or [])
    bounds = [*np.flatnonzero(np.diff(lags, prepend=-1)), len(lags)]
    for a, b in pairwise(bounds):
        p, at = int(lags[a]), places[a:b]
        for s, length, q in before:
            if p % q == 0:
                at = at[(at < s) | (at + (min_exp - 1) * p >= s + length)]
        if not len(at):
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ids[:-p] == ids[p:], [False]]).view(np.int8)))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s >= (min_exp - 1) * p and e - s + p >= min_length and (s, e - s + p) not in found:
                found[s, e - s + p] = p
                before.append((s, e - s + p, p))
    return sorted((s, length, q) for (s, length), q in found.items())


def summary(listed: list[str], runs: list[Run]) -> tuple:
    """The result columns: the run with the greatest exponent (ties: least start, then period), all runs, and the words outside repeats."""
    runs = sorted((s, q, length) for s, length, q in runs)
    flat = [v for s, q, length in runs for v in (s, length, q)]
    if not runs:
        return len(listed), 0, None, None, None, None, flat, " ".join(listed)
    s, q, length = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]))
    kept = np.ones(len(listed), bool)
    for start, period, long in runs:
        kept[start + period : start + long] = False
    return len(listed), len(runs), s, length, q, 1000 * length // q, flat, " ".join(listed[i] for i in np.flatnonzero(kept))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=RESULTS)
    return frame.astype(dict.fromkeys(["start", "length", "period", "exponent_milli"], "Int64"))


def _whole(texts: pd.Series) -> pd.DataFrame:
    return _frame([summary(listed := _WORD.findall(text or ""), find_runs(word_ids(listed))) for text in texts])


def _from_runs(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
    triples = ([] if r is None else [tuple(x) for x in np.asarray(r, dtype=np.int64).reshape(-1, 3).tolist()] for r in runs)
    return _frame([summary(_WORD.findall(text or ""), own) for text, own in zip(texts, triples, strict=True)])


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts to one row for each range of lags, with the ids and the runs of short lags; the first row has the latter as its own result."""
    for batch in batches:
        for key, text in zip(batch["key"], batch["text"], strict=True):
            ids = word_ids(_WORD.findall(text))
            short = find_runs(ids, 1, SHORT + 1)
            flat = [v for run in short for v in run]
            last = len(ids) // MIN_EXP
            step = max(LAGS, -(-last // MOST_RANGES))
            for lo in range(SHORT + 1, max(last + 1, SHORT + 2), step):
                yield pd.DataFrame({"key": [key], "lo": [lo], "hi": [min(lo + step, last + 1)], "ids": [ids.tobytes()], "known": [flat]})


def _scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            known = [tuple(x) for x in np.asarray(row.known, dtype=np.int64).reshape(-1, 3).tolist()]
            found = find_runs(np.frombuffer(row.ids, np.int32), row.lo, row.hi, known) + (known if row.lo == SHORT + 1 else [])
            if found:
                yield pd.DataFrame([(row.key, *run) for run in found], columns=["key", "start", "length", "period"])


def _long_runs(keyed: DataFrame) -> DataFrame:
    """(key, runs) of (key, text): equal texts once, a range of lags to a task."""
    ranges = cut(keyed.groupBy("key").agg(F.first("text").alias("text")).mapInPandas(_numbered, "key string, lo long, hi long, ids binary, known array<bigint>"))
    found = ranges.repartition("key", "lo").mapInPandas(_scanned, "key string, start long, length long, period long")
    least = found.groupBy("key", "start", "length").agg(F.min("period").alias("period"))
    listed = F.array_sort(F.collect_list(F.struct("start", "length", "period")))
    return least.groupBy("key").agg(F.flatten(F.transform(listed, lambda r: F.array(r["start"], r["length"], r["period"]))).alias("runs"))


def collapse(docs: DataFrame, text_col: str = "text", long_chars: int = LONG_CHARS) -> DataFrame:
    """``docs`` with n_words, n_runs, the run of greatest exponent (start, length, period, exponent_milli; null without runs), runs (all, by start and
    period, as structs) and collapsed (the words that no run holds after its first period, joined by spaces)."""

    def work(numbered: DataFrame) -> DataFrame:
        text = F.coalesce(F.col(text_col), F.lit(""))
        # Not foldable, so that the filters stay above what makes the text: below it they would compute it again, inside its own lambdas.
        sized = numbered.withColumn("_long", F.when(F.monotonically_increasing_id() >= 0, F.length(text) > long_chars))
        short, long = sized.filter("not _long"), sized.filter("_long")
        here = short.withColumn("_result", F.pandas_udf(_whole, _RESULT)(text)).drop("_long")
        keyed = long.withColumn("_key", F.sha2(F.col(text_col), 256))
        runs = _long_runs(keyed.select(F.col("_key").alias("key"), F.col(text_col).alias("text")))
        there = keyed.join(runs, F.col("_key") == F.col("key"), "left").withColumn("_result", F.pandas_udf(_from_runs, _RESULT)(F.col(text_col), F.col("runs"))).select(*numbered.columns, "_result")
        triple = lambda i: F.struct(F.get("_result.runs", 3 * i).alias("start"), F.get("_result.runs", 3 * i + 1).alias("length"), F.get("_result.runs", 3 * i + 2).alias("period"))
        places = F.when(F.col("_result.n_runs") > 0, F.sequence(F.lit(0), (F.col("_result.n_runs") - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
        return here.unionByName(there).select(*numbered.columns, *(F.col(f"_result.{c}") for c in RESULTS if c != "runs"), F.transform(places, triple).alias("runs"))

    return guarded(docs, work, RESULTS, (text_col,))


def planted(docs: DataFrame) -> DataFrame:
    """The contract's test input, (doc_id, text): a document whose crc32 of doc_id ends in 0 becomes periodic from some word on, the others stay."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words(F.col("text"))).alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w")
    start = F.pmod("g", F.greatest(n, F.lit(1))).cast("int")
    placed = chosen.withColumn("a", start).withColumn("p", (1 + F.floor((n - start) / (3 + F.pmod("g", F.lit(8))))).cast("int"))
    repeated = F.transform(F.sequence("a", n - 1), lambda i: F.get("w", F.col("a") + F.pmod(i - F.col("a"), F.col("p"))))
    return placed.select("doc_id", F.when(n > 0, F.array_join(F.concat(F.slice("w", 1, F.col("a")), repeated), " ")).otherwise(F.col("text")).alias("text"))


def digests(collapsed: DataFrame) -> DataFrame:
    """doc_id, the counts, and digests of the runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return collapsed.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
