"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import cut, new_path, shared_dir, stored  # noqa: F401

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def runs(texts: list[str | None], chars: int = 1 << 20) -> Iterator[list[str | None]]:
    """The texts in successive runs of up to ``chars`` characters, or one longer text.

    Spark bounds a batch by its bytes (spark.sql.execution.arrow.maxBytesPerBatch); this bounds what is made of one at a time."""
    run: list[str | None] = []
    held = 0
    for text in texts:
        if run and held + len(text or "") > chars:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text or "") + 64
    if run:
        yield run


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that sorts and merges, for joins with exploded rows: Spark sizes these as if each stood for one, and would send them through the driver."""
    return df.hint("merge")


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed."""
    hashable = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(*(c.isNull() for c in hashable), *hashable)


def guarded(docs: DataFrame, work: Callable[[DataFrame], DataFrame], results: list[str], needed: tuple[str, ...] = ("text",)) -> DataFrame:
    """``docs`` with the ``results`` that ``work`` adds. It sees the ``needed`` columns, and the others under numbers, so no name of theirs is taken for one of its own."""
    names = {c: c if c in needed else f"_{i}" for i, c in enumerate(docs.columns)}
    done = work(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())))
    return done.select(*(F.col(n).alias(c) for c, n in names.items() if c not in results), *results)
