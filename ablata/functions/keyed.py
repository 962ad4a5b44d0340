"""Randomness as a function of keys: md5 of the joined keys, so that every engine and every rerun draws the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(*parts: Column | str | int) -> Column:
    """A hex digest that orders rows at random by their keys."""
    return F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def whole(*parts: Column | str | int) -> Column:
    """A random integer in 0 to 2**32 - 1 by the keys."""
    return F.conv(F.substring(key(*parts), 1, 8), 16, 10).cast("long")


def between(least: Column, most: Column, *parts: Column | str | int) -> Column:
    """A random integer from least to most, both included."""
    return least + whole(*parts) % (most - least + 1)
