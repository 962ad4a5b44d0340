"""Mixing sources to target weights by pivotal rounding.

Sizes are words. Sources in code point order (null last) weigh 5, 2, 1, repeating, and share ``TOTAL`` times all words; a source gets at
most ``MOST`` times its own words, and what it can't take is shared by the others by weight until none is above.

Each document of a source asks for ratio = target / size copies. The whole copies are taken at once; the rest is a probability. Two
documents with probabilities left transfer words from one to the other, at random in a way that keeps both expectations, until one
of them is 0 or 1; the last one left is drawn. So a source's taken words differ from its target by at most one document. Documents are
first rounded within random groups of about ``GROUP`` documents, whose one open document each goes up a reduction tree with fan-in ``FAN``; a
source of any size is thus many small groups. Draws are seeded by (seed, source, group, level) and made in doc_id order, so reruns agree.

Sources may be many: they are ranked by ranges of names, and the level at which the limits stop is found by repeated sums. Repeated rows are
documents of their own; equal ones (doc_id, text and source) travel as one row with a count, in parts of ``GROUP``, and are interchangeable. A key's
rows that differ in other columns get their copies in the order of their hashes.

Null and empty texts have size 0 and are never taken. Sources without words have target 0. An empty table gives no rows.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, row_hash

WEIGHTS, TOTAL, MOST = (5, 2, 1), 1.5, 2.0
GROUP, FAN, SEED = 256, 32, 20240601
#: The table of sources is broadcast if it has so many rows at most; beyond that it is joined by shuffles.
BROADCAST_SOURCES = 100_000
_EPS = 1e-12
#: A key's rows that differ are numbered in so many parts.
PARTS = 64
_PLAN = "doc_id long, source string, key long, size long, source_size long, target double, copies int, open double, bucket long"


def _ranked(by_source: DataFrame) -> DataFrame:
    """``by_source`` with the 0-based ``rank`` of the source by code point, null last, without one task for all."""
    ranged = cut(by_source.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    # One row for each part.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.withColumn("inside", inside).join(F.broadcast(parts), "part").withColumn("rank", F.col("before") + F.col("inside")).drop("part", "inside", "before")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size): one row per source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("double")
    limited = cut(_ranked(by_source).withColumn("weight", weight).withColumn("most", MOST * F.col("source_size")))
    everything = limited.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, stopped = 0.0, -1
    while True:
        # Those that the level lets reach their limit stop; the others share what these leave.
        full = F.lit(level) * F.col("weight") >= F.col("most")
        n, taken, weights = limited.agg(F.count_if(full), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == stopped or not weights:
            break
        stopped, level = n, max(level, (TOTAL * everything - (taken or 0.0)) / weights)
    return limited.withColumn("target", F.least(F.lit(level) * F.col("weight"), F.col("most"))).select("source", "source_size", "n_docs", "target")


def _rounded(level: int):
    """Rounds one group; at most one document stays open."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if "many" in rows:
            rows = rows.loc[rows.index.repeat(rows["many"])].drop(columns="many")
        rows = rows.sort_values(["doc_id", "size", "key"], kind="stable", na_position="first").reset_index(drop=True)
        draw = random.Random(f"{SEED}|{key[0]}|{key[1]}|{level}").random
        left, sizes, copies = rows["open"].tolist(), rows["size"].tolist(), rows["copies"].tolist()
        held = -1
        for i, p in enumerate(left):
            if p <= 0:
                continue
            if held < 0:
                held = i
                continue
            q, a, b = left[held], sizes[held], sizes[i]
            forth, back = min(q * a, (1 - p) * b), min((1 - q) * a, p * b)  # words that can go either way
            if draw() * (forth + back) < back:
                q, p = (0.0, p + q * a / b) if q * a <= (1 - p) * b else (q - (1 - p) * b / a, 1.0)
            else:
                q, p = (1.0, p - (1 - q) * a / b) if (1 - q) * a <= p * b else (q + p * b / a, 0.0)
            before, held = held, -1
            for k, share in ((before, q), (i, p)):
                if _EPS < share < 1 - _EPS:
                    left[k], held = share, k
                else:
                    left[k], copies[k] = 0.0, copies[k] + round(share)
        rows["open"], rows["copies"] = left, copies
        return rows

    return run


def plan_mix(sizes: DataFrame) -> DataFrame:
    """(doc_id, source, key, size) to the same rows with source_size, target and copies."""
    targets = cut(source_targets(sizes))
    sources, most = targets.agg(F.count("*"), F.coalesce(F.max("n_docs"), F.lit(0))).first()
    named = targets.select(F.col("source").alias("_source"), "source_size", "n_docs", "target")
    named = F.broadcast(named) if sources <= BROADCAST_SOURCES else named
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    groups = F.greatest(F.ceil(F.col("n_docs") / GROUP), F.lit(1))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / GROUP)))
    equal = sizes.groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("n")).withColumn("part", part)
    asked = (
        equal.join(named, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("ratio", F.when(F.col("size") > 0, ratio).otherwise(F.lit(0.0)))
        .withColumn("copies", F.floor("ratio").cast("int"))
        .withColumn("open", F.col("ratio") - F.floor("ratio"))
        .withColumn("bucket", F.pmod(F.xxhash64("key", "part", F.lit(SEED)), groups))
        .withColumn("many", F.least(F.lit(GROUP), F.col("n") - F.col("part") * GROUP).cast("int"))
        .select("doc_id", "source", "key", "size", "source_size", "target", "copies", "open", "bucket", "many")
    )
    done, level, spread = [], 0, -(-most // GROUP)
    while True:
        rounded = cut(asked.groupBy("source", "bucket").applyInPandas(_rounded(level), _PLAN))
        if spread <= 1:
            drawn = F.pmod(F.xxhash64("key", F.lit(SEED + 1)), F.lit(1 << 53)) / F.lit(float(1 << 53))
            last = F.col("copies") + F.when(drawn < F.col("open"), 1).otherwise(0)
            done.append(rounded.withColumn("copies", last.cast("int")))
            break
        done.append(rounded.filter("open = 0"))
        asked = rounded.filter("open > 0").withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))
        level, spread = level + 1, -(-spread // FAN)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("open", "bucket")


def _key(doc_id: Column, text: Column, source: Column) -> Column:
    """A hash of a document; that a value is null is hashed too, so that it isn't the same as one value missing elsewhere."""
    return F.xxhash64(doc_id.isNull(), doc_id, text.isNull(), text, source.isNull(), source)


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, size, row), written once; key is the hash of the first two and the text, row that of the whole row."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    doc_id, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    return cut(docs.select(doc_id.alias("doc_id"), source.alias("source"), _key(doc_id, F.col("text"), source).alias("key"), size.alias("size"), row_hash(docs).alias("row")))


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    planned = plan_mix(document_sizes(docs))
    return planned.withColumn("taken", F.col("copies") * F.col("size")).drop("key")


def take_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    sizes = document_sizes(docs)
    # A key's documents have one ratio, so the same whole copies; ``more`` of them have one more.
    by_key = plan_mix(sizes).groupBy("key").agg(F.min("copies").alias("whole"), F.sum("copies").alias("total"), F.count("*").alias("n"))
    by_key = by_key.filter("total > 0").select("key", "whole", (F.col("total") - F.col("n") * F.col("whole")).alias("more"))
    rows = sizes.groupBy("key", "row").agg(F.count("*").alias("equal")).withColumn("part", F.pmod("row", F.lit(PARTS)))
    # How many rows of the key come before: those of earlier parts (PARTS rows a key), then those in the part.
    earlier = lambda by, order: F.coalesce(F.sum("equal").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("key", "part").agg(F.sum("equal").alias("equal")).select("key", "part", earlier(["key"], "part").alias("parts"))
    placed = rows.withColumn("inside", earlier(["key", "part"], "row")).join(parts, ["key", "part"]).join(by_key, "key")
    extra = F.greatest(F.lit(0), F.least(F.col("equal"), F.col("more") - F.col("parts") - F.col("inside")))
    wanted = placed.select(F.col("key").alias("_key"), F.col("row").alias("_hash"), (F.col("equal") * F.col("whole") + extra).alias("_copies")).filter("_copies > 0")
    # Equal rows are one before they are shuffled.
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), _key(F.col("doc_id").cast("long"), F.col("text"), F.col("source").cast("string")).alias("_key"), row_hash(docs).alias("_hash"))
    once = keyed.groupBy("_key", "_hash").agg(F.first("_row").alias("_row"))
    return once.join(wanted, ["_key", "_hash"]).select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")
