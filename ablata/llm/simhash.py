"""SimHash near-duplicates by multi-index hashing.

Fingerprints have 64 bits, cut into two segments of 32. If two fingerprints differ in at most 2 bits, some segment differs in at most
one, so every fingerprint is entered once in each segment's table and looks up the Hamming ball of radius 1 around its own segment
(half of it: of two neighbours, the one whose differing bit is 0 finds the other). Table matches are verified over all 64 bits.

Exact copies are folded into one fingerprint first. A table entry with more than ``BUCKET`` fingerprints is not paired up: its
fingerprints, and those that look it up, are linked through shared points of their full 64-bit balls of radius 1, which meet exactly
when two fingerprints differ in at most 2 bits. That finds the same links through 65 rows each, however large the entry.

Null, empty and wordless texts have fingerprint zero. Every row has a result row, rows of an equal doc_id too; a null doc_id is never the
smallest in its component unless no other is in it. ``keep_one_row`` keeps a single row of a component, whatever the ids: that with the least
doc_id (null last), of several the one with the least hash, of equal rows one. ``keep_one`` goes by doc_id: rows of one doc_id are one document,
which stays or goes whole, and rows without a doc_id stay. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, row_hash, unbroadcast
from .components import components, fresh_key

SHINGLE, SEED = 3, 42
SEGMENTS, SEGMENT_BITS, MAX_BITS = 2, 32, 2
#: Table entries of up to so many distinct fingerprints are compared pair by pair.
BUCKET = 16


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[SHINGLE - 1 :].tolist() or [len(line)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, last, strict=False)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64), dtype="int64")


def _segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT_BITS * k).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def _entries(fps: DataFrame) -> DataFrame:
    """(seg, key, fp): each fingerprint in each table."""
    own = F.array(*(F.struct(F.lit(k).alias("seg"), _segment(F.col("fp"), k).alias("key")) for k in range(SEGMENTS)))
    return fps.select("fp", F.explode(own).alias("e")).select("e.seg", "e.key", "fp")


def _lookups(fps: DataFrame) -> DataFrame:
    """(seg, key, fp): each segment itself and with one 0 bit set."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(SEGMENT_BITS)))
    keys = F.transform(F.filter(flips, lambda bit: F.col("key").bitwiseAND(bit) == 0), lambda bit: F.col("key").bitwiseOR(bit))
    return _entries(fps).select("seg", "fp", F.explode(keys).alias("key"))


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) to edges (a, b) with the components of all links at up to 2 differing bits."""
    first = Window.partitionBy("seg", "key").orderBy("fp")
    tables = _entries(fps).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= BUCKET + 1).groupBy("seg", "key").agg(F.collect_list("fp").alias("found"))
    met = cut(
        _lookups(fps)
        .join(unbroadcast(tables.select("seg", fresh_key("key"), "found")), ["seg", "key"])
        .select("seg", "key", "fp", F.size("found") > BUCKET, F.filter("found", lambda o: (o != F.col("fp")) & (F.bit_count(o.bitwiseXOR(F.col("fp"))) <= MAX_BITS)))
        .toDF("seg", "key", "fp", "large", "near")
        .filter("large or size(near) > 0")
        .select("fp", "large", F.when(~F.col("large"), F.col("near")).alias("near"))
    )
    paired = met.filter("not large").select(F.col("fp").alias("a"), F.explode("near").alias("b"))
    crowd = met.filter("large").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64)))
    points = crowd.select("fp", F.explode(F.transform(flips, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("point"))
    # Ball points of one fingerprint only join nothing; the others are linked to the least fingerprint that reaches them.
    shared = points.groupBy("point").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).filter("b <> most").select("point", "b")
    meeting = points.join(unbroadcast(shared.select(fresh_key("point"), "b")), "point").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return paired.union(meeting)


def _roots(marked: DataFrame) -> DataFrame:
    """(doc_id, fp) to (fp, root, component_id): one row per fingerprint."""
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(classes.select("fp")))
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return cut(joined.join(least, "root").select("fp", "root", "component_id"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (the smallest doc_id reachable)."""
    marked = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.pandas_udf(_fingerprints, "long")(F.col(text_col)).alias("fp")))
    return marked.join(_roots(marked).drop("root"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose doc_id stands for its component; rows without a doc_id stay."""
    heads = simhash_components(docs, id_col, text_col).filter("doc_id = component_id").select(F.col("doc_id").alias("_head")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))
    own = F.col("_doc").getField(id_col)
    return rows.join(heads, own == F.col("_head"), "left_semi").unionByName(rows.filter(own.isNull())).select("_doc.*")


def keep_one_row(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component."""
    doc_id, row = F.col(id_col).cast("long"), row_hash(docs)
    marked = cut(docs.select(doc_id.alias("doc_id"), row.alias("row"), F.pandas_udf(_fingerprints, "long")(F.col(text_col)).alias("fp")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    by_class = marked.groupBy("fp").agg(first.alias("first"))
    heads = by_class.join(_roots(marked).select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    # How many rows there are of each head: all but one of equal rows go.
    heads = cut(heads.join(marked.groupBy("row").agg(F.count("*").alias("equal")), "row").select(F.col("row").alias("_head"), "equal"))
    single, repeated = heads.filter("equal = 1").select("_head"), heads.filter("equal > 1").select("_head")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), row.alias("_row"))
    kept = keyed.join(single, F.col("_row") == F.col("_head"), "left_semi").select("_doc")
    if not repeated.isEmpty():
        several = keyed.join(repeated, F.col("_row") == F.col("_head"), "left_semi")
        kept = kept.unionByName(several.groupBy("_row").agg(F.first("_doc").alias("_doc")).select("_doc"))
    return kept.select("_doc.*")
