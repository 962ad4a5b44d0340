"""The sampling job: draw subsets of each subject, score them, write them; a rerun goes on where a killed run stopped.

Subjects are committed in groups by hash of their key. A group's rows are written to a folder of their own, and only then does the
manifest get a row for each subject of it, in one small file that appears whole or not at all. What the manifest doesn't name is not
there: readers join with it, and a rerun draws only the subjects that it lacks. If two runs commit a subject, the part with the least
name counts. Draws are keyed, so an interrupted job ends with the same rows as one that ran through.

A subject without items has no row and is never committed. Nothing depends on the number of subjects: the driver goes through
``commits`` groups and sees one flag of each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cohort, metrics, sampling, scoring

COMMITS = 16


def _folder(path: str, kind: str) -> str:
    return f"{path.rstrip('/')}/{kind}"


def _manifest_schema(kind: str) -> str:
    return f"subject {kind}, part string, n_samples long, label_sum long"


def committed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(subject, part, n_samples, label_sum) of what is committed; ``kind`` is the subject's type."""
    rows = spark.read.schema(_manifest_schema(kind)).parquet(_folder(path, "manifest") + "/*")
    first = F.min(F.struct("part", "n_samples", "label_sum")).alias("first")
    return rows.groupBy("subject").agg(first).select("subject", "first.*")


def sampled(spark: SparkSession, path: str, kind: str, item: str) -> DataFrame:
    """(subject, sample, features, yhat) of the committed subjects; ``item`` is a feature's type."""
    rows = spark.read.schema(f"subject {kind}, sample int, features array<{item}>, yhat int, part string").parquet(_folder(path, "samples") + "/*")
    return rows.join(committed(spark, path, kind).select("subject", "part"), ["subject", "part"], "left_semi").drop("part")


#: Samples that are drawn from one copy of their subject's items.
SAMPLES = 50


def subsets(strata: DataFrame, n_samples: int, seed: int) -> DataFrame:
    """(subject, sample, features): the draws of ``sampling.stratified`` as sorted arrays, which are at most a subject's items.

    A subject's items are dealt out once for every ``SAMPLES`` samples, whose digests share what comes before the item and are parted, not
    sorted: no row is made for an item of a sample, and one subject's samples are on all tasks."""
    spark = strata.sparkSession
    listed = strata.groupBy("subject", "cluster").agg(F.collect_list(F.struct("feature")).alias("items"))
    own = metrics.proportions(strata).join(listed, ["subject", "cluster"]).groupBy("subject").agg(F.collect_list(F.struct("n", "proportion", "items")).alias("strata"))
    chunks = own.join(metrics.min_sample_size(strata), "subject").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((n_samples - 1) // SAMPLES))))
    # A stated number of partitions is not coalesced: little is shuffled and much is made of it.
    dealt = chunks.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "subject", "chunk")
    first = F.col("chunk") * SAMPLES
    numbers = F.sequence(first, F.least(first + SAMPLES, F.lit(n_samples)) - 1)
    quotas = lambda i: F.transform("strata", lambda s: F.least(F.bround(sampling.size_of(seed, i) * s["proportion"]).cast("long"), s["n"]).cast("int"))
    # What ``sampling.order_of`` hashes: this, and then the item.
    prefix = lambda i: F.concat_ws("|", F.lit(str(seed)), F.col("subject").cast("string"), i.cast("string"))
    samples = F.transform(numbers, lambda i: F.struct(i.alias("sample"), prefix(i).alias("prefix"), quotas(i).alias("quotas")))
    items = F.transform("strata", lambda s: F.transform(s["items"], lambda x: x["feature"]))
    rows = dealt.select("subject", samples.alias("samples"), items.alias("items"), F.transform(items, lambda s: F.transform(s, lambda x: x.cast("string"))).alias("names"))
    kinds = {f.name: f.dataType.simpleString() for f in strata.schema.fields}
    taken = rows.mapInArrow(_taken, f"subject {kinds['subject']}, sample int, features array<{kinds['feature']}>")
    return taken.select("subject", "sample", F.sort_array("features").alias("features"))


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each sample's first items of each stratum in the order of their digests; none for a sample without items."""
    for batch in batches:
        for at in range(len(batch)):
            samples, strata = batch["samples"][at].as_py(), batch["items"][at].values
            items, ends = strata.flatten(), np.cumsum(strata.value_lengths().to_numpy())
            names = [None if n is None else b"|" + n.encode() for n in batch["names"][at].values.flatten().to_pylist()]
            kept, found = [], []
            for sample in samples:
                if not any(q > 0 for q in sample["quotas"]):
                    continue
                base = md5(sample["prefix"].encode())
                places = [begin + _first(base, names[begin:end], q) for begin, end, q in zip([0, *ends[:-1].tolist()], ends.tolist(), sample["quotas"], strict=True) if q > 0]
                kept.append(sample["sample"])
                found.append(items.take(pa.array(np.concatenate(places))).drop_null())
            if kept:
                offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.concat_arrays(found))
                yield pa.RecordBatch.from_arrays([batch["subject"].take(pa.array([at] * len(kept))), pa.array(kept, pa.int32()), lists], ["subject", "sample", "features"])


def _first(base, names: list[bytes | None], k: int) -> np.ndarray:
    """Places of the k names whose digests after ``base`` are least. Equal digests are equal names."""
    if k >= len(names):
        return np.arange(len(names))
    digests = []
    for name in names:
        own = base.copy()
        if name is not None:
            own.update(name)
        digests.append(own.digest())
    halves = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
    high = halves[:, 0]
    found = np.argpartition(high, k - 1)[:k]
    if (high <= high[found].max()).sum() > k:  # the first half doesn't tell the last one from the next
        found = np.lexsort((halves[:, 1], high))[:k]
    return found


def sampling_job(strata: DataFrame, scorer: Column | Callable, path: str, n_samples: int = 10_000, seed: int = 0, commits: int = COMMITS, **scoring_options) -> DataFrame:
    """Runs the job for the subjects of (subject, cluster, feature) that ``path`` lacks, and returns what is ``committed``."""
    spark, kinds = strata.sparkSession, {f.name: f.dataType.simpleString() for f in strata.schema.fields}
    kind, item = kinds["subject"], kinds["feature"]
    # So that there is something to list before the first commit.
    spark.createDataFrame([], _manifest_schema(kind)).write.mode("ignore").parquet(_folder(path, "manifest") + "/start")
    spark.createDataFrame([], f"subject {kind}, sample int, features array<{item}>, yhat int, part string").write.mode("ignore").parquet(_folder(path, "samples") + "/start")
    group = F.pmod(F.xxhash64("subject"), F.lit(commits))
    for k in range(commits):
        own = strata.filter(group == k)
        todo = cohort.not_done(own.select("subject").distinct(), committed(spark, path, kind))
        if todo.isEmpty():
            continue
        _commit(cohort.selected(own, todo), scorer, path, n_samples, seed, kind, item, scoring_options)
    return committed(spark, path, kind)


def _commit(strata: DataFrame, scorer: Column | Callable, path: str, n_samples: int, seed: int, kind: str, item: str, options: dict) -> None:
    """One group: its rows, and then its rows in the manifest, counted from what was written."""
    spark, part = strata.sparkSession, uuid.uuid4().hex
    scored = scoring.score(subsets(strata, n_samples, seed), scorer, **options)
    target = f"{_folder(path, 'samples')}/{part}"
    scored.select("subject", F.col("sample").cast("int").alias("sample"), "features", "yhat", F.lit(part).alias("part")).write.parquet(target)
    written = spark.read.schema(f"subject {kind}, yhat int").parquet(target)
    counted = written.groupBy("subject").agg(F.count("*").alias("n_samples"), F.sum("yhat").alias("label_sum"))
    counted.select("subject", F.lit(part).alias("part"), "n_samples", "label_sum").coalesce(1).write.parquet(f"{_folder(path, 'manifest')}/{part}")


def sampled_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subject, sample, feature) and (subject, sample, yhat) of ``sampled``: what the influence operators and writers take."""
    inc = rows.select("subject", "sample", F.explode("features").alias("feature"))
    return inc, rows.select("subject", "sample", "yhat")
