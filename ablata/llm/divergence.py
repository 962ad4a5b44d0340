"""Which sources of a language use other words than the rest: term counts and divergences by SQL on shards.

Texts become term counts by DuckDB SQL on each Arrow batch, so only counts are shuffled. Spark adds them up by (lang, source, term), which
spreads a frequent term over its sources, and deals them into shards by hash of lang and term, as many as keep a shard near
``SHARD_ROWS`` rows. SQL on a shard keeps the terms of enough documents; after the totals of all groups are known, SQL on a shard gives
its partial sums for each pair of sources and its best terms of each source. Spark merges sums and ranks.

The sum for a pair of sources runs over all kept terms, those that neither source has included. It is taken apart so that only terms
that both have meet in a shard. With p(t) a group's smoothed share of a term, p0 that of a term it lacks, and f the summand,

    sum f(p, q) = V f(p0, q0) + sum over terms of the group of (f(p, q0) - f(p0, q0))
                + sum over terms of the other of (f(p0, q) - f(p0, q0)) + sum over terms of both of (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)).

The two middle sums need only how often a group has each count. All arithmetic is exact, in whole numbers.

Null text, lang and source count as empty strings. Groups without terms have a row for each other source of their language. Repeated rows
are documents of their own; an empty table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Rows of term counts in a shard, about; and DuckDB's share of a worker's memory.
SHARD_ROWS, MEMORY = 1 << 20, "600MB"
#: Characters of text that SQL counts at a time; a longer text is one batch.
BATCH_CHARS = 1 << 22

_COUNTS = r"""
    SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs
    FROM (SELECT lang, source, doc, term, count(*) AS n FROM (
        SELECT lang, source, doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT row_number() OVER () AS doc, * FROM texts)) GROUP BY ALL)
    GROUP BY ALL
    UNION ALL SELECT DISTINCT lang, source, '', 0, 0 FROM texts"""

_KEPT = f"""
    SELECT lang, source, term, n, CAST(sum(n) OVER same AS BIGINT) AS n_lang, row_number() OVER (same ORDER BY source) = 1 AS first
    FROM shard WINDOW same AS (PARTITION BY lang, term) QUALIFY sum(docs) OVER same >= {MIN_DOCS}"""

_F = "(({0} - {1}) * ({0} - {1}) // {1})"

_PAIRS = f"""
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
        CAST(sum({_F.format("a.p", "b.p")}::HUGEINT - {_F.format("a.p", "b.p0")} - {_F.format("a.p0", "b.p")} + {_F.format("a.p0", "b.p0")}) AS DECIMAL(38, 0)) AS value
    FROM shard a JOIN shard b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    UNION ALL SELECT lang, source, 'term', term, {_F.format("p", "q")}::DECIMAL(38, 0) AS value FROM shard WHERE p > q
    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {TOP}"""


def _connection():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``BATCH_CHARS`` bytes of text."""
    lengths = pc.binary_length(batch.column("text")).to_pylist()
    at = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > BATCH_CHARS:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(lengths):
        yield batch.slice(at)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (lang, source, term, n, docs), and a row with the empty term for each group."""
    with _connection() as con:
        for batch in batches:
            for part in _sliced(batch):
                con.register("texts", pa.table(part))
                yield from con.sql(_COUNTS).to_arrow_table().to_batches()


def _by_shard(sql: str):
    """A function of a partition's batches: SQL over all of its rows as the table ``shard``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _connection() as con:
            made = False
            for batch in batches:
                if batch.num_rows:
                    con.register("batch", pa.table(batch))
                    con.execute("INSERT INTO shard SELECT * FROM batch" if made else "CREATE TABLE shard AS SELECT * FROM batch")
                    made = True
            if made:
                yield from con.sql(sql).to_arrow_table().to_batches(max_chunksize=1 << 16)

    return run


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a group's row with the empty term only says that the group exists."""
    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    partial = texts.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), in decimals, as SCALE * n may pass 64 bits; null without terms."""
    wide = lambda c: c.cast("decimal(18,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * wide(n + 1)
    bottom = wide(total + terms)
    return 1 + F.when(terms > 0, F.call_function("div", top, bottom))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q).cast("decimal(38,0)")


def audit(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language, all other sources by their divergence from it, and the ``TOP`` terms it
    has more often than the language, by their summands."""
    spark = docs.sparkSession
    counts = cut(term_counts(docs))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), counts.count() // shard_rows + 1)
    by_term = counts.filter("term <> ''").repartition(shards, "lang", "term")
    kept = cut(by_term.mapInArrow(_by_shard(_KEPT), "lang string, source string, term string, n long, n_lang long, first boolean"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.count_if("first").alias("terms"))
    every = counts.filter("term = ''").select("lang", "source")
    groups = every.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "total_lang", "terms"])
    groups = cut(groups.withColumn("p0", _share(F.lit(0), F.col("total"), F.col("terms"))))
    known = kept.join(groups, ["lang", "source"])
    shares = known.select("lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "p0", _share(F.col("n_lang"), F.col("total_lang"), F.col("terms")).alias("q"))
    found = cut(shares.repartition(shards, "lang", "term").mapInArrow(_by_shard(_PAIRS), "lang string, source string, part string, item string, value decimal(38,0)"))
    # How often a group has each count meets the other sources: the sums over a group's own terms.
    spread = known.groupBy("lang", "source", "n", "total", "terms", "p0").agg(F.count("*").alias("times"))
    spread = spread.select("lang", F.col("source").alias("own"), _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), F.col("p0").alias("own_p0"), "times")
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"))
    meeting = spread.join(other, "lang").filter("own <> other")
    times, p, p0, q0 = F.col("times").cast("decimal(18,0)"), F.col("p"), F.col("own_p0"), F.col("other_p0")
    both = F.array(
        F.struct(F.col("own").alias("source"), F.col("other").alias("item"), (times * (_f(p, q0) - _f(p0, q0))).cast("decimal(38,0)").alias("value")),
        F.struct(F.col("other").alias("source"), F.col("own").alias("item"), (times * (_f(q0, p) - _f(q0, p0))).cast("decimal(38,0)").alias("value")),
    )
    own_terms = meeting.select("lang", F.explode(both).alias("x")).select("lang", "x.*")
    first = groups.select("lang", "source", "p0", "terms")
    absent = first.join(other, "lang").filter("source <> other").select("lang", "source", F.col("other").alias("item"), F.coalesce((F.col("terms").cast("decimal(18,0)") * _f(F.col("p0"), F.col("other_p0"))).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias("value"))
    pairs = absent.unionByName(own_terms).unionByName(found.filter("part = 'pair'").drop("part")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    return ranked.unionByName(terms).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
