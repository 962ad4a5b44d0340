"""Components of long chains: many rounds."""

from pyspark.sql import functions as F

from ablata.llm import components


def test_size_estimates_do_not_grow_with_the_rounds(spark):
    edges = spark.range(2000).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    found = components.components(edges)
    # Estimates carried from round to round have thousands of digits here, and fill the driver on longer chains.
    assert int(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 10**40
    rows = found.collect()
    assert len(rows) == 2001 and len({r["root"] for r in rows}) == 1
    assert {r["root"] for r in rows} == {min(r["node"] for r in rows)}
