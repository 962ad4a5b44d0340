"""Writers: long tables partitioned by subject, wide matrices, JSON, versioned paths."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import incidence


def write_by_subject(df: DataFrame, path: str, form: str = "parquet", key: str = "subject") -> None:
    """One folder for each subject. The feature name stays a column."""
    writer = df.write.partitionBy(key)
    writer.option("header", True).csv(path) if form == "csv" else writer.format(form).save(path)


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """A whole result in one table."""
    df.write.option("header", True).format(form).save(path)


def write_json(df: DataFrame, path: str) -> None:
    """Nested results as JSON lines."""
    df.write.json(path)


def write_matrices(inc: DataFrame, samples: DataFrame, subject: object, features: list[str], path: str) -> None:
    """One subject's design matrix, and the same with yhat and y."""
    own = incidence.wide(inc.filter(F.col("subject") == F.lit(subject)), samples.filter(F.col("subject") == F.lit(subject)), features)
    own.drop("yhat", "y").write.option("header", True).csv(f"{path}/design_matrix")
    own.write.option("header", True).csv(f"{path}/pred_results")


def write_archive(subject: object, path: str, inc: DataFrame, samples: DataFrame, features: list[str], correlations: DataFrame, subset_correlations: DataFrame, vector_correlations: DataFrame) -> None:
    """One subject's five tables: design_matrix, pred_results, corr_results, sampling_corr and encoded_img_corr."""
    write_matrices(inc, samples, subject, features, path)
    named = {"corr_results": correlations, "sampling_corr": subset_correlations, "encoded_img_corr": vector_correlations}
    for name, table in named.items():
        table.filter(F.col("subject") == F.lit(subject)).write.option("header", True).csv(f"{path}/{name}")


#: Rows of a subject in one file of ``write_all_matrices``.
FILE_ROWS = 100_000


def _quoted(name: Column) -> Column:
    """A CSV field."""
    return F.when(name.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(name)


def matrix_lines(inc: DataFrame, samples: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """(table, subject, chunk, place, value): the lines of the design matrix and of the same with yhat and y, for all subjects at once.

    Each subject has its own columns, its features in sorted order; a subject of many samples has several chunks, each with a header. A row is
    made from the sorted places of its features, with zeros between, in proportion to its length."""
    features = inc.select("subject", "feature").distinct()
    names = features.groupBy("subject").agg(F.array_sort(F.collect_list("feature")).alias("names"))
    chunks = samples.groupBy("subject").agg(F.ceil(F.count("*") / file_rows).alias("chunks"))
    heads = chunks.join(names, "subject", "left").withColumn("names", F.coalesce("names", F.expr("filter(names, x -> false)"), F.array()))
    placed = heads.select("subject", F.posexplode("names").alias("at", "feature"))
    held = inc.select("subject", "sample", "feature").distinct().join(placed, ["subject", "feature"]).groupBy("subject", "sample").agg(F.array_sort(F.collect_list("at")).alias("held"))
    rows = samples.join(heads.select("subject", "chunks", F.size("names").alias("n")), "subject").join(held, ["subject", "sample"], "left")
    zeros = lambda n: F.repeat(F.lit(",0"), n)
    ones = F.transform("held", lambda at, i: F.concat(zeros(at - F.coalesce(F.get("held", i - 1), F.lit(-1)) - 1), F.lit(",1")))
    tail = zeros(F.col("n") - F.coalesce(F.get("held", F.size("held") - 1), F.lit(-1)) - 1)
    cells = F.concat(F.col("sample").cast("string"), F.coalesce(F.array_join(ones, ""), F.lit("")), tail)
    lines = rows.select("subject", F.pmod(F.xxhash64("sample"), F.col("chunks")).alias("chunk"), F.col("sample").alias("place"), cells.alias("cells"), F.concat_ws(",", F.lit(""), F.coalesce(F.col("yhat").cast("string"), F.lit("")), F.coalesce(F.col("y").cast("string"), F.lit(""))).alias("labels"))
    header = F.array_join(F.concat(F.array(F.lit("sample")), F.transform(F.col("names").cast("array<string>"), _quoted)), ",")
    titles = heads.select("subject", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast(samples.schema["sample"].dataType).alias("place"), header.alias("cells"), F.lit(",yhat,y").alias("labels"))
    both = F.array(F.struct(F.lit("design_matrix").alias("table"), F.col("cells").alias("value")), F.struct(F.lit("pred_results").alias("table"), F.concat("cells", "labels").alias("value")))
    return lines.unionByName(titles).select("subject", "chunk", "place", F.explode(both).alias("x")).select("x.table", "subject", "chunk", "place", "x.value")


def write_all_matrices(inc: DataFrame, samples: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Design matrices and prediction tables of all subjects in one job: ``path/table=.../subject=.../chunk=.../`` with one CSV file each."""
    lines = matrix_lines(inc, samples, file_rows).repartition("table", "subject", "chunk")
    ordered = lines.sortWithinPartitions("table", "subject", "chunk", F.col("place").asc_nulls_first())
    ordered.select("table", "subject", "chunk", "value").write.partitionBy("table", "subject", "chunk").text(path)


def write_all_archives(path: str, inc: DataFrame, samples: DataFrame, correlations: DataFrame, subset_correlations: DataFrame, vector_correlations: DataFrame) -> None:
    """The five tables of all subjects: the two matrices, and three long tables with a folder for each subject."""
    write_all_matrices(inc, samples, f"{path}/matrices")
    for name, table in {"corr_results": correlations, "sampling_corr": subset_correlations, "encoded_img_corr": vector_correlations}.items():
        write_by_subject(table, f"{path}/{name}", "csv")


def stamped(path: str, at: datetime) -> str:
    """A path that says when it was made."""
    return f"{path}/{at:%m-%d-%Y-%H-%M-%S}"


def write_version(df: DataFrame, path: str, at: datetime) -> str:
    """Writes a new version beside the earlier ones and returns its path; nothing is overwritten."""
    target = stamped(path, at)
    df.write.parquet(target)
    return target
