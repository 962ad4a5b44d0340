"""Scans: CSV with a stated schema, CSV trees with the key in the path, JSON documents, list literals, images."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUBJECTS = "subject_id string, severity int, feature_list string"
CLUSTERINGS = "mi_id string, img_id_list array<string>, agglomerative struct<best_cluster_labels: array<int>, best_silhouette_score: double, n_clusters: array<int>, silhouette_scores: array<double>>"


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, index_name: str | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with a header and a stated schema. ``index_name`` names a first column without a header."""
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=True)
    if index_name and df.columns[0] != index_name:
        df = df.withColumnRenamed(df.columns[0], index_name)
    return require_columns(df, *required)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df``, or ValueError with the columns it lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_keyed(spark: SparkSession, root: str, file_name: str, schema: str, key: str = "subject_id") -> DataFrame:
    """All ``root/<key>/file_name`` in long form (one schema for all subjects), with the folder's name as ``key``."""
    df = spark.read.csv(f"{root}/*/{file_name}", header=True, schema=schema)
    return df.withColumn(key, F.regexp_extract(F.input_file_name(), rf"([^/]+)/{file_name.replace('.', '[.]')}$", 1))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one to a file."""
    return spark.read.json(path, schema=schema, multiLine=True)


#: One item of a list literal: in single or double quotes with backslash escapes, or bare up to a comma.
_ITEM = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^\s,'"][^,]*"""


#: An escape, or text without one.
_PIECE = r"(?s)\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|[^\\]+"
#: What letters after a backslash stand for.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\\": "\\", "'": "'", '"': '"', "\n": ""}


def _unescaped(piece: Column) -> Column:
    """A piece of a string literal as it reads; an unknown escape keeps its backslash."""
    known = F.create_map(*(F.lit(x) for pair in _ESCAPES.items() for x in pair))
    code = F.when(piece.rlike(r"^\\[xu]..+$"), F.decode(F.unhex(F.lpad(F.substring(piece, 3, 4), 4, "0")), "UTF-16BE"))
    return F.when(piece.startswith("\\"), F.coalesce(code, F.try_element_at(known, F.substring(piece, 2, 1)), piece)).otherwise(piece)


def list_literal(cell: Column) -> Column:
    """A cell such as ``['a', "it's", 3]`` as an array of strings; null if it has no brackets around it."""
    inner = F.regexp_extract(cell, r"(?s)^\s*\[(.*)\]\s*$", 1)
    whole = F.regexp_extract_all(inner, F.lit(_ITEM), F.lit(0))
    quoted = lambda x: x.startswith("'") | x.startswith('"')
    plain = lambda x: F.array_join(F.transform(F.regexp_extract_all(F.substring(x, 2, F.length(x) - 2), F.lit(_PIECE), F.lit(0)), _unescaped), "")
    return F.when(cell.rlike(r"(?s)^\s*\[.*\]\s*$"), F.transform(whole, lambda x: F.when(quoted(x), plain(x)).otherwise(F.rtrim(x))))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, subject_id, feature_id, content) of ``<subject>_<feature>.jpg`` files."""
    files = spark.read.format("binaryFile").load(path)
    stem = F.regexp_extract("path", r"([^/]+)[.][^./]+$", 1)
    return files.select("path", F.substring_index(stem, "_", 1).alias("subject_id"), F.regexp_extract(stem, "_(.*)$", 1).alias("feature_id"), "content")


def discover(spark: SparkSession, pattern: str) -> DataFrame:
    """(stem, path) of the files that match a pattern."""
    files = spark.read.format("binaryFile").load(pattern).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)[.][^./]+$", 1).alias("stem"), "path")


@dataclass
class JobConfig:
    """Settings of a sampling job; strings are stripped, and wrong values raise ValueError."""

    subject_table: str
    item_dir: str = ""
    encoder: str = "densenet121"
    n_samples: int = 10_000
    batch_subjects: int = 10
    min_items: int = 20
    cohort: str = "groundtruth-positive"
    #: Embedding widths by encoder, and cohorts.
    ENCODERS = {"densenet121": 1024, "resnet50": 2048, "vit": 768}
    COHORTS = ("groundtruth-positive", "groundtruth-negative")

    def __post_init__(self) -> None:
        for name, value in vars(self).items():
            if isinstance(value, str):
                setattr(self, name, value.strip())
        self.item_dir = self.item_dir or os.environ.get("ABLATA_ITEM_DIR", "")
        if self.encoder not in self.ENCODERS:
            raise ValueError(f"encoder must be one of {', '.join(self.ENCODERS)}")
        if self.cohort not in self.COHORTS:
            raise ValueError(f"cohort must be one of {', '.join(self.COHORTS)}")
        for name in ("n_samples", "batch_subjects", "min_items"):
            if not isinstance(getattr(self, name), int) or getattr(self, name) < 1:
                raise ValueError(f"{name} must be a positive integer")

    @property
    def width(self) -> int:
        """Embedding width of the encoder."""
        return self.ENCODERS[self.encoder]
