"""Scoring of subsets by any black box.

A scorer is a Column expression of the subset's features, a function from a pandas Series of feature lists to a Series of labels
(``batched=True``), or a function from one feature list to a label. Functions run in Arrow batches; one that must load a model does so
once in a worker, in ``load``, and gets it as a second argument.
"""

from __future__ import annotations

import inspect
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(scorer: Callable, probe: list) -> None:
    """Warns if the scorer doesn't take one argument, and raises TypeError if it doesn't return an int for a probe."""
    if len(inspect.signature(scorer).parameters) != 1:
        warnings.warn("a scorer takes one argument", stacklevel=2)
    value = scorer(probe)
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"a scorer returns an int, not {type(value).__name__}")


def score(subsets: DataFrame, scorer: Column | Callable, load: Callable[[], object] | None = None, batched: bool = False) -> DataFrame:
    """(…, features) with ``yhat``. A batched scorer that returns another number of labels fails the job."""
    if isinstance(scorer, Column):
        return subsets.withColumn("yhat", scorer.cast("int"))

    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load() if load else None
        for part in parts:
            if batched:
                labels = pd.Series(scorer(part) if model is None else scorer(part, model))
                if len(labels) != len(part):
                    raise ValueError("a scorer returns one label for each subset")
                yield labels.astype("int32").reset_index(drop=True)
                continue
            yield pd.Series([int(scorer(list(x)) if model is None else scorer(list(x), model)) for x in part], dtype="int32")

    batches.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return subsets.withColumn("yhat", F.pandas_udf(batches, "int")(F.col("features")))


def probabilities(margin: Column) -> Column:
    """Class probabilities (negative, positive) of a margin."""
    p = F.lit(1.0) / (1 + F.exp(-margin))
    return F.array(1 - p, p)


def single_items(items: DataFrame) -> DataFrame:
    """Each item as a subset of its own."""
    return items.withColumn("features", F.array("feature"))


#: Channel means and deviations of the image collection that the encoders were trained on.
MEANS, DEVIATIONS = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def normalised(pixels):
    """Pixels (height, width, 3) of 0 to 1, by the channels' means and deviations."""
    import numpy as np

    return (pixels - np.array(MEANS)) / np.array(DEVIATIONS)


def prepared(images: DataFrame, size: int = 224, normalise: bool = True) -> DataFrame:
    """(…, content) with ``pixels``: three channels, ``size`` square, normalised or 0 to 1. Needs an image library in the workers."""

    def run(parts: pd.Series) -> pd.Series:
        import io

        import numpy as np
        from PIL import Image

        pixels = (np.asarray(Image.open(io.BytesIO(x)).convert("L").convert("RGB").resize((size, size))) / 255.0 for x in parts)
        return pd.Series([(normalised(p) if normalise else p).ravel().tolist() for p in pixels])

    return images.withColumn("pixels", F.pandas_udf(run, "array<double>")(F.col("content")))
