"""Token counts by the whole-token shortcut.

Before any text is read, every word-final string of the vocabulary is encoded alone; those that give one token form the proved set.
A text is split into pre-tokens; members of the set count one each, and only the rest are merged, once for each distinct pre-token
in a worker's bounded memo. Nothing is shuffled; the proved set is bounded by the vocabulary.

Null and empty texts have 0 tokens; runs between spaces with a character outside Latin-1 are encoded by the library and remembered, texts that
are mostly such runs or hold special strings are encoded by it whole. Repeated rows are counted row by row; an empty table gives no rows; other columns are left as they are, unless they have a result's name, which
the result replaces.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_bpe import Memo, splitter, whole_tokens

_memos: dict[str, Memo] = {}


def count_text(text: str | None, path: str, whole: frozenset[bytes]) -> int:
    """Tokens of one text."""
    if not text:
        return 0
    own = splitter(path)
    pieces = own.split(text)
    if pieces is None:
        return len(own.encode(text))
    memo = _memos.get(path)
    if memo is None:
        memo = _memos[path] = Memo(lambda piece: len(own.piece(piece)))
    rest = [piece for piece in pieces if piece not in whole]
    return len(pieces) - len(rest) + sum(map(memo.__getitem__, rest))


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``."""
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(whole_tokens(vocabulary))

    @F.pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        return pd.Series([count_text(text, vocabulary, whole.value) for text in texts], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.withColumn("n_bytes", F.octet_length(text).cast("long"))
        .withColumn("n_tokens", n_tokens(text))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
