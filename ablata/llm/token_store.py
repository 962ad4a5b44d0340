"""Token ids in directly addressable codes (DAC).

An id is cut into 8-bit chunks. Level k holds the k-th chunk of every id that has one, in order, and a bitmap that says which of them
go on; a rank directory counts the set bits before each 512-bit block. Token i is found by following the ranks upward, at most four
steps, without decoding its neighbours.

A store is a folder of Parquet files written and committed by Spark, so a lost executor or a second attempt leaves no half-written
data. Each row is a segment: whole documents in ascending doc_id order, about ``SEGMENT_IDS`` ids, with its document directory and
the DAC payload. ``part`` is the range of doc_ids a task wrote and ``part_start`` the segment's first position in it; the position in
the whole store is the ids of all earlier parts plus that.

Null and empty texts hold only the end id. A null doc_id comes first; rows with the same doc_id stay, ordered by text. An empty table
gives an empty store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, runs
from .word_bpe import splitter

MAGIC = b"DAC1"
BLOCK_BITS = 512
SEGMENT_IDS = 1 << 18
_SEGMENT = "part int, seg int, part_start long, n_ids long, doc_ids array<long>, doc_lens array<long>, payload binary"
#: A worker's memo learns so many pre-tokens, first come; the others are encoded once for each batch.
MEMO_WORDS = 500_000
_memos: dict[str, dict[bytes | str, bytes]] = {}


def dac_encode(ids: np.ndarray) -> bytes:
    """The DAC bytes of unsigned 32-bit ids."""
    levels, now = [], ids.astype("<u4")
    while True:
        more = now > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK_BITS // 8), np.uint8)])
        ones = np.bitwise_count(bits.view("<u8")).reshape(-1, BLOCK_BITS // 64).sum(axis=1)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        levels.append(struct.pack("<Q", len(now)) + now.astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        if not more.any():
            return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)
        now = now[more] >> 8


class Dac:
    """Reads DAC bytes."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a DAC payload")
        (count,), at, self.levels = struct.unpack_from("<I", data, 4), 8, []
        for _ in range(count):
            (n,) = struct.unpack_from("<Q", data, at)
            blocks = -(-n // BLOCK_BITS)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, np.uint8, blocks * BLOCK_BITS // 8, at + 8 + n)
            ranks = np.frombuffer(data, "<u8", blocks + 1, at + 8 + n + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += 8 + n + len(bits) + ranks.nbytes

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """Token i, by rank only."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK_BITS
            inside = np.unpackbits(bits[block * BLOCK_BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK_BITS]
            i = int(ranks[block]) + int(inside.sum())
        return value

    def decode(self) -> np.ndarray:
        """All ids."""
        above = None
        for chunks, bits, _ in reversed(self.levels):
            now = chunks.astype("<u4")
            if above is not None:
                now[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= above << 8
            above = now
        return above


def encode_texts(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of each text, as little-endian 32-bit bytes. Each distinct pre-token that the memo lacks is encoded once by the library."""
    own, memo = splitter(path), _memos.setdefault(path, {})
    room = MEMO_WORDS - len(memo)
    split = [own.split(text) if text else [] for text in texts]
    pieces = list(chain.from_iterable(filter(None, split)))
    found = list(map(memo.get, pieces))
    lacking = [i for i, ids in enumerate(found) if ids is None]
    new, ids_of = list({pieces[i] for i in lacking}), {}
    for at in range(0, len(new), 256):
        part = new[at : at + 256]
        ids_of.update(zip(part, own.encode_pieces(part), strict=True))
    for i in lacking:
        found[i] = ids_of[pieces[i]]
    memo.update(islice(ids_of.items(), max(0, room)))
    out, at = [], 0
    for text, own_pieces in zip(texts, split, strict=True):
        if own_pieces is None:
            out.append(np.array(own.encode(text), "<u4").tobytes())
        else:
            out.append(b"".join(found[at : at + len(own_pieces)]))
            at += len(own_pieces)
    return out


def _segments(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    context, seg, start = TaskContext.get(), 0, 0
    part = context.partitionId() if context else 0
    ids, doc_ids, lens, held = [], [], [], 0

    def flush() -> pa.RecordBatch:
        payload = dac_encode(np.frombuffer(b"".join(ids), "<u4"))
        columns = [[part], [seg], [start], [held], [doc_ids], [lens], [payload]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        names = ["part", "seg", "part_start", "n_ids", "doc_ids", "doc_lens", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        encoded = chain.from_iterable(encode_texts(run, vocabulary) for run in runs(batch.column(1).to_pylist()))
        for doc_id, own in zip(batch.column(0).to_pylist(), encoded, strict=True):
            ids += (own, end)
            doc_ids.append(doc_id)
            lens.append(len(own) // 4 + 1)
            held += lens[-1]
            if held >= SEGMENT_IDS:
                yield flush()
                seg, start = seg + 1, start + held
                ids, doc_ids, lens, held = [], [], [], 0
    if doc_ids:
        yield flush()


def write_store(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes every text and writes a store to ``path``; returns ``path``. Texts are shuffled once, into ranges of doc_id and, as many rows may share an id or
    have none, of the text's hash; documents of one id are in the order of that hash."""
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("_hash"))
    ranged = keyed.repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text").select("doc_id", "text")
    ranged.mapInArrow(lambda batches: _segments(batches, vocabulary, end_id), _SEGMENT).write.option("compression", "zstd").parquet(path)
    return path


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: doc_id, start (in the whole store), n_tokens, ids_crc32."""
    segments = spark.read.schema(_SEGMENT).parquet(path)
    decoded = segments.select("part", "part_start", "doc_ids", "doc_lens", "payload").mapInArrow(_documents, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # One row for each part: as many as the writing stage had tasks, whatever the number of documents.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return decoded.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "doc_id", "at", "n_tokens", "ids_crc32"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        for row in range(batch.num_rows):
            part, start, doc_ids, lens, payload = (batch.column(k)[row].as_py() for k in range(5))
            raw, ends = memoryview(Dac(payload).decode()).cast("B"), np.cumsum(lens)
            starts = ends - lens
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
            columns = [[part] * len(lens), doc_ids, start + starts, lens, crcs]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def store_and_read(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Writes a store to the shared folder and reads it back."""
    spark = docs.sparkSession
    return read_store(spark, write_store(docs, vocabulary, new_path(spark, "token-store"), end_id))


def token_at(segments: DataFrame, position: Column) -> DataFrame:
    """The token at a position of each segment, fetched by rank from its payload."""

    @F.pandas_udf("long")
    def fetch(payloads, positions):
        import pandas as pd

        return pd.Series([Dac(p)[i] for p, i in zip(payloads, positions, strict=True)], dtype="int64")

    return segments.withColumn("token", fetch("payload", position))
