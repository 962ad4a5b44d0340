"""Token counts and the token store against the library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ablata.llm import token_counts, token_store, word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
WHOLE = word_bpe.whole_tokens(PATH)
ODD = ["", " ", "it's WE'LL don't ''s !'s x's'tt", "<|endoftext|> a <|startoftext|>", "ΑΣ İstanbul é", "x\u0085y \x1c z\xa0w", "½²³ªº µ ÿ Ÿ ſ", "a" * 3000, "!?" * 2000, "\x00\x01 tab\tnl\n", "日本語 text", "ÀÉÎ naïve", "12.5kg"]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_whole_tokens_are_proved():
    for piece in sorted(WHOLE)[::97]:
        assert len(ids_of(piece.decode("latin-1"))) == 1


def check(texts):
    for text, raw in zip(texts, token_store.encode_texts(texts, PATH), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == ids_of(text)
        assert token_counts.count_text(text, PATH, WHOLE) == len(ids_of(text))


def test_odd_texts():
    check([*ODD, None])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x2FF), max_size=60), max_size=4))
def test_any_text(texts):
    check(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500))
def test_dac_round_trip(ids):
    dac = token_store.Dac(token_store.dac_encode(np.array(ids, "<u4")))
    assert dac.decode().tolist() == ids and len(dac) == len(ids)
    assert [dac[i] for i in range(0, len(ids), 7)] == ids[::7]
    with pytest.raises(IndexError):
        dac[len(ids)]


DOCS = [(5, "b a", "x"), (1, None, "x"), (3, "", "x"), (5, "a b", "x"), (None, "null id", "x"), (2, "word " * 4000, "x"), (7, ODD[4], None)]


def test_counts(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, n_tokens string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, PATH).collect())
    assert got == sorted((d or 0, len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 2048) for d, t, _ in DOCS)


def test_store(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, start string").repartition(3)
    path = token_store.write_store(docs, PATH, str(tmp_path / "store"))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_store.read_store(spark, path).collect())
    at, want = 0, []
    for d, t, _ in sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*ids_of(t), 2], "<u4")
        want.append((at, d, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    segments = spark.read.parquet(path).orderBy("part", "seg")
    first = token_store.token_at(segments, segments.n_ids - 1).collect()
    assert all(r["token"] == 2 for r in first)


def test_empty_store(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.read_store(spark, token_store.write_store(docs, PATH, str(tmp_path / "e"))).count() == 0
    assert token_counts.count_tokens(docs, PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab cd\n\t'sX.,!?1é“”’—…œŒ™日本Ως́̈\u00a0\u2009\u3000\u200bİ🙂ffiÅ"), max_size=80), max_size=4))
def test_texts_of_several_scripts(texts):
    check([*texts, *(f"plain words around it {t} and behind it" for t in texts)])


def test_one_odd_character_leaves_the_rest_to_the_shortcut():
    text = "it’s a plain text, with one dash — and “quotes” " + "of many plain words " * 50
    pieces = word_bpe.splitter(PATH).split(text)
    assert sum(isinstance(p, str) for p in pieces) == 3 and sum(isinstance(p, bytes) for p in pieces) > 200
    assert word_bpe.splitter(PATH).split("Привет мир и все") is None
    check([text, "Привет мир и все", "漢字かな交じり文 " * 30, "😀" * 500])


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_runs_of_texts(size, monkeypatch):
    from ablata.llm.common import runs

    texts = ["a" * n for n in (0, 5, 50, 3, 500, 0)] + [None]
    found = list(runs(texts, size))
    assert [t for run in found for t in run] == texts and all(found)


def test_rows_without_an_id_are_spread(spark, tmp_path):
    """4,000 texts without an id, and as many of one id: several parts, and every document once."""
    docs = spark.createDataFrame([(None if i % 2 else 7, f"text number {i}", "x") for i in range(8000)], "doc_id long, text string, _hash string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart
    try:
        path = token_store.write_store(docs, PATH, f"{tmp_path}/store")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in spark.read.parquet(path).selectExpr("part", "size(doc_ids) n").groupBy("part").agg({"n": "sum"}).withColumnRenamed("sum(n)", "count").collect()]
    assert len(sizes) >= 3 and max(sizes) < 4000 and sum(sizes) == 8000
    rows = token_store.read_store(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None] * 4000 + [7] * 4000
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert sorted(r["ids_crc32"] for r in rows) == sorted(zlib.crc32(np.array([*ids_of(f"text number {i}"), 2], "<u4").tobytes()) for i in range(8000))
