"""Every registered query of the subpackage: its columns, its rows, and its SQL twin if it has one."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ablata.llm import queries

COLUMNS = {
    "op1_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op2_token_store": "doc_id start n_tokens ids_crc32",
    "op3_decontamination": "doc_id item_id n_matched n_windows",
    "op4_mixing": "doc_id size source_size target taken",
    "op5_main_text": "page_id url text n_chars",
    "op6_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op7_language": "doc_id held_out lang_pred score",
    "op8_simhash": "doc_id fingerprint component_id",
    "op9_private_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op10_chat_formatting": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op11_passage_quality": "doc_id held_out score predicted",
    "op12_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op13_source_divergence": "lang source part item value rank",
}


def test_registered():
    assert set(COLUMNS) | {"mix_targets", "quality_base"} == set(queries.QUERIES) and set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_rows(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    named = COLUMNS[name].split()
    assert df.columns[: len(named)] == named
    rows = df.collect()
    key = named[0]
    source = {"page_id": "pages", "conv_id": "conversations"}.get(key, "documents")
    ids = set() if key == "lang" else {r[0] for r in spark.read.parquet(f"{sf_dir}/{source}.parquet").select(key).collect()}
    if name == "op13_source_divergence":
        assert {r["lang"] for r in rows} == {r[0] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang").collect()}
    elif name == "op3_decontamination":
        assert {r[key] for r in rows} <= ids
    else:
        assert {r[key] for r in rows} == ids | ({-7} if key == "conv_id" else set())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twins(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(result.fetchall())
