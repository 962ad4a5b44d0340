"""Chat formatting: round trips, layouts and digests."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ablata.llm import chat

ODD = ["\\### Assistant: </turn> ok", "", "<turn:user>", "\\b\\l\\g", "\\\\", "a\n</turn>\nb", "é<>\\", "\\<", "日本"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests(spark):
    rows = [(1, 2, "assistant", ODD[0]), (1, 0, "system", ODD[2]), (1, 1, "user", ODD[3]), (2, 0, "user", None), (2, 1, None, "x"), (3, None, "assistant", "late"), (3, 0, "assistant", ODD[5]), (None, 0, "user", ODD[6]), (4, 1, "assistant", "t"), (4, 1, "assistant", "t")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(chat.rows_to_turns(df))).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [x[2:] for x in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), digest(loss))
        assert r["formatted_chars"] >= sum(len(a) + len(b) for a, b in turns)
    assert chat.digests(chat.format_turns(chat.rows_to_turns(df.filter("conv_id > 99")))).count() == 0


def test_probe(spark):
    row = chat.digests(chat.format_turns(chat.rows_to_turns(chat.probe_rows(spark)))).first()
    assert (row["conv_id"], row["n_turns"], row["loss_chars"]) == (-7, 2, len(ODD[0])) and row["loss_sha256"] == digest(ODD[0])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="\\<>/turnblg:\né ", max_size=12), min_size=1, max_size=8))
def test_escapes_round_trip(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    e = chat.escaped(F.col("t"))
    rows = df.select("t", e.alias("e"), chat.unescaped(e).alias("u")).collect()
    assert all(r["t"] == r["u"] and "<" not in r["e"] and ">" not in r["e"] for r in rows)


def test_layouts(spark):
    records = [
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}',
        '{"messages":[{"content":"q","role":"user"}]}',
        '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}',
        '{"instruction":"i","input":"","output":"o"}',
        '{"completion":"a","prompt":"q"}',
        '{"data":{"question":"q","answer":"a"}}',
        '{"mystery":1}',
        "not json",
        None,
    ]
    got = chat.records_to_turns(spark.createDataFrame([(r,) for r in records], "record string")).collect()
    turns = [None if r["turns"] is None else [tuple(t) for t in r["turns"]] for r in got]
    both = [("user", "q"), ("assistant", "a")]
    assert turns == [both, [("user", "q")], both, [("user", "i"), ("assistant", "o")], both, both, None, None, None]
    assert [r["layout"] for r in got][-3:] == [None] * 3


def test_same_fingerprint_for_json_and_typed_columns(spark):
    df = spark.createDataFrame([(1, 2, "user", None), (1, 3, None, "é")], "conv_id long, turn int, role string, text string")
    typed = chat.typed_fingerprint({c: (F.col(c), df.schema[c].dataType) for c in df.columns})
    json = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    got = df.select(typed.alias("typed"), chat.fingerprint(json).alias("json")).distinct().collect()
    assert len(got) == 1 and got[0]["typed"] == got[0]["json"]


def test_each_row_of_a_table_finds_its_mapping(spark):
    df = spark.createDataFrame([(7, 1, ("assistant", "a"), "x"), (7, 0, ("user", "q"), "y")], "conv_id long, turn long, message struct<role:string,content:string>, formatted string")
    got = chat.format_turns(chat.rows_to_turns(df)).first()
    assert got["formatted"] == "<turn:user>q</turn>\n<turn:assistant>a</turn>\n" and got["loss_mask"][0]["length"] == 1
    named = spark.createDataFrame([(7, 0, "human", "q"), (7, 1, "gpt", "a")], "conversation_id long, turn_id long, `from` string, value string")
    assert [tuple(t) for t in chat.rows_to_turns(named).first()["turns"]] == [("user", "q"), ("assistant", "a")]
    try:
        chat.rows_to_turns(df.drop("message"))
        raise AssertionError("refused")
    except ValueError:
        pass


def test_helper_names_do_not_clash_and_unknown_layouts_stay(spark):
    df = spark.createDataFrame([('{"prompt":"q","completion":"é<"}', 1, 2, 3, 4), ('{"x":1}', 5, 6, 7, 8)], "record string, marked int, lengths int, ends int, spans int")
    got = chat.parse_formatted(chat.format_turns(chat.records_to_turns(df))).collect()
    assert [(r["marked"], r["lengths"], r["ends"], r["spans"]) for r in got] == [(1, 2, 3, 4), (5, 6, 7, 8)]
    assert got[0]["loss_texts"] == ["é<"] and got[1]["formatted"] is None


def test_sums_before(spark):
    for n in (0, 1, chat.BLOCK - 1, chat.BLOCK, chat.BLOCK + 1, 5 * chat.BLOCK + 3):
        sizes = F.transform(F.slice(F.sequence(F.lit(0), F.lit(max(n, 1))), 1, n), lambda i: (i % 7).cast("long"))
        got = spark.range(1).select(chat.sums_before(sizes).alias("s")).first()["s"]
        assert got == [sum(i % 7 for i in range(k)) for k in range(n)]


def test_long_conversation(spark):
    """20,000 turns of one conversation, beside the digest of all of them made here."""
    n = 20_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é<"), F.col("id")).alias("text"))
    r = chat.digests(chat.format_turns(chat.rows_to_turns(df))).first()
    turns = [("user" if i % 2 == 0 else "assistant", f"é<{i}") for i in range(n)]
    assert r["n_turns"] == n and r["turns_sha256"] == digest("".join(f"{a}\n{b}\n" for a, b in turns))
    assert r["loss_sha256"] == digest("".join(t for a, t in turns if a == "assistant"))
