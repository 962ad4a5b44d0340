"""Chat formatting by schema fingerprints. DataFrame functions only.

A record's nested field paths (``messages[].role`` and so on; value types are left out) are hashed, and the hash selects a declarative
mapping to canonical turns (role, text). ``LAYOUTS`` names the known layouts by an example record, from which the fingerprint is
computed; more are added by passing them in. Records are JSON strings (``records_to_turns``) or the typed columns of a table
(``rows_to_turns``, for layouts with a row per turn): both kinds of record go through the same fingerprint, row by row. Typed values are
replaced by null before they are fingerprinted, so long texts are not copied. Columns that a layout doesn't name don't matter to it.

The template writes ``<turn:ROLE>TEXT</turn>`` and a newline for each turn. ``<``, ``>`` and the backslash inside roles and texts
become backslash sequences without those characters, so a mark in the output is always the template's own and the texts come back
exactly. The loss mask is a list of (start, length) in bytes of the formatted text's UTF-8 form that covers each assistant text; bytes,
because a piece of a byte string is found at once, while the n-th code point is found by counting.

Work is in proportion to a conversation's length, but for ordering its turns. A conversation is one string, so 2 GB is its limit.

Null texts and roles are empty; turns are ordered by turn, then role and text (null turns first); repeated rows are turns of their
own; rows with a null conv_id form one conversation; an empty table gives no rows; a record with an unknown layout keeps a row
with null turns and its fingerprint, to be reported; a table that no layout fits is refused. No helper columns are added, so
other columns may have any name but those of the results.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role string, text string>>"
LEARNED_ROLE = "assistant"
CLOSE = "</turn>\n"
#: Prefix sums are taken within blocks of so many turns and over the blocks.
BLOCK = 256


@dataclass(frozen=True)
class Layout:
    """A layout: an example record (JSON), and either the turn list's path with its field names, or (role, path) of single texts."""

    name: str
    example: str
    list_path: str | None = None
    role_field: str = ""
    text_field: str = ""
    singles: tuple[tuple[str, str], ...] = ()
    #: Names of roles that differ from the canonical ones.
    roles: tuple[tuple[str, str], ...] = ()
    #: For layouts with a record per turn: the paths of the conversation's id and of the turn's place in it.
    id_path: str | None = None
    order_path: str | None = None

    def paths(self) -> set[str]:
        """The nested field paths of the example."""

        def under(value: object, at: str) -> set[str]:
            if isinstance(value, dict):
                return set().union(*(under(v, f"{at}.{k}") for k, v in value.items()))
            return under(value[0], f"{at}[]") if isinstance(value, list) else {at}

        return under(json.loads(self.example), "$")

    def columns(self) -> list[str]:
        """The example's outermost fields."""
        return sorted(json.loads(self.example))


LAYOUTS = (
    Layout("messages", '{"messages":[{"role":"user","content":"x"}]}', "$.messages", "role", "content"),
    Layout("conversations", '{"conversations":[{"from":"human","value":"x"}]}', "$.conversations", "from", "value", roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("turns", '{"turns":[{"role":"user","text":"x"}]}', "$.turns", "role", "text"),
    Layout("instruction", '{"instruction":"x","input":"x","output":"x"}', singles=(("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Layout("instruction_only", '{"instruction":"x","output":"x"}', singles=(("user", "$.instruction"), ("assistant", "$.output"))),
    Layout("prompt", '{"prompt":"x","completion":"x"}', singles=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("prompt_response", '{"system":"x","prompt":"x","response":"x"}', singles=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("nested", '{"data":{"question":"x","answer":"x"}}', singles=(("user", "$.data.question"), ("assistant", "$.data.answer"))),
)
#: Layouts of tables with a row per turn.
ROW_LAYOUTS = (
    Layout("turn_rows", '{"conv_id":1,"turn":1,"role":"x","text":"x"}', role_field="$.role", text_field="$.text", id_path="$.conv_id", order_path="$.turn"),
    Layout("reply_rows", '{"conversation_id":1,"turn_id":1,"from":"x","value":"x"}', role_field="$.from", text_field="$.value", roles=(("human", "user"), ("gpt", "assistant")), id_path="$.conversation_id", order_path="$.turn_id"),
    Layout("thread_rows", '{"thread":1,"position":1,"author":"x","content":"x"}', role_field="$.author", text_field="$.content", id_path="$.thread", order_path="$.position"),
    Layout("message_rows", '{"conv_id":1,"turn":1,"message":{"role":"x","content":"x"}}', role_field="$.message.role", text_field="$.message.content", id_path="$.conv_id", order_path="$.turn"),
)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def fingerprint(record: Column) -> Column:
    """The hash of a JSON record's nested field paths; null if it isn't JSON."""
    return _paths_hash(F.try_parse_json(record))


def _paths_hash(record: Column) -> Column:
    # Scalar kinds go, so that null and string, or whole and decimal, values give the same paths.
    return F.sha2(F.regexp_replace(F.schema_of_variant(record), r":\s*(?!OBJECT|ARRAY)[A-Z]+(\([0-9, ]*\))?", ":"), 256)


def typed_fingerprint(columns: dict[str, tuple[Column, T.DataType]]) -> Column:
    """The hash of the nested field paths of a record made of typed columns; the same as that of its JSON form."""

    def shape(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.when(value.isNotNull(), F.struct(*(shape(value[f.name], f.dataType).alias(f.name) for f in kind)))
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: shape(x, kind.elementType))
        return F.lit(None).cast("string")

    return _paths_hash(F.to_variant_object(F.struct(*(shape(c, kind).alias(name) for name, (c, kind) in columns.items()))))


def _typed_paths(schema: T.StructType) -> set[str]:
    def under(kind: T.DataType, at: str) -> set[str]:
        if isinstance(kind, T.StructType):
            return set().union(*(under(f.dataType, f"{at}.{f.name}") for f in kind))
        return under(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else {at}

    return under(schema, "$")


def _known(spark: SparkSession, layouts: tuple[Layout, ...]) -> dict[str, str]:
    return spark.range(1).select(*(fingerprint(F.lit(x.example)).alias(x.name) for x in layouts)).first().asDict()


def _renamed(role: Column, x: Layout) -> Column:
    for old, new in x.roles:
        role = F.when(role == old, F.lit(new)).otherwise(role)
    return F.coalesce(role, F.lit(""))


def escaped(text: Column) -> Column:
    """The text without any ``<``, ``>`` or bare backslash."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescaped(text: Column) -> Column:
    """Undoes ``escaped``: every backslash in it is followed by one of the three letters."""
    text = F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def records_to_turns(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """JSON records of mixed layouts with their ``layout``, ``schema_fingerprint`` and canonical ``turns``."""
    own = F.col("schema_fingerprint")
    known = _known(records.sparkSession, layouts)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in layouts:
        layout = F.when(own == known[x.name], F.lit(x.name)).otherwise(layout)
        turns = F.when(own == known[x.name], _mapped(F.col(record_col), x)).otherwise(turns)
    marked = records.withColumn("schema_fingerprint", fingerprint(F.col(record_col)))
    return marked.withColumn("layout", layout).withColumn("turns", turns)


def _mapped(record: Column, x: Layout) -> Column:
    if x.list_path is None:
        found = F.array(*(F.struct(F.lit(role).alias("role"), F.get_json_object(record, path).alias("text")) for role, path in x.singles))
        return F.filter(found, lambda t: t["text"].isNotNull() & (t["text"] != "")).cast(TURNS)
    items = F.from_json(F.get_json_object(record, x.list_path), f"array<struct<`{x.role_field}` string, `{x.text_field}` string>>")
    return F.transform(items, lambda t: F.struct(_renamed(t[x.role_field], x).alias("role"), F.coalesce(t[x.text_field], F.lit("")).alias("text"))).cast(TURNS)


def rows_to_turns(rows: DataFrame, layouts: tuple[Layout, ...] = ROW_LAYOUTS) -> DataFrame:
    """A table with a row per turn to (conv_id, turns). Each row's own fingerprint selects its mapping; of several, the first."""
    fitting = [x for x in layouts if x.paths() <= _typed_paths(rows.schema)]
    if not fitting:
        raise ValueError(f"no layout fits the columns {rows.columns}")
    known = _known(rows.sparkSession, tuple(fitting))
    at = lambda path: F.col(".".join(f"`{name}`" for name in path.split(".")[1:]))
    part = F.raise_error(F.lit("a row has no known layout"))
    for x in reversed(fitting):
        own = typed_fingerprint({c: (F.col(f"`{c}`"), rows.schema[c].dataType) for c in x.columns()})
        mapped = F.struct(at(x.id_path).alias("conv_id"), at(x.order_path).alias("turn"), _renamed(at(x.role_field).cast("string"), x).alias("role"), F.coalesce(at(x.text_field).cast("string"), F.lit("")).alias("text"))
        part = F.when(own == known[x.name], mapped).otherwise(part)
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    turns = F.transform(ordered, lambda t: F.struct(t["role"], t["text"])).cast(TURNS)
    return rows.select(part.alias("part")).select("part.*").groupBy("conv_id").agg(turns.alias("turns"))


def sums_before(sizes: Column) -> Column:
    """For each entry of an array the sum of those before it. Each step of ``aggregate`` copies what it has gathered, hence blocks."""
    grown = lambda parts, start: F.aggregate(parts, F.array(start), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    zero = F.lit(0).cast("long")
    last = F.floor((F.size(sizes) - 1) / BLOCK).cast("int")
    blocks = F.when(F.size(sizes) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(sizes, b * BLOCK + 1, BLOCK)))

    def summed(parts: Column) -> Column:
        starts = grown(F.transform(parts, lambda p: F.aggregate(p, zero, lambda acc, n: acc + n)), zero)
        return bound(starts, lambda s: F.flatten(F.transform(parts, lambda p, i: bound(grown(p, F.get(s, i)), lambda g: F.slice(g, 1, F.size(p))))))

    return F.when(F.size(sizes) > 0, bound(blocks, summed)).otherwise(F.array().cast("array<bigint>"))


def format_turns(conversations: DataFrame) -> DataFrame:
    """(…, turns) with ``formatted`` and ``loss_mask`` in place of turns."""

    def written(t: Column) -> Column:
        return F.struct((t["role"] == LEARNED_ROLE).alias("learned"), F.concat(F.lit("<turn:"), escaped(t["role"]), F.lit(">")).alias("open"), escaped(t["text"]).alias("body"))

    def masked(marked: Column) -> Column:
        sizes = F.transform(marked, lambda t: (F.octet_length(t["open"]) + F.octet_length(t["body"]) + len(CLOSE)).cast("long"))
        span = lambda start, t: F.when(t["learned"], F.struct((start + F.octet_length(t["open"])).alias("start"), F.octet_length(t["body"]).cast("long").alias("length")))
        spans = bound(sizes, lambda s: F.zip_with(sums_before(s), marked, span))
        text = F.array_join(F.transform(marked, lambda t: F.concat(t["open"], t["body"], F.lit(CLOSE))), "")
        return F.struct(F.filter(spans, lambda x: x.isNotNull()).alias("loss_mask"), text.alias("formatted"))

    others = [f"`{c}`" for c in conversations.columns if c not in ("turns", "formatted", "loss_mask")]
    done = bound(F.transform("turns", written), masked)
    return conversations.select(*others, F.struct(done.alias("done"), F.lit(0)).alias("turns")).select(*others, "turns.done.*")


def parse_formatted(formatted: DataFrame) -> DataFrame:
    """``turns`` and ``loss_texts`` read back from ``formatted`` and ``loss_mask``."""
    pieces = F.filter(F.split("formatted", CLOSE), lambda p: p != "")
    turn = lambda p: F.struct(unescaped(F.substring_index(F.substring(p, 7, 1 << 30), ">", 1)).alias("role"), unescaped(F.substring_index(p, ">", -1)).alias("text"))
    under = lambda whole: F.transform("loss_mask", lambda m: unescaped(F.substring(whole, (m["start"] + 1).cast("int"), m["length"].cast("int")).cast("string")))
    return formatted.withColumn("turns", F.transform(pieces, turn).cast(TURNS)).withColumn("loss_texts", bound(F.col("formatted").cast("binary"), under))


def digests(formatted: DataFrame) -> DataFrame:
    """The digest columns of conversations, all from the formatted output."""
    back = parse_formatted(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def probe_rows(spark: SparkSession) -> DataFrame:
    """A conversation, numbered -7, that says control strings."""
    said = "\\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
