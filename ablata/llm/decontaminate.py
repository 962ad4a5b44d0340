"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

Numbers, names and the units after numbers become typed placeholders; what stood there is kept as slot values. A template window is
``WINDOW`` successive template tokens, of which at least ``MIN_LITERALS`` are words; a shorter item is one window. Items with the same
template, whose slots repeat in the same way, are one class: the class stands for them with the windows of its least item.

A document is reported with an item if it holds at least ``MIN_COVERAGE`` of the item's distinct windows, and its slots are consistent. A
preamble that many items share says nothing about any of them: of the item's own windows, those that at most half as many classes have as
its most shared one, ``MIN_COVERAGE`` must be there, too, and with windows weighed by one over the number of their classes, ``MIN_WEIGHT`` of
the item's weight. An item whose windows are all as shared as each other is judged by all of them. For slots, over the matched windows, an item's slot value goes with one document value and the other way round, for at least half of the pairs
seen. So a question with other numbers or names is caught, while phrases of the same shape with slots that don't go together are not.
Consistency and coverage are taken over all matched windows, and also over each alignment (a text and a distance between item and
document position), so that an item that repeats its own template, or a document with several variants of one, is judged occurrence by
occurrence. And enough windows with slot values that some item of the class has in that window are always reported. n_slots and
consistency are of all matched windows or, where these are not consistent, of the most consistent alignment with enough windows, if there is one.

A capitalised word inside a sentence is a name. One that begins a text, sentence, line or quotation may be a name or any word: windows
with such words are hashed in both readings, all as words and all as names, and match if any reading does. In a text without any
capitalised word, each word may be a name: its windows are also hashed with each one of their words as an open place, and meet windows
of items that have their only name in that place. Counted are the windows
of the first reading; equal words in such places are no slots. Digits and letters are separate tokens also where nothing stands between.

An item of fewer than ``WINDOW`` tokens is found in a text of just as many tokens, and with ``short_inside`` anywhere in a text: documents
then have windows of each such width that occurs among the items, too. An item without a window, as it has fewer than ``MIN_LITERALS``
words in any five tokens ("12 + 37 = ?"), is found where it stands word for word, signs included: all its windows of up to ``WINDOW`` words,
numbers and signs must be there; one of less than ``MIN_EXACT`` of these is found only in a text that holds no others.

One scan finds the document windows that may be in an item, by a bitmap of bounded size, and only these are kept. A document with enough of
a class's weight has one of its rarest windows, those that make up the share it may lack, so only these are looked up first; what that
finds is then compared with all windows of the class. A window that a million items share thus makes no pairs by itself. Where an item
repeats a window, its first place stands for all, so that repeats on both sides are not multiplied. Beyond ``MOST_WORDS`` the bitmap fills
up and more windows pass it, which costs time and changes no result. The item side is broadcast
up to ``BLOCK_WINDOWS`` windows, beyond that joined by shuffles with ``SALTS`` copies, so a frequent window is split.

Null and empty texts hold nothing and match nothing. Rows with the same doc_id count as one document, each row with a null doc_id as one
of its own, reported as null. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WINDOW, MIN_LITERALS, MIN_COVERAGE, MIN_CONSISTENT, MIN_EXACT = 5, 2, 0.5, 0.5, 3
MIN_WEIGHT = 0.15
#: What sums of weights may be off by.
_SLACK = 1e-9
BLOCK_WINDOWS, SALTS = 1 << 18, 16
#: Bits of the filter for each benchmark window, up to ``MOST_WORDS`` words of 64 bits.
BITS_A_WINDOW, MOST_WORDS = 64, 1 << 19
_NAME = "\u0001"
#: Before a capitalised word that begins a text, sentence, line or quotation.
_START = "\u0002"
#: Units that are a slot when they follow a number.
UNITS = ("mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "foot", "yd", "yard", "yards", "mile", "miles", "mg", "g", "kg", "lb", "lbs", "oz", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollar", "dollars", "euro", "euros", "cent", "cents", "degree", "degrees", "mph", "kmh", "hz", "khz", "mhz", "ghz", "w", "kw", "v", "j", "n", "k", "pa", "mol")


def template_tokens(text: Column) -> Column:
    """Tokens in order, in lower case: numbers, and words, where names and words that may be names have a mark before them."""
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(_NAME), F.lit(" ")), F.lit(_START), F.lit(" "))
    # A name is a capitalised word inside a sentence: after a letter, digit or comma and one space.
    named = F.regexp_replace(plain, r"\p{Lu}(?<=[\p{L}\p{N},;] \p{Lu})\p{Ll}+", f"{_NAME}$0")
    marked = F.regexp_replace(named, rf"\p{{Lu}}(?<![\p{{L}}{_NAME}]\p{{Lu}})\p{{Ll}}+", f"{_START}$0")
    return F.regexp_extract_all(F.lower(marked), F.lit(rf"[0-9]+(?:[.,][0-9]+)*|[{_NAME}{_START}]?[\p{{L}}\p{{N}}&&[^0-9]]+"), F.lit(0))


def _kind(tokens: str, token: Column, i: Column) -> Column:
    """A slot's kind, or null for a word."""
    number = lambda t: (t >= "0") & (t < ":")
    unit = (i > 0) & number(F.get(tokens, i - 1)) & token.isin(*UNITS)
    return F.when(token.startswith(_NAME), "name").when(number(token), "number").when(unit, "unit")


def exact_tokens(text: Column) -> Column:
    """Words, numbers and signs in order, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{N}&&[^0-9]]+|[^\s\p{L}\p{N}]"), F.lit(0))


def _hashed(rows: DataFrame, id_col: str, text_col: str, short: tuple[int, ...] = (), exact: tuple[int, ...] = (), holes: bool = True, item_side: bool = False) -> DataFrame:
    """(id, row, m, v, k, width, wh, mh, ...): a hash of the text, marked tokens, slot values by token (null for words; the array is null if there
    are no slots), hashes of the template tokens, the window hashes, and (at, h, hole) of the windows with words that may be names, as names: those that
    begin a sentence where hole is -1, else the one at hole, on the item side the window's only name. wh and mh are followed by those of each width of ``short``, for longer texts,
    and by e and the exact window hashes of each width of ``exact``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spelled = [exact_tokens(text).alias("e")] if exact else []
    tokens = rows.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), template_tokens(text).alias("m"), text.rlike(r"[0-9]").alias("digits"), (~text.rlike(r"\p{Lu}\p{Ll}")).alias("plain"), *spelled)
    maybe = lambda t: t.startswith(_START)
    plain = tokens.withColumn("t", F.transform("m", lambda t: F.when(maybe(t), F.substring(t, 2, 1 << 30)).otherwise(t)))
    sloted = plain.withColumn("any", F.col("digits") | F.exists("t", lambda t: t.startswith(_NAME)))
    words = F.transform("t", lambda t: F.xxhash64(t))
    kinds = F.transform("t", lambda t, i: F.when(_kind("t", t, i).isNotNull(), F.xxhash64(F.lit(_NAME), _kind("t", t, i))).otherwise(F.xxhash64(t)))
    values = F.transform("t", lambda t, i: F.when(_kind("t", t, i).isNotNull(), t))
    kept = ["id", "row", "m", "plain", *(["e"] if exact else [])]
    keyed = sloted.select(*kept, F.when(F.col("any"), kinds).otherwise(words).alias("k"), F.when(F.col("any"), values).alias("v"), F.least(F.size("t"), F.lit(WINDOW)).alias("width"))
    name = F.xxhash64(F.lit(_NAME), F.lit("name"))
    renamed = keyed.select(
        *kept, "k", "v", "width",
        F.filter(F.transform("m", lambda t, i: F.when(maybe(t), i)), lambda i: i.isNotNull()).alias("places"),
        F.transform("m", lambda t, i: F.when(maybe(t), name).otherwise(F.get("k", i))).alias("mk"),
    )

    def both(label: str, width: Column, fits: Column, holes: bool) -> list[Column]:
        last = F.size("k") - width
        starts = F.when(fits, F.sequence(F.lit(0), last))
        end = F.size("mk") - width  # a second use, or the optimiser moves mk into the lambda below
        around = F.flatten(F.transform("places", lambda i: F.sequence(F.greatest(i - width + 1, F.lit(0)), F.least(i, end))))
        first = F.transform(starts, lambda i: F.xxhash64(F.slice("k", i + 1, width)))
        other = F.transform(F.when(fits, F.array_distinct(around)), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("mk", i + 1, width)).alias("h"), F.lit(-1).alias("hole")))
        if holes:
            named = lambda x: F.coalesce(x.startswith(_NAME), F.lit(False))
            if item_side:
                only = lambda i: F.size(F.filter(F.slice("v", i + 1, width), named)) == 1
                open_at = lambda i, j: named(F.get("v", i + j)) & only(i)
            else:
                open_at = lambda i, j: F.get("v", i + j).isNull()
            holed = lambda i, j: F.xxhash64(F.lit("hole"), F.concat(F.slice("k", i + 1, j), F.array(name), F.slice("k", i + j + 2, width - 1 - j)))
            each = lambda i: F.transform(F.filter(F.sequence(F.lit(0), width - 1), lambda j: open_at(i, j)), lambda j: F.struct(i.alias("at"), holed(i, j).alias("h"), j.alias("hole")))
            some = F.flatten(F.transform(starts, each))
            # Documents with capitalised words have no such windows, those without have no others.
            other = F.concat(other, some) if item_side else F.when(F.col("plain"), some).otherwise(other)
        return [first.alias(f"wh{label}"), other.alias(f"mh{label}")]

    found = both("", F.col("width"), F.col("width") >= MIN_LITERALS, holes)
    for n in short:
        found += both(str(n), F.lit(n), F.col("width") > n, False)
    for n in exact:
        fits = F.size("e") >= n if n >= MIN_EXACT else F.size("e") == n
        places = F.when(fits, F.sequence(F.lit(0), F.size("e") - n))
        found.append(F.transform(places, lambda i: F.xxhash64(F.lit("exact"), F.slice("e", i + 1, n))).alias(f"eh{n}"))  # noqa: B023
    return renamed.select("id", "row", "m", "v", "k", "width", *(["e"] if exact else []), *found)


_WINDOW = "array<struct<at:int,width:int,h:bigint,base:bigint,hole:int,slots:array<string>>>"


def _listed(hashed: DataFrame, wanted, short: tuple[int, ...] = (), exact: tuple[int, ...] = ()) -> DataFrame:
    """(id, row, at, width, h, base, hole, slots): the windows whose hash is ``wanted`` in any reading; slots are the values in the window,
    null where a word stands, and base is the hash of the first reading. Exact windows have no slots."""
    window = lambda at, width, h, base, hole, slots: F.struct(at.alias("at"), width.alias("width"), h.alias("h"), base.alias("base"), hole.alias("hole"), slots.alias("slots"))

    def both(label: str, width: Column) -> list[Column]:
        mark = lambda t, j, hole: F.when(t.startswith(_START), t).when((j == hole) & ~t.startswith(_NAME), F.concat(F.lit(_START), t))
        marked = lambda w: F.transform(F.slice("m", w["at"] + 1, width), lambda t, j: mark(t, j, w["hole"]).otherwise(F.get("v", w["at"] + j)))
        first = F.transform(f"wh{label}", lambda h, i: F.when(wanted(h), window(i, width, h, h, F.lit(-1), F.slice("v", i + 1, width))))
        other = F.transform(f"mh{label}", lambda w: F.when(wanted(w["h"]), window(w["at"], width, w["h"], F.get(f"wh{label}", w["at"]), w["hole"], marked(w))))
        return [first, other]

    held = both("", F.col("width"))
    for n in short:
        held += both(str(n), F.lit(n))
    for n in exact:
        held.append(F.transform(f"eh{n}", lambda h, i: F.when(wanted(h), window(i, F.lit(n), h, h, F.lit(-1), F.lit(None).cast("array<string>")))))  # noqa: B023
    held = [F.coalesce(F.filter(x, lambda w: w.isNotNull()), F.array()).cast(_WINDOW) for x in held]
    rows = hashed.select("id", "row", F.explode(F.concat(*held)).alias("w")).select("id", "row", "w.*")
    words = F.size(F.filter("slots", lambda v: v.isNull()))
    return rows.filter(F.col("slots").isNull() | (words >= MIN_LITERALS))


def _own_values(slots: Column) -> Column:
    """A hash of a window's slot values."""
    return F.xxhash64(F.transform(F.filter(F.coalesce(slots, F.array()), lambda v: v.isNotNull()), lambda v: F.translate(v, _START, _NAME)))


def _classed(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, text, class, exact): items that have a window or, if exact, at least one word, number or sign."""
    hashed = _hashed(benchmark.select(F.struct(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).alias("item"), F.col(text_col).alias("text")), "item", "text", exact=(1,))
    literal = lambda i: F.size(F.filter(F.slice("v", i + 1, F.col("width")), lambda v: v.isNull())) >= MIN_LITERALS
    worded = (F.col("width") >= MIN_LITERALS) & (F.col("v").isNull() | F.exists(F.sequence(F.lit(0), F.greatest(F.size("v") - F.col("width"), F.lit(0))), literal))
    # Which slots have equal values, and which words may be names.
    repeats = F.transform(F.coalesce("v", F.array().cast("array<string>")), lambda x: F.when(x.isNotNull(), F.array_position("v", x)))
    marks = F.transform("m", lambda t: t.startswith(_START))
    own = F.when(worded, F.xxhash64("k", repeats, marks)).otherwise(F.xxhash64(F.lit("exact"), "e"))
    return hashed.filter(worded | (F.size("e") > 0)).select("id.item_id", "id.text", own.alias("class"), (~worded).alias("exact"))


def item_classes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, class_item_id): each item with the least one of its class, under which ``found_classes`` reports it."""
    items = _classed(benchmark, id_col, text_col)
    least = items.groupBy("class").agg(F.min("item_id").alias("class_item_id"))
    return items.join(least, "class").select("item_id", "class_item_id", "class")


def _bit_filter(side: DataFrame, n: int):
    """A test that every hash of ``side`` passes, from a bitmap of ``BITS_A_WINDOW`` bits for each of its n windows as far as it may have them.

    Each hash has two bits in it, so that few others pass."""
    size = min(MOST_WORDS, 1 << max(6, (n * BITS_A_WINDOW // 64).bit_length()))
    word = lambda h, k: F.pmod(F.shiftright(h, 6 + 24 * k), F.lit(size)).cast("int")
    bit = lambda h, k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 58 * k), F.lit(64)).cast("int"))
    own = F.explode(F.array(*(F.struct(word(F.col("h"), k).alias("word"), bit(F.col("h"), k).alias("bits")) for k in (0, 1))))
    held = [0] * size
    for row in side.select(own.alias("x")).groupBy("x.word").agg(F.bit_or("x.bits").alias("bits")).collect():  # MOST_WORDS rows at most
        held[row["word"]] = row["bits"]
    bitmap = F.split(F.lit(",".join(map(str, held))), ",").cast("array<bigint>")  # folded into one constant
    has = lambda h, k: F.element_at(bitmap, word(h, k) + 1).bitwiseAND(bit(h, k)) != 0
    return lambda h: has(h, 0) & has(h, 1)


def _class_windows(items: DataFrame) -> DataFrame:
    """One row per distinct window of each class and reading of it: class, item_id, n_items, item_at (the first), width, h, base, hole, item_slots, weight,
    own, n_windows, needed, needed_own, needed_weight, lead (is among the rarest that must be looked up)."""
    least = F.min(F.struct(F.col("item_id").isNull().alias("no_id"), F.col("item_id"), F.col("text"))).alias("rep")
    classes = items.groupBy("class", "exact").agg(least, F.count("*").alias("n_items")).select("class", "exact", "rep.item_id", "rep.text", "n_items")
    template = _listed(_hashed(classes.filter("not exact"), "class", "text", item_side=True), lambda h: F.lit(True))
    spelled = classes.filter("exact").select(F.col("class").alias("id"), F.lit(0).cast("long").alias("row"), exact_tokens(F.col("text")).alias("e"))
    spelled = spelled.withColumn("width", F.least(F.size("e"), F.lit(WINDOW)))
    h = lambda i: F.xxhash64(F.lit("exact"), F.slice("e", i + 1, F.col("width")))
    each = F.transform(F.sequence(F.lit(0), F.size("e") - F.col("width")), lambda i: F.struct(i.alias("at"), F.col("width").alias("width"), h(i).alias("h"), h(i).alias("base"), F.lit(-1).alias("hole"), F.lit(None).cast("array<string>").alias("slots")))
    listed = template.unionByName(spelled.select("id", "row", F.explode(each).alias("w")).select("id", "row", "w.*"))
    bases = listed.select(F.col("id").alias("class"), "base").distinct().join(classes.select("class", "exact"), "class")
    frequency = bases.groupBy("base").agg(F.count("*").alias("classes"))
    of_class = Window.partitionBy("class")
    weighed = bases.join(frequency, "base").withColumn("weight", F.when(F.col("exact"), F.lit(1.0)).otherwise(1 / F.col("classes")))
    weighed = weighed.withColumn("own", ~F.col("exact") & (2 * F.col("classes") <= F.max("classes").over(of_class)))
    rarest = of_class.orderBy("classes", "base")
    ranked = weighed.withColumn("rank", F.row_number().over(rarest)).withColumn("rarer", F.sum("weight").over(rarest.rowsBetween(Window.unboundedPreceding, -1)))
    totals = weighed.groupBy("class").agg(F.count("*").alias("n_windows"), F.count_if("own").alias("n_own"), F.sum("weight").alias("total"))
    # An exact item needs all of its windows.
    share = lambda n, of: F.when(F.col("exact"), F.col(n)).otherwise(F.ceil(of * F.col(n)).cast("long"))
    named = classes.drop("text").join(totals, "class").withColumn("needed", share("n_windows", MIN_COVERAGE)).withColumn("needed_own", share("n_own", MIN_COVERAGE))
    named = named.withColumn("needed_weight", F.when(F.col("exact"), F.col("total")).otherwise(MIN_WEIGHT * F.col("total")))
    # Each rule may lack some windows, and finds one among the rarest that are more.
    by_number = F.col("rank") <= F.col("n_windows") - F.col("needed") + 1
    by_own = (F.col("n_own") == 0) | (F.col("rank") <= F.col("n_own") - F.col("needed_own") + 1)
    by_weight = F.coalesce("rarer", F.lit(0.0)) <= F.col("total") - F.col("needed_weight") + _SLACK
    lead = ranked.select("class", "base", "weight", "own", "rank", "rarer").join(named, "class").withColumn("lead", by_number & by_own & by_weight)
    wide = listed.select(F.col("id").alias("class"), F.col("at").alias("item_at"), "width", "h", "base", "hole", F.col("slots").alias("item_slots"))
    first = wide.groupBy("class", "width", "h", "base").agg(F.min(F.struct("item_at", "hole", "item_slots")).alias("first")).select("class", "width", "h", "base", "first.*")
    return first.join(lead.drop("rank", "rarer", "total", "n_own"), ["class", "base"])


def _met(large: DataFrame, small: DataFrame, keys: list[str], n: int, how: str = "inner") -> DataFrame:
    """A join with an item side of n windows: broadcast if these are few, else by shuffles in which each key is split into ``SALTS``."""
    if n <= BLOCK_WINDOWS:
        return large.join(F.broadcast(small), keys, how)
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return large.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], how).drop("salt")


def found_classes(docs: DataFrame, benchmark: DataFrame, short_inside: bool = False) -> DataFrame:
    """One row per document and class of items: doc_id, item_id (the class's least), n_matched, n_windows (of the item), n_slots, consistency,
    same_slots (in all matched windows the values are those of some item of the class), n_items (of the class), class."""
    items = cut(_classed(benchmark, "item_id", "text"))
    side = cut(_class_windows(items))
    kinds = side.groupBy("exact", "width").agg(F.count("*").alias("n"), F.max("hole").alias("hole")).collect()
    by_width, holes = {(r["exact"], r["width"]): r["n"] for r in kinds}, any(r["hole"] >= 0 for r in kinds)
    n = sum(by_width.values())
    short = tuple(sorted(w for e, w in by_width if not e and w < WINDOW)) if short_inside else ()
    exact = tuple(sorted(w for e, w in by_width if e))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.hex("row")))
    # Most windows are in no item: a bitmap drops them before they become rows. What is left is written once and used twice.
    passed = _listed(_hashed(docs, "doc_id", "text", short, exact, holes), _bit_filter(side, n), short, exact).withColumnRenamed("id", "doc_id")
    passed = cut(passed.select(key.alias("doc"), "doc_id", "row", "at", "width", "h", "slots"))
    candidates = _met(passed.select("doc", "width", "h"), side.filter("lead").select("width", "h", "class"), ["width", "h"], n).select("doc", "class").distinct()
    # Where both have the same word that may be a name, it is as good as a word.
    pair = F.filter(F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("doc")), lambda p: p["item"].isNotNull() & ~(p["item"].startswith(_START) & (p["item"] == p["doc"])))
    pair = F.transform(pair, lambda p: F.struct(F.translate(p["item"], _START, _NAME).alias("item"), F.translate(p["doc"], _START, _NAME).alias("doc")))
    looked_up = side.select("class", "item_id", "n_items", "n_windows", "needed", "needed_own", "needed_weight", "weight", F.col("own").alias("own_window"), "item_at", "width", "h", "base", "item_slots")
    hits = _met(candidates, looked_up, ["class"], n).join(passed, ["doc", "width", "h"])
    hits = hits.select("doc", "doc_id", "row", "class", "item_id", "n_items", "n_windows", "needed", "needed_own", "needed_weight", (F.col("at") - F.col("item_at")).alias("shift"), "base", F.struct("base", "weight", "own_window").alias("window"), F.coalesce(pair, F.array()).alias("pairs"), _own_values(F.col("slots")).alias("values"))
    # The values that items of a class have in its windows.
    members = _listed(_hashed(items.filter("not exact"), "class", "text", item_side=True), lambda h: F.lit(True))
    values = cut(members.select(F.col("id").alias("class"), "base", _own_values(F.col("slots")).alias("values")).distinct())
    hits = _met(hits, values.withColumn("own", F.lit(True)), ["class", "base", "values"], values.count(), "left")
    ratio = lambda pairs: F.when(F.size(pairs) > 0, F.least(F.size(F.array_distinct(pairs["item"])), F.size(F.array_distinct(pairs["doc"]))) / F.size(pairs)).otherwise(F.lit(1.0))
    pooled = lambda sets: F.array_distinct(F.flatten(F.collect_set(sets)))
    weight = lambda held: F.aggregate(held, F.lit(0.0), lambda acc, w: acc + w["weight"])
    own = lambda held: F.size(F.filter(held, lambda w: w["own_window"]))
    enough = lambda held: (F.size(held) >= F.col("needed")) & (own(held) >= F.col("needed_own")) & (weight(held) >= F.col("needed_weight") - _SLACK)
    of_class = ["doc", "doc_id", "class", "item_id", "n_items", "n_windows", "needed", "needed_own", "needed_weight"]
    aligned = (
        hits.withColumn("own", F.coalesce("own", F.size("pairs") == 0))
        .groupBy(*of_class, "row", "shift")
        .agg(F.collect_set("window").alias("held"), F.collect_set(F.when(F.col("own"), F.col("window"))).alias("own"), F.bool_and("own").alias("same_slots"), pooled("pairs").alias("pairs"))
        .withColumn("best", F.when(enough("held"), F.struct(ratio(F.col("pairs")).alias("consistency"), F.size("pairs").alias("n_slots"))))
    )
    found = aligned.groupBy(*of_class).agg(pooled("held").alias("held"), pooled("own").alias("own"), F.bool_and("same_slots").alias("same_slots"), pooled("pairs").alias("pairs"), F.max("best").alias("best"))
    rated = (
        found.withColumn("n_matched", F.size("held"))
        .withColumn("all", F.struct(ratio(F.col("pairs")).alias("consistency"), F.size("pairs").alias("n_slots")))
        .withColumn("rated", F.when(F.col("all.consistency") >= MIN_CONSISTENT, F.col("all")).otherwise(F.coalesce("best", "all")))
        .select("*", "rated.*")
    )
    caught = rated.filter(enough("held") & ((F.col("consistency") >= MIN_CONSISTENT) | enough("own")))
    return caught.select("doc_id", "item_id", "n_matched", "n_windows", "n_slots", "consistency", "same_slots", "n_items", "class")


def contaminated(docs: DataFrame, benchmark: DataFrame, short_inside: bool = False) -> DataFrame:
    """``found_classes`` with a row for each item of a class. A class may have very many: ``found_classes`` and ``item_classes`` say the same in fewer rows."""
    found = found_classes(docs, benchmark, short_inside).drop("item_id", "n_items")
    return found.join(item_classes(benchmark).select("class", "item_id"), "class").select("doc_id", "item_id", "n_matched", "n_windows", "n_slots", "consistency", "same_slots")


def keep_clean(docs: DataFrame, benchmark: DataFrame, short_inside: bool = False) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not reported; rows without a doc_id stay."""
    caught = found_classes(docs, benchmark, short_inside).select(F.col("doc_id").alias("_caught")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))
    return rows.join(caught, F.col("_doc.doc_id") == F.col("_caught"), "left_anti").select("_doc.*")
