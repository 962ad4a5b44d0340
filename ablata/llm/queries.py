"""The operators applied to their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, language, main_text, mixture, passage_quality, periodicity, private_data, quality, simhash, token_counts, token_store
from .common import table

VOCABULARY = "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path(VOCABULARY)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.found_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), short_inside=True)
    return found.drop("class")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.detect(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.probe_rows(spark))
    return chat.digests(chat.format_turns(chat.rows_to_turns(rows)))


def op11_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodicity.digests(periodicity.collapse(periodicity.planted(table(spark, sf_dir, "documents"))))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source of the mixture gets, before documents are rounded."""
    targets = mixture.source_targets(mixture.document_sizes(table(spark, sf_dir, "documents")))
    return targets.withColumn("target", F.round("target", 3))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface counts of the quality rules, without the method's verdict."""
    return quality.base_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_token_store,
        op3_decontamination,
        op4_mixing,
        op5_main_text,
        op6_quality_rules,
        op7_language,
        op8_simhash,
        op9_private_data,
        op10_chat_formatting,
        op11_passage_quality,
        op12_periodic_runs,
        op13_source_divergence,
        mix_targets,
        quality_base,
    )
}

_ESCAPED_LENGTH = r"(length({0}) + length({0}) - length(replace({0}, '\', '')) + length({0}) - length(replace({0}, '<', '')) + length({0}) - length(replace({0}, '>', '')))"

ORACLES = {
    "op10_chat_formatting": rf"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum({_ESCAPED_LENGTH.format("role")} + {_ESCAPED_LENGTH.format("text")} + length('<turn:></turn>') + 1) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    # The level at which limits stop, by testing each number of stopped sources in the order of limit by weight.
    "mix_targets": r"""
        WITH s AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS source_size, count(*) AS n_docs FROM documents GROUP BY source),
        w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
        l AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        v AS (SELECT max(level) AS level FROM l WHERE level * weight < most)
        SELECT source, source_size, n_docs, round(least(coalesce(v.level, total) * weight, most), 3) AS target FROM w, v""",
    # A lag that can have a run has four equal words at its multiples; stretches lie between successive places that differ.
    "op12_periodic_runs": r"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce(CAST(doc_id AS VARCHAR), '') AS s FROM documents),
        h AS (SELECT *, len(w) AS n, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(s) + 1), lambda k: [ord(s[k])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
            lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295) AS h FROM d),
        g AS (SELECT *, (h // 10) % greatest(n, 1) AS a, 3 + (h // 10) % 8 AS parts FROM h),
        o AS (SELECT i, unnest(range(len(w))) AS pos, unnest(w) AS word FROM d),
        t AS (SELECT i, k AS pos, CASE WHEN h % 10 = 0 AND k >= a THEN a + (k - a) % (1 + (n - a) // parts) ELSE k END AS at FROM (SELECT i, n, h, a, parts, unnest(range(n)) AS k FROM g)),
        e AS MATERIALIZED (SELECT t.i, t.pos, o.word FROM t JOIN o ON o.i = t.i AND o.pos = t.at),
        lags AS (SELECT i, n, unnest(range(1, n // 4 + 1)) AS q FROM g),
        probes AS (SELECT i, n, q, unnest(range(0, (n - 1) // q - 2)) AS k FROM lags),
        p1 AS MATERIALIZED (SELECT p.i, p.n, p.q, p.k, x.word FROM probes p JOIN e x ON x.i = p.i AND x.pos = p.k * p.q),
        p2 AS MATERIALIZED (SELECT p.* FROM p1 p JOIN e x ON x.i = p.i AND x.pos = (p.k + 1) * p.q AND x.word = p.word),
        p3 AS MATERIALIZED (SELECT p.* FROM p2 p JOIN e x ON x.i = p.i AND x.pos = (p.k + 2) * p.q AND x.word = p.word),
        likely AS MATERIALIZED (SELECT DISTINCT p.i, p.n, p.q FROM p3 p JOIN e x ON x.i = p.i AND x.pos = (p.k + 3) * p.q AND x.word = p.word),
        pairs AS MATERIALIZED (SELECT l.i, l.q, x.pos, x.pos + l.q AS next, x.word FROM likely l JOIN e x USING (i)),
        breaks AS (SELECT p.i, p.q, p.pos FROM pairs p JOIN e y ON y.i = p.i AND y.pos = p.next WHERE y.word <> p.word
            UNION ALL SELECT i, q, -1 FROM likely UNION ALL SELECT i, q, n - q FROM likely),
        stretches AS (SELECT i, q, lag(pos) OVER (PARTITION BY i, q ORDER BY pos) + 1 AS start, pos FROM breaks),
        runs AS MATERIALIZED (SELECT i, start, pos - start + q AS length, min(q) AS q FROM stretches WHERE pos - start >= 3 * q AND pos - start + q >= 6 GROUP BY ALL),
        best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY i ORDER BY length::DOUBLE / q DESC, start, q) = 1),
        listed AS (SELECT i, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY i),
        gone AS (SELECT DISTINCT i, unnest(range(start + q, start + length)) AS pos FROM runs),
        kept AS (SELECT i, string_agg(word, ' ' ORDER BY pos) AS text FROM e ANTI JOIN gone USING (i, pos) GROUP BY i)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, 1000 * length // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
        FROM d LEFT JOIN listed USING (i) LEFT JOIN best USING (i) LEFT JOIN kept USING (i)""",
    # Every kept term of a language for every one of its groups, as the definition has it.
    "op13_source_divergence": r"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        o AS MATERIALIZED (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS MATERIALIZED (SELECT lang, term FROM (SELECT DISTINCT i, lang, term FROM o) GROUP BY ALL HAVING count(*) >= 3),
        g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
        c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
        f AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        p AS MATERIALIZED (SELECT lang, source, term, n, 1 + CAST(1000000000::HUGEINT * (n + 1) // (sum(n) OVER same + count(*) OVER same) AS BIGINT) AS p FROM f WINDOW same AS (PARTITION BY lang, source)),
        t AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM f GROUP BY ALL),
        l AS MATERIALIZED (SELECT lang, term, 1 + CAST(1000000000::HUGEINT * (n + 1) // (sum(n) OVER same + count(*) OVER same) AS BIGINT) AS q FROM t WINDOW same AS (PARTITION BY lang)),
        s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - l.q) * (p.p - l.q) // l.q FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE p.n > 0 AND p.p > l.q)
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM x QUALIFY part = 'pair' OR rank <= 200""",
    # Each repeated window covers five words; a word is counted once.
    "quality_base": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS l, row_number() OVER () AS i FROM documents),
        g AS (SELECT i, unnest(range(0, len(w) - 4)) AS p, w FROM d WHERE len(w) > 4),
        r AS (SELECT i, p FROM (SELECT i, p, count(*) OVER (PARTITION BY i, list_aggregate(w[p + 1:p + 5], 'string_agg', ' ')) AS n FROM g) WHERE n > 1),
        c AS (SELECT i, count(DISTINCT p + k) AS n FROM r, range(5) AS x(k) GROUP BY i),
        b AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
            len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN c USING (i))
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b""",
}
