"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one bit per failed rule; a policy is a named set of rules, so that a new
policy, or an ablation, reads the ledger only and never the texts.

Defined results: a null or empty text has no words (all measurements 0) and
fails ``few_words``; ties and repeated rows are scored row by row; columns
beside id and text are ignored; an empty table gives an empty ledger. Texts
are measured whole, whatever their length. Repeats are found by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.llm import textkit as tk
from maskline.llm.stage import shared_dir, table, with_id, written

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_bangs", "n_bars")

#: Rule name -> condition of failure over the measurements. The position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words and n_symbols > 0",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "shouting": "2 * n_upper > n_letters",
    "exclamation": "10 * n_bangs > 3 * n_words",
    "table_rows": "10 * n_bars > 2 * n_words",
    "long_words": "word_chars > 40 * n_words",
}

#: Policy name -> rules that reject. A released policy never changes; add a new name.
POLICIES: dict[str, tuple[str, ...]] = {
    "2024.1-base": ("few_words", "repeated_windows"),
    "2024.2": tuple(RULES),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _measure(text: pa.Array) -> list[np.ndarray]:
    out = [np.zeros(len(text), np.int64) for _ in MEASURES]
    for i, j, buf, offsets in tk.chunks(text):
        n = j - i
        owner = np.repeat(np.arange(n), np.diff(offsets))
        count = lambda hit: tk.per_doc(owner[hit], n)  # noqa: E731, B023
        words = tk.segments(buf, offsets)
        spaces = tk.SPACES[buf]
        lines = tk.segments(buf, offsets, tk.NEWLINES)
        if len(lines.start):
            worded = np.diff(np.concatenate([[0], np.cumsum(~spaces)])[np.stack([lines.start, lines.end])], axis=0)[0] > 0
        else:
            worded = np.zeros(0, bool)
        line_doc = lines.doc[worded]
        _, first = np.unique(tk.salted(lines.key[worded], line_doc), return_index=True)
        n_lines = tk.per_doc(line_doc, n)
        at, key = tk.windows(words.key, words.doc, 5)
        _, same, times = np.unique(tk.salted(key, words.doc[at]), return_inverse=True, return_counts=True)
        again = at[times[same] > 1] if len(at) else at
        mark = np.zeros(len(words.start) + 5, np.int64)
        np.add.at(mark, again, 1)
        np.add.at(mark, again + 5, -1)
        covered = np.cumsum(mark)[: len(words.start)] > 0
        got = (
            tk.per_doc(words.doc, n),
            count(~spaces & ((buf & 0xC0) != 0x80)),
            count(_SYMBOL[buf]),
            n_lines,
            n_lines - tk.per_doc(line_doc[first], n),
            tk.per_doc(words.doc[covered], n),
            count(((buf | 32) >= 97) & ((buf | 32) <= 122)),
            count((buf >= 65) & (buf <= 90)),
            count(buf == 33),
            count(buf == 124),
        )
        for column, values in zip(out, got, strict=True):
            column[i:j] = values
    return out


def measurements(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, MEASURES...) for each row; one pass over the texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, _measure(batch.column(1)))], names=[id_col, *MEASURES])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, with_id(df, id_col, ", ".join(f"{m} long" for m in MEASURES)))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and fail_bits: bit k is set if rule k of RULES fails."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES.values()):
        bits = bits + F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    return measurements(df, id_col, text_col).withColumn("fail_bits", bits)


def mask(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def passes(policy: str = "2024.2") -> Column:
    """True where no rule of the policy has failed."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(book: DataFrame, policy: str = "2024.2") -> DataFrame:
    """For each rule of the policy: rows that fail it, that only it rejects, and that the policy keeps without it."""
    whole = mask(POLICIES[policy])
    inside = F.col("fail_bits").bitwiseAND(F.lit(whole))
    rows = [F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in POLICIES[policy]]
    return (
        book.groupBy(inside.alias("inside")).count()  # at most 2^rules rows from here on
        .select("inside", "count", F.explode(F.array(*rows)).alias("x"))
        .groupBy(F.lit(policy).alias("policy"), F.col("x.rule").alias("rule"), F.col("x.bit").alias("bit"))
        .agg(
            F.sum("count").alias("n_rows"),
            F.sum(F.when(F.expr("inside & x.bit") != 0, F.col("count")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.expr("inside = x.bit"), F.col("count")).otherwise(0)).alias("n_only"),
            F.sum(F.when(F.expr("(inside & ~x.bit) = 0"), F.col("count")).otherwise(0)).alias("n_kept_without"),
        )
    )


def stored(docs: DataFrame) -> DataFrame:
    """The ledger of docs, written once: policies and ablations read it and never the texts."""
    return written(ledger(docs), shared_dir(docs.sparkSession), "ledger")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> doc_id, base measurements, base_failed, kept, what the earlier policy kept, and the ledger's bits."""
    base = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    return stored(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & passes()).alias("kept"), passes("2024.1-base").alias("kept_2024_1"),
        "fail_bits", F.lit("2024.2").alias("policy"), "n_lines", "n_letters", "n_upper", "n_bangs", "n_bars",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy decides over documents, from the stored ledger."""
    book = stored(table(spark, sf_dir, "documents"))
    return ablation(book, "2024.1-base").union(ablation(book, "2024.2"))


_BLANK = r"\x20\x09-\x0D"
_LEFT = lambda keep: f"CAST(length(regexp_replace(text, '{keep}', '', 'g')) AS BIGINT)"
_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(RULES.values()))
_BOOK = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^{_BLANK}]+') AS ws FROM d),
wins AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(str_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^{_BLANK}]') GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, {_LEFT(f'[{_BLANK}]')} AS word_chars, {_LEFT('[^#*$%&|<>]')} AS n_symbols, coalesce(lines.dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
 coalesce(lines.n, 0) AS n_lines, {_LEFT('[^A-Za-z]')} AS n_letters, {_LEFT('[^A-Z]')} AS n_upper, {_LEFT('[^!]')} AS n_bangs, {_LEFT('[^|]')} AS n_bars
 FROM d JOIN w USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CAST({_BITS} AS BIGINT) AS fail_bits FROM m)"""
_ORACLE = rf"""{_BOOK}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (fail_bits & {mask(POLICIES["2024.2"])}) = 0 AS kept, (fail_bits & {mask(POLICIES["2024.1-base"])}) = 0 AS kept_2024_1,
 fail_bits, '2024.2' AS policy, n_lines, n_letters, n_upper, n_bangs, n_bars FROM b"""

_RULE = lambda policy, r: (
    f"SELECT '{policy}' AS policy, '{r}' AS rule, CAST({mask((r,))} AS BIGINT) AS bit, count(*) AS n_rows, count(*) FILTER (({RULES[r]})) AS n_failed,"
    f" count(*) FILTER ((fail_bits & {mask(POLICIES[policy])}) = {mask((r,))}) AS n_only, count(*) FILTER ((fail_bits & {mask(POLICIES[policy]) - mask((r,))}) = 0) AS n_kept_without FROM b"
)
_ABLATION = _BOOK + " UNION ALL ".join(_RULE(p, r) for p in POLICIES for r in POLICIES[p])

QUERIES = {"op8_quality_rules": op8_quality_rules, "quality_ablation": quality_ablation}
ORACLES: dict[str, str] = {"op8_quality_rules": _ORACLE, "quality_ablation": _ABLATION}
