"""Language identification by words first, then by character n-grams.

A known word scores its log frequency in each language. An unseen word backs
off to its 5-grams; if none is known to its 4-grams, and so on to single
characters. A text scores the sum over its words; the score of the answer is
its share after softmax (equal priors).

Words are letters (Unicode category L) with the marks that follow them. The
model is fitted on a bounded sample of labelled rows: about SAMPLE_ROWS, chosen
by a hash of id and text, whatever the size of the table. Counting words and
n-grams is a Spark job; the tables that reach the executors have at most
MAX_WORDS and MAX_GRAMS rows, and fewer where they would hold over CELLS scores.
Every text is scored whole.

Defined results: null text, or text without a letter, is ``und`` with score 0;
rows equal in id and text are in the sample together or not at all;
a text of words that share no character with the model gives the first language
in order, with equal shares; ties go to the first language in order; without
labelled rows everything is ``und``; repeated rows are scored row by row; other
columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.llm.stage import shared_dir, table, with_id, written

SAMPLE_ROWS = 20_000
MAX_WORDS, MAX_GRAMS, MAX_ORDER = 100_000, 100_000, 5
#: Scores, rows times languages, of one table.
CELLS = 20_000_000
#: A word or n-gram is known if the sample has it so often.
LEAST_COUNT = 2
UNKNOWN = "und"
CACHE_WORDS = 60_000
#: Rows that go back to the JVM at once: what is carried along may be whole texts.
OUT_ROWS = 500


ASCII_WORD = re.compile("[a-z]+")


@cache
def word_pattern(last: int) -> re.Pattern:
    """A letter, then letters and marks, up to a code point; built once a process from the Unicode categories."""
    sets: dict[str, list[str]] = {"L": [], "M": []}
    for kind, ranges in sets.items():
        first = None
        for c in range(last + 2):
            inside = c <= last and unicodedata.category(chr(c))[0] == kind
            if inside and first is None:
                first = c
            elif not inside and first is not None:
                ranges.append(f"\\U{first:08x}-\\U{c - 1:08x}")
                first = None
    letters, marks = ("".join(x) for x in sets.values())
    return re.compile(f"[{letters}][{letters}{marks}]*")


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case. Classes of characters up to U+FFFF are looked up, further ones are searched, so they are left out where a text has none."""
    low = (text or "").lower()
    if low.isascii():
        return ASCII_WORD.findall(low)
    plain = len(low.encode("utf-16-le", "surrogatepass")) == 2 * len(low)
    return word_pattern(0xFFFF if plain else sys.maxunicode).findall(low)


def grams(word: str, order: int) -> list[str]:
    w = f"_{word}_" if order > 1 else word
    return [w[i : i + order] for i in range(len(w) - order + 1)]


class Model(NamedTuple):
    langs: list[str]
    words: dict[str, int]  # word -> row of word_scores
    word_scores: np.ndarray  # float32, a column for each language
    grams: dict[str, int]
    gram_scores: np.ndarray

    def backoff(self, word: str) -> np.ndarray:
        for order in range(MAX_ORDER, 0, -1):
            rows = [r for g in grams(word, order) if (r := self.grams.get(g)) is not None]
            if rows:
                return self.gram_scores[rows].mean(0)
        return np.zeros(len(self.langs), np.float32)


def training(df: DataFrame, allowed: Column, rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> DataFrame:
    """About rows of the allowed rows that have a label, by a hash of id and text."""
    labelled = df.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = labelled.select(F.lit(1)).count()
    share = min(1 << 20, (rows << 20) // max(n, 1) + 1)
    return labelled.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col("text")), F.lit(1 << 20)) < share).select("lang", "text")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, lang, n): the words of a batch, counted."""
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            counts: dict[str, Counter] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text))
            for lang, c in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([lang] * len(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["item", "lang", "n"])


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 5000):
            part, c = batch.slice(k, 5000).to_pydict(), Counter()
            for word, lang, n in zip(part["item"], part["lang"], part["n"], strict=True):
                for order in range(1, MAX_ORDER + 1):
                    for g in grams(word, order):
                        c[g, lang] += n
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in c], pa.string()), pa.array([x for _, x in c], pa.string()), pa.array(list(c.values()), pa.int64())], names=["item", "lang", "n"])


def _table(counts: DataFrame, langs: list[str], most: int, by_length: bool) -> tuple[dict[str, int], np.ndarray]:
    """The most frequent items (most at most), with log frequency by language."""
    by_item = counts.groupBy("item").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))  # an entry per language
    most = max(1000, min(most, CELLS // len(langs)))
    kept = by_item.where(F.col("all") >= LEAST_COUNT).orderBy(F.desc("all"), "item").limit(most).collect()
    n = np.zeros((len(kept), len(langs)))
    place = {x: k for k, x in enumerate(langs)}
    for row, r in enumerate(kept):
        for lang, count in r.by.items():
            n[row, place[lang]] = count
    lengths = np.array([len(r.item) if by_length else 0 for r in kept])
    scores = np.zeros_like(n)
    for group in (lengths == k for k in np.unique(lengths)):  # n-grams compare with those of their order
        total = n[group].sum(0)
        scores[group] = np.log((n[group] + 0.1) / (total + 0.1 * max(group.sum(), 1)))
    return {r.item: k for k, r in enumerate(kept)}, scores.astype(np.float32)


def fit(sample: DataFrame, folder: str) -> Model | None:
    """Model of a sample of (lang, text); None if it is empty."""
    words = sample.select("lang", F.col("text").cast("string")).mapInArrow(_counted, "item string, lang string, n long")
    words = written(words.groupBy("item", "lang").agg(F.sum("n").alias("n")), folder, "words")
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())  # labels of a bounded sample
    if not langs:
        return None
    pieces = words.mapInArrow(_gram_counts, "item string, lang string, n long").groupBy("item", "lang").agg(F.sum("n").alias("n"))
    return Model(langs, *_table(words, langs, MAX_WORDS, False), *_table(pieces, langs, MAX_GRAMS, True))


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_WORDS, MAX_GRAMS and CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m is not None:
            fixed = len(m.words)
            rows = np.zeros((fixed + CACHE_WORDS, len(m.langs)), np.float32)
            rows[:fixed] = m.word_scores

            class Seen(dict):
                def __missing__(self, word: str) -> int:
                    at = len(self)
                    if at >= fixed + CACHE_WORDS:
                        return -1
                    rows[at] = m.backoff(word)
                    self[word] = at
                    return at

            seen = Seen(m.words)
        for batch in (whole.slice(k, OUT_ROWS) for whole in batches for k in range(0, whole.num_rows, OUT_ROWS)):
            langs, scores = [], []
            for text in batch.column(1):
                words = words_of(text.as_py()) if m is not None else []
                if not words:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                if len(seen) >= fixed + CACHE_WORDS // 2:  # forget unseen words between texts
                    seen.clear()
                    seen.update(m.words)
                at = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
                total = rows[at[at >= 0]].sum(0, dtype=np.float64)
                for w, a in zip(words, at, strict=True) if (at < 0).any() else ():
                    if a < 0:
                        total += m.backoff(w)
                share = np.exp(total - total.max())
                share /= share.sum()
                k = int(total.argmax())
                langs.append(m.langs[k])
                scores.append(float(share[k]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])
        pa.default_memory_pool().release_unused()  # the worker lives on

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, with_id(df, id_col, "lang_pred string, score double"))


def held_out(id_col: str = "doc_id") -> Column:
    """True for every third id, by checksum: never learned from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def fitted(docs: DataFrame) -> Model | None:
    return fit(training(docs, F.coalesce(~held_out(), F.lit(True))), shared_dir(docs.sparkSession))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fitted(docs)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
ORACLES: dict[str, str] = {}
