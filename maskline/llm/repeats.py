"""Removal of repeated passages: every window of words that stood earlier already.

Fixed-block anchors. Each text is indexed by its blocks: BLOCK words each, that
do not overlap, from the first word on. Any window of WINDOW = 2 * BLOCK words
holds a whole block of its own text, wherever it begins. So every rolling run
of BLOCK words of every text is probed against the index, and where a window
stands in two places, the earlier one's block is a hit in both. Hits are then
extended: the windows that hold a hit are compared with each other, exactly,
and consecutive windows that stood earlier are one maximal repeat. Work is a
few passes over words: a passage in a million texts is a million entries, and
no pairs of places are made (see exchange.py).

"Earlier" means a smaller id, or in the same row an earlier start; rows without
id come last, and rows of equal id count in the order in which they were
stored. Windows are judged on the input: a window that is removed still counts
as an earlier place.

Defined results: words are runs outside U+0020 and U+0009..U+000D, unchanged; a
null or empty text has no words; texts of fewer than WINDOW words keep all;
repeated rows are removed whole but for the first (if long enough); other
columns are ignored; an empty table gives an empty result. Texts are taken
whole; one of any length is one chunk. Anchors are filtered by leading bits of
hashes (a false hit costs only a comparison); windows are told apart by 96 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from maskline.llm import exchange as ex
from maskline.llm import textkit as tk
from maskline.llm.stage import shared_dir, table, written

BLOCK = 10
WINDOW = 2 * BLOCK
NO_ID = np.iinfo(np.int64).max

QUESTION = "slice long, chunk long, n long, keys binary, tags binary, docs binary"


class Anchors:
    """The words of a chunk, its rolling blocks, and their distinct hashes in order."""

    def __init__(self, chunk: ex.Chunk, bits: int):
        self.words = tk.segments(chunk.buf, chunk.offsets)
        doc = self.words.doc
        self.first = np.searchsorted(doc, np.arange(len(chunk.offsets)))
        self.at, self.block = tk.windows(self.words.key, doc, BLOCK)
        self.order, self.new = ex.runs([ex.cut(self.block, bits)])
        self.keys = ex.cut(self.block[self.order[self.new]], bits)

    def sizes(self, slices: int) -> dict[int, int]:
        return {s: b - a for s, a, b in ex.cuts(self.keys, slices)}

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct hash: whether a block of the index has it, and whether it occurs twice here."""
        begin = np.flatnonzero(self.new)
        aligned = (self.at - self.first[self.words.doc[self.at]]) % BLOCK == 0
        return (np.logical_or.reduceat(aligned[self.order], begin) if len(begin) else np.zeros(0, bool)), np.diff([*begin, len(self.order)]) > 1

    def windows(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, key, tag) of the windows that hold a hit; hit: by distinct hash."""
        n = len(self.words.key)
        block, hits = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.int64)
        block[self.at] = self.block
        hits[self.at[self.order]] = hit[np.cumsum(self.new) - 1]
        total = np.concatenate([[0], np.cumsum(hits)])
        doc = self.words.doc
        start = np.arange(max(0, n - WINDOW + 1))
        start = start[(doc[start] == doc[start + WINDOW - 1]) & (total[start + WINDOW - BLOCK + 1] > total[start])]
        a, b = block[start], block[start + BLOCK]
        tag = tk.mix(a * tk._SPAN[3] + b * tk._SPAN[2] + np.uint64(5)) >> np.uint64(32)
        return start, tk.mix(a * tk._SPAN[0] + b * tk._SPAN[1]), tag


def _ids(keys: pa.Array) -> np.ndarray:
    return keys.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _earliest(a: Anchors, ids: np.ndarray, start: np.ndarray, key: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first) of windows by key, tag, id and place: the first of a run is the chunk's earliest."""
    order = np.lexsort((start, ids[a.words.doc[start]], tag, key))
    first = np.ones(len(order), bool)
    k, t = key[order], tag[order]
    first[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    return order, first


def _questions(chunks: DataFrame, slices: int, bits: int) -> DataFrame:
    """Which rolling blocks of each chunk occur elsewhere too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in ex.opened(batch):
                a = Anchors(c, bits)
                index, twice = a.index()
                rows = [(s, c.number, j - i, ex.packed(a.keys[i:j], bits), np.packbits(index[i:j]).tobytes(), np.packbits(twice[i:j]).tobytes()) for s, i, j in ex.cuts(a.keys, slices)]
                yield _rows(rows)
        pa.default_memory_pool().release_unused()

    return chunks.select("chunk", "keys", "offsets", "texts").mapInArrow(run, QUESTION)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.binary()] * 3
    columns = zip(*rows, strict=True) if rows else ((),) * 6
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in QUESTION.split(", ")])


def _split(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1])


def _is_anchor(bits: int):
    """Answers: the hash is that of a block of the index, and it occurs twice or more."""

    def work(t: pa.Table) -> list[np.ndarray]:
        n = t.column("n").to_pylist()
        keys = np.concatenate([ex.unpacked(x, k, bits) for x, k in zip(t.column("keys").to_pylist(), n, strict=True)])
        index, twice = (np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(t.column(c).to_pylist(), n, strict=True)]) for c in ("tags", "docs"))
        order, first = ex.runs([keys])
        begin = np.flatnonzero(first)
        times = np.add.reduceat(1 + twice[order].astype(np.int64), begin)
        hit = np.maximum.reduceat(index[order], begin).astype(bool) & (times > 1)
        out = np.empty(len(keys), bool)
        out[order] = hit[np.cumsum(first) - 1]
        return _split(out, n)

    return work


def _stood_earlier(t: pa.Table) -> list[np.ndarray]:
    """Answers: another chunk has the window at an earlier place."""
    n = t.column("n").to_pylist()
    chunk = np.repeat(t.column("chunk").to_numpy(), n)
    keys = np.concatenate([ex.unpacked(x, k) for x, k in zip(t.column("keys").to_pylist(), n, strict=True)])
    tags, docs = (np.concatenate([read(x, k) for x, k in zip(t.column(c).to_pylist(), n, strict=True)]) for c, read in (("tags", ex.wide), ("docs", ex.from_range)))
    order = np.lexsort((chunk, docs, tags, keys))
    k, g = keys[order], tags[order]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = (k[1:] == k[:-1]) & (g[1:] == g[:-1])
    return _split(out, n)


def _window_questions(chunks: DataFrame, hits: DataFrame, slices: int, bits: int) -> DataFrame:
    """The distinct windows around hits, each with the id of its earliest place in the chunk."""

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for c in ex.opened(left):
            a = Anchors(c, bits)
            start, key, tag = a.windows(ex.truth(right, a.sizes(slices)))
            ids = _ids(c.keys)
            order, first = _earliest(a, ids, start, key, tag)
            own = order[first]
            doc = ids[a.words.doc[start[own]]]
            rows += [(s, c.number, j - i, ex.packed(key[own[i:j]]), ex.narrow(tag[own[i:j]]), ex.ranged(doc[i:j])) for s, i, j in ex.cuts(key[own], slices)]
        return pa.Table.from_batches([_rows(rows)])

    return chunks.select("chunk", "keys", "offsets", "texts").groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(work, QUESTION)


def _kept(chunks: DataFrame, answers: DataFrame, slices: int, bits: int, id_col: str) -> DataFrame:
    """(id, n_words, n_removed, spans, kept) from both rounds of answers."""
    kind = chunks.schema["keys"].dataType.elementType

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        rounds = right.column("round").to_numpy()
        first_round, second_round = (right.filter(pa.array(rounds == k)) for k in (1, 2))
        for c in ex.opened(left):
            a = Anchors(c, bits)
            n, words, n_docs = len(a.words.key), a.words, len(c.keys)
            start, key, tag = a.windows(ex.truth(first_round, a.sizes(slices)))
            order, first = _earliest(a, _ids(c.keys), start, key, tag)
            repeated = np.ones(len(order), bool)
            repeated[order[first]] = ex.truth(second_round, {s: j - i for s, i, j in ex.cuts(key[order[first]], slices)})
            begins = np.sort(start[repeated])
            marks = np.zeros(n + 1, np.int64)
            np.add.at(marks, begins, 1)
            np.add.at(marks, begins + WINDOW, -1)
            covered = np.cumsum(marks)[:n] > 0
            # a span is a run of windows whose starts follow each other
            head = np.ones(len(begins), bool)
            head[1:] = (np.diff(begins) > 1) | (words.doc[begins[1:]] != words.doc[begins[:-1]])
            tail = np.roll(head, -1)
            span_doc = words.doc[begins[head]]
            spans = pa.StructArray.from_arrays([pa.array(begins[head] - a.first[span_doc]), pa.array(begins[tail] + WINDOW - a.first[span_doc])], names=["start", "end"])
            stays = np.flatnonzero(~covered)
            owner = words.doc[stays]
            last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
            text, size = ex.joined_words(c.buf, words.start[stays], words.end[stays], last)
            bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, size, n_docs).astype(np.int64))])
            kept = pa.LargeStringArray.from_buffers(n_docs, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))).cast(pa.string())
            out.append(pa.table([
                c.keys, pa.array(tk.per_doc(words.doc, n_docs)), pa.array(tk.per_doc(words.doc[covered], n_docs)),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(span_doc, np.arange(n_docs + 1)).astype(np.int32)), spans), kept,
            ], names=[id_col, "n_words", "n_removed", "spans", "kept"]))
        return pa.concat_tables(out)

    schema = StructType([StructField(id_col, kind), *StructType.fromDDL("n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string").fields])
    return chunks.select("chunk", "keys", "offsets", "texts").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(work, schema)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """(id, n_words, n_removed, spans, kept) for each row: spans [start, end) of words are its maximal repeats of earlier text, kept is the rest."""
    spark = df.sparkSession
    folder = folder or shared_dir(spark)
    chunks = ex.chunked(df.select(F.col(id_col).cast("long").alias(id_col), text_col), id_col, text_col, tk.SPACES, folder)
    n_words = chunks.select(F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    slices, bits = ex.slices_for(spark, n_words), ex.filter_bits(n_words)
    hits = written(ex.answered(_questions(chunks, slices, bits), slices, _is_anchor(bits)), folder, "hits")
    earlier = written(ex.answered(_window_questions(chunks, hits, slices, bits), slices, _stood_earlier), folder, "earlier")
    answers = hits.withColumn("round", F.lit(1)).union(earlier.withColumn("round", F.lit(2)))
    return _kept(chunks, answers, slices, bits, id_col)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> doc_id, n_words, n_removed, kept_sha256, n_spans."""
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))


_ORACLE = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, s, array_to_string(ws[s:s + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS s FROM w)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM g) WHERE k > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) AS p FROM again),
spans AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM again) WHERE before IS NULL OR s > before + 1 GROUP BY doc_id),
words AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256, CAST(coalesce(spans.n, 0) AS BIGINT) AS n_spans
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id)"""

QUERIES = {"op13_substring_dedup": op13_substring_dedup}
ORACLES: dict[str, str] = {"op13_substring_dedup": _ORACLE}
