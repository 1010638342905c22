"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words: positions marked 1 are hashed,
positions marked 0 are ignored, so a passage with substituted words still
shares hashes with the test item. Hashes of the training text meet those of the
benchmark; each hit fixes a diagonal (text position minus item position), along
which the words are compared. The best run on a diagonal (a match counts 1, a
substitution -2) is an overlap if it has MIN_WORDS matching words, or MIN_SHARE
of a shorter item but eight at least, which is what a mask spans. Items of LEAST_WORDS to seven words are too short for a mask
and must stand in the text whole. One row per text and item is returned, for
its best run.

Words are runs of letters, digits and other non-punctuation; ASCII and Latin-1
capitals are folded. The hashes of a benchmark of up to SMALL_BYTES of distinct
texts are sent to the executors, and the texts are scanned once, in place. With
a larger one the hashes of both sides are joined: a filter of fixed size drops
most of the training text's first, the rest meets the benchmark's by equality,
and the texts and items that share a hash are brought together to be compared.
Both ways give the same rows.

Defined results: null or empty texts and items, and items of fewer than
LEAST_WORDS words, match nothing; repeated texts are reported row by row;
repeated items each get their row, but are compared once; of equal runs the
first in the text counts; columns beside id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.llm import textkit as tk
from maskline.llm.stage import shared_dir, table, with_id, written

MASKS = ("11011011", "1110100101", "1010011011")
MIN_WORDS, MIN_SHARE, LEAST_WORDS, LEAST_MASKED = 13, 0.7, 5, 8
SUBSTITUTION = -2
SMALL_BYTES = 4 << 20
#: Leading bits of a hash in the filter of a small benchmark, and of a large one (a bit each: 16 MB).
_BITS, LARGE_BITS, CHUNK_BITS = 22, 27, 16

SPLIT = tk.SPACES.copy()
SPLIT[list(range(0x21, 0x30)) + list(range(0x3A, 0x41)) + list(range(0x5B, 0x61)) + list(range(0x7B, 0x7F))] = True

HIT = "item long, n_matched long, n_span long, item_words long, item_start long, doc_start long, coverage double"


def words(buf: np.ndarray, offsets: np.ndarray) -> tk.Segments:
    """Folded words of a chunk of texts."""
    capital = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
    if len(capital):
        buf = buf.copy()
        buf[capital] += 0x20
    return tk.segments(buf, offsets, SPLIT, tk.LOWER)


def spaced(key: np.ndarray, doc: np.ndarray, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of each place where the mask lies within one text."""
    span = len(pattern)
    m = len(key) - span + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.full(m, MASKS.index(pattern) + 1 if pattern in MASKS else 100 + span, np.uint64)
    for k, c in enumerate(pattern):
        if c == "1":
            total += key[k : k + m] * tk._SPAN[k]
    at = np.flatnonzero(doc[:m] == doc[span - 1 :])
    return at, tk.mix(total[at])


def patterns_of(n_words: int) -> tuple[str, ...]:
    """The masks of an item of so many words: one without gaps if it is short."""
    return () if n_words < LEAST_WORDS else MASKS if n_words >= LEAST_MASKED else ("1" * n_words,)


def wanted(n_words: int) -> float:
    """Matching words that make an overlap with an item."""
    return n_words if n_words < LEAST_MASKED else max(LEAST_MASKED, min(MIN_WORDS, MIN_SHARE * n_words))


class Seeds(NamedTuple):
    """Hashes of a benchmark, sorted, with the item and place of each."""

    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray  # filter on the top bits of a hash
    ids: list[int]
    keys: list[np.ndarray]
    patterns: tuple[str, ...]


def item_words(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return words(data, np.array([0, len(data)])).key


def seeds(items: list[tuple[int, str | None]]) -> Seeds:
    ids, keys, found, patterns = [], [], [], set()
    for item_id, text in items:
        key = item_words(text)
        for pattern in patterns_of(len(key)):
            at, h = spaced(key, np.zeros(len(key), np.int64), pattern)
            found.append((h, np.full(len(at), len(ids)), at))
            patterns.add(pattern)
        ids.append(item_id)
        keys.append(key)
    h, item, place = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2)
    order = np.argsort(h, kind="stable")
    seen = np.zeros(1 << _BITS, bool)
    seen[h >> np.uint64(64 - _BITS)] = True
    return Seeds(h[order], item[order], place[order], seen, ids, keys, tuple(sorted(patterns)))


def best_run(match: np.ndarray) -> tuple[int, int]:
    """[first, last) of the run with the largest score; the earliest of equals."""
    sums = np.concatenate([[0], np.cumsum(np.where(match, 1, SUBSTITUTION))])
    floor = np.minimum.accumulate(sums)
    last = int(np.argmax(sums - floor))
    return int(np.flatnonzero(sums[: last + 1] == floor[last])[-1]), last


def best_overlap(text: np.ndarray, item: np.ndarray, diagonals: list[int]) -> tuple | None:
    """(matched, span, item words, item start, text start, coverage) of the best run of matching words, the first of equals, if it is an overlap."""
    best = None
    for diagonal in sorted(diagonals):
        a, b = max(0, -diagonal), min(len(item), len(text) - diagonal)
        match = item[a:b] == text[a + diagonal : b + diagonal]
        x, y = best_run(match)
        matched = int(match[x:y].sum())
        if matched >= wanted(len(item)) and (best is None or matched > best[0]):
            best = (matched, y - x, len(item), a + x, a + x + diagonal, matched / len(item))
    return best


def overlaps(s: Seeds, key: np.ndarray, doc: np.ndarray, n: int) -> list[tuple]:
    """(text, item, matched, span, item words, item start, text start, coverage) for the texts of a chunk."""
    found: dict[tuple[int, int], set[int]] = {}  # text and item: diagonals
    first = np.searchsorted(doc, np.arange(n + 1))
    for pattern in s.patterns:
        at, h = spaced(key, doc, pattern)
        maybe = np.flatnonzero(s.seen[h >> np.uint64(64 - _BITS)])
        at, h = at[maybe], h[maybe]
        low, high = np.searchsorted(s.hashes, h), np.searchsorted(s.hashes, h, "right")
        hit = np.flatnonzero(high > low)
        for p, a, b in zip(at[hit].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
            d = int(doc[p])
            for k in range(a, b):
                found.setdefault((d, int(s.item[k])), set()).add(p - int(first[d]) - int(s.place[k]))
    rows = ((d, s.ids[item], best_overlap(key[first[d] : first[d + 1]], s.keys[item], list(diagonals))) for (d, item), diagonals in sorted(found.items()))
    return [(d, item, *best) for d, item, best in rows if best]


KINDS = [pa.int64()] * 6 + [pa.float64()]
NAMES = [x.split()[0] for x in HIT.split(", ")]


def distinct_items(benchmark: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(items (item, text) of distinct texts, ids (item, item_id)), both written."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    items = written(rows.select("text").distinct().withColumn("item", F.monotonically_increasing_id()), folder, "items")
    return items.select("item", "text"), written(rows.join(items, "text").select("item", "item_id"), folder, "item-ids")


def _small(items: DataFrame) -> Seeds | None:
    """The seeds of items, or None if their texts are too large to send."""
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > SMALL_BYTES:
        return None
    return seeds(sorted((r.item, r.text) for r in items.collect()))  # SMALL_BYTES of text at most


def _scan(texts: DataFrame, s: Seeds, id_col: str) -> DataFrame:
    """(id, HIT) of texts (id, text); no shuffle."""
    shared = texts.sparkSession.sparkContext.broadcast(s)  # bounded by SMALL_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in tk.chunks(batch.column(1)):
                w = words(buf, offsets)
                rows = overlaps(shared.value, w.key, w.doc, j - i)
                owner = batch.column(0).take(pa.array([i + r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([owner, *(pa.array([r[1 + c] for r in rows], kind) for c, kind in enumerate(KINDS))], names=[id_col, *NAMES])

    return texts.mapInArrow(run, with_id(texts, id_col, HIT))


def _hashes(texts: DataFrame, patterns: tuple[str, ...], own: bool, seen: np.ndarray | None = None) -> DataFrame:
    """(hash, owner, place) of texts (owner, text): of the masks that an item has (own), or of all patterns where the filter lets them through."""
    shared = texts.sparkSession.sparkContext.broadcast(seen)  # 2^LARGE_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners = batch.column(0).to_numpy()
            for i, j, buf, offsets in tk.chunks(batch.column(1)):
                w = words(buf, offsets)
                first, sizes = np.searchsorted(w.doc, np.arange(j - i)), tk.per_doc(w.doc, j - i)
                for pattern in patterns:
                    at, h = spaced(w.key, w.doc, pattern)
                    if own:
                        ok = np.array([pattern in patterns_of(n) for n in sizes.tolist()], bool)[w.doc[at]]
                    else:
                        top = h >> np.uint64(64 - LARGE_BITS)
                        ok = shared.value[(top >> np.uint64(3)).astype(np.int64)] >> (top & np.uint64(7)).astype(np.uint8) & 1 > 0
                    at, h = at[ok], h[ok]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(owners[i + w.doc[at]]), pa.array(at - first[w.doc[at]])], names=["hash", "owner", "place"])

    return texts.mapInArrow(run, "hash long, owner long, place long")


def _filter(hashes: DataFrame) -> np.ndarray:
    """Bits of the leading LARGE_BITS of hashes, put together in chunks on Spark."""
    top = F.shiftrightunsigned("hash", 64 - LARGE_BITS)
    bits = hashes.select(F.shiftright(top, CHUNK_BITS).alias("chunk"), top.bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)).alias("bit")).distinct()

    def pack(t: pa.Table) -> pa.Table:
        bit = np.zeros(1 << CHUNK_BITS, np.uint8)
        bit[t.column("bit").to_numpy()] = 1
        return pa.table({"chunk": pa.array([t.column("chunk")[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bit, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((1 << LARGE_BITS) // 8, np.uint8)
    width = (1 << CHUNK_BITS) // 8
    for r in bits.groupBy("chunk").applyInArrow(pack, "chunk long, bits binary").collect():  # 2^LARGE_BITS bits at most
        out[r.chunk * width : (r.chunk + 1) * width] = np.frombuffer(r.bits, np.uint8)
    return out


def _join(rows: DataFrame, items: DataFrame, folder: str) -> DataFrame:
    """(uid, HIT) of written rows (uid, text), for items of any size: hashes are joined, then what shares one is compared."""
    lengths = tuple("1" * n for n in range(LEAST_WORDS, LEAST_MASKED))
    ours = written(_hashes(items.select(F.col("item").alias("owner"), "text"), MASKS + lengths, True), folder, "seeds")
    theirs = _hashes(rows.select(F.col("uid").alias("owner"), "text"), MASKS + lengths, False, _filter(ours))
    hit = theirs.withColumnRenamed("owner", "uid").join(ours.select("hash", F.col("owner").alias("item"), F.col("place").alias("_p")), "hash")
    pairs = hit.select("uid", "item", (F.col("place") - F.col("_p")).alias("diagonal")).distinct()
    pairs = written(pairs.groupBy("uid", "item").agg(F.array_sort(F.collect_list("diagonal")).alias("diagonals")), folder, "pairs")  # no more than words of both texts
    both = pairs.join(items.select("item", F.col("text").alias("item_text")), "item").join(rows.select("uid", "text"), "uid").select("uid", "text", "item", "item_text", "diagonals")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                uid, text, item, item_text, diagonals = (c[k].as_py() for c in batch.columns)
                best = best_overlap(item_words(text), item_words(item_text), diagonals)
                if best:
                    out.append((uid, item, *best))
            columns = zip(*out, strict=True) if out else ((),) * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, [pa.int64(), *KINDS], strict=True)], names=["uid", *NAMES])

    return both.mapInArrow(run, f"uid long, {HIT}")


def _numbered(df: DataFrame, folder: str) -> DataFrame:
    return written(df.withColumn("uid", F.monotonically_increasing_id()), folder, "rows")


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """A row for each text and benchmark item that overlap."""
    folder = folder or shared_dir(df.sparkSession)
    items, ids = distinct_items(benchmark, folder)
    texts = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    small = _small(items)
    if small:
        found = _scan(texts, small, id_col)
    else:
        rows = _numbered(texts.withColumnRenamed(id_col, "_id"), folder)
        found = _join(rows, items, folder).join(rows.select("uid", "_id"), "uid").withColumnRenamed("_id", id_col)
    return found.join(ids, "item").select(id_col, "item_id", *NAMES[1:])


def clean(df: DataFrame, benchmark: DataFrame, folder: str | None = None) -> DataFrame:
    """Whole rows of df (with a text column) that overlap no item."""
    folder = folder or shared_dir(df.sparkSession)
    items, _ = distinct_items(benchmark, folder)
    small = _small(items)
    if not small:
        rows = written(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("uid")), folder, "rows")
        return rows.join(_join(rows, items, folder).select("uid"), "uid", "left_anti").select("_row.*")
    shared, at = df.sparkSession.sparkContext.broadcast(small), df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for i, j, buf, offsets in tk.chunks(batch.column(at)):
                w = words(buf, offsets)
                keep[[i + r[0] for r in overlaps(shared.value, w.key, w.doc, j - i)]] = False
            yield batch.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents x benchmark -> doc_id, item_id, n_matched, n_span, item_words, item_start, doc_start, coverage."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontamination": op7_decontamination}
ORACLES: dict[str, str] = {}
