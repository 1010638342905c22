"""Chunks of texts, and questions that chunks put to slices of hash space.

A chunk is one written row with the texts of some neighbouring rows, so that a
later pass meets the same texts in the same order. What chunks have to know of
each other goes by hash: a chunk deals its distinct hashes, sorted, out to
slices, each as one block of small differences; a slice answers every hash with
one bit, in the order of the question. So a hash costs two to eight bytes on
its way there and a bit on its way back, and no slice sees a text. A hash that
every chunk holds is one entry of each: no value makes a slice large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from maskline.llm import textkit as tk
from maskline.llm.stage import written

#: Bytes of text in a chunk (one longer text is a chunk of its own), and hashes in a slice.
CHUNK_TEXT, SLICE_KEYS = 4 << 20, 2_000_000
#: Tasks that slices are dealt to at most; each then takes several, one after the other.
MOST_TASKS = 20_000


class Chunk(NamedTuple):
    number: int
    keys: pa.Array
    buf: np.ndarray
    offsets: np.ndarray


def counted(buf: np.ndarray, offsets: np.ndarray, split: np.ndarray) -> np.ndarray:
    """Runs of bytes outside split in each text."""
    if not len(buf):
        return np.zeros(len(offsets) - 1, np.int64)
    inside = ~split[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(buf)]
    first[heads] = inside[heads]
    return np.diff(np.concatenate([[0], np.cumsum(first)])[offsets])


def chunked(df: DataFrame, key_col: str, text_col: str, split: np.ndarray, folder: str) -> DataFrame:
    """Written rows (chunk, keys array, words array<long>, offsets, texts) of df; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in tk.chunks(batch.column(1), CHUNK_TEXT):
                one = pa.array([0, j - i], pa.int32())
                keys = pa.ListArray.from_arrays(one, batch.column(0).slice(i, j - i))
                words = pa.ListArray.from_arrays(one, pa.array(counted(buf, offsets, split)))
                texts = pa.compress(buf.tobytes(), "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([keys, words, pa.array([offsets.astype(np.int64).tobytes()], pa.binary()), pa.array([texts], pa.binary())], names=["keys", "words", "offsets", "texts"])

    schema = StructType([StructField("keys", ArrayType(df.schema[key_col].dataType)), *StructType.fromDDL("words array<long>, offsets binary, texts binary").fields])
    rows = df.select(F.col(key_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
    return written(rows.withColumn("chunk", F.monotonically_increasing_id()), folder, "chunks")


def opened(table: pa.Table | pa.RecordBatch) -> Iterator[Chunk]:
    """The chunks in rows of chunked()."""
    get = {n: table.column(n) for n in ("chunk", "keys", "offsets", "texts")}
    for k in range(table.num_rows):
        offsets = np.frombuffer(get["offsets"][k].as_py(), np.int64)
        buf = np.frombuffer(pa.decompress(get["texts"][k].as_py(), int(offsets[-1]), "zstd"), np.uint8)
        yield Chunk(get["chunk"][k].as_py(), get["keys"][k].values, buf, offsets)


def slices_for(spark: SparkSession, n_keys: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_keys // SLICE_KEYS), 1)


def filter_bits(n_keys: int) -> int:
    """Leading bits of a hash by which a filter tells so many hashes apart but for some one in 4,000."""
    return min(64, n_keys.bit_length() + 12)


def cut(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> np.uint64(64 - bits) << np.uint64(64 - bits)


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as their byte planes, no more than the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def wide(block: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(block, np.uint8, offset=1).reshape(block[0], n)
    out = np.zeros((n, 8), np.uint8)
    out[:, : block[0]] = planes.T
    return out.reshape(-1).view("<u8")


def ranged(values: np.ndarray) -> bytes:
    """Signed whole numbers as the least one and what each is above it."""
    least = values.min() if len(values) else 0
    return int(least).to_bytes(8, "little", signed=True) + narrow(values.view(np.uint64) - np.int64(least).view(np.uint64))


def from_range(block: bytes, n: int) -> np.ndarray:
    return (wide(block[8:], n) + np.frombuffer(block[:8], "<u8")[0]).view(np.int64)


def packed(keys: np.ndarray, bits: int = 64) -> bytes:
    """Sorted hashes as the first one and the differences."""
    keys = keys >> np.uint64(64 - bits)
    return keys[:1].astype("<u8").tobytes() + narrow(np.diff(keys))


def unpacked(block: bytes, n: int, bits: int = 64) -> np.ndarray:
    steps = np.concatenate([np.frombuffer(block[:8], "<u8"), wide(block[8:], n - 1)])
    return np.cumsum(steps, dtype=np.uint64) << np.uint64(64 - bits)


def cuts(keys: np.ndarray, slices: int) -> list[tuple[int, int, int]]:
    """(slice, first, last) of the runs of sorted hashes that go to one slice."""
    which = ((keys >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
    edge = np.flatnonzero(np.diff(which)) + 1
    bounds = [0, *edge.tolist(), len(keys)] if len(keys) else [0]
    return [(int(which[a]), a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def answered(questions: DataFrame, slices: int, work: Callable[[pa.Table], list[np.ndarray]], *group: str) -> DataFrame:
    """(chunk, group..., slice, bits) for questions (slice, chunk, group..., ...).

    work gets all questions of a slice (and group) and returns an array of truth values for each.
    """
    tasks = min(slices, MOST_TASKS)
    dealt = questions.repartitionById(tasks, F.pmod("slice", F.lit(tasks)).cast("int")).sortWithinPartitions("slice", *group)
    by, kinds = ["slice", *group], [questions.schema[g] for g in group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, own = [], None

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(rest)
            bits = [np.packbits(x).tobytes() for x in work(t)]
            columns = {"chunk": t.column("chunk"), **{g: t.column(g) for g in group}, "slice": t.column("slice"), "bits": pa.array(bits, pa.binary())}
            return pa.Table.from_pydict(columns).combine_chunks().to_batches()[0]

        for batch in batches:
            names = list(zip(*(batch.column(g).to_pylist() for g in by), strict=True))
            edge = [k for k in range(1, len(names)) if names[k] != names[k - 1]]
            for a, b in zip([0, *edge], [*edge, len(names)], strict=True):
                if a == b:
                    continue
                if rest and names[a] != own:
                    yield done()
                    rest = []
                own = names[a]
                rest.append(batch.slice(a, b - a))
        if rest:
            yield done()

    schema = StructType([StructField("chunk", questions.schema["chunk"].dataType), *kinds, *StructType.fromDDL("slice long, bits binary").fields])
    return dealt.mapInArrow(run, schema)


def truth(answers: pa.Table, sizes: dict[int, int]) -> np.ndarray:
    """The bits of a chunk's answers in the order of its sorted hashes; sizes: hashes by slice, in order."""
    bits = dict(zip(answers.column("slice").to_pylist(), answers.column("bits").to_pylist(), strict=True))
    parts = [np.unpackbits(np.frombuffer(bits[s], np.uint8), count=n) for s, n in sizes.items()]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def sorted_order(keys: np.ndarray) -> np.ndarray:
    """Order of 64-bit keys. Their leading bits are sorted together with the places, which is far faster than sorting places by key."""
    low = np.uint64(len(keys).bit_length())
    order = (np.sort(keys >> low << low | np.arange(len(keys), dtype=np.uint64)) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int32 if len(keys) < 1 << 31 else np.int64)
    found = keys[order]
    if (found[1:] < found[:-1]).any():  # a few keys with equal leading bits
        order = order[np.argsort(found, kind="stable")]
    return order


def runs(order_by: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, first) of rows sorted by the arrays, first one first: which of the sorted rows begins a run of equal rows."""
    order = np.lexsort(order_by[::-1]) if len(order_by) > 1 else sorted_order(order_by[0])
    first = np.ones(len(order), bool)
    if len(order):
        first[1:] = False
        for x in order_by:
            y = x[order]
            first[1:] |= y[1:] != y[:-1]
    return order, first


def joined_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, size of each word with its blank) of words followed by one blank each, but for those that are last in their text."""
    size = end - start + ~last
    begin = np.cumsum(size) - size
    body = np.repeat(start - begin, size) + np.arange(int(size.sum()))
    out = buf[np.minimum(body, max(len(buf) - 1, 0))] if len(buf) else np.zeros(0, np.uint8)
    out[(begin + size - 1)[~last]] = 0x20
    return out, size
