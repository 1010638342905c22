"""Vectorised work on whole Arrow batches of text: word and line segments and
their 64-bit hashes, without a Python loop over words.

Words are maximal runs outside U+0020 and U+0009..U+000D. Segments with equal
bytes get equal hashes on every executor (no dependence on Python's hash seed).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once; a longer text is cut at white space. Scratch arrays take some forty times as much.
CHUNK_BYTES = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NEWLINES = np.zeros(256, bool)
NEWLINES[0x0A] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(0, 2**64, 1 << 16, dtype=np.uint64) | np.uint64(1)
_SPAN = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (published constants of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Segments(NamedTuple):
    doc: np.ndarray  # index of the text in the chunk
    start: np.ndarray  # first byte in the chunk
    end: np.ndarray  # one past the last byte
    key: np.ndarray  # uint64 hash of the bytes


def chunks(texts: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) for runs of texts of about max_bytes; null counts as empty."""
    arr = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(arr)
    if not n:
        return
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def segments(buf: np.ndarray, offsets: np.ndarray, split: np.ndarray = SPACES, fold: np.ndarray | None = None) -> Segments:
    """Maximal runs of bytes that split does not name, none across two texts. fold maps bytes before hashing."""
    if len(buf) > 2 * CHUNK_BYTES:  # one very long text: piecewise, so that scratch arrays stay small
        cut, parts, at = CHUNK_BYTES, [], 0
        marks = np.flatnonzero(split[buf])
        while at < len(buf):
            k = int(np.searchsorted(marks, at + cut))
            to = int(marks[k]) + 1 if k < len(marks) else len(buf)
            inner = np.unique(np.clip(offsets, at, to)) - at
            inner = np.array([0, to - at]) if len(inner) < 2 else inner
            s = _segments(buf[at:to], inner, split, fold)
            parts.append((s.start + at, s.end + at, s.key))
            at = to
        start, end, key = (np.concatenate(x) for x in zip(*parts, strict=True))
        return Segments(np.searchsorted(offsets, start, "right") - 1, start, end, key)
    return _segments(buf, offsets, split, fold)


def _segments(buf: np.ndarray, offsets: np.ndarray, split: np.ndarray, fold: np.ndarray | None) -> Segments:
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, np.zeros(0, np.uint64))
    inside = ~split[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = end - start
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    body = buf[inside] if fold is None else fold[buf[inside]]
    value = _BYTE[body] * _PLACE[place & 0xFFFF]
    key = mix(np.add.reduceat(value, begin) + size.astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
    return Segments(np.searchsorted(offsets, start, "right") - 1, start, end, key)


def windows(key: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of each run of width segments that lies in one text."""
    m = len(key) - width + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for k in range(width):
        total += key[k : k + m] * _SPAN[k]
    at = np.flatnonzero(doc[:m] == doc[width - 1 :])
    return at, mix(total[at])


def per_doc(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, n).astype(np.int64)


def salted(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts."""
    return mix(key + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
