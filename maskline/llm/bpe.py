"""Byte-level BPE encoding and decoding with the vocabulary of a public tokenizer.

Encoding does not replay merges. An Aho-Corasick automaton finds the longest
token at each place of a piece; a token is taken only if it is compatible with
the one before it, that is, if merging by rank would not have joined across
their border. A table remembers which pairs are compatible. Where no token
fits, the last one is given back and a shorter prefix is tried; places that
failed are never tried again, so the work is linear in the piece. The result is
exactly that of merging by rank. Decoding gathers bytes through a table of
offsets into one block that holds all tokens.

Texts are split into pieces by the tokenizer's pattern, and pieces are encoded
once per task (a cache of bounded size). Strings of special tokens in a text
become their ids.

Defined results: a null or empty text has no ids and decodes to an empty text;
unknown ids are an error; ids that are not whole UTF-8 decode with U+FFFD;
repeated rows are encoded row by row; columns beside id and text are ignored.
The vocabulary's path is a parameter, and its size (about 50,000 tokens) is
that of the file, not of the data.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.llm.stage import table, with_id
#: The pattern that splits a text into pieces, of the public vocabulary. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of PLAIN characters only, where these ranges are the letters, digits and white space.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
PLAIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+"
NOT_PLAIN = re.compile("[^\t\n\r -~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-ſ‐-‧‰-⁞₠-₿]")
#: Pieces that a task remembers in each of two generations, the longest of them, and pairs of tokens.
CACHE_PIECES, CACHE_LENGTH, CACHE_PAIRS = 80_000, 64, 400_000
#: Rows that go back to the JVM at once.
OUT_ROWS = 1000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in -> byte, by the rule of byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file. Pickles as its tables alone."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab, model = spec["model"]["vocab"], spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.tokens[i] = bytes(alphabet[c] for c in text)
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        self.ordinary = sorted(vocab.values())
        self.sizes = [len(x) for x in self.tokens]
        self.left, self.right = list(range(size)), list(range(size))
        self.joined: dict[tuple[int, int], int] = {}
        #: id -> order of its merge; bytes come first
        self.rank = [0] * size
        for place, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            if self.joined.setdefault((i, j), k) == k and self.left[k] == k:
                self.left[k], self.right[k], self.rank[k] = i, j, place + 1

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "shorter", "decode_tables", "patterns", "compatible")}

    @cached_property
    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for i in self.ordinary:
            a.add_word(self.tokens[i].decode("latin-1"), i)
        a.make_automaton()
        return a

    @cached_property
    def shorter(self) -> dict[int, int]:
        """Token -> longest token that is a proper prefix of it, or -1."""
        by_bytes = {self.tokens[i]: i for i in self.ordinary}
        find = lambda t: next((by_bytes[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_bytes), -1)
        return {i: find(self.tokens[i]) for i in self.ordinary}

    @cached_property
    def compatible(self) -> dict[tuple[int, int], bool]:
        return {}

    def fits(self, a: int, b: int) -> bool:
        """True if merging by rank leaves the border between tokens a and b.

        Undo merges of the two, latest first; no earlier merge may join the parts that touch.
        """
        known = self.compatible.get((a, b))
        if known is not None:
            return known
        rank, x, y = self.rank, a, b
        good, limit = True, len(self.tokens) + 1  # a merge across the border comes first if its rank is under limit
        while good:
            over = self.joined.get((x, y))
            if over is not None and rank[over] < limit:
                good = False
            elif rank[x] > rank[y]:
                limit, x = rank[x], self.right[x]
            elif rank[y] > 0:  # of equal ranks the leftmost merge comes first: that across the border
                limit, y = rank[y] + 1, self.left[y]
            else:
                break
        self.compatible[a, b] = good
        return good

    def encode_piece(self, piece: bytes) -> list[int]:
        n, size, shorter, compatible = len(piece), self.sizes, self.shorter, self.compatible
        longest = [-1] * n
        for end, i in self.automaton.iter(piece.decode("latin-1")):  # ends rise, so the last match at a place is its longest
            longest[end + 1 - size[i]] = i
        if n and size[longest[0]] == n:  # every token is its own encoding
            return [longest[0]]
        taken: list[int] = []
        open_at = bytearray(b"\x01" * (n + 1))
        at, token = 0, longest[0] if n else -1
        while at < n:
            end = at + size[token]
            if open_at[end]:
                good = not taken or compatible.get((taken[-1], token))
                if good is None:
                    good = self.fits(taken[-1], token)
                if good:
                    taken.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    continue
            token = shorter[token]
            if token < 0:  # nothing fits here: give back the last token
                open_at[at] = 0
                token = taken.pop()
                at -= size[token]
        return taken

    @cached_property
    def patterns(self):
        import regex

        plain = re.compile(PLAIN_PATTERN)
        every = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        return plain, every, special

    def pieces(self, text: str) -> list[str]:
        plain, every, _ = self.patterns
        return (every if NOT_PLAIN.search(text) else plain).findall(text)

    def encoder(self):
        """A function text -> int32 ids that remembers pieces."""
        codec = self

        class Known(dict):
            """Pieces of this and the last generation: what is in use survives when the older half is dropped."""

            older: dict[str, bytes] = {}

            def __missing__(self, piece: str) -> bytes:
                ids = self.older.get(piece)
                if ids is None:
                    ids = array("i", codec.encode_piece(piece.encode())).tobytes()
                if len(piece) <= CACHE_LENGTH:
                    if len(self) >= CACHE_PIECES:
                        self.older = dict(self)
                        self.clear()
                        if len(codec.compatible) > CACHE_PAIRS:
                            codec.compatible.clear()
                    self[piece] = ids
                return ids

        known = Known()
        special = self.patterns[2]

        def encode(text: str | None) -> np.ndarray:
            parts = special.split(text or "") if special else [text or ""]
            ids = [b"".join(map(known.__getitem__, self.pieces(p))) if k % 2 == 0 else np.int32(self.special[p]).tobytes() for k, p in enumerate(parts)]
            return np.frombuffer(b"".join(ids), np.int32)

        return encode

    @cached_property
    def decode_tables(self) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.cumsum([0, *map(len, self.tokens)])
        return np.frombuffer(b"".join(self.tokens), np.uint8), offsets

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        block, offsets = self.decode_tables
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens)):
            raise ValueError("an id that is not in the vocabulary")
        size = offsets[ids + 1] - offsets[ids]
        begin = np.cumsum(size) - size
        return block[np.repeat(offsets[ids] - begin, size) + np.arange(int(size.sum()))].tobytes()


def _encoded(encoder: Callable[[str | None], np.ndarray], texts: pa.Array) -> pa.ListArray:
    found = [encoder(t.as_py()) for t in texts]
    offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))


def _decoded(codec: Codec, ids: pa.ListArray) -> pa.Array:
    texts = [codec.decode_bytes(pc.fill_null(i.values, -1).to_numpy(zero_copy_only=False) if i.is_valid else np.zeros(0, np.int32)).decode("utf-8", "replace") for i in ids]
    return pa.array(texts, pa.string())


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row; no shuffle."""
    codec = df.sparkSession.sparkContext.broadcast(Codec(vocabulary))  # as large as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec.value.encoder()
        for batch in batches:
            for k in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(k, OUT_ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), _encoded(encoder, part.column(1))], names=[id_col, "ids"])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, with_id(df, id_col, "ids array<int>"))


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded string) for each row; null ids count as none."""
    codec = df.sparkSession.sparkContext.broadcast(Codec(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(k, OUT_ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _decoded(codec.value, part.column(1))], names=[id_col, ids_col, "decoded"])

    return df.select(id_col, ids_col).mapInArrow(run, with_id(df, id_col, f"{ids_col} array<int>, decoded string"))


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded string) for each row: encoded, and its ids decoded, by one Python worker, so that a task needs one copy of the tables."""
    codec = df.sparkSession.sparkContext.broadcast(Codec(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec.value.encoder()
        for batch in batches:
            for k in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(k, OUT_ROWS)
                ids = _encoded(encoder, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, _decoded(codec.value, ids)], names=[id_col, "ids", "decoded"])
        pa.default_memory_pool().release_unused()  # the worker lives on

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, with_id(df, id_col, "ids array<int>, decoded string"))


def digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded, then its ids decoded."""
    return round_trip(df, vocabulary, id_col).select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return digests(table(spark, sf_dir, "documents"), default_vocabulary())


QUERIES = {"op1_bpe": op1_bpe}
ORACLES: dict[str, str] = {}
