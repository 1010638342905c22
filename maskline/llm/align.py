"""Alignment of two tokenizers' tokens over the same bytes, and how often ids meet.

Every text is encoded by a byte-level BPE vocabulary (A) and a piece vocabulary
with byte fallback (B). Byte offsets where tokens of both end cut them into
groups; two tokens whose byte ranges overlap are linked.

Inverted pair bitmaps: for each pair of ids, a chunk of documents holds a
compressed bitmap of the documents that link the pair, and planes of what the
count of links is above one, bit by bit. Bitmaps are made for a few texts at a
time and merged by OR, list by list or bit by bit. Popcounts of the bitmaps,
summed over chunks (which share no document), are the documents of a pair;
planes weigh in with their powers of two for its links. To score documents, the
counts of pairs go back to the chunks, and every posting adds the count of its
pair to the documents in it. Neither texts nor links cross a shuffle: what
does is one row for a pair and chunk, and the bitmaps of a chunk, once.

Defined results: a text that is null or empty, or whose tokens do not join to
the blank and the text byte by byte, has no tokens (all zeros, no groups);
repeated rows are documents of their own; ties for the highest count all are
best; other columns are ignored; an empty table gives an empty result. Texts
are taken whole; one of any length is one document of its chunk. The
vocabularies' paths are parameters; tables are as large as they are.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from maskline.llm import textkit as tk
from maskline.llm.bpe import byte_alphabet
from maskline.llm.exchange import narrow, runs, wide
from maskline.llm.stage import shared_dir, table, written

#: Bytes of text of a chunk of documents, of the texts whose bitmaps are made at once, and parts that a task remembers.
CHUNK_TEXT, PIECE_TEXT, CACHE_PARTS = 32 << 20, 1 << 20, 200_000
BLANK = "▁"
#: Parts that are encoded in one text.
JOINED = 50
#: Where texts are cut into parts: at one blank between other characters. The pattern of A ends a piece there, whatever stands around, and
#: no piece of B has a blank after another character, so neither has a token across.
CUT = re.compile(r"(?<=\S) (?=\S)")


class Tokens(NamedTuple):
    """Tokens of some texts in order: ids, ends (in bytes from the first text's first) and how many each text has."""

    ids: np.ndarray
    end: np.ndarray
    count: np.ndarray


class Pair:
    """Encoders of both vocabularies. Pickles as its paths."""

    def __init__(self, bytes_json: str, bytes_ranks: str, pattern: str, pieces: str):
        self.paths = bytes_json, bytes_ranks, pattern, pieces

    def __getstate__(self):
        return {"paths": self.paths}

    @cached_property
    def a_bytes(self) -> list[bytes]:
        """Id of A -> bytes, by the vocabulary's byte-level alphabet."""
        with open(self.paths[0], encoding="utf-8") as f:
            vocab, alphabet = json.load(f)["model"]["vocab"], byte_alphabet()
        out = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            out[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        return out

    @cached_property
    def b_bytes(self) -> list[bytes]:
        """Id of B -> bytes: U+2581 is a blank, <0xHH> a byte."""
        model = self.b_model
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        return [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace(BLANK, " ").encode() for i, x in enumerate(names)]

    @cached_property
    def a_model(self):
        import tiktoken

        with open(self.paths[1], "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return tiktoken.Encoding("a", pat_str=self.paths[2], mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def b_model(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.paths[3])

    @cached_property
    def a_sizes(self) -> np.ndarray:
        return np.array([len(x) for x in self.a_bytes])

    @cached_property
    def b_sizes(self) -> np.ndarray:
        return np.array([len(x) for x in self.b_bytes])

    def a_ids(self, text: str) -> list[int]:
        return self.a_model.encode_ordinary(" " + text)

    def b_ids(self, text: str) -> list[int]:
        return self.b_model.encode(text) if text else [self.b_model.piece_to_id(BLANK)]  # the encoder adds the blank itself, if there is a text

    def _both(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B of a blank and the text; None where they do not join to it."""
        a, b, whole = self.a_ids(text), self.b_ids(text), (" " + text).encode()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == whole and b"".join(map(self.b_bytes.__getitem__, b)) == whole
        return (np.array(a, np.int32), np.array(b, np.int32)) if same else None

    def _learn(self, parts: list[str]) -> None:
        """Remember the tokens of parts. Those with no white space at their ends are encoded in one text, where none has a token across."""
        known = self.known
        inner = [p for p in parts if p and not p[0].isspace() and not p[-1].isspace()]
        found = [(some, self._both(" ".join(some))) for some in (inner[k : k + JOINED] for k in range(0, len(inner), JOINED))]
        good = [(some, both) for some, both in found if both is not None]
        if good:
            names = [p for some, _ in good for p in some]
            size = np.cumsum([len(p.encode()) + 1 for p in names])
            ids = [np.concatenate([both[k] for _, both in good]) for k in (0, 1)]
            cuts = [(4 * np.searchsorted(np.cumsum(sizes[x]), size, "right")).tolist() for x, sizes in zip(ids, (self.a_sizes, self.b_sizes), strict=True)]
            a, b = ids[0].tobytes(), ids[1].tobytes()
            known.update(zip(names, zip(map(a.__getitem__, map(slice, [0, *cuts[0]], cuts[0])), map(b.__getitem__, map(slice, [0, *cuts[1]], cuts[1])))))  # noqa: B905
        for p in parts:
            if p not in known:
                one = self._both(p)
                known[p] = one and (one[0].tobytes(), one[1].tobytes())

    @cached_property
    def known(self) -> dict[str, tuple[bytes, bytes] | None]:
        return {}

    def encoded(self, texts: list[str | None]) -> tuple[Tokens, Tokens]:
        """Tokens of A and B of the whole texts, part by part; none where they do not join to the blank and the text."""
        # U+2581 is a blank for B, but not for the text
        parts = [CUT.split(t) if t and BLANK not in t else [] for t in texts]
        if len(self.known) > CACHE_PARTS:
            self.known.clear()
        self._learn(list({p for row in parts for p in row}.difference(self.known)))
        found = [[self.known[p] for p in row] for row in parts]
        pairs = [tuple(b"".join(x) for x in zip(*row, strict=True)) if row and None not in row else (b"", b"") for row in found]
        return tuple(self._tokens([x[k] for x in pairs], sizes) for k, sizes in enumerate((self.a_sizes, self.b_sizes)))

    @staticmethod
    def _tokens(blocks: list[bytes], sizes: np.ndarray) -> Tokens:
        ids = np.frombuffer(b"".join(blocks), np.int32).astype(np.int64)
        return Tokens(ids, np.cumsum(sizes[ids]), np.array([len(x) // 4 for x in blocks], np.int64))

    @cached_property
    def written_ids(self) -> np.ndarray:
        """Decimal ids of A and B followed by a comma, then those of A by a bar and of B by a semicolon."""
        n = [range(len(self.a_sizes)), range(len(self.b_sizes))]
        return np.array([f"{i}{end}" for ends in (",,", "|;") for k, end in zip(n, ends, strict=True) for i in k], object)

    def groups(self, a: Tokens, b: Tokens) -> tuple[np.ndarray, list[str]]:
        """(groups of each text, each written as a1,a2|b1;a3|b2,b3)."""
        ends = np.intersect1d(a.end, b.end, assume_unique=True)
        ga, gb = np.searchsorted(ends, a.end), np.searchsorted(ends, b.end)
        n_a, n_b = len(self.a_sizes), len(self.b_sizes)
        last = lambda g: np.append(g[1:] != g[:-1], True)[: len(g)]
        out = np.empty(len(ga) + len(gb), np.int64)
        # all of A of a group come before all of B of it
        out[np.arange(len(ga)) + np.searchsorted(gb, ga)] = a.ids + last(ga) * (n_a + n_b)
        out[np.arange(len(gb)) + np.searchsorted(ga, gb, "right")] = b.ids + n_a + last(gb) * (n_a + n_b)
        text = self.written_ids[out]
        bounds = np.cumsum(np.concatenate([[0], a.count + b.count]))
        per_text = np.searchsorted(ends, np.concatenate([[0], a.end])[np.cumsum(np.concatenate([[0], a.count]))], "right")
        return np.diff(per_text), ["".join(text[i:j].tolist())[:-1] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def links(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, id of A, id of B) of every two tokens that overlap: the union of ends cuts the bytes into their common parts."""
    cuts = np.sort(np.concatenate([a.end, b.end]))
    cuts = cuts[np.append(cuts[1:] != cuts[:-1], True)] if len(cuts) else cuts
    at, bt = np.searchsorted(a.end, cuts), np.searchsorted(b.end, cuts)
    return np.searchsorted(np.cumsum(a.count), at, "right"), a.ids[at], b.ids[bt]


class Bitmaps(NamedTuple):
    """Bitmaps of documents by key: entries sorted by key, then document. Compressed, a key has a list or, if shorter, bits."""

    key: np.ndarray
    doc: np.ndarray

    def packed(self, n_docs: int) -> tuple[np.ndarray, np.ndarray, bytes]:
        """(keys, documents of each, block of lists of two bytes a document and of bits)."""
        begin = np.flatnonzero(np.append(True, self.key[1:] != self.key[:-1])[: len(self.key)])
        count = np.diff(np.append(begin, len(self.key)))
        dense = 16 * count > n_docs
        many = np.repeat(dense, count)
        bits = np.zeros((int(dense.sum()), n_docs), bool)
        bits[(np.cumsum(dense) - 1)[np.repeat(np.arange(len(count)), count)[many]], self.doc[many]] = True
        return self.key[begin], count, np.packbits(bits, axis=1).tobytes() + self.doc[~many].astype("<u2").tobytes()

    @staticmethod
    def unpacked(keys: np.ndarray, count: np.ndarray, block: bytes, n_docs: int) -> Bitmaps:
        dense = 16 * count > n_docs
        width, n = -(-n_docs // 8), int(dense.sum())
        doc = np.empty(int(count.sum()), np.int64)
        many = np.repeat(dense, count)
        doc[many] = np.nonzero(np.unpackbits(np.frombuffer(block, np.uint8, n * width).reshape(n, width), axis=1, count=n_docs))[1] if n else 0
        doc[~many] = np.frombuffer(block, "<u2", offset=n * width)
        return Bitmaps(np.repeat(keys, count), doc)


def merged(parts: list[Bitmaps]) -> Bitmaps:
    """OR of bitmaps."""
    key, doc = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
    order, first = runs([key.astype(np.uint64) << np.uint64(16) | doc.astype(np.uint64)])
    own = order[first]
    return Bitmaps(key[own], doc[own])


def planes(text: np.ndarray, key: np.ndarray) -> list[Bitmaps]:
    """Bitmaps of the documents of each key among links (text, key), then those of each bit of the number of links above one."""
    order, first = runs([key.astype(np.uint64) << np.uint64(16) | text.astype(np.uint64)])
    own = order[first]
    above = np.diff(np.append(np.flatnonzero(first), len(order))) - 1
    out = [Bitmaps(key[own], text[own])]
    while above.any():
        hit = (above & 1).astype(bool)
        out.append(Bitmaps(key[own[hit]], text[own[hit]]))
        above >>= 1
    return out


INDEX = "n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, pairs binary, counts array<binary>, maps array<binary>, members array<binary>"


def _stored(levels: list[list[Bitmaps]], n_docs: int) -> tuple[bytes, list[bytes], list[bytes], list[bytes]]:
    """(pairs, then by plane: documents of each pair, block, which pairs)."""
    counts, blocks, members, pairs = [], [], [], np.zeros(0, np.int64)
    for k, parts in enumerate(levels):
        key, count, block = merged(parts).packed(n_docs)
        pairs = key if k == 0 else pairs
        counts.append(narrow(count))
        blocks.append(block)
        members.append(np.searchsorted(pairs, key).astype("<u4").tobytes() if k else b"")
    return pairs.astype("<i8").tobytes(), counts, blocks, members


def pair_index(df: DataFrame, pair: Pair, id_col: str, text_col: str, folder: str, digest: bool = False) -> DataFrame:
    """Written rows of chunks: ids and alignments of their documents (groups as text, or its SHA-256 if digest), and the bitmaps of pairs."""
    shared = df.sparkSession.sparkContext.broadcast(pair)  # paths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = shared.value
        for batch in batches:
            for i, j, _, _ in tk.chunks(batch.column(1), CHUNK_TEXT):
                part, levels, stats = batch.slice(i, j - i), [], []
                for x, y, _, _ in tk.chunks(part.column(1), PIECE_TEXT):  # an empty batch has none
                    a, b = two.encoded(part.column(1).slice(x, y - x).to_pylist())
                    n_groups, groups = two.groups(a, b)
                    text, p, q = links(a, b)
                    for k, bits in enumerate(planes(text + x, p << 32 | q)):
                        levels += [[]] * (k == len(levels))
                        levels[k] = [*levels[k], bits]
                    stats.append((a.count, b.count, n_groups, tk.per_doc(text, y - x), [hashlib.sha256(g.encode()).hexdigest() if g and digest else g for g in groups]))
                pairs, counts, blocks, members = _stored(levels, j - i)
                one, columns = pa.array([0, j - i], pa.int32()), list(zip(*stats, strict=True))
                lists = [part.column(0), *(pa.array(np.concatenate(c)) for c in columns[:4]), pa.array([g for c in columns[4] for g in c], pa.string())]
                blobs = [pa.array([counts], pa.list_(pa.binary())), pa.array([blocks], pa.list_(pa.binary())), pa.array([members], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([*(pa.ListArray.from_arrays(one, x) for x in lists), pa.array([pairs], pa.binary()), *blobs], names=["ids", *(x.split()[0] for x in INDEX.split(", "))])
        pa.default_memory_pool().release_unused()

    schema = StructType([StructField("ids", ArrayType(df.schema[id_col].dataType)), *StructType.fromDDL(INDEX).fields])
    rows = df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
    return written(rows.withColumn("chunk", F.monotonically_increasing_id()), folder, "index")


def _planes_of(row: dict) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, bytes]]]:
    """(pairs, planes (place of its pair, documents of it, block)) of a row of the index."""
    pairs = np.frombuffer(row["pairs"], "<i8")

    def each():
        for k, (counts, block, member) in enumerate(zip(row["counts"], row["maps"], row["members"], strict=True)):
            place = np.frombuffer(member, "<u4").astype(np.int64) if k else np.arange(len(pairs))
            yield place, wide(counts, len(place)).astype(np.int64), block

    return pairs, each()


def popcounts(index: DataFrame) -> DataFrame:
    """(chunk, pair, n_docs, n_links): documents and links of each pair in each chunk, from the bitmaps' sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs, each = _planes_of(row | {"maps": [b""] * len(row["counts"])})
                docs, total = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
                for k, (place, count, _) in enumerate(each):
                    total[place] += count << max(k - 1, 0)
                    docs = count if k == 0 else docs
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row["chunk"])), pa.array(pairs), pa.array(docs), pa.array(total)], names=["chunk", "pair", "n_docs", "n_links"])

    return index.select("chunk", "pairs", "counts", "members").mapInArrow(run, "chunk long, pair long, n_docs long, n_links long")


def pair_counts(per_chunk: DataFrame) -> DataFrame:
    """(pair, n_docs, n_links, best): corpus-wide; best where no pair of the same id of A has more documents."""
    counts = per_chunk.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links")).withColumn("a", F.shiftright("pair", 32))
    top = counts.groupBy("a").agg(F.max("n_docs").alias("top"))
    return counts.join(top, "a").select("pair", "n_docs", "n_links", (F.col("n_docs") == F.col("top")).alias("best"))


def token_pairs(counts: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links, best): the table of which ids stand for each other."""
    return counts.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n_docs", "n_links", "best")


def _scored(index: DataFrame, scores: DataFrame, id_col: str) -> DataFrame:
    """Postings give the counts of their pairs (chunk, pair, n_docs, best) to their documents."""
    kind = index.schema["ids"].dataType.elementType

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_batches(1):
            values = row.to_pylist()[0] | {"ids": None}
            n_docs = len(values["n_a"])
            pairs, each = _planes_of(values)
            order = np.argsort(right.column("pair").to_numpy()) if len(pairs) else np.zeros(0, np.int64)
            count = right.column("n_docs").to_numpy()[order] if len(pairs) else np.zeros(0, np.int64)
            best = right.column("best").to_numpy()[order].astype(np.int64) if len(pairs) else np.zeros(0, np.int64)
            total, n_best = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
            for k, (place, size, block) in enumerate(each):
                bits = Bitmaps.unpacked(place, size, block, n_docs)
                weight = 1 << max(k - 1, 0)
                np.add.at(total, bits.doc, count[bits.key] * weight)
                hit = best[bits.key] > 0
                n_best += tk.per_doc(bits.doc[hit], n_docs) * weight
            lists = {n: pa.array(values[n], pa.string() if n == "groups" else pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")}
            out.append(pa.table({id_col: row.column("ids")[0].values, **lists, "n_best": pa.array(n_best), "count_sum": pa.array(total), "groups": pa.array(values["groups"], pa.string())}))
        return pa.concat_tables(out)

    schema = StructType([StructField(id_col, kind), *StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string").fields])
    return index.groupBy("chunk").cogroup(scores.groupBy("chunk")).applyInArrow(work, schema)


def alignments(df: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, digest: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for each row; with digest, the SHA-256 of groups in their place."""
    folder = folder or shared_dir(df.sparkSession)
    index = pair_index(df, pair, id_col, text_col, folder, digest)
    per_chunk = written(popcounts(index), folder, "popcounts")
    counts = written(pair_counts(per_chunk), folder, "pairs")
    return _scored(index, per_chunk.select("chunk", "pair").join(counts.select("pair", "n_docs", "best"), "pair"), id_col)


def default_pair() -> Pair:
    import public_tokenizers

    path = public_tokenizers.path
    return Pair(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, path("piece_bpe_32k.model"))


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    found = alignments(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")), default_pair(), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES = {"op12_cross_tokenizer": op12_cross_tokenizer}
ORACLES: dict[str, str] = {}
