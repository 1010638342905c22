"""Scoring of whole texts by a gated recurrent language model, trained here.

Words are lower-cased in ASCII; every text ends with one end token. Counting is
exact and covers all training texts: a table of distinct words per chunk of
texts is summed by word and joined back by chunk, so no vocabulary ever meets
the driver or a single task.

The model (numpy) is a recurrent network with one gate. Its output softmax is
factored into CLASSES classes of WIDTH words: the probability of a word is that
of its class times that within the class. The most frequent words have their
own place; the rest fall into WIDTH buckets by their last letters, the first
class, and a word's share of its bucket is its smoothed count. So every string
has a probability; the known words and one unseen word per bucket sum to one
(each unseen string gets the share of that one). Training is truncated
backpropagation: a task's texts follow one another, their flow is cut into
STREAMS, each stream reads the word before its first one, and the state is
carried from window to window. Each task trains a copy on its own part of the
texts and the copies are averaged, ROUNDS times; together the rounds see every
training text once. Which texts a task holds depends on how the table is laid
out, so another layout gives somewhat other weights and scores; counts and base
scores do not change. Scoring carries the state through the whole text,
whatever its length.

Defined results: a null or empty text is its end token alone; a null id counts
as not held out; repeated rows are scored row by row; an empty training set
gives base scores of log10(1 / 1) = 0 and a model that knows nothing; other
columns are ignored. Words are told apart by 59-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.llm import textkit as tk
from maskline.llm.stage import shared_dir, table, written

CLASSES, WIDTH, HIDDEN = 32, 32, 16
#: Streams side by side, words in a window, rounds of averaging, first step size.
STREAMS, WINDOW, ROUNDS, STEP = 256, 16, 3, 0.01
#: Bytes of text in a chunk, and states whose outputs are computed together.
CHUNK_BYTES, OUTPUTS = 6 << 20, 16_384
#: A place among a chunk's keys and its count share one long: the count takes the low bits.
COUNT_BITS = 40
SIZE = CLASSES * WIDTH
_LOW = np.uint64(WIDTH - 1)
#: Key of the end token; no word has it, as words of bucket 0 never hash to 0 but for chance.
END = np.uint64(0)


def word_keys(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of each token of each text with its end token, tokens per text). The low bits of a key are its bucket."""
    w = tk.segments(buf, offsets, fold=tk.LOWER)
    n = len(offsets) - 1
    lengths = tk.per_doc(w.doc, n) + 1
    keys = np.full(int(lengths.sum()), END, np.uint64)
    if len(w.key):
        last = tk.LOWER[buf[w.end - 1]].astype(np.uint64)
        before = np.where(w.end - w.start > 1, tk.LOWER[buf[np.maximum(w.end - 2, 0)]], 0).astype(np.uint64)
        bucket = tk.mix(before * np.uint64(256) + last) & _LOW
        keys[np.arange(len(w.key)) + w.doc] = (w.key & ~_LOW) | bucket
    return keys, lengths


def packed(places: np.ndarray) -> bytes:
    """Places as compressed planes of bytes; the more frequent a key the smaller its place, so the upper planes are nearly empty."""
    return zlib.compress(np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def chunked(docs: DataFrame, id_col: str, text_col: str, held: Column) -> DataFrame:
    """One row per chunk of texts: ids, held-out marks, token counts, distinct keys by falling frequency, their training counts, and the tokens as places among the keys."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held_out = np.array(batch.column(1).to_pylist(), bool)
            for i, j, buf, offsets in tk.chunks(batch.column(2), CHUNK_BYTES):
                keys, lengths = word_keys(buf, offsets)
                own, place, times = np.unique(keys, return_inverse=True, return_counts=True)
                order = np.argsort(-times, kind="stable")
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order))
                own, place = own[order], rank[place]
                train = np.bincount(place[np.repeat(~held_out[i:j], lengths)], minlength=len(own))
                one = [own.tobytes(), packed(train), packed(place), lengths.tobytes(), held_out[i:j].tobytes()]
                del keys, order, rank, place, train
                ids = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(0).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([x], pa.binary()) for x in one)], names=["ids", "own", "train", "place", "lengths", "held"])

    rows = docs.select(F.col(id_col), F.coalesce(held, F.lit(False)), F.col(text_col).cast("string"))
    out = rows.mapInArrow(run, f"ids array<{id_type}>, own binary, train binary, place binary, lengths binary, held binary")
    return out.withColumn("chunk", F.monotonically_increasing_id())


def chunk_keys(chunks: DataFrame) -> DataFrame:
    """(chunk, place, key, n): training count of each distinct key of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, own, train in zip(*batch.columns, strict=True):
                key, n = np.frombuffer(own.as_py(), np.int64), unpacked(train.as_py())
                for k in range(0, len(key), 20_000):
                    part, times = key[k : k + 20_000], n[k : k + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk.as_py())), pa.array(np.arange(k, k + len(part))), pa.array(part), pa.array(times)], names=["chunk", "place", "key", "n"])

    return chunks.select("chunk", "own", "train").mapInArrow(run, "chunk long, place long, key long, n long")


class Vocabulary:
    """Places of the frequent words, and totals of the buckets of the rest. Of fixed size."""

    def __init__(self, words: list[tuple[int, int]], rest: dict[int, tuple[int, int]], total: int, distinct: int):
        keys = np.array([w for w, _ in words], np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.places = keys[order], np.arange(WIDTH, WIDTH + len(keys))[order]
        self.total, self.distinct = total, distinct
        self.rest = np.array([rest.get(b, (0, 0)) for b in range(WIDTH)], np.float64)
        counts = np.zeros(SIZE)
        counts[:WIDTH] = self.rest[:, 0]
        counts[WIDTH : WIDTH + len(words)] = [n for _, n in words]
        self.counts = counts

    def place(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        return np.where(known, self.places[at] if len(self.keys) else 0, (keys & _LOW).astype(np.int64))

    def share(self, place: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 of a word's part of its place: 0 for words of their own place, else the smoothed count in the bucket."""
        total, distinct = self.rest[np.minimum(place, WIDTH - 1)].T
        return np.where(place < WIDTH, np.log10((count + 1) / (total + distinct + 1)), 0.0)


class Network:
    NAMES = ("embed", "recur", "to_class", "class_bias", "to_word", "word_bias")

    def __init__(self, parameters: list[np.ndarray]):
        self.p = [np.array(x, np.float32) for x in parameters]

    @classmethod
    def fresh(cls, counts: np.ndarray) -> Network:
        """Small random weights; the biases reproduce word frequencies."""
        rng = np.random.default_rng(5)
        normal = lambda scale, *shape: rng.normal(0, scale, shape)
        share = (counts.reshape(CLASSES, WIDTH) + 0.5) / (counts.sum() + 0.5 * SIZE)
        return cls([
            normal(0.3, SIZE, 2 * HIDDEN), normal(0.25, HIDDEN, 2 * HIDDEN), normal(0.1, HIDDEN, CLASSES), np.log(share.sum(1)),
            normal(0.1, CLASSES, HIDDEN, WIDTH), np.log(share / share.sum(1, keepdims=True)),
        ])

    def advance(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(state, gate, candidate) after reading x."""
        z = self.p[0][x]
        z += h @ self.p[1]
        z[:, :HIDDEN] *= 0.5
        np.tanh(z, out=z)
        gate, new = z[:, :HIDDEN] * 0.5 + 0.5, z[:, HIDDEN:]
        return new + gate * (h - new), gate, new

    def by_class(self, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        group = y // WIDTH
        order = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[order], np.arange(CLASSES + 1))
        for k in range(CLASSES):
            if bounds[k + 1] > bounds[k]:
                yield k, order[bounds[k] : bounds[k + 1]]

    def log_probability(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of the probability of y after states h."""
        a = h @ self.p[2] + self.p[3]
        a -= a.max(1, keepdims=True)
        out = a[np.arange(len(y)), y // WIDTH] - np.log(np.exp(a).sum(1))
        for k, rows in self.by_class(y):
            b = h[rows] @ self.p[4][k] + self.p[5][k]
            b -= b.max(1, keepdims=True)
            out[rows] += b[np.arange(len(rows)), y[rows] % WIDTH] - np.log(np.exp(b).sum(1))
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(gradients of the mean loss, last state) of one window; x and y are (time, stream)."""
        steps, streams = x.shape
        states, gates, news = [h], [], []
        for t in range(steps):
            h, g, c = self.advance(x[t], h)
            states.append(h)
            gates.append(g)
            news.append(c)
        flat, target = np.concatenate(states[1:]), y.reshape(-1)
        grad = [np.zeros_like(q) for q in self.p]
        a = flat @ self.p[2] + self.p[3]
        a = np.exp(a - a.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        a[np.arange(len(target)), target // WIDTH] -= 1
        grad[2], grad[3] = flat.T @ a, a.sum(0)
        down = a @ self.p[2].T
        for k, rows in self.by_class(target):
            own = flat[rows]
            b = own @ self.p[4][k] + self.p[5][k]
            b = np.exp(b - b.max(1, keepdims=True))
            b /= b.sum(1, keepdims=True)
            b[np.arange(len(rows)), target[rows] % WIDTH] -= 1
            grad[4][k], grad[5][k] = own.T @ b, b.sum(0)
            down[rows] += b @ self.p[4][k].T
        down = down.reshape(steps, streams, HIDDEN)
        later = np.zeros_like(h)
        inner = np.empty((steps, streams, 2 * HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            d, g, c = down[t] + later, gates[t], news[t]
            inner[t, :, :HIDDEN] = d * (states[t] - c) * g * (1 - g)
            inner[t, :, HIDDEN:] = d * (1 - g) * (1 - c * c)
            grad[1] += states[t].T @ inner[t]
            later = d * g + inner[t] @ self.p[1].T
        read = x.reshape(-1)
        order = np.argsort(read, kind="stable")
        first = np.flatnonzero(np.diff(read[order], prepend=-1))
        grad[0][read[order[first]]] = np.add.reduceat(inner.reshape(-1, 2 * HIDDEN)[order], first)
        return [g / len(target) for g in grad], h


class Trainer:
    """Adam over the windows of streams that are cut from a flow of texts."""

    def __init__(self, net: Network, end: int, step: float):
        self.net, self.last, self.step, self.seen, self.tokens = net, end, step, 0, 0
        self.mean, self.square = ([np.zeros_like(q) for q in net.p] for _ in range(2))
        self.waiting = np.zeros(0, np.int64)

    def feed(self, words: np.ndarray) -> None:
        self.waiting = np.concatenate([self.waiting, words])
        steps = len(self.waiting) // STREAMS
        if steps >= WINDOW:
            self.learn(self.waiting[: steps * STREAMS], STREAMS)
            self.waiting = self.waiting[steps * STREAMS :]

    def finish(self) -> None:
        if len(self.waiting):
            self.learn(self.waiting, 1)

    def learn(self, flow: np.ndarray, streams: int) -> None:
        """Train on a flow of words, cut into streams; each reads the word before its first one."""
        x, y = (v.reshape(streams, -1).T for v in (np.concatenate([[self.last], flow[:-1]]), flow))
        self.last = int(flow[-1])
        h = np.zeros((y.shape[1], HIDDEN), np.float32)
        self.tokens += y.size
        for t in range(0, len(y), WINDOW):
            grad, h = self.net.gradients(x[t : t + WINDOW], y[t : t + WINDOW], h)
            self.seen += 1
            rate = self.step * np.sqrt(1 - 0.999**self.seen) / (1 - 0.9**self.seen)
            for q, g, m, v in zip(self.net.p, grad, self.mean, self.square, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * m / (np.sqrt(v) + 1e-8)


def train(chunks: DataFrame, vocabulary: Vocabulary) -> Network:
    """Rounds of training in parallel on disjoint parts of the training texts, averaged by tokens after each."""
    net = Network.fresh(vocabulary.counts)
    end = int(vocabulary.place(np.array([END]))[0])
    if not vocabulary.total:
        return net
    spark = chunks.sparkSession
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast((vocabulary, net.p))  # SIZE words and the weights: fixed
        step = STEP / 2**r

        def run(batches: Iterator[pa.RecordBatch], shared=shared, step=step) -> Iterator[pa.RecordBatch]:
            words, weights = shared.value
            trainer = Trainer(Network(weights), end, step)
            for batch in batches:
                for own, place, lengths, held in zip(*batch.columns, strict=True):
                    places = words.place(np.frombuffer(own.as_py(), np.uint64))[unpacked(place.as_py())]
                    learn = ~np.frombuffer(held.as_py(), bool)
                    trainer.feed(places[np.repeat(learn, np.frombuffer(lengths.as_py(), np.int64))])
            trainer.finish()
            if trainer.tokens:
                flat = np.concatenate([q.reshape(-1) for q in trainer.net.p]).astype(np.float64) * trainer.tokens
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat), pa.array(np.full(len(flat), trainer.tokens))], names=["i", "v", "n"])

        part = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(ROUNDS)) == r).select("own", "place", "lengths", "held")
        sums = part.mapInArrow(run, "i long, v double, n long").groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("i").toPandas()  # a row per weight
        if len(sums):
            flat, at, new = (sums.v / sums.n).to_numpy(), 0, []
            for q in net.p:
                new.append(flat[at : at + q.size].reshape(q.shape))
                at += q.size
            net = Network(new)
    return net


def text_scores(net: Network, words: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """Natural log-probability of each text; the longest texts first, side by side, each with its state carried to its end."""
    order = np.argsort(-lengths, kind="stable")
    size, start = lengths[order], (np.cumsum(lengths) - lengths)[order]
    out = np.zeros(len(lengths))
    h = np.zeros((len(lengths), HIDDEN), np.float32)
    states, targets, owners, held = [], [], [], 0
    x = np.full(len(lengths), end)
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")
    for t in range(longest):
        n = int(active[t])
        h, _, _ = net.advance(x[:n], h[:n])
        x = words[start[:n] + t]
        states.append(h)
        targets.append(x)
        owners.append(order[:n])
        held += n
        if held >= OUTPUTS or t + 1 == longest:
            value = net.log_probability(np.concatenate(states), np.concatenate(targets))
            out += np.bincount(np.concatenate(owners), value, len(out))
            states, targets, owners, held = [], [], [], 0
    return out


def scores(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    chunks = written(chunked(docs, id_col, text_col, held), folder, "chunks")
    counts = written(chunk_keys(chunks).groupBy("key").agg(F.sum("n").alias("c")), folder, "counts")
    seen = counts.where("c > 0")
    top = [(r.key, r.c) for r in seen.orderBy(F.col("key") != int(END), F.desc("c"), "key").limit(SIZE - WIDTH).collect()]  # the end token always has a place
    total, distinct = seen.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    buckets = seen.groupBy(F.col("key").bitwiseAND(F.lit(WIDTH - 1)).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # WIDTH rows
    rest = {r.b: [r.c, r.v] for r in buckets}
    for key, c in top:
        rest[key & (WIDTH - 1)][0] -= c
        rest[key & (WIDTH - 1)][1] -= 1
    vocabulary = Vocabulary(top, {b: tuple(x) for b, x in rest.items()}, total, distinct)
    shared = spark.sparkContext.broadcast((vocabulary, train(chunks, vocabulary).p))
    end = int(vocabulary.place(np.array([END]))[0])
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    id_type = docs.schema[id_col].dataType.simpleString()

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        words, weights = shared.value
        net, out = Network(weights), []
        tagged = found.column("tag").to_numpy()
        for row in texts.to_batches():
            for ids, own, place, lengths, held_out in zip(*(row.column(n) for n in ("ids", "own", "place", "lengths", "held")), strict=True):
                own, place, lengths = np.frombuffer(own.as_py(), np.uint64), unpacked(place.as_py()), np.frombuffer(lengths.as_py(), np.int64)
                count = np.zeros(len(own))
                count[tagged >> COUNT_BITS] = tagged & ((1 << COUNT_BITS) - 1)
                where = words.place(own)
                doc = np.repeat(np.arange(len(lengths)), lengths)
                summed = lambda v: np.bincount(doc, v[place], len(lengths))  # noqa: E731, B023
                base = summed(np.log10((count + 1) / (words.total + words.distinct + 1)))
                own_share = summed(words.share(where, count))
                model = text_scores(net, where[place], lengths, end) / np.log(10) + own_share
                columns = [ids.values, pa.array(np.frombuffer(held_out.as_py(), bool)), pa.array(lengths), pa.array(summed((count > 0).astype(float)).astype(np.int64))]
                columns += [pa.array(np.full(len(lengths), words.total)), pa.array(base), pa.array(model)]
                out.append(pa.Table.from_arrays(columns, names=names))
        return pa.concat_tables(out)

    # words that no training text has keep count 0 and need not come back
    per_chunk = chunk_keys(chunks).select("chunk", "place", "key").join(counts.where("c > 0").hint("merge"), "key").select("chunk", F.expr(f"(place << {COUNT_BITS}) | c").alias("tag"))
    parts = max(1, chunks.count())  # a task holds one chunk or a few, at every size
    whole = chunks.select("chunk", "ids", "own", "place", "lengths", "held").repartition(parts, "chunk")
    both = whole.groupBy("chunk").cogroup(per_chunk.repartition(parts, "chunk").groupBy("chunk"))
    return both.applyInArrow(score, f"{id_col} {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(7)) == 2


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return scores(table(spark, sf_dir, "documents"), held_out())


QUERIES = {"op2_lm_scoring": op2_lm_scoring}
ORACLES: dict[str, str] = {}
