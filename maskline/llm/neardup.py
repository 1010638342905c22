"""Near-duplicate join on word shingles: Jaccard similarity of 0.8 or more.

Chosen-path join (Christiani and Pagh 2017; Christiani, Pagh and Sivertsen
2018). A text is its set of five-word shingles, embedded as MinHash
coordinates. A run splits all sets by the value at a coordinate that the path
so far selects, and with probability 1/THRESHOLD - 1 by a second one, level
after level; similar sets stay together in some branch. Buckets of at most
BUCKET sets are compared by brute force. A bucket whose sets are all linked already
needs no more work, so SCOUTS runs go first, in which larger buckets are compared in
random blocks: that links most of a large group. Later a large bucket of one linked
group and at most BUCKET / 2 other sets is dealt into blocks, each with all of
the others, so that only these are copied. Sets of other large buckets start anew
in more runs and twice as deep; what is still large after DEPTH levels
is compared in pairs of blocks, so that no task holds a large group. Runs repeat
until a pair at the threshold meets with probability RECALL: for all sets after
LEVELS levels, for those of large buckets even after DEPTH levels.

Equal sets are one node throughout. Compared pairs only link candidates; each
candidate component is then checked exactly, block by block: every pair of its
sets is counted by its true Jaccard similarity. What blocks exchange are sets
of hashes, made once per text. Links are summed per text and never listed, and
components never leave Spark.

Result: one row per input row with class_id (least id of its component) and
n_links (how many other rows are similar to it, copies included).

Defined results: words are folded to lower case in ASCII; a text of one to four
words is a single shingle; a text without words (or null) is its own class
with no link; a null id never names a class unless all ids of the class are
null; repeated rows are copies; other columns are ignored; an empty table gives
an empty result. Sets are told apart by 64-bit digests.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.llm import textkit as tk
from maskline.llm.components import components
from maskline.llm.stage import discard, shared_dir, table, with_id, written

SHINGLE, THRESHOLD = 5, 0.8
RECALL = 0.999
COORDINATES = 128
LEVELS, DEPTH = 3, 9
BUCKET, BLOCK = 400, 100
#: Runs before the others, in which large buckets link their random blocks.
SCOUTS = 2
#: Bytes of the sets of one block, and rows up to which the ids of candidates are sent to all executors (16 bytes each).
BLOCK_BYTES, SMALL_ROWS = 16 << 20, 2_000_000
#: Share of equal coordinates from which two sets are candidates: 4.2 deviations below the threshold.
CANDIDATE = 0.65

_rng = np.random.default_rng(811)
_MULTIPLY = _rng.integers(0, 2**32, COORDINATES, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, COORDINATES, dtype=np.uint32)


def survival(levels: int, similarity: float = THRESHOLD) -> float:
    """Probability that two sets of that similarity share a bucket after so many levels of one run."""
    p = 1.0
    for _ in range(levels):
        p = 1 - (1 - similarity * p) * (1 - (1 / THRESHOLD - 1) * similarity * p)
    return p


def starts(n: int) -> np.ndarray:
    """Paths from which runs start."""
    return tk.mix(np.arange(1, n + 1, dtype=np.uint64))


def _twice(path: np.ndarray) -> np.ndarray:
    """Whether a path takes the second split too."""
    return (tk.mix(path + np.uint64(3)) >> np.uint64(32)) < np.uint64(int((1 / THRESHOLD - 1) * 2**32))


@functools.cache
def runs(levels: int, recall: float = RECALL, most: int = 200) -> int:
    """Runs after which a pair at the threshold is a candidate with probability recall, so many levels deep.

    The share of its equal coordinates varies around the threshold, which
    CANDIDATE cuts below; of the roots it counts which really split twice.
    """
    equal = range(math.ceil(CANDIDATE * COORDINATES), COORDINATES + 1)
    weight = np.array([math.comb(COORDINATES, k) * THRESHOLD**k * (1 - THRESHOLD) ** (COORDINATES - k) for k in equal])
    below = np.array([k / COORDINATES * survival(levels - 1, k / COORDINATES) for k in equal])
    miss = np.ones(len(weight))
    for n, twice in enumerate(_twice(starts(most)), 1):
        miss = miss * (1 - below) ** (2 if twice else 1)
        if 1 - weight.sum() + (weight * miss).sum() <= 1 - recall:
            return n
    raise ValueError("the recall is out of reach")


def shingle_sets(text: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text with a word."""
    for i, _, buf, offsets in tk.chunks(text):
        words = tk.segments(buf, offsets, fold=tk.LOWER)
        at, key = tk.windows(words.key, words.doc, SHINGLE)
        doc = words.doc[at]
        bounds = np.searchsorted(doc, np.arange(len(offsets)))
        word_bounds = np.searchsorted(words.doc, np.arange(len(offsets)))
        for d in range(len(offsets) - 1):
            if bounds[d + 1] > bounds[d]:
                yield i + d, np.unique(key[bounds[d] : bounds[d + 1]])
            elif word_bounds[d + 1] > word_bounds[d]:
                few = words.key[word_bounds[d] : word_bounds[d + 1]]
                yield i + d, tk.mix((few * tk._SPAN[: len(few)]).sum(keepdims=True) + np.uint64(len(few)))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """MinHash coordinates, 16 bits each."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        np.minimum(least, (x[k : k + 2048, None] * _MULTIPLY + _ADD).min(0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, sketch, text): node is the digest of the shingle set, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node: list = [None] * batch.num_rows
            rows: list = [None] * batch.num_rows
            for i, s in shingle_sets(batch.column(1)):
                total = tk.mix(tk.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(keepdims=True) + np.uint64(len(s)))
                node[i] = int(total.view(np.int64)[0])
                rows[i] = sketch(s).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), pa.array(rows, pa.binary()), batch.column(1)], names=[id_col, "node", "sketch", "text"])
        pa.default_memory_pool().release_unused()  # the worker lives on

    texts = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, with_id(texts, id_col, "node long, sketch binary, text string"))


def _descend(path: np.ndarray, rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(path, row) after LEVELS more levels; values: coordinates by row. What is chosen depends on the path alone."""
    for _ in range(LEVELS):
        parts = []
        for k in (1, 2):
            chosen = tk.mix(path + np.uint64(k))
            go = slice(None) if k == 1 else np.flatnonzero(_twice(path))
            c = (chosen[go] >> np.uint64(20)) % np.uint64(COORDINATES)
            value = values[rows[go], c.astype(np.int64)].astype(np.uint64)
            parts.append((tk.mix(path[go] * np.uint64(0x9E3779B97F4A7C15) + (c << np.uint64(16)) + value + np.uint64(k << 40)), rows[go]))
        path, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
    return path, rows


def _paths(df: DataFrame, n_runs: int = 0, levels: int = LEVELS, after: int = 0) -> DataFrame:
    """(path, node, label) of sets (node, label, sketch) in so many runs (after others), or of (node, label, sketch, path), so many levels down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                node, label = part.column(0).to_numpy(), part.column(1).to_numpy()
                values = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(-1, COORDINATES)
                own = np.arange(len(node))
                if n_runs:
                    start = [(np.full(len(node), start, np.uint64), own) for start in starts(after + n_runs)[after:]]
                else:
                    start = [(part.column(3).to_numpy().view(np.uint64), own)]
                for path, rows in start:
                    for _ in range(levels // LEVELS):
                        path, rows = _descend(path, rows, values)
                    yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(node[rows]), pa.array(label[rows])], names=["path", "node", "label"])

    return df.select("node", "label", "sketch", *(() if n_runs else ("path",))).mapInArrow(run, "path long, node long, label long")


def blocks(rows: DataFrame, key: str, size: Column) -> DataFrame:
    """rows (key, node, ...) with group and side: one group if size (in blocks) is at most two, else a group for each pair of blocks."""
    return (
        rows.withColumn("_n", F.when(size <= 2, 1).otherwise(F.ceil(size)).cast("int"))
        .withColumn("_own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("_n")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("group", F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other")))
        .withColumn("side", F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2))
        .drop("_n", "_own", "_other")
    )


def in_groups(df: DataFrame, work: Callable[[pa.Table], list[np.ndarray]], out: str) -> DataFrame:
    """work over the rows of each group (a long column, first), streamed in order of group."""
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            key = t.column(0).to_numpy()
            edge = np.flatnonzero(np.diff(key)) + 1
            rest = t.slice(edge[-1] if len(edge) else 0)
            found = [x for a, b in zip([0, *edge[:-1]], edge, strict=True) if (x := work(t.slice(a, b - a))) is not None] if len(edge) else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)
        if rest is not None and (x := work(rest)) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=names)
        rest = None
        pa.default_memory_pool().release_unused()  # the worker lives on

    return df.repartition("group").sortWithinPartitions("group").mapInArrow(run, out)


def _roots(linked: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Least node that each row reaches over the links of a group."""
    label = node.copy()
    while True:
        low = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1)
        low = np.minimum(low, label)
        if (low == label).all():
            return label
        label = low


def _pairs(side: np.ndarray) -> np.ndarray:
    """Which pairs of rows a group compares: all, or those of two blocks."""
    ok = (side[:, None] != side[None, :]) | (side[:, None] == 0)
    np.fill_diagonal(ok, False)
    return ok


def _candidates(t: pa.Table) -> list[np.ndarray] | None:
    """Star edges (u, v) between the labels of the rows (group, label, side, sketch) of a bucket. What has one label is linked already."""
    if t.num_rows < 2:
        return None
    label, side = t.column(1).to_numpy(), t.column(2).to_numpy()
    if (label == label[0]).all():
        return None
    values = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint16).reshape(-1, COORDINATES)
    same = np.stack([(values == v).sum(1) for v in values]) >= CANDIDATE * COORDINATES
    root = _roots(same & _pairs(side) & (label[:, None] != label[None, :]), label)
    tied = np.unique(np.stack([label, root], 1)[root != label], axis=0)
    return [tied[:, 0], tied[:, 1]] if len(tied) else None


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices over the shared shingles."""
    m = len(sets)
    shingle, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[order], owner[order]
    new = np.concatenate([[True], shingle[1:] != shingle[:-1]])
    place = np.cumsum(new) - 1
    times = np.bincount(place)
    shared = times[place] > 1
    column = np.cumsum(times > 1)[place[shared]] - 1
    owner = owner[shared]
    out = np.zeros((m, m), np.float64)
    width = max(256, 2_000_000 // m)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        incidence = np.zeros((m, width), np.float32)
        incidence[owner[a:b], column[a:b] - first] = 1
        out += incidence @ incidence.T
    return out.astype(np.int64)


def _verified(t: pa.Table) -> list[np.ndarray] | None:
    """(node, root, links) of the rows (group, node, side, weight, hashes): exact similarity."""
    if t.num_rows < 2:
        return None
    node, side, weight = (t.column(k).to_numpy() for k in (1, 2, 3))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column(4)]
    n = np.array([len(s) for s in sets])
    inner = intersections(sets)
    # inner / (n + n - inner) >= 4 / 5, in whole numbers
    linked = (9 * inner >= 4 * (n[:, None] + n[None, :])) & _pairs(side)
    return [node, _roots(linked, node), (linked * weight[None, :]).sum(1)]


def _hash_sets(df: DataFrame) -> DataFrame:
    """(label, node, weight, hashes) of rows (label, node, weight, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sets = zip(*((i, s.tobytes()) for i, s in shingle_sets(batch.column(3))), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in batch.columns[:3]), pa.array(sets, pa.binary())], names=["label", "node", "weight", "hashes"])

    return df.select("label", "node", "weight", "text").mapInArrow(run, "label long, node long, weight long, hashes binary")


def _edges(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Star edges (u, v) between the labels of members (group, node, label, side)."""
    rows = members.select("group", "node", "label", "side").join(sketches.select("node", "sketch").hint("merge"), "node")
    return in_groups(rows.select("group", "label", "side", "sketch"), _candidates, "u long, v long")


def _shapes(paths: DataFrame) -> DataFrame:
    """(path, size, most, major) of the buckets of (path, node, label) in which not all sets are linked yet: the label that most sets have."""
    labels = paths.groupBy("path", "label").agg(F.count("*").alias("n"))
    shapes = labels.groupBy("path").agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("label", "n").alias("major"))
    return shapes.where("most < size")


def _dealt(rows: DataFrame, crowd: Column) -> DataFrame:
    """(group, node, label, side) of bucket members with their shapes: one group, or pairs of blocks, or in a crowd blocks of its major label with all others in each."""
    n = F.when(F.col("size") <= BUCKET, 1).otherwise(F.ceil(F.col("size") / (BUCKET // 2))).cast("int")
    return (
        rows.withColumn("_own", F.pmod(F.xxhash64("node", F.lit(7)), n).cast("int"))
        .withColumn("_other", F.explode(F.when(crowd & (F.col("label") == F.col("major")), F.array("_own")).otherwise(F.sequence(F.lit(0), n - 1))))
        .withColumn("group", F.when(crowd, F.xxhash64("path", "_other", "_other")).otherwise(F.xxhash64("path", F.least("_own", "_other"), F.greatest("_own", "_other"))))
        .withColumn("side", F.when(crowd | (F.col("_own") == F.col("_other")), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2))
    )


def _level(paths: DataFrame, sketches: DataFrame, folder: str, name: str, last: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(edges, (node, label, path) in the buckets that are too large to be compared before the last level, None without such)."""
    paths = written(paths, folder, f"paths-{name}")
    shapes = written(_shapes(paths), folder, f"sizes-{name}")
    crowd = (F.col("size") > BUCKET) & (F.col("size") - F.col("most") <= BUCKET // 2)
    now = (F.col("size") <= BUCKET) | crowd | F.lit(last)
    edges = _edges(_dealt(paths.join(shapes.where(now).hint("merge"), "path"), crowd), sketches)
    later = shapes.where(~now).select("path")
    return edges, None if last or later.isEmpty() else paths.join(later.hint("merge"), "path")


def _candidate_edges(sketches: DataFrame, folder: str) -> DataFrame:
    """Star edges (u, v) of pairs that are likely similar: runs of splits, brute force in small buckets."""
    paths = written(_paths(sketches.withColumn("label", F.col("node")), SCOUTS, after=runs(DEPTH)), folder, "paths-scouts")
    sizes = paths.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
    block = F.when(F.col("size") > BUCKET, F.pmod(F.xxhash64("node", "path"), F.ceil(F.col("size") / (BUCKET // 2)))).otherwise(F.lit(0))
    groups = paths.join(sizes.hint("merge"), "path").select(F.xxhash64("path", block).alias("group"), "node", "label", F.lit(0).alias("side"))
    linked = components(_edges(groups, sketches), f"{folder}/scouted")
    few = linked.hint("broadcast" if linked.count() <= SMALL_ROWS else "merge")
    known = sketches.join(few, "node", "left").withColumn("label", F.coalesce("label", "node"))

    found, rest = _level(_paths(known, runs(LEVELS)), sketches, folder, "all")
    edges = linked.select(F.col("node").alias("u"), F.col("label").alias("v")).union(found)  # the same components, by fewer steps
    if rest is None:
        return edges
    # sets of large buckets: more runs, split level after level, where they are not linked yet
    own = written(sketches.join(rest.select("node", "label").distinct().hint("merge"), "node"), folder, "large")
    paths = _paths(own, runs(DEPTH), 2 * LEVELS)
    for level in range(2 * LEVELS, DEPTH + 1, LEVELS):
        found, rest = _level(paths, own, folder, str(level), level >= DEPTH)
        edges = edges.union(found)
        if rest is None:
            break
        paths = _paths(rest.select("path", "node").join(own.hint("merge"), "node")).distinct()
    return edges


def _joined(rows: DataFrame, name: Column, folder: str) -> DataFrame:
    """(node, class_id, n_links) of rows (uid, node, sketch, text, ...); a class has the least name of its rows.

    The large sides are merged on sorted keys. Only the ids of candidates go to
    all executors where they are few (SMALL_ROWS), so that the texts stay in place.
    """
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("uid").alias("uid"), F.min(name).alias("least"), F.count("*").alias("weight"), F.first("sketch").alias("sketch"))
    nodes = written(nodes, folder, "nodes")
    groups = components(_candidate_edges(nodes.select("node", "sketch"), folder), f"{folder}/candidates")
    nodes = nodes.drop("sketch")

    # every pair of a candidate component, exactly
    members = written(groups.join(nodes.select("node", "uid", "weight").hint("merge"), "node"), folder, "members")
    few = members.hint("broadcast" if members.count() <= SMALL_ROWS else "merge")
    sets = written(_hash_sets(rows.select("uid", "text").join(few, "uid")), folder, "sets")
    sizes = sets.groupBy("label").agg(F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("hashes")) / BLOCK_BYTES).alias("size"))
    parts = blocks(sets.join(sizes, "label"), "label", F.col("size"))
    compared = in_groups(parts.select("group", "node", "side", "weight", "hashes"), _verified, "node long, root long, links long")
    compared = written(compared.groupBy("node", "root").agg(F.sum("links").alias("links")), folder, "compared")
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(compared.select(F.col("node").alias("u"), F.col("root").alias("v")), f"{folder}/links")
    tied = written(nodes.join(linked, "node").join(links, "node"), folder, "tied")
    least = tied.groupBy("label").agg(F.min("least").alias("class_id"))
    tied = tied.join(least, "label").select("node", "class_id", "links")
    final = nodes.join(tied, "node", "left").select("node", F.coalesce("class_id", "least").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    final = written(final, folder, "final")
    levels = ["scouts", "all", *map(str, range(2 * LEVELS, DEPTH + 1, LEVELS))]
    work = [f"{kind}-{k}" for k in levels for kind in ("paths", "sizes")]
    discard(rows.sparkSession, folder, *work, "scouted", "large", "nodes", "candidates", "members", "sets", "compared", "links", "tied")
    return final


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """(id, class_id, n_links) for each row of df."""
    folder = folder or shared_dir(df.sparkSession)
    rows = written(signatures(df, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), folder, "rows")
    final = _joined(rows, F.col(id_col), folder)
    return (
        rows.select(id_col, "node").join(final.hint("merge"), "node", "left")
        .select(id_col, F.when(F.col("node").isNull(), F.col(id_col)).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )


def one_per_class(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Rows of df, one of each class: that with the least id (null last). Rows without words all stay."""
    folder = folder or shared_dir(df.sparkSession)
    rest = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text_col)).alias("_rest")
    rows = signatures(df.select(rest, F.col(text_col)), "_rest", text_col).withColumn("uid", F.monotonically_increasing_id())
    rows = written(rows, folder, "rows")
    own = F.col("_rest").getField(id_col)
    name = F.struct(own.isNull().alias("none"), own.alias("id"), F.col("uid").alias("row"))
    final = _joined(rows, name, folder).select("node", "class_id")
    kept = rows.select("uid", "node", name.alias("name")).join(final.hint("merge"), "node", "left").where("node is null or name = class_id").select("uid")
    stay = rows.select("uid", "_rest", "text").join(kept.hint("merge"), "uid", "left_semi")
    return stay.select(*(F.col("text").alias(c) if c == text_col else F.col("_rest").getField(c).alias(c) for c in df.columns))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> doc_id, class_id, n_links."""
    return classes(table(spark, sf_dir, "documents"))


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
ORACLES: dict[str, str] = {}
