"""Collocations: frequent phrases of two and three words, by language, that hold together.

SON partitioning (Savasere, Omiecinski and Navathe 1995). The texts are dealt
to SHARDS shards. Each shard is mined completely, on many tasks, at a support
lowered in proportion: of a language that has a share p of its words in the
shard, every phrase that stands there LEAST * p times or more. A phrase with
LEAST occurrences in all reaches that in some shard, so the union of what the
shards find misses nothing. Then all candidates are counted exactly over all
shards, phrase by phrase, with their parts, which are candidates as well.

Mining goes by leading bits of hashes (see exchange.py): a false candidate is
only counted in vain. Exact counts are summed by the phrase itself.

A candidate is cut in two where its score is lowest: LEAST occurrences or more,
score = floor(1000000 * a * a / (l * r)) with a, l, r the counts of the phrase
and its parts; of equal cuts the first counts. A candidate that stands in a
longer one with half its count or more is dropped.

Defined results: a null language is ``und``; A-Z are lower-cased; a null or
empty text has no words; phrases do not cross the marks of SEPARATORS; repeated
rows count each; ties in rank go by count, then by the phrase's bytes; other
columns are ignored; an empty table gives an empty result. Products are
decimals of 38 digits (counts up to 10^16).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskline.llm import exchange as ex
from maskline.llm import textkit as tk
from maskline.llm.stage import shared_dir, table, written

SHARDS, LEAST, LONGEST, TOP = 4, 10, 3, 2000

SEPARATORS = np.zeros(256, bool)
SEPARATORS[list(b".,;:!?\n\v\f\r")] = True
SPLIT = SEPARATORS.copy()
SPLIT[list(b" \t")] = True

QUESTION = "slice long, chunk long, lang string, n long, keys binary, times binary"


class Mined:
    """The phrases of one to LONGEST words of a chunk: by language, their distinct hashes in order."""

    def __init__(self, chunk: ex.Chunk):
        self.buf = tk.LOWER[chunk.buf]
        self.words = words = tk.segments(self.buf, chunk.offsets, SPLIT)
        piece = np.cumsum(SEPARATORS[self.buf])[words.start] + words.doc if len(words.start) else words.doc
        found = [tk.windows(words.key, piece, k) for k in range(1, LONGEST + 1)]
        self.at = np.concatenate([at.astype(np.int32) for at, _ in found])
        self.size = np.repeat(np.arange(1, LONGEST + 1, dtype=np.int8), [len(at) for at, _ in found])
        hashes = tk.mix(np.concatenate([h for _, h in found]) + self.size.astype(np.uint64))
        del piece, found
        coded = chunk.keys.dictionary_encode()
        owner = coded.indices.to_numpy(zero_copy_only=False)[words.doc][self.at].astype(np.uint16 if len(coded.dictionary) < 1 << 16 else np.int64)
        by_lang = np.argsort(owner, kind="stable").astype(np.int32)
        bounds = np.searchsorted(owner[by_lang], np.arange(len(coded.dictionary) + 1))
        self.langs: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # places, times and hashes of distinct phrases
        for k, lang in enumerate(coded.dictionary.to_pylist()):
            own = by_lang[bounds[k] : bounds[k + 1]]
            if len(own):
                order, new = ex.runs([hashes[own]])
                begin = np.flatnonzero(new)
                self.langs[lang] = own[order[begin]], np.diff(np.append(begin, len(order))), hashes[own[order[begin]]]

    def phrases(self, places: np.ndarray) -> pa.Array:
        """The words at the places, one blank between them."""
        at, size = self.at[places], self.size[places].astype(np.int64)
        first = np.cumsum(size) - size
        inner = np.arange(int(size.sum())) - np.repeat(first, size)
        word = np.repeat(at, size) + inner
        body, sizes = ex.joined_words(self.buf, self.words.start[word], self.words.end[word], inner == np.repeat(size, size) - 1)
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.append(first, len(word))]
        return pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))).cast(pa.string())


def _questions(chunks: DataFrame, slices: int, bits: int) -> DataFrame:
    """The distinct phrases of each chunk and language, with their counts there."""
    names = [x.split()[0] for x in QUESTION.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in ex.opened(batch):
                for lang, (_, times, keys) in Mined(c).langs.items():
                    rows = [(s, c.number, lang, j - i, ex.packed(keys[i:j], bits), ex.narrow(times[i:j])) for s, i, j in ex.cuts(keys, slices)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        pa.default_memory_pool().release_unused()

    return chunks.select("chunk", "keys", "offsets", "texts").mapInArrow(run, QUESTION)


def _frequent_somewhere(bits: int):
    """Answers: some shard has the phrase as often as its support asks for. Rows are of one language."""

    def work(t: pa.Table) -> list[np.ndarray]:
        n, shard, support = (t.column(c).to_pylist() for c in ("n", "shard", "support"))
        keys = np.concatenate([ex.unpacked(x, k, bits) for x, k in zip(t.column("keys").to_pylist(), n, strict=True)])
        times = np.concatenate([ex.wide(x, k) for x, k in zip(t.column("times").to_pylist(), n, strict=True)]).astype(np.float64)
        order, new = ex.runs([keys])
        run = np.empty(len(keys), np.int64)
        run[order] = np.cumsum(new) - 1
        own = np.repeat(shard, n)
        frequent = np.zeros(int(new.sum()), bool)
        for s, least in dict(zip(shard, support, strict=True)).items():
            here = own == s
            frequent |= np.bincount(run[here], times[here], len(frequent)) >= least
        out = frequent[run]
        return np.split(out, np.cumsum(n)[:-1])

    return work


def _counted(chunks: DataFrame, answers: DataFrame, slices: int) -> DataFrame:
    """(lang, phrase, n) of the candidates in each chunk."""

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.string()), "n": pa.array([], pa.int64())})]
        for c in ex.opened(left):
            mined, said = Mined(c), right.column("lang").to_pylist()
            for lang, (places, times, keys) in mined.langs.items():
                own = right.filter(pa.array([x == lang for x in said], pa.bool_()))
                hit = np.flatnonzero(ex.truth(own, {s: j - i for s, i, j in ex.cuts(keys, slices)}))
                out.append(pa.table({"lang": pa.array([lang] * len(hit), pa.string()), "phrase": mined.phrases(places[hit]), "n": pa.array(times[hit].astype(np.int64))}))
        return pa.concat_tables(out)

    return chunks.select("chunk", "keys", "offsets", "texts").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(work, "lang string, phrase string, n long")


def frequent_phrases(df: DataFrame, lang_col: str, text_col: str, folder: str, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(frequent (lang, phrase, words, n): all phrases of up to LONGEST words with least occurrences or more; totals (lang, total) of words)."""
    spark = df.sparkSession
    chunks = ex.chunked(df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col)), "lang", text_col, SPLIT, folder)
    shard = F.pmod(F.xxhash64("chunk"), F.lit(SHARDS))
    sizes = chunks.select(shard.alias("shard"), F.explode(F.arrays_zip("keys", "words")).alias("x")).groupBy("shard", F.col("x.keys").alias("lang")).agg(F.sum("x.words").alias("words"))
    sizes = written(sizes, folder, "sizes")
    totals = written(sizes.groupBy("lang").agg(F.sum("words").alias("total")), folder, "totals")
    n_words = totals.agg(F.sum("total")).first()[0] or 0
    # the least whole number that is not below least * words / total
    supports = written(sizes.join(totals, "lang").where("total > 0").select("shard", "lang", F.expr(f"greatest(1, (words * {least} + total - 1) div total)").alias("support")), folder, "supports")
    slices, bits = ex.slices_for(spark, LONGEST * n_words), ex.filter_bits(LONGEST * n_words)
    asked = _questions(chunks, slices, bits).withColumn("shard", shard).join(supports, ["shard", "lang"])
    candidates = written(ex.answered(asked, slices, _frequent_somewhere(bits), "lang"), folder, "candidates")
    counts = _counted(chunks, candidates, slices).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return written(counts.withColumn("words", F.size(F.split("phrase", " "))), folder, "frequent"), totals


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, folder: str | None = None) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all candidates that no longer one holds; n: words of the language."""
    folder = folder or shared_dir(df.sparkSession)
    frequent, totals = frequent_phrases(df, lang_col, text_col, folder, least)
    counts = frequent.select("lang", "phrase", "n")
    w = F.split("phrase", " ")
    part = lambda *k: F.concat_ws(" ", *(w[i] for i in k))
    whole = frequent.where("words > 1").withColumnRenamed("n", "a")
    cut = lambda k, left, right: F.struct(F.lit(k).alias("cut"), left.alias("left"), right.alias("right"))
    ways = F.when(F.col("words") == 2, F.array(cut(1, part(0), part(1)))).otherwise(F.array(cut(1, part(0), part(1, 2)), cut(2, part(0, 1), part(2))))
    parts = whole.select("lang", "phrase", "a", F.explode(ways).alias("x")).select("lang", "phrase", "a", "x.*")
    parts = parts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    big = lambda c: f"cast({c} as decimal(38,0))"
    score = F.expr(f"(1000000 * {big('a')} * {big('a')}) div ({big('l')} * {big('r')})")
    scored = parts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    longer = whole.where("words = 3").select("lang", F.col("a").alias("most"), F.explode(F.array(part(0, 1), part(1, 2))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    stays = scored.join(longer, ["lang", "phrase"], "left").where("most is null or 100 * most < 50 * a")
    return stays.join(totals, "lang").select("lang", "phrase", "a", "x.l", "x.r", F.col("total").alias("n"), "x.score")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> lang, rank, phrase, a, l, r, n, score: each language's first TOP collocations."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = collocations(table(spark, sf_dir, "documents")).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= TOP)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ORACLE = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS g, count(*) AS c FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, c AS a, str_split(g, ' ') AS s FROM g WHERE k > 1 AND c >= {LEAST}),
cuts AS (SELECT lang, k, g, a, j, array_to_string(s[1:j], ' ') AS x, array_to_string(s[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
scored AS (SELECT cuts.lang, cuts.k, cuts.g, a, l.c AS l, r.c AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.c AS HUGEINT) * r.c) AS BIGINT) AS score,
 row_number() OVER (PARTITION BY cuts.lang, cuts.g ORDER BY (CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.c AS HUGEINT) * r.c), j) AS t
 FROM cuts JOIN g AS l ON l.lang = cuts.lang AND l.g = x JOIN g AS r ON r.lang = cuts.lang AND r.g = y),
longer AS (SELECT lang, g, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(s[1:2], ' '), array_to_string(s[2:3], ' ')]) AS g FROM c WHERE k = 3) GROUP BY ALL),
stays AS (SELECT scored.* FROM scored LEFT JOIN longer USING (lang, g) WHERE t = 1 AND (most IS NULL OR 100 * most < 50 * a))
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM stays) JOIN n USING (lang) WHERE rank <= {TOP}"""

QUERIES = {"op11_phrase_mining": op11_phrase_mining}
ORACLES: dict[str, str] = {"op11_phrase_mining": _ORACLE}
