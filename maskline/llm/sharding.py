"""Sharding along a Hilbert curve, with DataFrame functions only.

Three metadata dimensions (source, language, size) are quantised to BITS bits
each: names by checksum, as only their equality matters to a reader, sizes by
powers of two. Rows are ordered by their index on the Hilbert curve, then by a
hash of id and text, then the id; the order is cut into runs whose row counts
differ by one at most (law ``rows``). A shard thus covers a compact box of
every dimension, which lets a reader prune files by any of them.

The global rank needs no single task that sees all rows: rows are counted by
(curve index, hash slice), the counts are summed up in curve order (at most
2^(3*BITS) cells, then the slices of each cell), and each slice numbers its own
rows. A hot cell is spread over all its slices, and so are the rows of one id
(or of none) as their texts differ.

Defined results: null text counts as no bytes; null source or language is its
own value; equal ids keep distinct slots (their order is by size and checksum,
and rows equal in all of these are interchangeable); columns beside these are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskline.llm.stage import shared_dir, table, written

DIMS, BITS = 3, 4
#: Rows that one hash slice of a cell should hold, and the bounds of the bits that number slices.
SLICE_ROWS, MIN_BITS, MAX_BITS = 50_000, 6, 24
HASH_BITS = 60


@cache
def curve_tables() -> tuple[list[int], list[int]]:
    """(next state, digit) by state * 8 + octant, for three dimensions.

    A state is an entry corner and a direction; the digit of an octant is its
    place in the Gray code after rotation (Hamilton's construction).
    """
    n, corners = DIMS, 1 << DIMS
    turn = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & (corners - 1)
    gray = lambda i: i ^ (i >> 1)
    place = {gray(i): i for i in range(corners)}
    ones = lambda i: (i ^ (i + 1)).bit_length() - 1  # noqa: E731  trailing set bits
    entry = lambda w: 0 if w == 0 else gray(2 * ((w - 1) // 2))
    heading = lambda w: 0 if w == 0 else (ones(w - 1) if w % 2 == 0 else ones(w)) % n
    following, digit = [], []
    for e in range(corners):
        for d in range(n):
            for octant in range(corners):
                w = place[turn(octant ^ e, 2 * n - (d + 1))]
                following.append((e ^ turn(entry(w), d + 1)) * n + (d + heading(w) + 1) % n)
                digit.append(w)
    return following, digit


def hilbert(x: Column, y: Column, z: Column, bits: int = BITS) -> Column:
    """Index on the curve of a cell with coordinates of that many bits."""
    following, digit = (F.array(*map(F.lit, t)) for t in curve_tables())

    def step(acc: Column, weight: Column) -> Column:  # weight: 2^level, highest level first
        bit = lambda c: F.when(c.bitwiseAND(weight) > 0, 1).otherwise(0)
        at = acc["s"] * 8 + bit(x) * 4 + bit(y) * 2 + bit(z)
        return F.struct(F.get(following, at).alias("s"), (acc["h"] * 8 + F.get(digit, at)).alias("h"))

    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("h"))
    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(bits - 1, -1, -1))), start, step, lambda acc: acc["h"])


def curve_order(df: DataFrame, n: int, id_col: str, dims: list[Column], tie: list[str], folder: str) -> DataFrame:
    """The n rows of df with curve (index) and place (from 0, gapless) in curve order; written to folder. A slice is a run of hashes."""
    bits = min(MAX_BITS, max(MIN_BITS, (n // SLICE_ROWS).bit_length()))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", id_col, *tie).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    rows = df.withColumn("curve", hilbert(*dims)).withColumn("_hash", hashed).withColumn("_slice", F.shiftright("_hash", HASH_BITS - bits).cast("int"))
    rows = written(rows, folder, "rows")
    sizes = written(rows.groupBy("curve", "_slice").agg(F.count("*").alias("_n")), folder, "sizes")
    cells = sizes.groupBy("curve").agg(F.sum("_n").alias("_cell"))  # 2^(3 * BITS) rows at most
    before = lambda w: F.coalesce(F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("_v", F.col("_cell")).select("curve", before(Window.orderBy("curve")).alias("_cell_first"))
    firsts = sizes.withColumn("_v", F.col("_n")).select("curve", "_slice", before(Window.partitionBy("curve").orderBy("_slice")).alias("_first"))
    firsts = firsts.join(cells, "curve").select("curve", "_slice", (F.col("_first") + F.col("_cell_first")).alias("_first"))
    own = Window.partitionBy("curve", "_slice").orderBy("_hash", id_col, *tie)
    return (
        rows.withColumn("_row", F.row_number().over(own))
        .join(written(firsts, folder, "firsts"), ["curve", "_slice"])
        .withColumn("place", F.col("_first") + F.col("_row") - 1)
        .drop("_hash", "_slice", "_row", "_first")
    )


def shard(df: DataFrame, shards: int = 8, id_col: str = "doc_id", folder: str | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, curve) for each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = lambda c: (F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % (1 << BITS)).cast("int")
    rows = df.select(
        F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        named("source").alias("_x"), named("lang").alias("_y"),
    )
    rows = rows.withColumn("_z", F.least(F.length(F.bin("size")) - 1, F.lit((1 << BITS) - 1)).cast("int"))
    total = df.count()
    ordered = curve_order(rows, total, id_col, [F.col("_x"), F.col("_y"), F.col("_z")], ["size", "text_crc32"], folder or shared_dir(df.sparkSession))
    ordered = ordered.withColumn("shard", F.expr(f"cast(place * {shards} div {max(total, 1)} as int)"))
    return ordered.select(
        id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.expr(f"place - (shard * {total}L + {shards - 1}) div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> doc_id, size, text_crc32, law, shard (0 to 7), slot, grown_shard, curve."""
    return shard(table(spark, sf_dir, "documents"))


def _oracle(shards: int = 8) -> str:
    """The curve level by level, a global row_number in its order, and the cut. crc32 is not at hand in SQL: the checksum is worked out bit by bit."""
    following, digit = (f"[{', '.join(map(str, t))}]" for t in curve_tables())
    bit = lambda c, k: f"(({c} >> {k}) & 1)"
    curve = "SELECT *, 0 AS s0, 0 AS h0 FROM p"
    for level, k in enumerate(range(BITS - 1, -1, -1)):
        at = f"(s{level} * 8 + {bit('x', k)} * 4 + {bit('y', k)} * 2 + {bit('z', k)} + 1)"
        curve = f"SELECT *, {following}[{at}] AS s{level + 1}, h{level} * 8 + {digit}[{at}] AS h{level + 1} FROM ({curve})"
    table = ", ".join(str(_crc_entry(k)) for k in range(256))
    crc = lambda t: (
        f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, octet_length(encode({t})) + 1), lambda i: CAST('0x' || substr(hex(encode({t})), 2 * i - 1, 2) AS BIGINT))), "
        f"lambda a, b: xor(a >> 8, [{table}][xor(a & 255, b) + 1])), CAST(4294967295 AS BIGINT))"
    )
    return f"""
WITH names AS (SELECT n, {crc('n')} % {1 << BITS} AS v FROM (SELECT DISTINCT coalesce(source, '') AS n FROM documents UNION SELECT DISTINCT coalesce(lang, '') FROM documents)),
texts AS (SELECT t, {crc('t')} AS c FROM (SELECT DISTINCT coalesce(text, '') AS t FROM documents)),
p AS (SELECT doc_id, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size, c AS text_crc32, a.v AS x, b.v AS y, least(length(bin(octet_length(encode(t)) + 1)) - 1, {(1 << BITS) - 1}) AS z
 FROM documents d JOIN texts ON t = coalesce(text, '') JOIN names a ON a.n = coalesce(source, '') JOIN names b ON b.n = coalesce(lang, '')),
o AS (SELECT *, h{BITS} AS curve, row_number() OVER (ORDER BY h{BITS}, substr(md5(concat_ws('|', doc_id, size, text_crc32)), 1, {HASH_BITS // 4}), doc_id, size, text_crc32) - 1 AS place, count(*) OVER () AS n FROM ({curve})),
c AS (SELECT *, place * {shards} // n AS shard FROM o)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(curve AS INTEGER) AS curve FROM c"""


def _crc_entry(k: int) -> int:
    """Entry of the table of the CRC-32 polynomial."""
    for _ in range(8):
        k = (k >> 1) ^ (0xEDB88320 if k & 1 else 0)
    return k


QUERIES = {"op9_sharding": op9_sharding}
ORACLES: dict[str, str] = {"op9_sharding": _oracle()}
