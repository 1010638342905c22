import itertools
import zlib
from collections import Counter

from pyspark.sql import functions as F

from maskline.llm import sharding as s


def test_curve_visits_neighbours(spark):
    cells = spark.createDataFrame(list(itertools.product(range(16), repeat=3)), "x int, y int, z int")
    got = {r.h: (r.x, r.y, r.z) for r in cells.withColumn("h", s.hilbert(F.col("x"), F.col("y"), F.col("z"))).collect()}
    assert sorted(got) == list(range(4096))
    assert all(sum(abs(a - b) for a, b in zip(got[i], got[i + 1])) == 1 for i in range(4095))


def test_shards(spark):
    rows = [(i % 900 if i < 1000 else None, None if i % 7 == 0 else "é" * (i % 50), "hot" if i % 3 else None, None if i % 5 else "en", 1) for i in range(1003)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, slot int")
    got = s.shard(df).collect()
    n = Counter(r.shard for r in got)
    assert len(got) == 1003 and set(n) == set(range(8)) and max(n.values()) - min(n.values()) <= 1
    for k in n:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(n[k]))
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in order)
    assert Counter((r.size, r.text_crc32) for r in got) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert s.shard(df.limit(0)).count() == 0
    again = {(r.doc_id, r.size, r.text_crc32): (r.shard, r.slot) for r in s.shard(df.repartition(7)).where("doc_id > 200").collect()}
    assert again == {(r.doc_id, r.size, r.text_crc32): (r.shard, r.slot) for r in got if r.doc_id is not None and r.doc_id > 200}


def test_order_against_sql(spark):
    import duckdb

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(s.ORACLES["op9_sharding"])
    got = s.op9_sharding(spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    for value in ("", "a", "The quick brown fox", "é"):
        acc = 0xFFFFFFFF
        for byte in value.encode():
            acc = acc >> 8 ^ s._crc_entry((acc ^ byte) & 255)
        assert acc ^ 0xFFFFFFFF == zlib.crc32(value.encode())


def test_rows_without_ids_are_spread(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id") + 1000).alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    folder = s.shared_dir(spark)
    assert s.shard(df, folder=folder).count() == 3000
    assert spark.read.parquet(folder + "/rows").groupBy("curve", "_slice").count().agg(F.max("count")).first()[0] < 200
