import math
from collections import Counter

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from maskline.llm import langid as li


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = li.predict(docs, li.fitted(docs)).join(docs.select("doc_id", "lang", li.held_out().alias("out")), "doc_id").where("out")
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 200 and right / n > 0.97


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "123 _ !", None), (5, "", "de"), (6, "THE dogs", None), (7, "hunde", None), (8, "日本", None), (8, "日本", None), (9, "hund " * 90_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = li.fit(df.where("doc_id in (1, 2)").union(df.where("doc_id in (1, 2)")).select("lang", "text"), li.shared_dir(spark))
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.predict(df, model).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[6][0] == "en" and got[7][0] == "de" and got[9][0] == "de" and got[8] == ("de", 0.5)
    assert li.predict(df, model).count() == len(rows)
    assert li.fit(df.limit(0).select("lang", "text"), li.shared_dir(spark)) is None
    assert {r.lang_pred for r in li.predict(df, None).collect()} == {"und"}
    assert model.backoff("katzen")[0] > model.backoff("katzen")[1]


def brute(sample, text):
    """Straight from the definition: words by language, then the longest n-grams that are known."""
    langs, words = sorted({x for x, _ in sample}), {}
    for lang, t in sample:
        for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", t.lower()):
            words.setdefault(w, Counter())[lang] += 1
    grams = {}
    for w, c in words.items():
        for k in range(1, 6):
            for g in li.grams(w, k):
                grams.setdefault(k, {}).setdefault(g, Counter()).update(c)
    known = lambda table: {x: c for x, c in table.items() if sum(c.values()) >= li.LEAST_COUNT}
    words, grams = known(words), {k: known(t) for k, t in grams.items()}

    def logs(table):
        total = {x: sum(c[x] for c in table.values()) for x in langs}
        return {i: [math.log((c[x] + 0.1) / (total[x] + 0.1 * len(table))) for x in langs] for i, c in table.items()}

    words, grams, score = logs(words), {k: logs(t) for k, t in grams.items()}, [0.0] * len(langs)
    found = regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower())
    for w in found:
        rows = [words[w]] if w in words else next((r for k in range(5, 0, -1) if (r := [grams[k][g] for g in li.grams(w, k) if g in grams[k]])), [])
        score = [s + (sum(r[j] for r in rows) / len(rows) if rows else 0) for j, s in enumerate(score)]
    share = [math.exp(s - max(score)) for s in score]
    return (langs[score.index(max(score))], max(share) / sum(share)) if found else ("und", 0.0)


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    sample = [(r.lang, r.text) for r in docs.where("doc_id % 2 = 0 and lang is not null and text is not null").collect()]
    model = li.fit(spark.createDataFrame(sample, "lang string, text string"), li.shared_dir(spark))
    texts = [r.text or "" for r in docs.where("doc_id % 2 = 1").collect()][:40] + ["हिन्दी में", "xqzzy katzenhaft", "²", "½ ½", "Ⅷ", "naïve Ⅷ"]
    got = {r.i: r for r in li.predict(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model, "i").collect()}
    for i, t in enumerate(texts):
        lang, score = brute(sample, t)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-4), t
    assert [got[len(texts) - k].lang_pred for k in (4, 3, 2)] == ["und"] * 3


def test_sample_of_rows_without_ids(spark):
    df = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("text "), "id").alias("text"))
    assert 300 < li.training(df, F.lit(True), 500).count() < 700


def test_carried_rows_go_back_in_small_batches(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "ein kleiner Satz" if i % 2 else "a small sentence", "de" if i % 2 else "en") for i in range(40)], "doc_id long, text string, lang string")
    model, taken = li.fit(docs.select("lang", "text"), li.shared_dir(spark)), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: taken.append(run))
    li.predict(docs, model)
    texts = ["ein Satz", None, "a sentence"] * 1000
    got = list(taken[0](iter([pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts)], names=["doc_id", "text"])] * 2)))
    assert max(b.num_rows for b in got) <= li.OUT_ROWS
    assert [x for b in got for x in b.column(0).to_pylist()] == [*range(3000)] * 2
    assert [x for b in got for x in b.column(1).to_pylist()] == ["de", "und", "en"] * 2000
