import hashlib
import re
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline as cp
from maskline.llm import bpe, langid

SF = "/root/testdata/sf0.001"


def clean(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {i + k for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letters = re.findall("[A-Za-z]", t)
    return (
        len(w) >= 10 and 100 * len(cover) <= 20 * len(w) and 10 * len(re.findall(r"[#*$%&|<>]", t)) <= len(w)
        and 10 * (len(lines) - len(set(lines))) <= 3 * len(lines) and 2 * sum(c.isupper() for c in letters) <= len(letters)
        and 10 * t.count("!") <= 3 * len(w) and 10 * t.count("|") <= 2 * len(w) and sum(map(len, w)) <= 40 * len(w)
    )


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id for r in langid.predict(docs, langid.fitted(docs)).collect() if r.lang_pred != "und" and r.score >= 0.5}
    ids = sorted(i for i in rows if i in known and clean(rows[i]))
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i in ids for w in [low(rows[i])]}
    label = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if b < a and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    ids = [i for i in ids if label[i] == i]
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 13]) for w in items for k in range(len(w) - 12)}
    dirty = {i for i in ids for w in [re.findall(r"\w+", rows[i].lower())] if any(tuple(w[k : k + 13]) in grams for k in range(len(w) - 12))}
    t = Tokenizer.from_file(bpe.default_vocabulary())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i in ids:
        if i not in dirty:
            e = t.encode(rows[i], add_special_tokens=False).ids
            want.add((i, len(e), sha(",".join(map(str, e))), sha(rows[i])))
    got = [tuple(r) for r in cp.run(spark, SF).collect()]
    assert len(got) == len(set(got)) == len(want) and set(got) == want and dirty and len(want) < len(rows)


def test_stages_on_odd_rows(spark, tmp_path):
    text = "one two three four five six seven eight nine ten eleven twelve " * 1 + "and so it goes on to the end of this plain line"
    docs = spark.createDataFrame([(None, text, None, "s", 1), (None, text, "en", None, 1), (7, None, None, None, None), (7, "", "en", "s", 0), (8, text + " more", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        now = cp.written(stage(spark, now, str(tmp_path)), str(tmp_path), name)
        assert now.columns == docs.columns
    assert [r.doc_id for r in now.collect()] == [8]
    assert cp.STAGES[-1][1](spark, now, str(tmp_path)).count() == 1
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
