import random
from collections import Counter

import numpy as np
import pytest

from maskline.llm import decontaminate as d


def make(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def test_planted_and_clean(spark, monkeypatch):
    rng = random.Random(5)
    items = {i: make(rng, rng.randrange(15, 60)) for i in range(40)}
    docs, want = [(900, None), (901, ""), (902, "one"), (903, "Common words of the " * 30_000)], set()
    for k in range(200):
        body, i = make(rng, rng.randrange(0, 400)), rng.randrange(40)
        if k % 3 == 0:
            passage = list(items[i])
            for at in rng.sample(range(len(passage)), len(passage) // 8):
                passage[at] = "xyz"
            place = rng.randrange(len(body) + 1)
            body[place:place] = [w.upper() + "," for w in passage]
            want.add((k, i))
        docs.append((k, rng.choice([" ", "\n", " -- "]).join(body)))
    docs += [(k, t) for k, t in docs if k == 0]
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(77, None), (78, "too short"), (79, "")], "item_id long, text string")
    got = d.contamination(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) + 1
    for r in got:
        assert r.item_words == len(items[r.item_id]) and r.n_matched >= min(d.MIN_WORDS, d.MIN_SHARE * r.item_words)
    kept = {r.doc_id for r in d.clean(df, bench).collect()}
    assert kept == {k for k, _ in docs} - {k for k, _ in want}
    monkeypatch.setattr(d, "SMALL_BYTES", 200)  # the way for large benchmarks gives the same
    assert sorted(map(tuple, d.contamination(df, bench).collect())) == sorted(map(tuple, got))
    assert Counter(map(tuple, d.clean(df, bench).collect())) == Counter(r for r in map(tuple, df.collect()) if r[0] in kept)
    assert d.contamination(df, bench.limit(0)).count() == 0 and d.clean(df.limit(0), bench).count() == 0


def test_best_run_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(300):
        m = rng.random(rng.integers(1, 25)) < 0.6
        score = np.where(m, 1, d.SUBSTITUTION)
        x, y = d.best_run(m)
        assert score[x:y].sum() == max(0, max(score[a:b].sum() for a in range(len(m)) for b in range(a + 1, len(m) + 1)))


def brute(docs, items):
    """Every alignment of every text and item, without any hash."""
    out = {}
    for i, t in docs:
        text = d.item_words(t)
        for j, u in items:
            item = d.item_words(u)
            if len(item) < d.LEAST_WORDS or not len(text):
                continue
            best = 0
            for diagonal in range(-len(item) + 1, len(text)):
                a, b = max(0, -diagonal), min(len(item), len(text) - diagonal)
                match = item[a:b] == text[a + diagonal : b + diagonal]
                x, y = d.best_run(match)
                best = max(best, int(match[x:y].sum()))
            if best >= d.wanted(len(item)):
                out[i, j] = best
    return out


@pytest.mark.parametrize("small", [4 << 20, 100])
def test_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(d, "SMALL_BYTES", small)
    rng = random.Random(9)
    items = [(k, " ".join(make(rng, n))) for k, n in enumerate([5, 6, 7, 8, 9, 14, 20, 40, 4, 3])]
    items += [(50, items[6][1]), (51, items[0][1])]  # repeated items
    docs = []
    for k in range(60):
        body = make(rng, rng.randrange(0, 60))
        passage = items[rng.randrange(len(items))][1].split()
        cut = passage[rng.randrange(3) :] if k % 3 == 0 else passage
        if k % 4:
            at = rng.randrange(len(body) + 1)
            body[at:at] = cut
        docs.append((k, " ".join(body)))
    want = brute(docs, items)
    got = d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): r.n_matched for r in got}
    assert len(found) == len(got) and set(found) <= set(want) and all(want[k] >= v for k, v in found.items())
    assert set(found) == set(want) and any(d.item_words(dict(items)[j]).size < 8 for _, j in found)
