import random
from collections import Counter

import numpy as np
import pytest

from maskline.llm import neardup as nd
from maskline.llm.components import components
from maskline.llm.stage import shared_dir


def shingles(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    links, label = Counter(), list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and len(x & y) * 9 >= 4 * (len(x) + len(y)):
                links[a] += 1
                links[b] += 1
                old, new = label[a], label[b]
                label = [new if k == old else k for k in label]
    ids = {k: min(sets[j][0] for j in range(len(sets)) if label[j] == k) for k in set(label)}
    return Counter((sets[k][0], ids[label[k]], links[k]) for k in range(len(sets)))


def corpus(rng, groups, most):
    words = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(500)]
    common = " ".join(rng.choices(words, k=25))
    docs = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.randrange(8, 200))
        for _ in range(rng.randrange(1, most)):
            new = list(base)
            for _ in range(rng.randrange(0, 4)):
                new[rng.randrange(len(new))] = rng.choice(words)
            docs.append(" ".join(new) + ("\n" + common if rng.random() < 0.3 else ""))
    return docs


@pytest.mark.parametrize(("bucket", "block_bytes", "small"), [(400, 1 << 24, 10**6), (6, 1 << 24, 0), (6, 2000, 0)])
def test_against_brute_force(spark, monkeypatch, bucket, block_bytes, small):
    monkeypatch.setattr(nd, "BUCKET", bucket)
    monkeypatch.setattr(nd, "BLOCK", bucket // 2)
    monkeypatch.setattr(nd, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(nd, "SMALL_ROWS", small)
    rng = random.Random(11)
    docs = corpus(rng, 60, 9) + [None, "", " \n", "a b", "A  B", "a b c", "long " * 60_000, "long " * 60_000]
    docs = list(enumerate(docs)) + [(3, None), (700, docs[5]), (701, docs[5])]
    df = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, node int")
    got = Counter(tuple(r) for r in nd.classes(df).collect())
    assert got == brute(docs)


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "x y z")], "doc_id long, text string")
    assert Counter(tuple(r) for r in nd.classes(df).collect()) == Counter({(None, None, 1): 2, (4, 4, 0): 1})
    assert nd.classes(df.limit(0)).count() == 0


def test_recall_of_runs():
    assert 1 - (1 - nd.survival(nd.LEVELS)) ** nd.runs(nd.LEVELS) >= nd.RECALL
    assert nd.runs(nd.LEVELS) < nd.runs(nd.DEPTH)


def test_recall_at_the_deepest_level():
    """Lone pairs at 0.8 whose buckets are split down to DEPTH still meet, and are candidates."""
    rng = np.random.default_rng(5)
    n = 4000
    one = rng.integers(0, 2**16, (n, nd.COORDINATES)).astype(np.uint16)
    two = np.where(rng.random(one.shape) < nd.THRESHOLD, one, rng.integers(0, 2**16, one.shape).astype(np.uint16))
    met = np.zeros(n, bool)
    for r in range(nd.runs(nd.DEPTH)):
        start = np.full(n, int(nd.tk.mix(np.array([r + 1], np.uint64))[0]), np.uint64)
        sides = []
        for values in (one, two):
            path, rows = start, np.arange(n)
            for _ in range(nd.DEPTH // nd.LEVELS):
                path, rows = nd._descend(path, rows, values)
            sides.append(set(zip(path.tolist(), rows.tolist(), strict=True)))
        met[[k for _, k in sides[0] & sides[1]]] = True
    met &= (one == two).mean(1) >= nd.CANDIDATE
    assert met.mean() >= 0.9975


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)]
    label = {x: x for e in edges for x in e}
    for _ in range(70):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long"), shared_dir(spark)).collect()}
    assert got == {x: k for x, k in label.items() if any(x in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("others", [0, 1, 3, 7])
def test_dealt_buckets_compare_every_pair_of_labels(spark, monkeypatch, others):
    """One linked group with a few others is copied once, the others to each of its blocks; else pairs of blocks."""
    monkeypatch.setattr(nd, "BUCKET", 6)
    rows = [(1, k, 5) for k in range(40)] + [(1, 100 + k, 100 + k % 2) for k in range(others)] + [(2, k, k) for k in range(4)] + [(3, 9, 9)]
    paths = spark.createDataFrame(rows, "path long, node long, label long")
    shapes = {r.path: r for r in nd._shapes(paths).collect()}
    assert set(shapes) == ({1, 2} if others else {2})
    crowd = nd.F.expr("size > 6 and size - most <= 3")
    got = nd._dealt(paths.join(nd._shapes(paths), "path"), crowd).select("path", "group", "node", "label", "side").collect()
    met, groups = set(), {}
    for r in got:
        groups.setdefault((r.path, r.group), []).append(r)
    for (path, _), members in groups.items():
        met |= {(path, a.node, b.node) for a in members for b in members if a.side != b.side or a.side == 0}
    want = {(p, a, b) for p, a, la in rows for q, b, lb in rows if p == q and p in shapes and la != lb}
    assert want <= met
    if 0 < others <= 3:
        assert sum(r.path == 1 and r.node < 40 for r in got) == 40  # the linked group is not copied
