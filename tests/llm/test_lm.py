import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from maskline.llm import lm


def tokens(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def test_base_scores_and_model_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(5001, None), (5002, ""), (5003, "ABC abc Äb\x1c x"), (5003, "ABC abc Äb\x1c x"), (None, "zzz")], "doc_id long, text string")).withColumn("c", F.lit(1))
    rows = docs.collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for r in rows if not out(r.doc_id) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    got = sorted(lm.scores(docs, lm.held_out()).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert len(got) == len(rows)
    for r, g in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id)), got, strict=True):
        t = tokens(r.text)
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (r.doc_id, out(r.doc_id), len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(g.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    held = [g for g in got if g.held_out]
    print(sum(g.score for g in held) / sum(g.n_tokens for g in held), sum(g.base_score for g in held) / sum(g.n_tokens for g in held))
    assert sum(g.score for g in held) > sum(g.base_score for g in held) + 0.02 * sum(g.n_tokens for g in held)
    assert lm.scores(docs.limit(0), lm.held_out()).count() == 0


def random_net(seed=0):
    rng = np.random.default_rng(seed)
    net = lm.Network.fresh(rng.random(lm.SIZE) * 50)
    return lm.Network([q + rng.normal(0, 0.1, q.shape) for q in net.p]), rng


def test_probabilities_sum_to_one():
    net, rng = random_net()
    h = np.repeat(rng.normal(0, 1, (1, lm.HIDDEN)).astype(np.float32), lm.SIZE, 0)
    assert abs(np.exp(net.log_probability(h, np.arange(lm.SIZE)).astype(float)).sum() - 1) < 1e-4


def test_state_is_carried_through_whole_texts():
    net, rng = random_net(1)
    lengths = np.array([1, 700, 3, 3, 90])
    words = rng.integers(0, lm.SIZE, lengths.sum())
    got = lm.text_scores(net, words, lengths, 40)
    at = 0
    for n, score in zip(lengths, got, strict=True):
        h, total, x = np.zeros((1, lm.HIDDEN), np.float32), 0.0, 40
        for y in words[at : at + n]:
            h, _, _ = net.advance(np.array([x]), h)
            total += float(net.log_probability(h, np.array([y]))[0])
            x = y
        at += n
        assert abs(total - score) < 1e-3 * max(1, abs(total))


def test_gradients_against_differences():
    net, rng = random_net(2)
    net.p = [q.astype(np.float64) for q in net.p]
    x, y = rng.integers(0, lm.SIZE, (2, 6, 4))
    h0 = rng.normal(0, 1, (4, lm.HIDDEN))

    def loss():
        h, total = h0, 0.0
        for t in range(6):
            h, _, _ = net.advance(x[t], h)
            total -= net.log_probability(h, y[t]).sum()
        return total / y.size

    grad, _ = net.gradients(x, y, h0)
    for q, g in zip(net.p, grad, strict=True):
        flat, slope = q.reshape(-1), g.reshape(-1)
        for k in [int(np.abs(slope).argmax()), *rng.integers(0, len(flat), 3)]:
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-5 - slope[k]) < 1e-4 * max(1e-2, abs(slope[k])) + 1e-6
