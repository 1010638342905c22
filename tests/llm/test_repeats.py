import hashlib
import random
import re

import numpy as np

from maskline.llm import exchange as ex
from maskline.llm import repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """(id, n_words, n_removed, spans, kept) by looking every window up; rows are in order."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, out = set(), [None] * len(rows)
    for k in order:
        words = WORD.findall(rows[k][1] or "")
        gone, starts = set(), []
        for s in range(len(words) - 19):
            g = tuple(words[s : s + 20])
            if g in seen:
                gone.update(range(s, s + 20))
                starts.append(s)
            seen.add(g)
        spans = []
        for s in starts:
            if spans and s == spans[-1][1] - 19:
                spans[-1][1] = s + 20
            else:
                spans.append([s, s + 20])
        out[k] = (rows[k][0], len(words), len(gone), tuple(map(tuple, spans)), " ".join(w for p, w in enumerate(words) if p not in gone))
    return out


def found(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, kept string, chunk int").repartition(parts)
    got = repeats.without_repeats(df).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, tuple((x.start, x.end) for x in r.spans), r.kept) for r in got), key=repr)


def test_against_every_window(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)] + ["é", "日本", "<b>", "W1"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(15, 70))) for _ in range(6)]
    rows = []
    for k in range(120):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(3)]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages).split()
            a = rng.randrange(0, 12)
            parts.insert(rng.randrange(len(parts)), "\t".join(p[a:]))
        rows.append((k - 7, "\n".join(parts)))
    rows += [(500, None), (501, ""), (502, " \n "), (503, "a " * 19), (504, "a " * 20), (505, "a " * 400), (None, passages[0])]
    rows += [(600 + k, rows[3][1]) for k in range(30)]  # a group of copies
    assert found(spark, rows) == sorted(brute(rows), key=repr)


def test_repeated_rows_and_nothing(spark):
    text = " ".join(f"x{k}" for k in range(50))
    got = found(spark, [(1, text), (1, text), (1, text), (None, text), (None, text)])
    assert sorted(r[2] for r in got) == [0, 50, 50, 50, 50]
    assert [r for r in got if r[2] == 0][0][0] == 1
    assert found(spark, [(2, "one two"), (3, None)]) == [(2, 2, 0, (), "one two"), (3, 0, 0, (), "")]
    assert found(spark, []) == []


def test_one_text_longer_than_a_chunk(spark):
    rng = random.Random(9)
    own = [f"u{rng.randrange(10**9)}" for _ in range(900_000)]
    own[700_000:700_300] = own[100:400]
    text = " ".join(own)
    assert len(text) > ex.CHUNK_TEXT
    got = found(spark, [(1, text), (2, " ".join(own[650_000:650_030]))], 1)
    assert [(r[2], r[3]) for r in got] == [(300, ((700_000, 700_300),)), (30, ((0, 30),))]


def test_blocks_of_hashes():
    rng = np.random.default_rng(1)
    for bits in (40, 52, 64):
        keys = np.unique(ex.cut(rng.integers(0, 2**64, 5000, dtype=np.uint64), bits))
        parts = [ex.unpacked(ex.packed(keys[a:b], bits), b - a, bits) for _, a, b in ex.cuts(keys, 7)]
        assert (np.concatenate(parts) == keys).all()
    for values in ([0], [5, 3, 2**62], [-7, 9, 2**63 - 1], [-(2**63), 2**63 - 1]):
        x = np.array(values, np.int64)
        assert (ex.from_range(ex.ranged(x), len(x)) == x).all()


def test_digest(spark, tmp_path):
    spark.createDataFrame([(1, " a  b\n")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = repeats.op13_substring_dedup(spark, str(tmp_path)).first()
    assert (r.n_words, r.n_removed, r.kept_sha256) == (2, 0, hashlib.sha256(b"a b").hexdigest())
