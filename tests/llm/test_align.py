import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from maskline.llm import align


@pytest.fixture(scope="module")
def pair():
    return align.default_pair()


@pytest.fixture(scope="module")
def encoders(pair):
    a = Tokenizer.from_file(pair.paths[0])
    a.encode_special_tokens = True
    return lambda t: a.encode(" " + t, add_special_tokens=False).ids, pair.b_model.encode


ODD = list("aeiou nthrsT'sdl  \n\t\r0129.,!?-_") + ["é", "ß", "½", "\xa0", "　", "日", "本", "́", "🙂", "’", " the", "<|endoftext|>", "<s>", "<0x41>", "<unk>", "▁", "\0", "ﬁ", "K", "Å"]


def texts(n):
    rng = random.Random(3)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_ids_are_those_of_whole_texts(pair, encoders):
    every = [*texts(6000), None, "", " ", "   ", "a  ", "\n", "x" * 3000, "a\n b\n  c \t d", " a b", "a b "]
    for some in (every[:200], every):  # parts that are new and parts that are known
        sides = pair.encoded(some)
        for k, tokens in enumerate(sides):
            ids = [x.tolist() for x in np.split(tokens.ids, np.cumsum(tokens.count)[:-1])]
            for t, got in zip(some, ids, strict=True):
                whole = (" " + (t or "")).encode()
                good = t and "▁" not in t and b"".join(pair.b_bytes[x] for x in encoders[1](t)) == whole
                assert got == (encoders[k](t) if good else []), repr(t)


def brute(rows, pair, encoders):
    held, docs = defaultdict(set), []
    for k, (i, t) in enumerate(rows):
        a, b = (encoders[0](t), encoders[1](t)) if t else ([], [])
        whole = (" " + t).encode() if t else b""
        if b"".join(pair.a_bytes[x] for x in a) != whole or b"".join(pair.b_bytes[x] for x in b) != whole:
            a, b = [], []
        spans = []
        for ids, names in ((a, pair.a_bytes), (b, pair.b_bytes)):
            at, out = 0, []
            for x in ids:
                out.append((at, at + len(names[x]), x))
                at += len(names[x])
            spans.append(out)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = ";".join("|".join(",".join(str(x) for s, e, x in side if lo < e <= hi) for side in spans) for lo, hi in zip([0, *ends], ends, strict=False))
        link = [(x, y) for s, e, x in spans[0] for u, v, y in spans[1] if s < v and u < e]
        for p in link:
            held[p].add(k)
        docs.append((i, len(a), len(b), len(ends), link, hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    best = Counter()
    for (x, _), s in held.items():
        best[x] = max(best[x], len(s))
    return sorted(((i, a, b, g, len(link), sum(len(held[p]) == best[p[0]] for p in link), sum(len(held[p]) for p in link), h) for i, a, b, g, link, h in docs), key=repr)


def test_against_all_overlaps(spark, pair, encoders):
    rows = [*enumerate(texts(150)), (1000, None), (1001, ""), (1002, "the cat the cat the cat " * 40), (None, "the cat"), (1003, "the cat"), (1003, "the cat"), (1004, "a▁b")]
    want = brute(rows, pair, encoders)
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_a int").repartition(3)
    got = align.alignments(df, pair, digest=True).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want
    written = {r.doc_id: r.groups for r in align.alignments(df, pair).collect() if r.doc_id == 1002}
    assert hashlib.sha256(written[1002].encode()).hexdigest() == next(r.groups for r in got if r.doc_id == 1002)
    assert align.alignments(df.limit(0), pair).count() == 0


def test_bitmaps():
    rng = np.random.default_rng(2)
    for n_docs in (1, 40, 5000):
        parts = [align.planes(rng.integers(0, n_docs, 3000), rng.zipf(1.3, 3000).clip(1, 500)) for _ in range(3)]
        both = align.merged([p[0] for p in parts])
        assert set(zip(both.key.tolist(), both.doc.tolist(), strict=True)) == {x for p in parts for x in zip(p[0].key.tolist(), p[0].doc.tolist(), strict=True)}
        again = align.Bitmaps.unpacked(*both.packed(n_docs), n_docs)
        assert (again.key == both.key).all() and (again.doc == both.doc).all()


def test_links_by_planes(spark, pair, tmp_path):
    df = spark.createDataFrame([(k, "ab cd " * k) for k in range(1, 60)], "doc_id long, text string").repartition(2)
    index = align.pair_index(df, pair, "doc_id", "text", str(tmp_path))
    counts = align.token_pairs(align.pair_counts(align.popcounts(index)))
    assert counts.agg({"n_links": "sum"}).first()[0] == sum(sum(r.n_links) for r in index.collect())
    assert counts.agg({"n_docs": "max"}).first()[0] == 59
