import hashlib
import random

import pytest
from tokenizers import Tokenizer

from maskline.llm import bpe

PATH = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH)


def random_texts(n):
    rng = random.Random(7)
    alphabet = list("aeiou nthrsT'sdl  \n\t\r0129.,!?-_") + ["é", "ü", "ß", "²", "ª", "½", "×", "\x1c", "\x85", "\xa0", " ", "　", "日", "本", "́", "🙂", "’", "'ll", "'re", " the", "<|endoftext|>", "<|end", "ſ", "ı", "​", "٣", "\0", "Ж"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_every_token_and_random_texts(codec, reference):
    encode = codec.encoder()
    for text in random_texts(6000) + ["a" * 3000, " " * 500 + "x", "<|endoftext|>" * 3, "\n \n  \n"]:
        want = reference.encode(text, add_special_tokens=False).ids
        assert encode(text).tolist() == want, repr(text)
        assert codec.decode_bytes(encode(text)).decode("utf-8", "replace") == reference.decode(want, skip_special_tokens=False)
    wrong = [i for i in codec.ordinary if codec.encode_piece(codec.tokens[i]) != [i]]
    assert not wrong


def test_broken_utf8_and_unknown_ids(codec, reference):
    import numpy as np

    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.randrange(256) for _ in range(8)]
        assert codec.decode_bytes(np.array(ids)).decode("utf-8", "replace") == reference.decode(ids, skip_special_tokens=False)
    with pytest.raises(ValueError):
        codec.decode_bytes(np.array([50257]))


def test_frames(spark, reference):
    texts = [None, "", "Hello  world é", "Hello  world é", "x " * 60_000, *random_texts(40)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.digests(df, PATH).collect()}
    for i, t in enumerate(texts):
        ids = reference.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(df.limit(0), PATH).count() == 0


def test_one_worker_encodes_and_decodes(spark):
    df = spark.createDataFrame([(i, f"text {i} é <|endoftext|>" if i % 7 else None) for i in range(2500)], "doc_id long, text string")
    plan = bpe.digests(df, PATH)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # else each task holds the tables twice
    apart = bpe.decode(bpe.encode(df, PATH), PATH)
    assert sorted(map(tuple, bpe.round_trip(df, PATH).collect())) == sorted(map(tuple, apart.collect()))
