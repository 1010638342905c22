import random
import re

from maskline.llm import quality as q


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    cover = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_measurements_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "\n\n", "a", "é ß\tx　y z", "x y\nx y\r\nx y\n \n", "a b c d e a b c d e", "w" * 70000 + " " + "w" * 70000]
    texts += [rng.choice(["", "\n", " "]).join(rng.choice(["a", "bé", " ", "\n", "#", "ü|", "Zz", "\t", "\x0b", "\x1c"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += ["\n".join(rng.choice(["one two three", "four five", "x"]) for _ in range(40)) for _ in range(5)]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r.doc_id: r for r in q.ledger(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), repr(t)


def test_long_text_is_cut_without_change():
    import numpy as np

    from maskline.llm import textkit as tk

    text = ("lorem ipsum dolor " * 400_000).encode()
    buf = np.frombuffer(text + b"tail end", np.uint8)
    s = tk.segments(buf, np.array([0, len(text), len(buf)]))
    assert len(s.key) == 1_200_002 and len(set(s.key.tolist())) == 5
    assert s.doc[-1] == 1 and s.doc[-3] == 0


def test_policies_and_ablation(spark):
    rows = [(1, "a " * 50), (2, "w" + " x".join(map(str, range(30)))), (3, "HELLO YOU " + " ".join("ABCDEFGHIJKL"))]
    book = q.ledger(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    kept = {r.doc_id for r in book.where(q.passes()).collect()}
    assert kept == {2}
    table = {r.rule: r for r in q.ablation(book).collect()}
    assert table["shouting"].n_only == 1 and table["shouting"].n_kept_without == 2 and table["few_words"].n_rows == 3
    assert q.ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0
