import random
import re
from collections import Counter

from maskline.llm import phrases


def brute(rows, least):
    """{(lang, phrase): (a, l, r, n, score)} by counting every run of words."""
    f, n, longer = Counter(), Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    for p, a in f.items():
        if len(p) == 4 and a >= least:
            for part in (p[:3], (p[0], *p[2:])):
                longer[part] = max(longer.get(part, 0), a)
    out = {}
    for p, a in f.items():
        if len(p) > 2 and a >= least and 100 * longer.get(p, 0) < 50 * a:
            cuts = [((10**6 * a * a) // (f[p[: 1 + k]] * f[(p[0], *p[1 + k :])]), k, f[p[: 1 + k]], f[(p[0], *p[1 + k :])]) for k in range(1, len(p) - 1)]
            score, _, left, right = min(cuts)
            out[p[0], " ".join(p[1:])] = (a, left, right, n[p[0]], score)
    return out


def found(spark, rows, parts, least=phrases.LEAST):
    df = spark.createDataFrame([(lang, t, "clash", 1) for lang, t in rows], "lang string, text string, phrase string, n int").repartition(parts)
    got = phrases.collocations(df, least=least).collect()
    assert len(got) == len({(r.lang, r.phrase) for r in got})
    return {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in got}


def texts(n):
    rng = random.Random(11)
    words = ["the", "The", "of", "a", "é", "É", "日本", "x-y", "<b>", "one", "two", "three"] + [f"w{k}" for k in range(8)]
    gap = [" ", "  ", "\t", ", ", "\n", ". ", " ! "]
    one = lambda: "".join(rng.choice(words) + rng.choices(gap, (20, 2, 1, 2, 1, 1, 1))[0] for _ in range(rng.randrange(0, 120)))
    return [(rng.choices(["en", "de", None, ""], (8, 3, 1, 1))[0], one() + "new york city " * rng.randrange(0, 3)) for _ in range(n)]


def test_against_all_runs_of_words(spark):
    rows = [*texts(400), ("en", None), ("fr", ""), ("en", "a a a a a a a a a a a a a a a"), ("long", "ab cd " * 1000)]
    want = brute(rows, 10)
    assert len(want) > 40
    assert found(spark, rows, 5) == want
    assert found(spark, rows, 1) == want  # however the shards come out
    assert found(spark, [], 1) == {}


def test_repeated_rows_count_each(spark):
    assert found(spark, [("en", "big apple")] * 10, 4) == {("en", "big apple"): (10, 10, 10, 20, 1_000_000)}
    assert found(spark, [("en", "big apple")] * 9, 4) == {}


def test_a_language_in_one_shard_only(spark):
    rows = [("de", "ja nein")] * 10 + [(f"l{k}", "x y z " * 10) for k in range(40)]
    assert found(spark, rows, 6) == brute(rows, 10)
