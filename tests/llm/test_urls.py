import re

from maskline.llm import urls

CASES = [None, "", "no scheme", "http://", "http://ORG", "http://a.org/x", "http://example.org/es/q", "https://www.Example.ORG/en/12?x=1", "http://badexample.org/es/",
         "http://a.com/fr/", "http://a.com/de/x#t", "http://a.com/DE/", "http://com/fr/a", "http://alphabets.net/x", "http://free-bets.net/", "http://casino.net", "http://u:p@a.org:80/",
         "http://spam-spam.net/", "x://y://z/adults", "http://click.net/x/track", "http://click.net/free", "http://ÉXXX.net/xxxé", "http://a.net/free/free/FREE", "http://a.net/" + "w" * 100_000]


def brute(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    low = lambda s: re.sub("[A-Z]", lambda c: c[0].lower(), s)
    host, path = (low(m[1]), m[2]) if m else ("", "")
    best = None
    for r in urls.RULES:
        name, slash, rest = r.pattern.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest) and (best is None or len(r.pattern) > len(best.pattern)):
            best = r
    hit = lambda t: re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low(url or ""))
    soft = [w for t, w in urls.SOFT.items() if hit(t)]
    bad = any(map(hit, urls.STRICT)) or (len(soft) >= 2 and sum(soft) >= 3)
    return host, path, best and best.pattern, best.verdict if best else "block" if bad else "allow"


def test_judge(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(CASES * 2)], "page_id long, url string, host string")
    got = urls.judge(df).collect()
    assert len(got) == 2 * len(CASES)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(CASES[r.page_id % len(CASES)]), CASES[r.page_id % len(CASES)]
    assert urls.judge(df.limit(0)).count() == 0


def test_vocabulary_from_a_table(spark):
    terms = spark.createDataFrame([("Bad", "strict", 5), ("meh", "soft", 1), ("Meh ", "soft", 2), ("so", "soft", 1), (" ", "soft", 9), (None, "soft", 1)], "term string, kind string, weight int")
    strict, soft = urls.read_vocabulary(terms)
    assert strict == {"bad": 5} and soft == {"meh": 2, "so": 1}
    df = spark.createDataFrame([(1, "http://a.net/bad"), (2, "http://meh.net/so"), (3, "http://meh.net/meh"), (4, "http://casino.net/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge(df, (), strict=strict, soft=soft).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}
