import html as entities
import random

from maskline.llm import html as h

NOISE = [
    '<nav class="top"><ul><li><a href="/a">Menu</a><li><a>Two</a></ul></nav>', '<header><h2>Site</h2></header>', '<aside>Side <b>bar</b></aside>', '<div class="cookie-notice">We use cookies</div>',
    '<div id="ad-7">Buy <span>now</span></div>', '<form><label>Mail</label><input name=x><button>Go</button></form>', '<script>if (a < b) { x("</p>") }</script>', "<style>p > a {}</style>",
    '<section class="comments"><p>First!</p><p>Nice <i>post</i></p></section>', "<!-- <p>hidden</p> -->", "<footer>&copy; 2024</footer>", '<div role="navigation">Next</div>',
]


def page(rng, text_blocks, noise):
    body = [f"<p>{entities.escape(b)}" + rng.choice(["", "</p>"]) for b in text_blocks]
    for n in noise:
        body.insert(rng.randrange(len(body) + 1), n)
    out = [rng.choice(NOISE) for _ in range(3)]
    tag = rng.choice(["article", "main"])
    return f"<!DOCTYPE html><html><head><title>T &amp</title></head><body class='sidebar'>{out[0]}{out[1]}<{tag}><h1>Head</h1>{''.join(body)}</{tag}>{out[2]}</body></html>"


def test_articles_in_mixed_templates(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(300):
        text = [" ".join(rng.choice(["a<b", "ü&x", "word", "it's", " \n\ttab", "日本"]) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 6))]
        rows.append((k, None if k == 7 else f"http://h{k % 3 and k % 5}.org/{k}", page(rng, text, rng.sample(NOISE, 3)), "clash"))
        want[k] = " ".join(["Head", *(x for b in text if (x := " ".join(b.split())))])
    more = {900: (None, ""), 901: ("", ""), 902: ("plain & simple", "plain & simple"), 903: ("<p>a<br>b <b>c</b>d</p></div><p>e", "a b cd e"), 904: ("<article></article><p>x", ""), 905: ("<div", "<div"),
            906: ("<article>" + "<p>w</p>" * 20_000 + "</article>", " ".join(["w"] * 20_000)), 907: ("<article>x <script>never ends", "x"), 908: ("<article><p>&#233;&eacute; &lt;b&gt;</article>", "éé <b>")}
    for k, (body, text) in more.items():
        rows.append((k, None, body, "clash"))
        want[k] = text
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in h.extract(df).collect()}
    assert len(got) == len(rows)
    for k, text in want.items():
        assert got[k].text == text, (k, rows[k][2] if k < 300 else None)
    assert h.extract(df.limit(0)).count() == 0


def test_wrapper_of_a_host(spark):
    make = lambda k: f"<body><h4>Our shop</h4><div class=story>{''.join(f'<p>story {k} {j}</p>' for j in range(k % 4 + 1))}</div>{'<div class=box>note</div>' if k % 2 else ''}<h5>The end</h5></body>"
    df = spark.createDataFrame([(k, "http://shop.org/", make(k)) for k in range(20)], "page_id long, url string, html string")
    got = {r.page_id: r for r in h.extract(df).collect()}
    assert got[3].text == "story 3 0 story 3 1 story 3 2 story 3 3"  # template text of the host is gone
    w = got[3].wrapper
    assert w.replace("div.box T", "X").count("(") == 2 and "( +p T -p )+" in w and "( +div.box T -div.box )?" in w
    for k in range(20):
        assert h.accepts(w, h.fold(" ".join(h.parse(make(k))[0]) + " ").strip())


def test_template_text_is_told_by_slot(spark):
    """Both divs have one path; only the wrapper tells the first, which is the same on all pages, from the second."""
    make = lambda k: f"<body><div>Our shop</div><h4>Story {k}</h4><div>text {k}</div>{'<aside><p>more</p></aside>' if k % 2 else '<p>own ' + str(k) + '</p>'}</body>"
    df = spark.createDataFrame([(k, "http://shop.org/", make(k)) for k in range(12)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.extract(df).collect()}
    assert got[3] == "Story 3 text 3" and got[4] == "Story 4 text 4 own 4"
    assert h.places("+a T -a ( +b T -b )+ ( +c T -c )?", "+a T -a +b T -b +b T -b ") == (1, 2, 2)
    assert h.places("+a T -a", "+b T -b ") is None


def test_copies_of_a_page_are_no_template(spark):
    copy = "<body><h4>News</h4><div>The whole story</div></body>"
    other = lambda k: f"<body><h5>Shop</h5><table><tr><td>item {k}</table></body>"
    rows = [(k, "http://a.org/", copy) for k in range(3)] + [(k, None, copy) for k in range(3, 8)] + [(k, None, other(k)) for k in range(8, 12)] + [(12, None, other(11))]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[k] for k in range(8)} == {"News The whole story"}
    assert [got[k] for k in range(8, 13)] == ["item 8", "item 9", "item 10", "item 11", "item 11"]


def test_alignment():
    assert h.fold("a b a b a b c ") == "( a b )+ c "
    assert h.align("a ( b )+ c", "a b c") == "a ( b )+ c"
    assert h.align("a c", "a b c") == "a ( b )? c"
    assert h.align("a ( b )? c", "a c") == "a ( b )? c"
    w = h.align("a x c", "a y c")
    assert h.accepts(w, "a x c") and h.accepts(w, "a y c")


def test_names_that_only_look_like_outside(spark):
    inner = "<div class='social-science'><p>theory</p></div><div class='post-header'><h1>Head</h1></div><div class='user-comments'>no</div><div id='ad-7'>no</div><div class='site-header'>no</div><div class='search links'>no</div><p>rest"
    got = h.extract(spark.createDataFrame([(1, "http://a.org/", f"<article>{inner}</article>")], "page_id long, url string, html string")).first()
    assert got.text == "theory Head rest"


def test_hot_host_and_any_partitioning(spark):
    """One host with more layouts than one step aligns; the same texts come from 1 and 64 partitions, and without its wrapper a page keeps template text."""
    kinds = [f"<h{k % 3 + 2}>Own {k}</h{k % 3 + 2}>" + "".join(f"<{t}>{t} {k}</{t}>" for j, t in enumerate(("ul", "ol", "dl", "pre", "center", "address", "figure")) if k >> j & 1) for k in range(128)]
    make = lambda k: f"<body><div>Our shop</div><section>{kinds[k]}</section><div>text {k}</div></body>"
    df = spark.createDataFrame([(k, None, make(k)) for k in range(128)] + [(128, None, make(5))], "page_id long, url string, html string")
    one = {r.page_id: r.text for r in h.extract(df.repartition(1)).collect()}
    assert one == {r.page_id: r.text for r in h.extract(df.repartition(64)).collect()}
    assert one[5] == one[128] and one[5].endswith("text 5") and one[5].startswith("Own 5")
    assert h.main_text(make(5), None, frozenset()).startswith("Our shop Own 5")


def test_long_streams_match_in_bounded_time():
    w = "( ( +a -a )? ( +a -a )? ( +a -a )? ( +a -a )? )+ +b -b"
    assert not h.accepts(w, " ".join(["+a -a"] * 5000)) and h.accepts(w, " ".join(["+a -a"] * 5000) + " +b -b")
