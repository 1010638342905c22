import base64
import hashlib

from maskline.llm import warc as w
from maskline.llm.stage import shared_dir

HTML = [None, "", "<p>a</p>", "<p>a</p>", "WARC/1.1\r\n\r\n\r\n\r\nWARC-Type: x", "é\x00\n" * 50_000, "<p>a</p>", "\r\n\r\n"]


def test_round_trip(spark):
    rows = [(i, None if i == 3 else f"http://h{i}.org/a b?q\r\n", h, "z") for i, h in enumerate(HTML * 3)] + [(23, "u", "\r\n\r\n", "z")]
    folder = shared_dir(spark)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    w.write_archives(w.with_revisits(pages, folder), folder + "/warc")
    records = w.read_records(spark, folder + "/warc")
    got = w.transactions(records).collect()
    assert records.count() == 3 * len(rows) and len(got) == len(rows)
    last = {}
    for i, _, h, _ in rows:
        last[h or ""] = max(last.get(h or "", -1), i)
    html = {i: h or "" for i, _, h, _ in rows}
    for r in got:
        page = r.metadata.page_id
        body = html[page].encode()
        assert r.capture.payload_bytes == len(body) and r.capture.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = last[html[page]] == page
        assert r.capture.kind == ("response" if first else "revisit") and r.capture.refers_to == (None if first else last[html[page]])
        assert r.capture.payload == (html[page] if first else None)
        assert r.request.method == "GET" and r.metadata.page_id == page
    few = w.with_revisits(pages, folder + "/few", min_bytes=4).where("refers_to is not null").count()
    assert few == sum(len((h or "").encode()) >= 4 and last[h or ""] != i for i, _, h, _ in rows)


def test_empty(spark):
    folder = shared_dir(spark)
    w.write_archives(w.with_revisits(spark.createDataFrame([], "page_id long, url string, html string"), folder), folder + "/warc")
    assert w.transactions(w.read_records(spark, folder + "/warc")).count() == 0


def test_each_record_is_a_member_and_files_are_bounded(spark, monkeypatch):
    import gzip
    import random

    monkeypatch.setattr(w, "FILE_BYTES", 20_000)
    rng, folder = random.Random(1), shared_dir(spark)
    rows = [(i, "http://a.org/", "".join(rng.choice("abcdefgh<>") for _ in range(3000)), None) for i in range(60)]
    w.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, refers_to long").coalesce(2), folder + "/warc")
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(folder + "/warc").collect()]
    assert len(files) > 3 and all(len(f) < 30_000 for f in files)
    for f in files:
        parts = list(w.members(f))
        assert parts[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and all(p.startswith(b"WARC/1.1") and p.endswith(b"\r\n\r\n") for p in parts if p)
        assert gzip.decompress(f) == b"".join(parts) and sum(1 for _ in w.parse(f)) == sum(bool(p) for p in parts)
    assert w.transactions(w.read_records(spark, folder + "/warc")).count() == 60
