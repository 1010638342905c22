"""WARC archives: writing captures, reading records, and assembling transactions.

Each capture becomes three WARC/1.1 records (request, response or revisit, and
metadata) that WARC-Concurrent-To ties together. Every record is a gzip member
of its own, as the standard asks, and each archive begins with a warcinfo
record. A task fills archives of about FILE_BYTES compressed bytes, one row of
a text table each, so that Spark's writer puts them into any store that it
reaches. It ends a row with a separator: here an empty gzip member, which
decompresses to nothing. Reading takes one member after another from an
archive's bytes and never holds an archive decompressed; transactions are
assembled by grouping records on the identifier of their capture.

Among captures with equal payloads of at least ``min_bytes`` the one with the
largest id is the response and the others revisit it. Defined results: null
html is an empty payload, a null URL an empty one; rows that repeat the largest
id of their payload are all responses; a null id is written as ``null`` and
never the target of a revisit unless no other id has that payload; columns
beside id, URL and html are ignored; an empty table gives empty archives. A
payload larger than FILE_BYTES has an archive of its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.llm.stage import shared_dir, table, written

#: Compressed bytes from which an archive is full: an archive is read by one task.
FILE_BYTES = 16 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "kind string, record_id string, capture_id string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, http_status int, method string, fields map<string,string>, payload string"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str, headers: list[tuple[str, str]], content_type: str, block: bytes) -> bytes:
    """A WARC record without the two CRLF that end it."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    lines += [f"{k}: {v}" for k, v in headers] + [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def member(data: bytes) -> bytes:
    """data as one gzip member."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _info(name: str) -> bytes:
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{name}>", f"WARC-Date: {DATE}", "Content-Type: application/warc-fields"]
    block = b"format: WARC File Format 1.1\r\n"
    return member("\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]+", "%20", url or "")


def _capture(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, place: str) -> list[bytes]:
    payload, uri = (html or "").encode(), _clean(url)
    name = f"urn:page:{'null' if page_id is None else page_id}:{place}"
    sha, ids = digest(payload), {k: f"{name}:{k}" for k in ("capture", "request", "metadata")}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    together = [("WARC-Concurrent-To", f"<{ids['capture']}>")]
    if refers_to is None:
        main = record("response", ids["capture"], uri, [("WARC-Payload-Digest", f"sha1:{sha}")], "application/http; msgtype=response", http + payload)
    else:
        headers = [("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        main = record("revisit", ids["capture"], uri, headers, "application/http; msgtype=response", http)
    host, rest = re.fullmatch(r"(?:.*?://([^/?#]*))?(.*)", uri, re.S).groups()
    ask = f"GET {rest or '/'} HTTP/1.1\r\nHost: {host or ''}\r\n\r\n".encode()
    note = f"page-id: {'null' if page_id is None else page_id}\r\nfetch-order: {place}\r\n".encode()
    return [
        record("request", ids["request"], uri, together, "application/http; msgtype=request", ask),
        main,
        record("metadata", ids["metadata"], uri, together, "application/warc-fields", note),
    ]


def with_revisits(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """pages with refers_to: the id of the response that a revisit repeats, else null."""
    body = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.unhex(F.sha1(body.cast("binary"))).alias("_sha"))
    latest = keyed.where(F.octet_length(body) >= min_bytes).groupBy("_sha").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n"))
    latest = written(latest.where("_n > 1").drop("_n"), folder, "latest")
    refers = F.when(~F.col("_last").eqNullSafe(F.col("page_id")), F.col("_last"))
    return keyed.join(latest, "_sha", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(captures: DataFrame, path: str) -> None:
    """Write (page_id, url, html, refers_to) as WARC files under path, a gzip member for each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, files, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join([_info(f"{part}.{files}"), *held])], pa.binary())], names=["value"])
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns), strict=True):
                    for x in _capture(page_id, url, html, refers_to, f"{part}.{n}"):
                        held.append(member(x + b"\r\n\r\n"))
                        size += len(held[-1])
                    n += 1
                    if size >= FILE_BYTES:
                        yield done()
                        files, held, size = files + 1, [], 0
        if held:
            yield done()

    rows = captures.select("page_id", "url", "html", "refers_to").mapInArrow(run, "value binary")
    # bytes pass through a text column and the writer as they are; the separator is an empty member
    rows.select(F.col("value").cast("string")).write.option("lineSep", member(b"").decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """What the gzip members of an archive hold, one after another."""
    view, at = memoryview(data), 0
    while at < len(data):
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof and at < len(data):
            part = view[at : at + step]
            out.append(unpack.decompress(part))
            at += len(part) - len(unpack.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of plain bytes, or of an archive of gzip members."""
    for plain in members(data) if data[:2] == b"\x1f\x8b" else (data,):
        at = 0
        while at < len(plain):
            stop = plain.find(b"\r\n\r\n", at)
            head = plain[at:stop].decode().split("\r\n")
            if stop < 0 or not head[0].startswith("WARC/"):
                raise ValueError(f"no WARC record at byte {at}")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
            size = int(headers["content-length"])
            yield headers, plain[stop + 4 : stop + 4 + size]
            at = stop + 4 + size + 4


def _fields(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode().split("\r\n")) if k}


def _row(headers: dict[str, str], block: bytes, payload: bool) -> dict:
    kind, own = headers["warc-type"], headers["warc-record-id"].strip("<>")
    row = {"kind": kind, "record_id": own, "capture_id": headers.get("warc-concurrent-to", own).strip("<>"), "target_uri": headers.get("warc-target-uri")}
    if kind == "metadata":
        row["fields"] = list(_fields(block).items())
        page = dict(row["fields"]).get("page-id", "null")
        row["page_id"] = None if page == "null" else int(page)
    elif kind == "request":
        row["method"] = block.split(b" ", 1)[0].decode()
    elif kind in ("response", "revisit"):
        http, _, body = block.partition(b"\r\n\r\n")
        status, _, rest = http.partition(b"\r\n")
        row["http_status"] = int(status.split()[1])
        stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "response":
            row |= {"payload_bytes": len(body), "payload_digest": digest(body)}
            if stated and stated != row["payload_digest"]:
                raise ValueError(f"payload of {own} does not match its digest")
            if payload:
                row["payload"] = body.decode()
        else:
            row |= {"payload_bytes": int(_fields(rest)["content-length"]), "payload_digest": stated, "refers_to": int(headers["warc-refers-to"].strip("<>").rpartition(":")[2])}
    return row


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of the archives under path; payload=False leaves the payloads out."""
    wanted = pa.schema([
        *((n, pa.string()) for n in ("kind", "record_id", "capture_id", "target_uri")), *((n, pa.int64()) for n in ("page_id", "refers_to", "payload_bytes")),
        ("payload_digest", pa.string()), ("http_status", pa.int32()), ("method", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in parse(content.as_py()):
                    if headers["warc-type"] == "warcinfo":
                        continue
                    rows.append(_row(headers, block, payload))
                    size += len(block) if payload else 0
                    if len(rows) == 500 or size > FILE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, wanted)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, wanted)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, capture, request, metadata)."""
    keep = [c for c in records.columns if c not in ("kind", "capture_id")]
    pick = lambda *kinds: F.first(F.when(F.col("kind").isin(*kinds), F.struct("kind", *keep)), ignorenulls=True)
    return records.groupBy("capture_id").agg(pick("response", "revisit").alias("capture"), pick("request").alias("request"), pick("metadata").alias("metadata")).where("capture is not null")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages -> archives -> page_id, payload_bytes, payload_digest, record_type, refers_to, url, method, http_status."""
    folder = shared_dir(spark)
    write_archives(with_revisits(table(spark, sf_dir, "pages"), folder), f"{folder}/warc")
    found = transactions(read_records(spark, f"{folder}/warc", payload=False).drop("payload"))
    return found.select(
        "metadata.page_id", "capture.payload_bytes", "capture.payload_digest", F.col("capture.kind").alias("record_type"), "capture.refers_to",
        "capture.target_uri", "request.method", "capture.http_status",
    )


QUERIES = {"op6_warc": op6_warc}
ORACLES: dict[str, str] = {}
