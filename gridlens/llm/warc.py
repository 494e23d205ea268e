"""WARC derivatives: linked metadata and plain-text conversion records of responses.

For every response record one `metadata` record (source headers, title, links,
source digests, as JSON) and one `conversion` record (the visible text) are
built. Both name the response in WARC-Refers-To, the metadata record is
WARC-Concurrent-To its conversion, the target URI and date carry over, the
response's payload digest is kept (and computed where it is missing), and each
new block gets a digest of its own. Record ids derive from the source's id, so
building again gives the same records.

Nulls and edge cases: a null block is empty; a block without a blank line has
headers only; a missing record id is derived from URI, date and block; repeated
responses give repeated records; text that is not HTML or text is not converted
(its conversion is empty). Bytes that do not decode are replaced. A response is
converted whole, however long; an empty table gives no rows; a page with the url of
another is a response of its own, and one that equals it gets the same ids. Columns of
pages that are named like a field of a response make way for it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.text import as_key, exact, longs

RESPONSE = "record_id string, target_uri string, warc_date string, warc_headers map<string,string>, block binary"
RECORD = "key long, record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, content_type string, block_digest string, payload_digest string, http_status int, source_headers string, content_length long, content binary"
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|template|noscript|head)\b[^>]*>.*?</\1\s*>", re.S | re.I)
_BLOCK = re.compile(r"</?(?:p|div|h[1-6]|ul|ol|li|table|tr|td|th|article|section|nav|header|footer|aside|main|form|blockquote|pre|body|html|dl|dt|dd|figure|hr)\b[^>]*>", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")
_HREF = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title\s*>", re.S | re.I)


def digest(data: bytes) -> str:
    """SHA-1 in base 32, as WARC files write digests."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source} {kind}')}>"


def split_http(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """Status, header fields in order, body."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    found = re.match(r"HTTP/\S+ (\d{3})", lines[0])
    return int(found[1]) if found else None, [(k.strip(), v.strip()) for k, sep, v in (x.partition(":") for x in lines[1:]) if sep], body


def decoded(body: bytes, fields: dict[str, str]) -> str | None:
    """Text of a body, or None where it is neither HTML nor text."""
    kind = fields.get("content-type", "text/html").lower()
    if not kind.startswith(("text/", "application/xhtml", "application/xml")):
        return None
    coding = fields.get("content-encoding", "").lower()
    try:
        body = gzip.decompress(body) if coding == "gzip" else zlib.decompress(body) if coding == "deflate" else body
    except (OSError, EOFError, zlib.error):
        return ""
    charset = re.search(r"charset=[\"']?([\w.:-]+)", kind)
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def plain_text(page: str) -> str:
    """All visible text; a line for each block."""
    text = _TAG.sub(" ", _BLOCK.sub("\n", _HIDDEN.sub(" ", page)))
    lines = (" ".join(x.split()) for x in text.split("\n"))
    return html.unescape("\n".join(x for x in lines if x))


def derive_one(record_id: str | None, uri: str | None, date: str | None, headers: dict | None, block: bytes | None) -> list[dict]:
    """The metadata and the conversion record of one response."""
    block, headers = block or b"", {k.lower(): v for k, v in (headers or {}).items()}
    source = record_id or f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uri} {date} {digest(block)}')}>"
    status, fields, body = split_http(block)
    page = decoded(body, {k.lower(): v for k, v in fields})
    text = plain_text(page) if page else ""
    payload = headers.get("warc-payload-digest") or digest(body)
    title = _TITLE.search(page) if page else None
    meta = {
        "source-id": source,
        "source-headers": fields,
        "source-block-digest": headers.get("warc-block-digest") or digest(block),
        "source-payload-digest": payload,
        "source-length": len(block),
        "title": " ".join(html.unescape(title[1]).split()) if title else None,
        "links": [html.unescape(a or b or c) for a, b, c in _HREF.findall(page or "")],
    }
    ids = {kind: derived_id(source, kind) for kind in ("metadata", "conversion")}
    bodies = {"metadata": ("application/json", json.dumps(meta, ensure_ascii=False).encode()), "conversion": ("text/plain; charset=utf-8", text.encode("utf-8", "replace"))}
    return [
        {
            "record_type": kind,
            "record_id": ids[kind],
            "refers_to": source,
            "concurrent_to": ids["conversion"] if kind == "metadata" else None,
            "target_uri": uri,
            "warc_date": date,
            "content_type": mime,
            "block_digest": digest(data),
            "payload_digest": payload,
            "http_status": status,
            "source_headers": json.dumps(fields, ensure_ascii=False),
            "content_length": len(data),
            "content": data,
        }
        for kind, (mime, data) in bodies.items()
    ]


def derive(responses: DataFrame, key: str | Column | None = None) -> DataFrame:
    """Two derived records per response (columns RECORD); `key` (long) is carried along."""
    carried = (F.col(key) if isinstance(key, str) else key if key is not None else F.lit(None))
    carried = as_key(carried).alias("key")
    order = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, rows = exact(batch["key"]), zip( *(batch[c] for c in ("record_id", "target_uri", "warc_date", "warc_headers", "block")), strict=True)
            found = [derive_one(*row) for row in rows]
            keys = [k for k, recs in zip(keys, found, strict=True) for _ in recs]
            yield pd.DataFrame([rec for recs in found for rec in recs], columns=order[1:]).assign(key=longs(keys)).astype({"http_status": "Int32"})

    return responses.select(carried, "record_id", "target_uri", "warc_date", "warc_headers", "block").mapInPandas(run, RECORD)


def as_responses(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of pages that were kept without their HTTP envelope; other columns stay, but for those named like a record's."""
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    head = F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")), "UTF-8")
    block = F.concat(head, body)
    hexa = F.md5(F.concat(F.encode(F.coalesce(F.col(url_col), F.lit("")), "UTF-8"), F.lit(b"\x00"), block))
    parts = [F.substring(hexa, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    made = [
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        F.col(url_col).alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.create_map(F.lit("WARC-Type"), F.lit("response")).alias("warc_headers"),
        block.alias("block"),
    ]
    names = [x.split()[0] for x in RESPONSE.split(", ")]
    return pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in names], *made)


def member(record: dict) -> bytes:
    """One record as a gzip member of a WARC file."""
    fields = [("WARC-Type", record["record_type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Date", record["warc_date"]), ("WARC-Target-URI", record["target_uri"]), ("WARC-Refers-To", record.get("refers_to")), ("WARC-Concurrent-To", record.get("concurrent_to")), ("WARC-Block-Digest", record["block_digest"]), ("WARC-Payload-Digest", record.get("payload_digest")), ("Content-Type", record["content_type"]), ("Content-Length", str(len(record["content"])))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return gzip.compress(head.encode() + record["content"] + b"\r\n\r\n", mtime=0)


def members(records: DataFrame) -> DataFrame:
    """Gzip members of records, in the order of the rows: concatenated, they are a WARC file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"member": [member(r) for r in batch.to_dict("records")]})

    return records.drop("key").mapInPandas(run, "member binary")


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of a WARC file, gzipped or plain."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip()] = v.strip()
        yield fields, stream.read(int(fields.get("Content-Length", 0)))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files, through Spark's own file access; a file is one row of work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                for fields, block in records_of(data):
                    if fields.get("WARC-Type") == "response":
                        yield pd.DataFrame([{"record_id": fields.get("WARC-Record-ID"), "target_uri": fields.get("WARC-Target-URI"), "warc_date": fields.get("WARC-Date"), "warc_headers": fields, "block": block}])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RESPONSE)
