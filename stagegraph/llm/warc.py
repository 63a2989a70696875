"""WARC derivative builder: response records become linked metadata and plain-text conversion records.

A record is a row (record_id, warc_type, refers_to, target_uri, warc_date, headers, block): ``headers`` holds the named WARC fields in
order, ``block`` the bytes of the record. ``responses`` makes response records of pages; ``parse_records`` reads the records of WARC
files (gzip or plain, as ``binaryFile`` rows); ``derive`` is the builder; ``to_bytes`` gives each record's wire form and
``write`` stores them as WARC files.

For each response, ``derive`` gives

* a *metadata* record (application/warc-fields): the source's status, content type, server, title, language, link and character
  counts, and the source's payload digest;
* a *conversion* record (text/plain): the page's visible text, whole.

Both name the response in WARC-Refers-To with its URI and date, keep its target URI, date and the source's own headers (as
``X-Source-*`` fields), carry a digest of their own block and the source's digest. Ids are UUIDs of the source's id and the kind, so
that a repeated run gives the same records.

Defined cases: a null or empty page is a response with an empty body; a null url is an empty target; rows that repeat give equal
records each; a body that is not UTF-8 is read with replacement; records of other types pass ``derive`` by; a file that is cut off ends
with its last whole record; an empty table gives no records; further columns are ignored; pages of any length are whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagegraph.llm.common import arrow_schema, pieces, record, shared_dir, table

RECORD = "record_id string, warc_type string, refers_to string, target_uri string, warc_date string, headers array<struct<name:string,value:string>>, block binary"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:stagegraph:warc")
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|head|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.DOTALL | re.IGNORECASE)
BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*(?:>|\Z)", re.IGNORECASE)
MARKUP = re.compile(r"<[!?/A-Za-z][^>]*(?:>|\Z)")
TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.DOTALL | re.IGNORECASE)
LANG = re.compile(r"<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.IGNORECASE)
LINK = re.compile(r"<a\b[^>]*?\bhref\s*=", re.IGNORECASE)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(parts))}>"


def plain_text(page: str) -> str:
    """The visible text, a line for each block."""
    text = html.unescape(MARKUP.sub("", BREAK.sub("\n", HIDDEN.sub("\n", page).replace("\n", " ").replace("\r", " ")).replace("\x00", "")))
    lines = (" ".join(x.split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def split_http(block: bytes) -> tuple[bytes, list[tuple[str, str]], bytes]:
    """Status line, header fields and body of an HTTP message; a block without a status line is all body."""
    if not block.startswith(b"HTTP/"):
        return b"", [], block
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.split(b"\r\n")
    fields = [tuple(x.decode("latin-1").split(":", 1)) for x in lines if b":" in x]
    return status, [(k.strip(), v.strip()) for k, v in fields], body


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """RECORD rows: each page as the response that brought it."""
    target = arrow_schema(pages.sparkSession, RECORD)

    def run(batches):
        for batch in pieces(batches):
            rows = []
            for page_id, url, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                body = (page or "").encode("utf-8", "surrogatepass")
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                own = record_id("response", str(page_id), url or "")
                headers = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
                rows.append((own, "response", None, url or "", date, [{"name": k, "value": v} for k, v in headers], block))
            yield record(dict(zip(target.names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in target.names}, target)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, RECORD)


def _derived(own: str, uri: str, date: str, headers: dict[str, str], block: bytes) -> list[tuple]:
    status, fields, body = split_http(block)
    source = headers.get("WARC-Payload-Digest") or digest(body)
    page, of = body.decode("utf-8", "replace"), {k.lower(): v for k, v in fields}
    text = plain_text(page)
    title, lang = TITLE.search(page), LANG.search(page)
    about = [
        ("sourceStatus", status.decode("latin-1")), ("sourceContentType", of.get("content-type", "")), ("sourceContentLength", str(len(body))),
        ("title", " ".join(html.unescape(title[1]).split()) if title else ""), ("language", lang[1].lower() if lang else ""),
        ("outlinks", str(len(LINK.findall(page)))), ("textCharacters", str(len(text))), ("sourcePayloadDigest", source),
    ]
    warc_fields = "".join(f"{k}: {v}\r\n" for k, v in about).encode()
    made = []
    for kind, media, content in (("metadata", "application/warc-fields", warc_fields), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "surrogatepass"))):
        named = [
            ("WARC-Refers-To", own), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("X-Source-Payload-Digest", source),
            *((f"X-Source-{k}", v) for k, v in fields), ("Content-Type", media), ("WARC-Block-Digest", digest(content)), ("Content-Length", str(len(content))),
        ]
        made.append((record_id(kind, own), kind, own, uri, date, [{"name": k, "value": v} for k, v in named], content))
    return made


def derive(records: DataFrame) -> DataFrame:
    """RECORD rows: a metadata and a conversion record for each response."""
    target = arrow_schema(records.sparkSession, RECORD)

    def run(batches):
        for batch in pieces(batches):
            rows = []
            for own, uri, date, headers, block in zip(*(batch.column(c).to_pylist() for c in ("record_id", "target_uri", "warc_date", "headers", "block")), strict=True):
                rows += _derived(own or "", uri or "", date or "", {x["name"]: x["value"] for x in headers or ()}, block or b"")
            yield record(dict(zip(target.names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in target.names}, target)

    return records.where("warc_type = 'response'").mapInArrow(run, RECORD)


def wire(own: str, kind: str, uri: str | None, date: str | None, headers: list[tuple[str, str]], block: bytes) -> bytes:
    first = [("WARC-Type", kind), ("WARC-Record-ID", own), *((("WARC-Target-URI", uri),) if uri else ()), *((("WARC-Date", date),) if date else ())]
    clean = lambda v: re.sub(r"[\r\n]+", " ", v or "")
    return b"WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in [*first, *headers]).encode() + b"\r\n" + block + b"\r\n\r\n"


def to_bytes(records: DataFrame, compress: bool = True) -> DataFrame:
    """(record_id, data): each record as it stands in a WARC file, by default a gzip member of its own."""
    shape = "record_id string, data binary"
    target = arrow_schema(records.sparkSession, shape)

    def run(batches):
        for batch in pieces(batches):
            rows = [wire(own, kind, uri, date, [(h["name"], h["value"]) for h in headers or ()], block or b"") for own, kind, uri, date, headers, block in zip(*(batch.column(c).to_pylist() for c in ("record_id", "warc_type", "target_uri", "warc_date", "headers", "block")), strict=True)]
            yield record({"record_id": batch.column("record_id"), "data": [gzip.compress(x, 6, mtime=0) for x in rows] if compress else rows}, target)

    return records.mapInArrow(run, shape)


def write(records: DataFrame, path: str) -> None:
    """Uncompressed WARC files under ``path``, one a partition, through Spark's text writer (on any store that Spark writes to).

    The writer ends each record with one line feed more than the two line ends of the format, which ``parse_records`` allows for.
    """
    to_bytes(records, compress=False).select(F.col("data").cast("string")).write.text(path)


def _inflated(data: bytes, step: int = 1 << 20):
    """The bytes of a plain or gzip file, ``step`` at a time; a gzip member that is cut off or damaged ends them."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + step] for i in range(0, len(data), step))
        return
    at, member = 0, zlib.decompressobj(31)
    while at < len(data):
        part = data[at : at + step]
        try:
            yield member.decompress(part)
        except zlib.error:
            return
        at += len(part) - len(member.unused_data)
        if member.eof:
            member = zlib.decompressobj(31)


def parse(data: bytes):
    """The records of a WARC file: (named fields, block); a record that is cut off ends it. Only what is left of the record at hand and
    the next block of the file are held."""
    held = bytearray()
    for some in _inflated(data):
        held += some
        at = 0
        while (start := held.find(b"WARC/", at)) >= 0:
            at, end = start, held.find(b"\r\n\r\n", start)
            if end < 0:
                break
            lines = held[start:end].decode("utf-8", "replace").split("\r\n")[1:]
            fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]
            length = {k.lower(): v for k, v in fields}.get("content-length", "")
            if not length.isdigit():
                return
            if end + 4 + int(length) > len(held):
                break
            at = end + 4 + int(length)
            yield fields, bytes(held[end + 4 : at])
        del held[: at if start >= 0 else max(at, len(held) - 4)]


def parse_records(files: DataFrame) -> DataFrame:
    """RECORD rows of WARC files; ``files`` has their bytes in ``content``, as Spark's binaryFile source gives them. Records come out in
    batches of bounded size."""
    target = arrow_schema(files.sparkSession, RECORD)
    own_names = ("warc-type", "warc-record-id", "warc-target-uri", "warc-date")
    made = lambda rows: record(dict(zip(target.names, zip(*rows, strict=True), strict=True)), target)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for fields, block in parse(batch.column("content")[i].as_py() or b""):
                    named = {k.lower(): v for k, v in fields}
                    rows.append((named.get("warc-record-id"), named.get("warc-type"), named.get("warc-refers-to"), named.get("warc-target-uri", ""), named.get("warc-date"), [{"name": k, "value": v} for k, v in fields if k.lower() not in own_names], block))
                    size += len(block)
                    if size > 4 << 20:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    return files.select("content").mapInArrow(run, RECORD)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived records of all pages, with the block as text. The pages are first stored as WARC files of responses, which are then
    read as any others."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(responses(table(spark, sf_dir, "pages")), folder)
    made = derive(parse_records(spark.read.format("binaryFile").load(folder)))
    value = lambda name: F.get(F.filter("headers", lambda h: h["name"] == name), 0)["value"]
    return made.select("record_id", "warc_type", "refers_to", "target_uri", "warc_date", value("X-Source-Payload-Digest").alias("source_digest"), value("WARC-Block-Digest").alias("block_digest"), value("X-Source-Content-Type").alias("source_content_type"), value("Content-Length").cast("long").alias("content_length"), F.col("block").cast("string").alias("block"))
