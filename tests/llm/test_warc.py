from __future__ import annotations

import base64
import gzip
import hashlib
from html.parser import HTMLParser

from stagegraph.llm import warc


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_derived_records_of_all_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    sources = {r.record_id: r for r in warc.responses(pages).collect()}
    derived = warc.derive(warc.responses(pages)).collect()
    assert len(sources) == pages.count() and len(derived) == 2 * len(sources)
    for r in derived:
        named, source = {h["name"]: h["value"] for h in r.headers}, sources[r.refers_to]
        body = bytes(source.block).split(b"\r\n\r\n", 1)[1]
        assert named["WARC-Refers-To"] == source.record_id and r.target_uri == named["WARC-Refers-To-Target-URI"] == source.target_uri
        assert named["X-Source-Payload-Digest"] == sha(body) and named["X-Source-Content-Type"] == "text/html; charset=utf-8"
        assert named["WARC-Block-Digest"] == sha(bytes(r.block)) and named["Content-Length"] == str(len(r.block))
    assert len({r.record_id for r in derived} | set(sources)) == 3 * len(sources)


def test_written_files_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/é", "<p>a</p>\n\nWARC/1.1 b"), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    records = warc.responses(pages)
    every = records.unionByName(warc.derive(records))
    warc.write(every, str(tmp_path / "w"))
    back = warc.parse_records(spark.read.format("binaryFile").load(str(tmp_path / "w")))
    plain = lambda df: sorted((r.record_id, r.warc_type, r.refers_to or "", r.target_uri, bytes(r.block)) for r in df.collect())
    assert plain(every) == plain(back)
    member = bytes(warc.to_bytes(records).first().data)
    assert len(list(warc.parse(member))) == 1


def test_plain_text_and_odd_rows(spark):
    assert warc.plain_text("<head><title>t</title></head><p>a <b>b</b><br>c &amp; d<script>x</script><!-- y --><div>e") == "a b\nc & d\ne"
    assert warc.plain_text("") == "" and list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\ncut")) == []
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derive(warc.responses(none)).collect() == []
    same = spark.createDataFrame([(1, "u", "x", "k")] * 2, "page_id long, url string, html string, block string")
    assert warc.derive(warc.responses(same)).select("record_id").distinct().count() == 2


class Visible(HTMLParser):
    """Text, title, language and links of a page, by the standard library's own parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.title, self.lang, self.links, self.titled = [], [], "", "", 0, False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        self.titled = tag == "title"
        if tag == "html":
            self.lang = (named.get("lang") or "").lower()
        self.links += tag == "a" and "href" in named
        if tag in ("script", "style", "noscript", "template", "head", "iframe", "svg"):
            self.hidden.append(tag)
        if tag in "address article aside blockquote body br div footer form h1 h2 h3 header li main nav ol p pre section table td tr ul".split():
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.titled = False
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()
            self.out.append("\n")
        if tag in "address article aside blockquote body div footer form h1 h2 h3 header li main nav ol p pre section table td tr ul".split():
            self.out.append("\n")

    def handle_data(self, data):
        if self.titled:
            self.title += data
        if not self.hidden:
            self.out.append(data.replace("\n", " "))

    def text(self):
        lines = (" ".join(x.split()) for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x)


def test_the_query_by_an_independent_parser(spark, sf_dir):
    pages = {r.url: r.html or "" for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = warc.op8_warc(spark, sf_dir).collect()
    assert len(got) == 2 * len(pages) == 2 * len({r.target_uri for r in got})
    for r in got:
        page = pages[r.target_uri]
        seen, body = Visible(page), page.encode()
        assert (r.source_digest, r.block_digest, r.content_length) == (sha(body), sha(r.block.encode()), len(r.block.encode()))
        assert r.source_content_type == "text/html; charset=utf-8" and r.warc_date == "1970-01-01T00:00:00Z"
        if r.warc_type == "conversion":
            assert r.block == seen.text()
        else:
            about = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in r.block.split("\r\n") if x)
            assert about == {
                "sourceStatus": "HTTP/1.1 200 OK", "sourceContentType": "text/html; charset=utf-8", "sourceContentLength": str(len(body)), "title": " ".join(seen.title.split()), "language": seen.lang,
                "outlinks": str(seen.links), "textCharacters": str(len(seen.text())), "sourcePayloadDigest": sha(body),
            }


def test_files_that_are_cut_off_and_long_records(spark):
    rows = [(f"<urn:uuid:{i}>", "resource", "u", None, [("Content-Length", str(n))], bytes([65 + i]) * n) for i, n in enumerate((10, 3_000_000, 0, 20))]
    plain = [warc.wire(*r) for r in rows]
    blocks = [r[-1] for r in rows]
    zipped = [gzip.compress(x) for x in plain]
    assert [b for _, b in warc.parse(b"".join(plain))] == [b for _, b in warc.parse(b"".join(zipped))] == [b for _, b in warc.parse(gzip.compress(b"".join(plain)))] == blocks
    assert [b for _, b in warc.parse(b"".join(zipped)[:-5])] in (blocks[:3], blocks)
    assert [b for _, b in warc.parse(b"".join(zipped[:2])[:-5])][0] == blocks[0] and [b for _, b in warc.parse(b"".join(plain)[:-30])] == blocks[:3]
    files = spark.createDataFrame([(bytearray(b"".join(zipped)), "a"), (bytearray(b"".join(plain)[: len(plain[0]) + 100]), "b"), (None, "c")], "content binary, headers string")
    assert sorted(bytes(r.block) for r in warc.parse_records(files).collect()) == sorted([*blocks, blocks[0]])
    clash = spark.createDataFrame([("r", "response", None, "u", "d", [{"name": "A", "value": "b"}], bytearray(b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n<p>x"), "y")], warc.RECORD + ", text string")
    made = warc.derive(clash).collect()
    assert [r.warc_type for r in made] == ["metadata", "conversion"] and bytes(made[1].block) == b"x" and {h.name for r in made for h in r.headers} >= {"X-Source-Server"}
