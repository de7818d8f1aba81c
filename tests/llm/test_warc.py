import base64
import gzip
import hashlib
import time
import zlib

import pytest

from clueframe.llm import warc

PAGE = "<!DOCTYPE html><html lang='EN'><head><title>A &amp; B</title><style>p{}</style></head><body><nav><a href='/x'>x</a></nav><p>One  two<br>three</p><script>var t='</p>';</script><!-- no --><p>Ünï &lt;tag&gt; 1 < 2</p></body></html>"
TEXT = "A & B\nx\nOne two\nthree\nÜnï <tag> 1 < 2"


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_plain_text():
    assert warc.plain_text(PAGE) == TEXT
    assert warc.plain_text("") == ""


def test_derive(spark):
    pages = spark.createDataFrame([(1, "http://a/", PAGE), (2, None, None), (1, "http://a/", PAGE)], "page_id long, url string, html string")
    rows = warc.derive(warc.responses_from_pages(pages, ("page_id",)), ("page_id",)).collect()
    assert [(r.page_id, r.type) for r in rows] == [(i, t) for i in (1, 2, 1) for t in ("metadata", "conversion")]
    meta, text = rows[0], rows[1]
    assert bytes(text.block).decode() == TEXT and text.block_digest == sha(TEXT.encode())
    assert meta.refers_to == text.refers_to and meta.payload_digest == sha(PAGE.encode()) == text.payload_digest
    fields = dict(x.split(": ", 1) for x in bytes(meta.block).decode().strip().split("\r\n"))
    assert fields["title"] == "A & B" and fields["language"] == "en" and fields["outlinks"] == "1"
    assert fields["source-payload-digest"] == sha(PAGE.encode()) and fields["source-header-content-type"] == "text/html; charset=utf-8"
    assert rows[4].record_id == meta.record_id and len({r.record_id for r in rows}) == 4
    assert bytes(rows[3].block) == b""


def test_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", PAGE + str(i)) for i in range(9)], "page_id long, url string, html string")
    responses = warc.responses_from_pages(pages).repartition(2)
    names = warc.write_warc(responses.union(warc.derive(responses)), f"file://{tmp_path}/w")
    assert names
    back = warc.read_warc(spark, f"file://{tmp_path}/w")
    assert sorted(r.record_id for r in back.collect()) == sorted(r.record_id for r in responses.union(warc.derive(responses)).collect())
    again = {r.record_id: (bytes(r.block), r.refers_to, r.payload_digest) for r in warc.derive(back).collect()}
    assert again == {r.record_id: (bytes(r.block), r.refers_to, r.payload_digest) for r in warc.derive(responses).collect()}


def test_reads_foreign_files(spark, tmp_path):
    body = b"caf\xe9"
    http = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/plain; charset=latin-1\r\n\r\n" + body
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:KEEP\r\nX-Own: 1\r\nContent-Length: {len(http)}\r\n\r\n".encode()
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(head + http + b"\r\n\r\n"))
    rows = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert [r.type for r in rows] == ["warcinfo", "response"] and rows[1].http_status == 404 and rows[1].headers["X-Own"] == "1"
    made = warc.derive(warc.read_warc(spark, f"file://{tmp_path}")).collect()
    assert [bytes(r.block).decode() for r in made][1] == "café" and {r.payload_digest for r in made} == {"sha1:KEEP"}


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derive(warc.responses_from_pages(pages, ("page_id",)), ("page_id",)).collect() == []


def test_query_against_brute_force(spark, sf):
    """Each page's two records, with text by a plain parser of another kind."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.skip, self.links = [], 0, 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "noscript", "template")
            self.links += tag == "a" and any(k == "href" for k, _ in attrs)
            self.out.append("\n" if tag in warc._BREAKS else "")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "noscript", "template")
            self.out.append("\n" if tag in warc._BREAKS else "")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {}
    for r in warc.op2_warc_derivatives(spark, sf).collect():
        got.setdefault(r.page_id, {})[r.type] = r
    assert len(got) == len({r.page_id for r in pages}) and all(set(x) == {"metadata", "conversion"} for x in got.values())
    squeezed = lambda t: [" ".join(x.split()) for x in t.split("\n") if x.strip()]
    for p in pages:
        reader = Reader()
        reader.feed(p.html or "")
        reader.close()
        meta, text = got[p.page_id]["metadata"], got[p.page_id]["conversion"]
        assert squeezed(text.block) == squeezed("".join(reader.out))
        assert text.n_bytes == len(text.block.encode()) and text.block_digest == sha(text.block.encode()) and meta.block_digest == sha(meta.block.encode())
        assert meta.refers_to == text.refers_to and meta.record_id != text.record_id and meta.target_uri == text.target_uri == p.url
        assert meta.payload_digest == text.payload_digest == sha((p.html or "").encode()) and f"outlinks: {reader.links}\r\n" in meta.block


@pytest.mark.parametrize("unit", ["<!--", "<script>", "</script", "<script", "<a", "<a href", "<html ", "<title>", "<![CDATA[", "<", "&", " \n", "lang=", "<a href=x>"])
def test_pages_of_a_megabyte_take_no_long(unit):
    page = unit * ((1 << 20) // len(unit))
    begun = time.process_time()
    warc.read_page(page)
    warc.read_page("<html lang=en><title>t</title><p>x" + page + ">")
    assert time.process_time() - begun < 8


def test_unclosed_markup():
    assert warc.plain_text("a<!-- b <p>c") == "a" and warc.plain_text("a<script>b</p>") == "a" and warc.plain_text("a < b <c") == "a < b <c"
    assert warc.read_page("<title>x<b>y</title> z<a>no</a><a href=q>yes</a>") == warc.Page("xy\nznoyes", "xy", None, 1)


def response(http, body, length=None):
    block = b"HTTP/1.1 200 OK\r\n" + http + b"\r\n\r\n" + body
    length = len(block) if length is None else length
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: {length}\r\n\r\n".encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_coded_bodies_and_repeated_headers(spark, tmp_path, packed):
    page = b"<p>one</p><p>two</p>" * 50
    gz, flat, raw = gzip.compress(page), zlib.compress(page), zlib.compress(page)[2:-4]
    chunks = b"".join(f"{len(gz[i : i + 9]):x};x=1\r\n".encode() + gz[i : i + 9] + b"\r\n" for i in range(0, len(gz), 9)) + b"0\r\n\r\n"
    bodies = [(b"Content-Encoding: gzip", gz), (b"Content-Encoding: deflate", flat), (b"content-encoding: deflate", raw), (b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip", chunks), (b"Content-Encoding: gzip", page), (b"Content-Encoding: br", b"\x01\x02"), (b"Set-Cookie: a=1\r\nX: y\r\nSet-Cookie: b=2", page)]
    data = b"".join(gzip.compress(response(*x)) if packed else response(*x) for x in bodies)
    (tmp_path / "a.warc").write_bytes(data)
    records = warc.read_warc(spark, f"file://{tmp_path}/a.warc")
    rows = records.collect()
    assert [bytes(r.payload) for r in rows] == [b for _, b in bodies] and [r.payload_digest for r in rows] == [sha(b) for _, b in bodies]
    made = warc.derive(records).collect()
    texts = [bytes(r.block).decode() for r in made if r.type == "conversion"]
    infos = [bytes(r.block).decode() for r in made if r.type == "metadata"]
    want = warc.plain_text(page.decode())
    assert texts == [want] * 5 + ["", want] and "not-decoded: br" in infos[5]
    assert rows[6].http_headers == {"Set-Cookie": "a=1\nb=2", "X": "y"} and "source-header-set-cookie: a=1\r\nsource-header-set-cookie: b=2\r\n" in infos[6]
    names = warc.write_warc(records.coalesce(1), f"file://{tmp_path}/out")
    back = warc.read_warc(spark, f"file://{tmp_path}/out").collect()
    assert len(names) == 1 and [bytes(r.block) for r in back] == [bytes(r.block) for r in rows]
    assert back[0].record_id == "<urn:x>" and len({r.record_id for r in back}) == len(bodies)


def test_damaged_files(spark, tmp_path):
    good = response(b"A: b", b"fine")
    cases = {
        "length": response(b"A: b", b"one", "many") + good,
        "none": good.replace(b"Content-Length", b"Other") + good,
        "cut": good + good[:-6],
        "head": good + good[:40],
        "noise": b"???" + good + b"\0" * 99 + good,
        "gzip": gzip.compress(good) + gzip.compress(good)[:-30],
        "broken": gzip.compress(good) + b"\x1f\x8b\x08" + b"\xff" * 40 + gzip.compress(good),
        "empty": b"",
    }
    got = {}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
        rows = warc.read_warc(spark, f"file://{tmp_path}/{name}").collect()
        got[name] = [(bytes(r.payload) if r.payload is not None else None, "WARC-Truncated" in r.headers) for r in rows]
        assert warc.derive(warc.read_warc(spark, f"file://{tmp_path}/{name}")).count() == 2 * sum(r.type == "response" for r in rows)
    assert got["length"] == [(b"one", True), (b"fine", False)] and got["none"] == [(b"fine", True), (b"fine", False)]
    assert got["cut"] == [(b"fine", False), (b"fi", True)]
    assert got["head"][0] == (b"fine", False) and got["head"][1][1] and len(got["head"]) == 2
    assert got["noise"] == got["broken"] == [(b"fine", False)] * 2 and got["gzip"][0] == (b"fine", False) and got["empty"] == []


def test_kept_columns_of_a_record_name(spark):
    pages = spark.createDataFrame([(1, "http://a/", PAGE, "mine", "x")], "page_id long, url string, html string, date string, headers string")
    rows = warc.derive(warc.responses_from_pages(pages, ("page_id", "date")), ("page_id", "date")).collect()
    assert {r.date for r in rows} == {warc.PAGE_DATE} and rows[0].page_id == 1
