"""WARC derivative builder: metadata and conversion records linked to their responses.

A record is a row: record_id, type, target_uri, date, refers_to, refers_to_target_uri,
refers_to_date, content_type, headers (the WARC headers it was read with), http_status,
http_headers, payload (the entity body, for responses), block (all bytes after the WARC
headers), block_digest and payload_digest (``sha1:`` and base32 of SHA-1).

``derive`` turns each response into two records:

* metadata (application/warc-fields): title, declared language, charset, number of links,
  and the source's status, HTTP headers, content type and digests as ``source-`` fields,
* conversion (text/plain): the payload without markup, in UTF-8.

Both name the response in refers_to, its address and date, and keep its payload digest; their
ids are name-based on the response's id and digest, so that deriving again gives the same
records.  A digest found in the source's headers is kept as it stands, else it is computed.

A body's chunks and its gzip or deflate coding are undone before its text is read; the payload, its digest and
its headers stay as they were.  Of another coding (``not-decoded`` in the metadata) there is no text.  A header that
occurs several times has its values on lines of their own in the map, and as fields of their own in metadata and files.

``read_warc`` takes plain or gzipped files, record by record; ``write_warc`` writes
a file for each partition.  A null page is an empty payload; a null address is kept null; repeated
responses give repeated records; records of other types give none.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import put

#: Bytes of blocks after which a batch of records is handed on.
_BATCH = 16 << 20
PAGE_DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space for URLs

_TEXTS = "record_id type target_uri date refers_to refers_to_target_uri refers_to_date content_type".split()
RECORD = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in _TEXTS),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("http_headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload", T.BinaryType()),
        T.StructField("block", T.BinaryType()),
        T.StructField("block_digest", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
    ]
)
_MAP = pa.map_(pa.string(), pa.string())
_ARROW = pa.schema([*((c, pa.string()) for c in _TEXTS), ("headers", _MAP), ("http_status", pa.int32()), ("http_headers", _MAP), ("payload", pa.binary()), ("block", pa.binary()), ("block_digest", pa.string()), ("payload_digest", pa.string())])


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def named_id(*parts: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(10).join(p or '' for p in parts))}>"


# Text of a page

_OPENED = re.compile(r"<(?:!--|!\[CDATA\[|[a-zA-Z/!?])", re.I)
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9]*)")
_DROPPED = {x: re.compile(rf"</{x}(?![\w-])", re.I) for x in ("script", "style", "noscript", "template")}
_BREAKS = frozenset("p div br hr h1 h2 h3 h4 h5 h6 li ul ol table tr section article header footer nav main aside blockquote pre title figure form dd dt dl body head html".split())
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_LANG = re.compile(r"(?<![\w-])lang\s*=\s*[\"']?([\w-]+)", re.I)
_HREF = re.compile(r"(?<![\w-])href\s*=", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def tidy(text: str) -> str:
    return _LINES.sub("\n", _BLANKS.sub(" ", entities.unescape(text))).strip()


@dataclass
class Page:
    """What a page says: its text (a line for each block, runs of white space as one blank), title, language and number of links."""

    text: str
    title: str | None = None
    lang: str | None = None
    links: int = 0


def read_page(page: str) -> Page:
    """One forward scan.  A comment, script or tag that isn't closed runs to the end of the page; a "<" after which no ">" comes is text."""
    out: list[str] = []
    found = Page("")
    at, title, last = 0, None, page.rfind(">")
    while at < len(page):
        m = _OPENED.search(page, at)
        if m is None or (m.start() > last and m[0] != "<!--"):
            break
        out.append(page[at : m.start()])
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
            out.append(" ")
            continue
        if m[0][1:3] == "![":
            at = m.end()
            out.append(" ")
            continue
        end = page.find(">", m.end() - 1)
        tag = page[m.start() + 1 : end]
        at = end + 1
        name = _NAME.match(tag)
        name = name[1].lower() if name else ""
        closes = tag[:1] == "/"
        if name in _DROPPED and not closes:
            closing = _DROPPED[name].search(page, at)
            end = page.find(">", closing.end()) if closing else -1
            at = len(page) if end < 0 else end + 1
            out.append(" ")
        elif name in _BREAKS:
            out.append("\n")
        elif tag[:1] == "!":
            out.append(" ")
        if name == "title":
            if not closes and title is None:
                title = len(out)
            elif closes and title is not None and found.title is None:
                found.title = tidy("".join(out[title:-1]))
        elif name == "html" and not closes and found.lang is None:
            lang = _LANG.search(tag)
            found.lang = lang[1].lower() if lang else None
        elif name == "a" and not closes:
            found.links += bool(_HREF.search(tag))
    out.append(page[at:])
    found.text = tidy("".join(out))
    return found


def plain_text(page: str) -> str:
    return read_page(page).text


def charset_of(content_type: str | None, payload: bytes) -> str:
    found = _CHARSET.search(content_type or "") or _CHARSET.search(payload[:2048].decode("latin-1"))
    name = found[1].lower() if found else "utf-8"
    try:
        "".encode(name)
    except (LookupError, ValueError):
        return "utf-8"
    return name


def _fields(pairs) -> bytes:
    return "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}\r\n" for k, v in pairs if v is not None).encode()


def _header(http: dict, name: str) -> list[str]:
    """The comma-separated values of a header, in lower case."""
    return [x.strip().lower() for k, v in http.items() if k.lower() == name for x in (v or "").replace("\n", ",").split(",") if x.strip()]


def _unchunked(data: bytes) -> bytes:
    """The body of a chunked message; what isn't chunked stays, a cut last chunk is kept as far as it goes."""
    out, at = [], 0
    while (end := data.find(b"\n", at)) >= 0:
        try:
            size = int(data[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return b"".join(out) if out else data
        if size <= 0:
            break
        out.append(data[end + 1 : end + 1 + size])
        at = end + 1 + size
        at += 2 if data[at : at + 2] == b"\r\n" else data[at : at + 1] == b"\n"
    return b"".join(out) if out or at or data[:1] == b"0" else data


def _inflated(data: bytes, bits: int) -> bytes | None:
    z = zlib.decompressobj(bits)
    try:
        return z.decompress(data) + z.flush()
    except zlib.error:
        return None


def decoded(payload: bytes, http: dict) -> tuple[bytes, str | None]:
    """A body without its transfer and content codings, and the coding that couldn't be undone (its body is given as empty).

    A body that isn't in the coding its header names is taken as it stands: many crawlers store it decoded.
    """
    body = _unchunked(payload) if "chunked" in _header(http, "transfer-encoding") else payload
    for coding in reversed(_header(http, "content-encoding")):
        if coding in ("gzip", "x-gzip"):
            body = (_inflated(body, 31) or body) if body[:2] == b"\x1f\x8b" else body
        elif coding == "deflate":
            x = _inflated(body, 15)
            x = _inflated(body, -15) if x is None else x
            body = body if x is None else x
        elif coding != "identity":
            return b"", coding
    return body, None


def derive_one(r: dict) -> list[dict]:
    """The metadata and conversion records of a response."""
    payload, http = r["payload"] or b"", dict(r["http_headers"] or {})
    kind = next((v for k, v in http.items() if k.lower() == "content-type"), None)
    body, unknown = decoded(payload, http)
    charset = charset_of(kind, body)
    page = read_page(body.decode(charset, "replace"))
    source = r["payload_digest"] or digest(payload)
    info = [
        ("title", page.title),
        ("language", page.lang),
        ("charset", charset),
        ("outlinks", page.links),
        ("not-decoded", unknown),
        ("source-status", r["http_status"]),
        ("source-block-digest", r["block_digest"]),
        ("source-payload-digest", source),
        *((f"source-header-{k.lower()}", x) for k, v in sorted(http.items()) for x in (v or "").split("\n")),
    ]
    out = []
    for type_, content_type, block in (("metadata", "application/warc-fields", _fields(info)), ("conversion", "text/plain; charset=utf-8", page.text.encode("utf-8", "replace"))):
        new = {
            "record_id": named_id(type_, r["record_id"], source),
            "type": type_,
            "target_uri": r["target_uri"],
            "date": r["date"],
            "refers_to": r["record_id"],
            "refers_to_target_uri": r["target_uri"],
            "refers_to_date": r["date"],
            "content_type": content_type,
            "headers": {},
            "http_status": None,
            "http_headers": http,
            "payload": None,
            "block": block,
            "block_digest": digest(block),
            "payload_digest": source,
        }
        new["headers"] = dict(_warc_headers(new))
        out.append(new)
    return out


def _batch(rows: list[dict], more: dict[str, pa.Array] | None = None) -> pa.RecordBatch:
    columns = [pa.array([(list(x.items()) if isinstance(x := r[f.name], dict) else x) for r in rows], f.type) for f in _ARROW]
    more = more or {}
    return pa.RecordBatch.from_arrays([*more.values(), *columns], names=[*more, *_ARROW.names])


def derive(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The derived records of response rows, with the ``keep`` columns of their sources before them (but those named like a record's)."""
    keep = tuple(c for c in keep if c not in RECORD.names)

    def run(batches):
        for batch in batches:
            left = batch.select([n for n in batch.schema.names if n in keep]) if keep else None
            at, rows = [], []
            for i, r in enumerate(batch.select(_ARROW.names).to_pylist()):
                if r["type"] == "response":
                    made = derive_one({**r, "http_headers": dict(r["http_headers"] or ())})
                    at += [i] * len(made)
                    rows += made
            yield _batch(rows, {n: left.column(n).take(pa.array(at, pa.int64())) for n in keep} if keep else None)

    schema = T.StructType([*(responses.schema[c] for c in keep), *RECORD.fields])
    return responses.select(*keep, *(F.col(f.name) for f in RECORD.fields)).mapInArrow(run, schema)


def responses_from_pages(pages: DataFrame, keep: tuple[str, ...] = (), url: str = "url", html: str = "html", date: str = PAGE_DATE) -> DataFrame:
    """Response records of a table of pages, as a crawler would have stored them: status 200, text/html; ``keep`` as for ``derive``."""
    keep = tuple(c for c in keep if c not in RECORD.names)
    x = pages.select(*keep, F.col(f"`{url}`").alias("__url"), F.col(f"`{html}`").alias("__html"))

    def run(batches):
        for batch in batches:
            rows = []
            for u, h in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()):
                payload = (h or "").encode("utf-8", "replace")
                http = {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))}
                block = b"HTTP/1.1 200 OK\r\n" + _fields(http.items()) + b"\r\n" + payload
                r = dict.fromkeys(_ARROW.names) | {"type": "response", "target_uri": u, "date": date, "content_type": "application/http; msgtype=response", "http_status": 200, "http_headers": http, "payload": payload, "block": block, "block_digest": digest(block), "payload_digest": digest(payload)}
                r["record_id"] = named_id("response", u, date, r["payload_digest"])
                r["headers"] = dict(_warc_headers(r))
                rows.append(r)
            yield _batch(rows, {n: batch.column(i) for i, n in enumerate(keep)})

    return x.mapInArrow(run, T.StructType([*(x.schema[c] for c in keep), *RECORD.fields]))


# Files

_NAMED = (
    ("WARC-Type", "type"),
    ("WARC-Record-ID", "record_id"),
    ("WARC-Date", "date"),
    ("WARC-Target-URI", "target_uri"),
    ("WARC-Refers-To", "refers_to"),
    ("WARC-Refers-To-Target-URI", "refers_to_target_uri"),
    ("WARC-Refers-To-Date", "refers_to_date"),
    ("WARC-Block-Digest", "block_digest"),
    ("WARC-Payload-Digest", "payload_digest"),
    ("Content-Type", "content_type"),
)


def _warc_headers(r: dict):
    out = [(name, r[c]) for name, c in _NAMED if r[c] is not None]
    return [*out, ("Content-Length", str(len(r["block"] or b"")))]


def record_bytes(r: dict) -> bytes:
    """A record as it stands in a file; headers it was read with are kept, the named ones renewed."""
    known = dict(_warc_headers(r))
    lower = {k.lower() for k in known}
    rest = [(k, x) for k, v in (r["headers"] or {}).items() if k.lower() not in lower for x in (v or "").split("\n")]
    return b"WARC/1.1\r\n" + _fields([*known.items(), *rest]) + b"\r\n" + (r["block"] or b"") + b"\r\n\r\n"


def _unpacked(data) -> Iterator[bytes]:
    """A file's bytes in pieces, its gzip members unpacked one after another; a damaged member ends where it can't be read."""
    data = memoryview(data)
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[i : i + _CHUNK]) for i in range(0, len(data), _CHUNK))
        return
    at = 0
    while bytes(data[at : at + 2]) == b"\x1f\x8b":
        z, used = zlib.decompressobj(31), at
        try:
            while not z.eof and used < len(data):
                piece = bytes(data[used : used + _CHUNK])
                used += len(piece)
                while piece:
                    if out := z.decompress(piece, _CHUNK):
                        yield out
                    piece = z.unconsumed_tail
            at = used - len(z.unused_data)
        except zlib.error:
            raw = bytes(data)
            at = raw.find(b"\x1f\x8b\x08", at + 2)
            if at < 0:
                return


class _Source:
    """A file that is read forward; what has been passed is let go."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.done = pieces, bytearray(), False

    def more(self) -> bool:
        piece = next(self.pieces, None)
        self.done = piece is None
        self.held += piece or b""
        return not self.done

    def find(self, what: bytes) -> int:
        """Where it begins in what is held, reading on until it is found; -1 if it isn't."""
        at = 0
        while (found := self.held.find(what, at)) < 0:
            at = max(0, len(self.held) - len(what) + 1)
            if not self.more():
                return -1
        return found

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _head(data: bytes) -> tuple[str, dict[str, str]]:
    """The first line and the fields of a head; a field that occurs again has its values on lines of their own."""
    first, *lines = data.decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = next((k for k in fields if k.lower() == name.lower()), name)
            fields[last] = f"{fields[last]}\n{value.strip()}" if last in fields else value.strip()
    return first, fields


_CHUNK = 1 << 20
_NEXT = b"\r\n\r\nWARC/"


def parse(data) -> Iterator[dict]:
    """The records of a file.

    A record whose Content-Length is missing or not a number goes on to where the next one begins; one that is
    cut short, or whose headers don't end, is given as far as it goes.  Both have ``WARC-Truncated: unspecified``.
    """
    source = _Source(_unpacked(data))
    while (at := source.find(b"WARC/")) >= 0:
        source.take(at)
        end = source.find(b"\r\n\r\n")
        _, fields = _head(source.take(end if end >= 0 else len(source.held)))
        source.take(4)
        low = {k.lower(): v for k, v in fields.items()}
        length = low.get("content-length", "")
        if length.isascii() and length.isdigit():
            block = source.take(int(length))
            whole = len(block) == int(length)
        else:
            source.held[:0] = b"\r\n\r\n"
            to = source.find(_NEXT)
            block, whole = source.take(to if to >= 0 else len(source.held))[4:], False
        if not whole:
            fields["WARC-Truncated"] = "unspecified"
        r = dict.fromkeys(_ARROW.names) | {c: low.get(name.lower()) for name, c in _NAMED} | {"headers": fields, "block": block}
        if r["type"] == "response" and block[:5] == b"HTTP/" and b"\r\n\r\n" in block:
            head, _, body = block.partition(b"\r\n\r\n")
            status, http = _head(head)
            code = status.split(" ")[1:2]
            r |= {"http_status": int(code[0]) if code and code[0].isascii() and code[0].isdigit() and len(code[0]) < 6 else None, "http_headers": http, "payload": body}
        elif r["type"] == "response":
            r["payload"] = block
        r["block_digest"] = r["block_digest"] or digest(block)
        if r["payload"] is not None:
            r["payload_digest"] = r["payload_digest"] or digest(r["payload"])
        yield r


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files under a path."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in parse(content.as_buffer()):
                    rows.append(r)
                    size += len(r["block"])
                    if len(rows) == 256 or size > _BATCH:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def write_warc(records: DataFrame, path: str) -> list[str]:
    """Write records to gzipped files, one for each partition with rows, record by record; returns their names.

    Ids are unique in a file: a record that is there already gets an id made of its own and a number.
    """

    def run(batches):
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():05d}.warc.gz"
        seen: dict[str | None, int] = {}

        def packed():
            for batch in batches:
                for i in range(batch.num_rows):
                    r = batch.slice(i, 1).to_pylist()[0]
                    r["headers"] = dict(r["headers"] or ())
                    n = seen[r["record_id"]] = seen.get(r["record_id"], 0) + 1
                    if n > 1 and r["record_id"] is not None:
                        r["record_id"] = named_id(r["record_id"], str(n))
                    yield gzip.compress(record_bytes(r), mtime=0)

        parts = packed()
        first = next(parts, None)
        if first is not None:
            put(f"{path}/{name}", chain([first], parts))
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    return sorted(r.name for r in records.select(*RECORD.names).mapInArrow(run, "name string").collect())


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    made = derive(responses_from_pages(pages, ("page_id",)), ("page_id",))
    return made.select("page_id", "record_id", "type", "target_uri", "date", "refers_to", "content_type", "block_digest", "payload_digest", F.length("block").cast("long").alias("n_bytes"), F.decode("block", "UTF-8").alias("block"))


QUERIES = {"op2_warc_derivatives": op2_warc_derivatives}
ORACLES: dict[str, str] = {}
