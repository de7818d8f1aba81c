"""Benchmark decontamination: a broadcast set of normalised test windows, scanned for in training text.

Text is lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
A window is ``n`` consecutive words of an item; an item of fewer words, but not
none, is one window.  Documents stream through workers that hold the windows as
sorted 64-bit hashes with a bit filter before them; each hash match is verified on
the words themselves, and the verified windows give hit words, spans and items.

The items go out in blocks of about ``BLOCK_BYTES`` of text.  One block is broadcast; where there
are more, they are files of the shared folder, and a worker passes them one after another over
``RUN_BYTES`` of documents, so that memory grows neither with the benchmark nor with the documents.

Null texts have no words; an item without words hits nothing; an item with a null
id marks words but is named nowhere; ids that repeat are one item.  Rows are judged
one by one, so repeated rows get equal results and tables without rows give none.
Input columns stay as they are, save one with the result's name, which is replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scan
from .shared import array, fresh, lean, put

N = 10
BLOCK_BYTES = 8 << 20
#: Text that workers hold at a time where a benchmark has several blocks.
RUN_BYTES = 32 << 20

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
    ]
)
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])


class Windows:
    """The windows of some items, by length: sorted hashes, and where each begins."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.ids = [x for x, _ in items]
        texts = [t for _, t in items]
        offsets = np.cumsum([0, *map(len, texts)])
        self.words = w = scan.Words(np.frombuffer(b"".join(texts), np.uint8), offsets, scan.ALNUM)
        h, counts = w.hashes(), w.counts
        self.by_length = []
        for k in sorted({min(int(c), n) for c in counts if c}):
            rows = np.flatnonzero(counts >= n if k == n else counts == k)
            at = np.concatenate([np.arange(w.rows[r], w.rows[r] + counts[r] - k + 1) for r in rows])
            keys = scan.rolling(h, k)[at]
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
            bits = max(16, int(len(keys)).bit_length() + 6)
            seen = np.zeros(1 << bits, dtype=bool)
            seen[keys >> np.uint64(64 - bits)] = True
            self.by_length.append((k, keys, at, seen, np.uint64(64 - bits)))

    def item(self, word: int) -> str | None:
        return self.ids[int(np.searchsorted(self.words.rows, word, side="right")) - 1]

    def hits(self, w: scan.Words, h: np.ndarray) -> Iterator[tuple[int, int, int, set[str]]]:
        """(row, first word, length, items) of each verified window; ``h`` are the words' hashes."""
        for k, keys, at, seen, shift in self.by_length:
            got = scan.rolling(h, k)
            near = np.flatnonzero(seen[got >> shift])
            lo = np.searchsorted(keys, got[near], side="left")
            hi = np.searchsorted(keys, got[near], side="right")
            row = np.searchsorted(w.rows, near, side="right") - 1
            real = (hi > lo) & (near + k <= w.rows[row + 1])
            for i, a, b, r in zip(near[real].tolist(), lo[real].tolist(), hi[real].tolist(), row[real].tolist()):
                text = w.text(i, i + k)
                same = [int(p) for p in at[a:b] if self.words.text(int(p), int(p) + k) == text]
                if same:
                    yield r, i, k, {x for x in map(self.item, same) if x is not None}


class _Items:
    """The items' blocks as workers get them: one is broadcast, more are files of the shared folder, read one by one."""

    def __init__(self, spark: SparkSession, items: Iterator[list[tuple[str | None, bytes]]]):
        self.token, self.count, self.sent, self.folder = uuid4().hex, 0, None, None
        first = next(items, None)
        second = next(items, None)
        if second is None:
            if first is not None:
                self.count, self.sent = 1, spark.sparkContext.broadcast(first)
            return
        self.folder = fresh(spark, "items")
        for block in chain([first, second], items):
            put(f"{self.folder}/{self.count}", [pickle.dumps(block)])
            self.count += 1

    def block(self, k: int):
        return self.sent.value if self.sent is not None else pickle.loads(array(f"{self.folder}/{k}", np.uint8, keep=False).tobytes())


_built: dict[tuple[str, int, int], Windows] = {}


def _windows(items: _Items, k: int, n: int) -> Windows:
    """The windows of block k, built once in a worker while it uses no other.

    The key is the token that the driver gave these items: a worker serves many jobs, and an address or
    number of its own may come back for other items.
    """
    key = (items.token, k, n)
    if key not in _built:
        _built.clear()
        _built[key] = Windows(items.block(k), n)
    return _built[key]


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str | None, bytes]]]:
    held, size = [], 0
    for r in items.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t")).where("t is not null").toLocalIterator():
        held.append((r.i, r.t.encode()))
        size += len(held[-1][1])
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_contamination(docs: DataFrame, items: DataFrame, n: int = N, text: str = "text", item_id: str = "item_id", item_text: str = "text", into: str = "contamination", cut: bool = False) -> DataFrame:
    """``docs`` with a struct ``into``: n_words, n_hit, items and spans of hit words (first and last index).

    With ``cut``, the bytes of hit spans are removed from the text itself.
    """
    sent = _Items(docs.sparkSession, _blocks(items, item_id, item_text))
    docs = docs.drop(into) if into in docs.columns else docs
    return docs.mapInArrow(_scanner(sent, n, text, into, cut), T.StructType([*docs.schema.fields, T.StructField(into, RESULT)]))


def _runs(batches, size: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches together until they hold ``size`` bytes."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def _look_up(index: Windows, w: scan.Words, h: np.ndarray, found: dict[int, tuple[list, set]]) -> None:
    for r, i, length, names in index.hits(w, h):
        spans, ids = found.setdefault(r, ([], set()))
        spans.append((i - int(w.rows[r]), i - int(w.rows[r]) + length - 1))
        ids |= names


def _scanner(items: _Items, n: int, text: str, into: str, cut: bool):
    def pieces(batch, at):
        return (w for _, _, w in scan.scanned(batch.column(at), scan.ALNUM))

    def one_block(batch, at):
        """Piece by piece, with the windows that stay in the worker."""
        index = _windows(items, 0, n) if items.count else None
        for w in pieces(batch, at):
            found: dict = {}
            if index is not None:
                _look_up(index, w, w.hashes(), found)
            yield w, found

    def run(batches):
        if items.count <= 1:
            for batch in batches:
                at = batch.schema.get_field_index(text)
                yield _judged(batch, one_block(batch, at), at, into, cut)
            return
        for some in _runs(batches, RUN_BYTES):  # each block is read once for a run of batches
            at = some[0].schema.get_field_index(text)
            held = [[(w, w.hashes(), {}) for w in pieces(batch, at)] for batch in some]
            for k in range(items.count):
                index = _windows(items, k, n)
                for w, h, found in chain.from_iterable(held):
                    _look_up(index, w, h, found)
            for batch, own in zip(some, held):
                yield _judged(batch, ((w, found) for w, _, found in own), at, into, cut)

    return lean(run)


def _judged(batch: pa.RecordBatch, pieces: Iterator, at: int, into: str, cut: bool) -> pa.RecordBatch:
    results, texts = [], []
    for w, found in pieces:
        for r, c in enumerate(w.counts.tolist()):
            spans, ids = found.get(r, ((), ()))
            spans = _merged(spans)
            results.append({"n_words": c, "n_hit": sum(y - x + 1 for x, y in spans), "items": sorted(ids), "spans": [{"first": x, "last": y} for x, y in spans]})
            if cut:
                texts.append(_without(w, r, spans) if spans else None)
    columns = list(batch.columns)
    if any(x is not None for x in texts):
        columns[at] = pa.array([t if x is None else x for t, x in zip(columns[at].to_pylist(), texts)], type=columns[at].type)
    return pa.RecordBatch.from_arrays([*columns, pa.array(results, type=_ARROW)], names=[*batch.schema.names, into])


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def _without(w: scan.Words, row: int, spans: list[tuple[int, int]]) -> str:
    at, kept = int(w.offsets[row]), []
    base = int(w.rows[row])
    for x, y in spans:
        kept.append(w.data[at : w.starts[base + x]].tobytes())
        at = int(w.ends[base + y])
    kept.append(w.data[at : w.offsets[row + 1]].tobytes())
    return b"".join(kept).decode()


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", n: int = N, text: str = "text", min_hit: int = 1) -> DataFrame:
    """``docs`` without the documents (or only the spans) where at least ``min_hit`` words are hit; same columns."""
    own = "__contamination"
    if remove == "documents":
        kept = find_contamination(docs, items, n, text, into=own).where(F.col(f"{own}.n_hit") < min_hit)
    elif remove == "spans":
        kept = find_contamination(docs, items, n, text, into=own, cut=True)
    else:
        raise ValueError("remove: documents or spans")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    c = lambda name: F.col(f"contamination.{name}")
    return found.select(
        "doc_id",
        c("n_words").alias("n_words"),
        c("n_hit").alias("n_hit"),
        F.size(c("items")).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(c("items")), ","), 256).alias("items_sha256"),
        (c("n_hit") > 0).alias("contaminated"),
    )


_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, k, gram FROM (
  SELECT item_id, least(len(w), {N}) AS k, array_to_string(w[i:i + least(len(w), {N}) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {N}) + 2)) AS i FROM b WHERE len(w) > 0))),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
x AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
m AS (SELECT x.r, x.i, x.k, g.item_id FROM x JOIN g USING (k, gram)),
p AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS j FROM m) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN s USING (r)"""

QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLES = {"op1_decontaminate": _SQL}
