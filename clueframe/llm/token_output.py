"""Token-id output: documents to ids to range-coded segments in a shared folder, and back.

``write_tokens`` deals documents by doc_id range, sorts each range, encodes the texts
(null: empty) with a tokenizers-library file, appends ``end_id`` to each document and
writes segments of whole documents (see ``range_coder``): a document's ids stand after
those of all documents with a smaller doc_id.  Null doc_ids come first; rows that share
a doc_id are ordered by text (by its first ``_PREFIX`` characters, then by a hash and all of it) and
all written.  However many rows share a doc_id or a text, they are dealt to several ranges.  Segments are rows of Parquet files, so
that Spark's commit makes a task's output whole or absent, and a shard is found by
(shard, segment); each holds its documents' ids and lengths, block sizes and checksums.

``read_tokens`` decodes the segments of a folder, checks every block, and returns a row
for each document.  An empty table makes a folder without segments.

Where the tokenizer drops white space before its model sees a word, and so gives a text
the ids of its ``[^\\x20\\x09-\\x0D]+`` parts one after another, each distinct part of a
batch is encoded once; other tokenizers get whole texts.  Parts are found by a 64-bit hash and
compared byte by byte; one that differs from the part of its hash is encoded by itself.  Where the
tokenizer's own rules for cutting a part are ``_RULES``, parts of common characters are cut here
and their pieces given to the library's model, which saves the library's bookkeeping.
"""

from __future__ import annotations

import json
import os
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import range_coder, scan
from .shared import arrow_batches, fresh, give_back, lean

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
SEGMENT_IDS = 4_000_000
_MOST_PARTS = 1_000_000
_MOST_PIECES = 300_000
_PIECE = 2 << 20
_PREFIX = 64
_SEPARATOR = "<|startoftext|>"

# The rules of a tokenizer that lower-cases and cuts a part into runs of letters, single digits and runs of other signs.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
#: Letters that are composed, and whose lower case is one of them.
_LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F"
#: Parts of these letters, digits and signs but the apostrophe; special tokens begin with "<|".
_COMMON = re.compile(rf"(?!.*<\|)[{_LETTERS}0-9!-&(-/:-@\[-`{{-~]+")
_PIECES = re.compile(rf"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The sign by which a byte-level vocabulary writes each byte: itself, or the next from 256.
_SIGNS = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(_SHOWN))}

_SEGMENTS = "shard int, segment int, start long, n_docs long, n_tokens long, payload binary"


def vocabulary_path(name: str = VOCABULARY) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    """Ids of texts by a tokenizers file, with a memory of the parts met before."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.by_part = self._drops_space(spec)
        special = [t for t in spec["added_tokens"] if t["content"] == _SEPARATOR and not t["normalized"]]
        self.separator = special[0]["id"] if special else None
        self.quick = all(spec.get(k) == x for k, x in _RULES.items()) and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and all(t["content"].startswith("<|") for t in spec["added_tokens"])
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.numbers = list(range(self.tokenizer.get_vocab_size()))  # of equal ids one object is held
        self.forget()

    @staticmethod
    def _drops_space(spec: dict) -> bool:
        before = spec.get("pre_tokenizer") or {}
        first = (before.get("pretokenizers") or [before])[0]
        kinds = {n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])}
        return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and kinds <= {"NFC", "Replace", "Lowercase"} and spec.get("post_processor") is None

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16)
        self.bytes, self.at, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some parts in one array, and the count of each."""
        if not self.quick:
            return self._by_library(texts)
        if len(self.pieces) > _MOST_PIECES:
            self.pieces.clear()
        ids, counts, rest = [], np.zeros(len(texts), np.int64), []
        known, numbers, tokenize = self.pieces, self.numbers, self.tokenizer.model.tokenize
        for i, t in enumerate(texts):
            if _COMMON.fullmatch(t):
                before = len(ids)
                for p in _PIECES.findall(t.lower()):
                    got = known.get(p)
                    if got is None:
                        got = known[p] = tuple([numbers[x.id] for x in tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(_SIGNS))])
                    ids += got
                counts[i] = len(ids) - before
            else:
                rest.append(i)
        flat = np.array(ids, np.uint32)
        if rest:
            more, n = self._by_library([texts[i] for i in rest])
            flat = np.insert(flat, np.repeat((np.cumsum(counts) - counts)[rest], n), more)
            counts[rest] = n
        return flat, counts

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.separator is None:
            got = self.whole(texts)
            return np.concatenate(got) if got else self.ids, np.array([len(x) for x in got], np.int64)
        odd = [i for i, t in enumerate(texts) if _SEPARATOR in t]
        ids, counts = [], []
        clean = ["" if _SEPARATOR in t else t for t in texts] if odd else texts
        for first in range(0, len(clean), 256 * 16):  # the library's results are large: a few at a time
            some = clean[first : first + 256 * 16]
            for e in self.whole([_SEPARATOR.join(some[i : i + 256]) for i in range(0, len(some), 256)]):
                at = np.flatnonzero(e == self.separator)
                counts.append(np.diff(np.concatenate([[-1], at, [len(e)]])) - 1)
                ids.append(e[e != self.separator])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        if odd:
            runs = np.split(flat, np.cumsum(counts)[:-1])
            for i, x in zip(odd, self.whole([texts[i] for i in odd])):
                runs[i], counts[i] = x, len(x)
            flat = np.concatenate(runs)
        return flat, counts

    def rows(self, column, end_id: int):
        """(ids of some rows with an end after each, lengths of these rows) over a column."""
        for _, _, w in scan.scanned(column, scan.NOT_SPACE, fold=False, budget=_PIECE):
            n = len(w.offsets) - 1
            if not self.by_part:
                texts = [w.data[a:b].tobytes().decode() for a, b in zip(w.offsets[:-1], w.offsets[1:])]
                got = self.whole(texts)
                lengths = np.array([len(x) + 1 for x in got], np.int64)
                yield np.concatenate([y for x in got for y in (x, [end_id])]).astype(np.uint32), lengths
                continue
            keys, first, back = _distinct(w.hashes())
            self.learn(keys, first, w)
            at = np.searchsorted(self.keys, keys)[back]
            start, count = self.start[at], self.count[at]
            for i in self._others(w, at):
                start[i], count[i] = len(self.ids), self._add(*self.parts([w.data[w.starts[i] : w.ends[i]].tobytes().decode()]))[1][0]
            ends = np.concatenate([[0], np.cumsum(count)])
            lengths = ends[w.rows[1:]] - ends[w.rows[:-1]] + 1
            out = np.empty(int(ends[-1]) + n, np.uint32)
            last = np.zeros(len(out), bool)
            last[np.cumsum(lengths) - 1] = True
            out[last] = end_id
            out[~last] = self.ids[np.repeat(start - ends[:-1], count) + np.arange(ends[-1])]
            yield out, lengths

    def learn(self, keys: np.ndarray, first: np.ndarray, w: scan.Words) -> None:
        if len(self.keys) > _MOST_PARTS:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool) if not len(self.keys) else self.keys[at.clip(max=len(self.keys) - 1)] != keys
        if not new.any():
            return
        begin, end = w.starts[first[new]], w.ends[first[new]]
        raw = w.data.tobytes()
        start, count = self._add(*self.parts([raw[a:b].decode() for a, b in zip(begin.tolist(), end.tolist())]))
        size = end - begin
        place = len(self.bytes) + np.cumsum(size) - size
        self.bytes = np.concatenate([self.bytes, w.data[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]])
        self.keys = np.insert(self.keys, at[new], keys[new])
        for name, x in (("start", start), ("count", count), ("at", place), ("size", size)):
            setattr(self, name, np.insert(getattr(self, name), at[new], x))

    def _add(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of some parts begin in ``ids``, and their counts."""
        start = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, ids.astype(np.uint16) if not len(ids) or ids.max() < 65536 else ids])
        return start, count

    def _others(self, w: scan.Words, at: np.ndarray) -> list[int]:
        """The words whose bytes aren't those of the part ``at`` which their hash names."""
        size = w.ends - w.starts
        other = size != self.size[at]
        size = np.where(other, 0, size)
        steps = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differs = w.data[np.repeat(w.starts, size) + steps] != self.bytes[np.repeat(self.at[at], size) + steps]
        if differs.any():
            other[np.repeat(np.arange(len(size)), size)[differs]] = True
        return np.flatnonzero(other).tolist()


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, where one of each stands, and the place of each hash among them."""
    order = np.argsort(h)
    x = h[order]
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(new) - 1
    return x[new], order[new], back


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _writer(vocabulary: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        shard, encoder = TaskContext.get().partitionId(), _encoder(vocabulary_path(vocabulary))
        docs, lengths, ids, held, segment, start = [], [], [], 0, 0, 0

        def flush():
            x = np.concatenate(ids)
            ids.clear()  # coding takes the most memory of a task
            give_back()
            row = [shard], [segment], [start], [len(docs)], [len(x)], [range_coder.pack(docs, np.concatenate(lengths), x)]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["shard", "segment", "start", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for x, n in encoder.rows(batch.column(1), end_id):
                docs += names[at : at + len(n)]
                at += len(n)
                ids.append(x)
                lengths.append(n)
                held += len(x)
                if held >= SEGMENT_IDS:
                    yield flush()
                    start, segment = start + held, segment + 1
                    docs, lengths, ids, held = [], [], [], 0
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, text: str = "text") -> None:
    """Write the ids of ``docs`` (doc_id, text) to a new folder."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # The last key tells equal rows apart: which of them comes first doesn't matter.
    order = (F.col("doc_id"), F.substring("text", 1, _PREFIX), F.xxhash64("text"))
    x = x.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, "row").sortWithinPartitions(*order, "text").drop("row")
    with arrow_batches(docs.sparkSession, rows=1000):
        x.mapInArrow(lean(_writer(vocabulary, end_id)), _SEGMENTS).write.parquet(path)


def _reader(base: dict[int, int], with_ids: bool):
    def run(batches):
        for batch in batches:
            for shard, start, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                docs, lengths, ids = range_coder.unpack(payload.as_buffer())
                ends = np.cumsum(lengths)
                begins = ends - lengths
                raw = memoryview(ids.astype("<u4")).cast("B")
                sums = [crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                columns = [pa.array(docs, pa.int64()), pa.array(begins + (base[shard] + start)), pa.array(lengths), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of a folder: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, the ids."""
    files = spark.read.schema(_SEGMENTS).parquet(path)
    base, at = {}, 0
    for r in files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():  # a row for each task that wrote
        base[r.shard], at = at, at + r.n
    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return files.select("shard", "start", "payload").mapInArrow(lean(_reader(base, with_ids)), kinds)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    return read_tokens(spark, path)


QUERIES = {"op5_token_output": op5_token_output}
ORACLES: dict[str, str] = {}
