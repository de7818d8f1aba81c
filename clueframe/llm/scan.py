"""Vectorised scanning of Arrow text columns.

Every delimiter the operators know is ASCII, so words are found on UTF-8 bytes:
a batch is one byte buffer with document offsets, and words, hashes and windows
are NumPy arrays over it.  A null text is an empty one.  Buffers are cut into
runs of whole documents of about ``PIECE`` bytes, so that working memory follows
the longest document, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 20  # bytes

_SEED = np.random.default_rng(0x5EED)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes that are lower-cased where an operator asks for A-Z to be folded.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _class(excluded) -> np.ndarray:
    flags = np.ones(256, dtype=bool)
    flags[list(excluded)] = False
    return flags


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = _class([0x20, *range(0x09, 0x0E)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` on lower-cased text; upper case counts as its lower case.
ALNUM = _class([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, budget: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``budget`` bytes; a longer row is alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + budget, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


class Words:
    """Words of some rows: byte ranges, and the index of each row's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: bool = True):
        self.data, self.offsets = data, offsets
        self.fold = fold
        flag = is_word[data]
        first = flag.copy()
        first[1:] &= ~flag[:-1]
        last = flag.copy()
        last[:-1] &= ~flag[1:]
        full = offsets[1:] > offsets[:-1]
        heads, tails = offsets[:-1][full], offsets[1:][full] - 1
        first[heads] = flag[heads]
        last[tails] = flag[tails]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def hashes(self, first: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word (or of its ``first`` bytes), the same in every process."""
        out = np.empty(len(self.starts), np.uint64)
        ends = self.ends if first is None else np.minimum(self.ends, self.starts + first)
        table = _BYTE[LOWER] if self.fold else _BYTE
        at = 0
        while at < len(out):  # in runs of words of about PIECE bytes
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
            data = self.data[base : ends[to - 1]]
            up, down = _powers(max(PIECE, 1 << (len(data) - 1).bit_length()))
            total = np.empty(len(data) + 1, np.uint64)
            total[0] = 0
            np.cumsum(table[data] * up[: len(data)], out=total[1:])
            begin, end = self.starts[at:to] - base, ends[at:to] - base
            out[at:to] = mix((total[end] - total[begin]) * down[begin])
            at = to
        return out

    def text(self, a: int, b: int) -> bytes:
        """Words a to b - 1, folded, with single spaces between them."""
        if a >= b:
            return b""
        words = (self.data[s:e].tobytes() for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist()))
        text = b" ".join(words)
        return text.lower() if self.fold else text


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_STEP, _BACK):
        x = np.full(n, base, dtype=np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k word hashes, rows ignored; k = 1 is not the word's own."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - k + 1] * _MUL + np.uint64(k)
    for i in range(1, k):
        out = mix(out) * _MUL + h[i : len(h) - k + 1 + i]
    return mix(out)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A cheaper hash of runs of k word hashes, for filters that are verified."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out *= _MUL
        out += h[i : len(h) - k + 1 + i]
    return mix(out)


def scanned(column, is_word: np.ndarray, fold: bool = True, budget: int = PIECE) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words) over a column."""
    data, offsets = text_buffer(column)
    for a, b in pieces(offsets, budget):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], is_word, fold)


def gathered(batches, column: int, budget: int):
    """A column's batches, small ones put together to about ``budget`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch.column(column))
        size += held[-1].nbytes
        if size >= budget:
            yield pa.chunked_array(held)
            held, size = [], 0
    if held:
        yield pa.chunked_array(held)
