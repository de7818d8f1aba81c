"""An adaptive context-mixing range coder for runs of token ids.

Ids are cut into equal blocks of at most ``BLOCK``, each coded from a fresh state and checksummed, so that
blocks are decoded on their own.  A block names its distinct ids first; in what follows they
go by their places in that list, so that ids may be of any 32-bit value.  Within a block
``LANES`` runs of ids are coded side by side, one id of each at a step, under one model that
all of them teach:

* order 0: adaptive frequencies over all of the block's ids, taken anew at steps that
  lie further and further apart, up to ``REFRESH``,
* order 1 (by the last id) and order 2 (by a hash of the last two) each predict an
  id with a confidence of 0 to 3; a context's prediction changes once its confidence is used up,
* the three are mixed: P(x) = u0 P0(x) + u1 [x = prediction 1] + u2 [x = prediction 2].  The weights
  belong to the pair of confidences and to whether the predictions agree, and are the adaptive shares
  of the steps in which the order in question was the highest that was right.

The coder is a range coder with a 48-bit low end, carries, and 16 bits put out at a time.  All of it is integer
arithmetic, save one quotient of integers below 2^53 whose floor doubles give exactly.
"""

from __future__ import annotations

import struct
from zlib import compress, crc32, decompress

import numpy as np

BLOCK = 1 << 21
LANES = 4096
REFRESH = 48
#: A lane has at least that many ids, so that short runs have few lanes.
LEAST_STEPS = 256
MAGIC = b"CFTK\x00\x02"
_SLOTS2 = 18  # bits
_WEIGHTS = 10  # bits: the three weights of a set add up to 2^10
_LEAST, _MASK = 1 << 32, (1 << 48) - 1


class _Model:
    """What both sides know of a block: D ids, whose places the orders predict."""

    def __init__(self, ids: int, lanes: int):
        self.ids, self.bits = ids, max(16, int(ids).bit_length() + 2)
        self.counts = np.ones(ids, np.int64)
        self.table1 = np.zeros(ids, np.int64)  # place * 4 + confidence
        self.table2 = np.zeros(1 << _SLOTS2, np.int64)
        self.events = np.tile(np.array([2, 2, 4], np.int64), (32, 1))
        self.one, self.two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.met: list[np.ndarray] = []
        self.due, self.step = 1, 0
        self.take_frequencies()
        self.take_weights()

    def take_frequencies(self) -> None:
        spare = (1 << self.bits) - self.ids
        f = self.counts * spare // int(self.counts.sum()) + 1
        f[int(np.argmax(f))] += (1 << self.bits) - int(f.sum())
        self.size0 = f
        self.start0 = np.cumsum(f) - f
        self.whole = np.repeat(np.arange(self.ids, dtype=np.int32), f)

    def take_weights(self) -> None:
        total = self.events.sum(axis=1, keepdims=True)
        w = self.events * ((1 << _WEIGHTS) - 3) // total + 1
        w[:, 2] += (1 << _WEIGHTS) - w.sum(axis=1)
        self.weight2, self.weight1, self.weight0 = w[:, 0] << self.bits, w[:, 1] << self.bits, w[:, 2].copy()
        big = self.events.sum(axis=1) > 1 << 16
        self.events[big] = (self.events[big] + 1) >> 1

    def predict(self, n: int) -> None:
        """Predictions and weights for the next id of the first n lanes."""
        one, two = self.one[:n], self.two[:n]
        self.slot2 = ((one * 0x9E3779B1 + two * 0x85EBCA6B) >> 11) & ((1 << _SLOTS2) - 1)
        self.e1, self.e2 = self.table1.take(one), self.table2.take(self.slot2)
        self.m1, self.m2 = self.e1 >> 2, self.e2 >> 2
        self.c1, self.c2 = self.e1 & 3, self.e2 & 3
        self.set = (self.c2 << 3) + (self.c1 << 1) + (self.m1 == self.m2)
        self.w2, self.w1, self.w0 = self.weight2.take(self.set), self.weight1.take(self.set), self.weight0.take(self.set)

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the ids x among 2^(bits + 10)."""
        self.right1, self.right2 = self.m1 == x, self.m2 == x
        start = self.w0 * self.start0.take(x) + self.w1 * (self.m1 < x) + self.w2 * (self.m2 < x)
        return start, self.w0 * self.size0.take(x) + self.w1 * self.right1 + self.w2 * self.right2

    def at(self, v: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold v: first the two predictions' shares are taken out, in order of place."""
        swap = self.m1 > self.m2
        low, high = np.minimum(self.m1, self.m2), np.maximum(self.m1, self.m2)
        w_low = np.where(swap, self.w2, self.w1)
        w_high = self.w1 + self.w2 - w_low
        v = v - np.minimum(np.maximum(v - self.w0 * self.start0.take(low), 0), w_low)
        v -= np.minimum(np.maximum(v - self.w0 * self.start0.take(high), 0), w_high)
        return self.whole.take((v / self.w0).astype(np.int64)).astype(np.int64)

    def learn(self, x: np.ndarray) -> None:
        """The ids of this step; ``interval`` was asked for them."""
        n = len(x)
        fresh = x << 2
        self.table1[self.one[:n]] = np.where(self.right1, np.minimum(self.e1 + 1, self.e1 | 3), np.where(self.c1 > 0, self.e1 - 1, fresh))
        self.table2[self.slot2] = np.where(self.right2, np.minimum(self.e2 + 1, self.e2 | 3), np.where(self.c2 > 0, self.e2 - 1, fresh))
        event = np.where(self.right2, 0, 2 - self.right1)
        self.met.append(x)
        self.events += np.bincount(self.set * 3 + event, minlength=96).reshape(32, 3)
        self.two[:n], self.one[:n] = self.one[:n], x
        self.step += 1
        if self.step & 3 == 0 or self.step < 16:
            self.take_weights()
        if self.step == self.due:
            self.counts += np.bincount(np.concatenate(self.met), minlength=self.ids) * 32
            self.met.clear()
            self.due += min(REFRESH, self.due)
            self.take_frequencies()


def _shape(n: int) -> tuple[int, int]:
    """(lanes, steps) of a block of n ids; the last lanes may be short or empty."""
    lanes = max(1, min(LANES, n // LEAST_STEPS))
    steps = -(-n // lanes)
    return -(-n // steps), steps


def _named(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order, and each id's place among them."""
    top = int(ids.max()) + 1
    if top > 1 << 22:
        names, places = np.unique(ids.astype(np.uint32), return_inverse=True)
        return names, places.reshape(-1)
    there = np.zeros(top, bool)
    there[ids] = True
    return np.flatnonzero(there).astype(np.uint32), (np.cumsum(there, dtype=np.int32) - np.int32(1)).take(ids)


def encode_block(ids: np.ndarray) -> bytes:
    """A block: its distinct ids, the size of each lane's code, and the codes."""
    names, places = _named(ids)
    lanes, steps = _shape(len(ids))
    grid = np.zeros(lanes * steps, np.uint32)
    grid[: len(ids)] = places
    del places
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    tail = len(ids) - (lanes - 1) * steps
    model = _Model(len(names), lanes)
    k = model.bits + _WEIGHTS
    wide = 2 * steps + 8
    out = np.zeros(lanes * wide, np.uint16)
    home = np.arange(lanes, dtype=np.int64) * wide
    pos = home.copy()
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, _MASK, np.int64)
    for t in range(steps):
        n = lanes if t < tail else lanes - 1
        x = grid[t, :n].astype(np.int64)
        model.predict(n)
        start, size = model.interval(x)
        l, g, p = low[:n], rng[:n], pos[:n]
        g >>= k
        l += start * g
        g *= size
        carry = l > _MASK
        if carry.any():
            l &= _MASK
            at = p[carry] - 1
            while len(at):  # into what is put out already
                out[at] += 1
                at = at[out[at] == 0] - 1
        while (short := g < _LEAST).any():
            out[p] = l >> 32
            p += short
            shift = short.astype(np.int64) << 4
            l <<= shift
            l &= _MASK
            g <<= shift
        model.learn(x)
    for _ in range(3):
        out[pos] = low >> 32
        pos += 1
        low = (low << 16) & _MASK
    tables = np.concatenate([np.diff(names, prepend=names[:1]), pos - home]).astype("<u4")
    tables = compress(tables.tobytes(), 6)
    codes = [out[h:p] for h, p in zip(home.tolist(), pos.tolist())]
    return b"".join([struct.pack("<IIII", len(names), int(names[0]), len(tables), lanes), tables, np.concatenate(codes).astype("<u2").tobytes()])


def decode_block(data, n: int) -> np.ndarray:
    """The n ids of a block."""
    count, first, size, lanes = struct.unpack_from("<IIII", data)
    if (lanes, -(-n // lanes)) != _shape(n):
        raise ValueError("not the lanes of a block of this size")
    steps = -(-n // lanes)
    tables = np.frombuffer(decompress(data[16 : 16 + size]), "<u4")
    if len(tables) != count + lanes:
        raise ValueError("not the tables of the block")
    names = first + np.cumsum(tables[:count], dtype=np.int64)
    ends = np.cumsum(tables[count:], dtype=np.int64)
    words = np.zeros(int(ends[-1]) + 4, np.int64)
    words[:-4] = np.frombuffer(data, "<u2", int(ends[-1]), 16 + size)
    pos = ends - np.diff(ends, prepend=0)
    code = np.zeros(lanes, np.int64)
    for _ in range(3):
        code = (code << 16) | words.take(pos)
        pos += 1
    rng = np.full(lanes, _MASK, np.int64)
    model = _Model(count, lanes)
    k = model.bits + _WEIGHTS
    tail = n - (lanes - 1) * steps
    grid = np.zeros((steps, lanes), np.int64)
    for t in range(steps):
        m = lanes if t < tail else lanes - 1
        model.predict(m)
        c, g, p = code[:m], rng[:m], pos[:m]
        g >>= k
        x = model.at((c / g).astype(np.int64))
        start, size = model.interval(x)
        c -= start * g
        g *= size
        while (short := g < _LEAST).any():
            shift = short.astype(np.int64) << 4
            c <<= shift
            c |= words.take(p, mode="clip") * short
            p += short
            g <<= shift
        grid[t, :m] = x
        model.learn(x)
    return names.take(np.ascontiguousarray(grid.T).reshape(-1)[:n]).astype(np.uint32)


def _sizes(n: int) -> list[int]:
    """Sizes of the blocks of a run of n ids."""
    blocks = -(-n // BLOCK)
    return [n // blocks + (i < n % blocks) for i in range(blocks)]


def _check(ids: np.ndarray) -> int:
    return crc32(np.ascontiguousarray(ids).astype("<u4").tobytes())


def encode(ids: np.ndarray) -> tuple[list[bytes], list[int]]:
    """The coded blocks of a run of ids, and a checksum of the ids of each."""
    runs = np.split(ids, np.cumsum(_sizes(len(ids)))[:-1]) if len(ids) else []
    return [encode_block(x) for x in runs], [_check(x) for x in runs]


def decode(blocks: list, sizes: list[int], checks: list[int]) -> np.ndarray:
    """The ids of coded blocks.  A block that can't be read, or whose checksum differs, raises ValueError."""
    out = []
    for k, (block, n, check) in enumerate(zip(blocks, sizes, checks, strict=True)):
        try:
            out.append(decode_block(block, n))
        except Exception as e:
            raise ValueError(f"block {k}: damaged") from e
        if _check(out[-1]) != check:
            raise ValueError(f"block {k}: the checksum differs")
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


_HEAD = struct.Struct("<6sIQII")


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment: header, table of documents, table of blocks, a checksum of these, coded blocks."""
    blocks, checks = encode(ids)
    head = b"".join(
        [
            _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(blocks), BLOCK),
            np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], "<u1").tobytes(),
            np.asarray(lengths).astype("<u8").tobytes(),
            np.array([len(b) for b in blocks], "<u4").tobytes(),
            np.array(checks, "<u4").tobytes(),
        ]
    )
    return b"".join([head, struct.pack("<I", crc32(head)), *blocks])


def unpack(data) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids) of a segment; ValueError if a checksum differs."""
    data = memoryview(data)
    magic, docs, tokens, n, size = _HEAD.unpack_from(data)
    if magic != MAGIC or size != BLOCK:
        raise ValueError("not a segment of this format")
    at = _HEAD.size

    def table(kind, count):
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    ids, null, lengths, sizes, checks = table("<i8", docs), table("<u1", docs), table("<u8", docs), table("<u4", n), table("<u4", n)
    if struct.unpack_from("<I", data, at)[0] != crc32(data[:at]):
        raise ValueError("the header's checksum differs")
    at += 4
    ends = at + np.cumsum(sizes, dtype=np.int64)
    blocks = [data[e - int(s) : e] for s, e in zip(sizes, ends.tolist())]
    return [None if z else int(x) for x, z in zip(ids, null)], lengths.astype(np.int64), decode(blocks, _sizes(tokens), checks.tolist())
