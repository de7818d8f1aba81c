"""Hashed features of texts, and what linear models over them share.

A row's features are the distinct 64-bit hashes of its lower-cased words, of their first
``PREFIX`` bytes and two-byte non-alphanumeric endings, and of its shape in coarse steps: length, and the shares
of words that repeat the word before, of words in capitals, of words without letters or
digits, and of three-word runs met before in the row.  A model holds the features met
in at least ``LEAST_ROWS`` rows of its training sample whose labels differ from the others'
by ``LEAST_Z`` standard deviations; a sample is the ``SAMPLE``
labelled rows of least hashed id, so that it is the same on every run, and its size and
the model's don't grow with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan

SAMPLE = 8000
PREFIX = 5
LEAST_ROWS = 6
#: Standard deviations by which a feature's share of some group of labels must differ from all rows' share.
LEAST_Z = 4.0
_ENDING, _SHAPE, _FRONT = np.uint64(0x51A9_E1D3), np.uint64(0x7F4A_7C15), np.uint64(0x2545_F491_4F6C_DD1D)
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True


def _shares(part: np.ndarray, heads: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(part)])
    return (total[heads + counts] - total[heads]) / np.maximum(counts, 1)


def row_features(w: scan.Words) -> tuple[np.ndarray, np.ndarray]:
    """(features of all rows, where each row begins), without repeats in a row."""
    h, heads, counts = w.hashes(), w.rows[:-1], w.counts
    n = len(h)
    row = np.repeat(np.arange(len(counts)), counts)
    again = np.zeros(n, bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    upper = np.concatenate([[0], np.cumsum(_CAPITAL[w.data])])
    upper = upper[w.ends] - upper[w.starts]
    alnum = np.concatenate([[0], np.cumsum(scan.ALNUM[w.data])])
    alnum = alnum[w.ends] - alnum[w.starts]
    caps = (upper >= 2) & (upper * 2 > alnum)
    bare = alnum == 0
    runs = scan.windows(h, 3)
    old = np.zeros(len(counts))
    for r in np.flatnonzero(counts >= 3):
        x = np.sort(runs[heads[r] : heads[r] + counts[r] - 2])
        old[r] = (x[1:] == x[:-1]).sum() / len(x)
    shape = np.stack(
        [
            np.minimum(np.log2(counts + 1), 15).astype(np.uint64),
            *(np.ceil(10 * s).astype(np.uint64) for s in (_shares(again, heads, counts), _shares(caps, heads, counts), _shares(bare, heads, counts), old)),
        ],
        axis=1,
    )
    shape = scan.mix((np.arange(shape.shape[1], dtype=np.uint64) << np.uint64(32)) + shape + _SHAPE)
    two = w.ends - w.starts >= 2
    last, before = w.data[w.ends - 1].astype(np.uint64), w.data[np.maximum(w.ends - 2, 0)].astype(np.uint64)
    odd = two & ~scan.ALNUM[w.data[w.ends - 1]] & ~scan.ALNUM[w.data[np.maximum(w.ends - 2, 0)]] if n else two
    endings = scan.mix(last * np.uint64(256) + before + _ENDING)
    fronts = w.hashes(PREFIX) ^ _FRONT
    long = w.ends - w.starts > PREFIX
    out = []
    for r, (a, c) in enumerate(zip(heads.tolist(), counts.tolist())):
        out.append(np.unique(np.concatenate([h[a : a + c], fronts[a : a + c][long[a : a + c]], endings[a : a + c][odd[a : a + c]], shape[r]])))
    begins = np.cumsum([0, *map(len, out)])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), begins


def over_rows(column):
    """(features, begins, word counts) of runs of rows of a column."""
    for _, _, w in scan.scanned(column, scan.NOT_SPACE):
        yield *row_features(w), w.counts


def _extract(batches):
    for batch in batches:
        sets = [f[a:b].tobytes() for f, at, _ in over_rows(batch.column(1)) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["label", "features"])


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, text: str = "text") -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of the sample.  ``labels`` has doc_id and label (int); rows where either is null are left out."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("label").cast("int").alias("__label")).where("__id is not null and __label is not null")
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "__label").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.col(f"`{text}`").alias("__text"))
    joined = texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select(F.col("__label").alias("label"), "__text")
    got = joined.mapInArrow(_extract, "label int, features binary").collect()
    got.sort(key=lambda r: (r.label, bytes(r.features)))
    return [np.frombuffer(bytes(r.features), np.uint64) for r in got], np.array([r.label for r in got], np.int64)


class Design:
    """Training rows as sparse columns over the kept features; groups: 0/1 columns of the rows."""

    def __init__(self, features: list[np.ndarray], groups: np.ndarray):
        flat = np.concatenate(features) if features else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(len(features), dtype=np.int32), [len(f) for f in features])
        keys, counts = np.unique(flat, return_counts=True)
        keys, counts = keys[counts >= LEAST_ROWS], counts[counts >= LEAST_ROWS]
        flat, row, column = self._among(keys, flat, row)
        telling = np.zeros(len(keys), bool)
        for g in groups.T.astype(float):
            p = g.mean()
            if 0 < p < 1:
                telling |= np.abs(np.bincount(column, g[row], len(keys)) - counts * p) >= LEAST_Z * np.sqrt(counts * p * (1 - p))
        self.keys = keys[telling]
        _, self.row, self.column = self._among(self.keys, flat, row)
        self.rows = len(features)

    @staticmethod
    def _among(keys: np.ndarray, flat: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The features that are among the keys, their rows and their places."""
        if not len(keys):
            return flat[:0], row[:0], np.zeros(0, np.int32)
        column = np.searchsorted(keys, flat).astype(np.int32).clip(max=len(keys) - 1)
        have = keys[column] == flat
        return flat[have], row[have], column[have]

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], self.rows)

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, values[self.row], len(self.keys))


def minimise(gradient, x: np.ndarray, steps: int = 200, rate: float = 0.1) -> np.ndarray:
    """Adam over the whole sample: the same result on every run."""
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        g = gradient(x)
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        x = x - rate * min(1.0, 3 * (1 - t / (steps + 1))) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def row_sums(keys: np.ndarray, weights: np.ndarray, features: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of the weights (features by outputs) of each row's features."""
    if not len(keys):
        return np.zeros((len(begins) - 1, weights.shape[1]))
    at = np.searchsorted(keys, features).clip(max=len(keys) - 1)
    have = keys[at] == features
    total = np.zeros((len(features) + 1, weights.shape[1]))
    np.cumsum(np.where(have[:, None], weights[at], 0.0), axis=0, out=total[1:])
    return total[begins[1:]] - total[begins[:-1]]
