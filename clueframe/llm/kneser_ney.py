"""Interpolated modified Kneser-Ney bigram model, counted in Spark and mapped by workers.

Text is lower-cased (A-Z); its tokens are words ``[^\\x20\\x09-\\x0D]+``, then one end.
A null text has no words.  With V distinct training tokens and N in all:

* P(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) P(w); v is a start mark before the first token,
* P(w) = max(t(w) - D'(t(w)), 0) / T + g' / (V + 1); t(w) is the number of distinct
  tokens before w, T the sum of t, and 1 / (V + 1) what an unknown token gets,
* D and D' have three values each (for counts 1, 2, 3 and over) from the counts of
  counts 1 to 4; where these don't determine a discount in [0, count] it is half the count.
  g and g' are what the discounts set free.  An unseen v leaves P(w) as it is.

The order is two: over this kind of text nearly every trigram is new, and their
tables alone would exceed a few times the input.

How it is counted.  Words are 64-bit hashes.  Tasks aggregate pieces of text to
sorted arrays of distinct keys and counts, cut them by key range and send each range
as one binary row; the receiving task merges arrays and writes a file of sorted keys
and one of counts, whole or not at all, to the shared folder.  Pairs of tokens are
keyed by both tokens' ranks in the vocabulary; their ranges follow the vocabulary's
counts, and the pairs of a frequent first word are spread over several ranges.  Each
file is small, however large the corpus; workers map the files and look keys up in
sorted order.  The driver holds a few numbers for each file.

Rows are scored one by one; repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scan
from .shared import array, arrow_batches, fresh, put, stored

PIECE = 8 << 20
END = np.uint64(0xE4D0_0000_0000_0001)
START = np.uint64(0xFFFF_FFFF)
_32 = np.uint64(32)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts.astype(np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[heads], np.add.reduceat(counts, heads)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[heads], np.diff(np.append(heads, len(keys)))


_ROW = "bucket int, keys binary, counts binary"


def _rows(parts) -> pa.RecordBatch:
    b, k, c = zip(*parts) if parts else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], names=["bucket", "keys", "counts"])


def _cut(keys, counts, edges):
    """(bucket, keys, counts) of each range that has keys; edges: where each bucket begins in keys."""
    for b in np.flatnonzero(np.diff(edges)):
        x, y = edges[b], edges[b + 1]
        yield int(b), keys[x:y].tobytes(), counts[x:y].astype(np.uint32).tobytes()


def _arrays(batches):
    """(bucket, keys, counts) of each run of rows of one bucket; the rows are sorted by bucket."""
    at, keys, counts = None, [], []
    for batch in batches:
        for b, k, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if b != at:
                if keys:
                    yield at, np.concatenate(keys), np.concatenate(counts)
                at, keys, counts = b, [], []
            keys.append(np.frombuffer(k.as_buffer(), np.uint64))
            counts.append(np.frombuffer(c.as_buffer(), np.uint32))
    if keys:
        yield at, np.concatenate(keys), np.concatenate(counts)


def _tokens(w: scan.Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of rows with an end after each, and where each row begins."""
    counts = w.counts
    heads = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.empty(heads[-1], np.uint64)
    last = np.zeros(heads[-1], bool)
    last[heads[1:] - 1] = True
    out[last], out[~last] = END, w.hashes()
    return out, heads


@dataclass
class Model:
    """What a worker needs to know of the files: a few numbers each."""

    folder: str
    bits: int  # the vocabulary's files go by that many high bits
    sizes: dict[int, int] = field(default_factory=dict)  # words in each of them
    ranks: dict[int, int] = field(default_factory=dict)  # rank of the first
    n: int = 0
    v: int = 0
    docs: int = 0
    breaks: tuple = ((0.0, 1.0), (0.0, 1.0))  # rank to share of the tokens
    pairs: list[tuple[int, int]] = field(default_factory=list)  # (bucket, first key), by key
    split: dict[int, tuple[int, int, int]] = field(default_factory=dict)  # N1, N2, N3+ of first words of several files
    width: int = 1  # ranks in a file of continuation counts
    types: int = 0
    discounts: tuple = ((0.5, 1.0, 1.5), (0.5, 1.0, 1.5))
    free: float = 1.0

    def vocabulary(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and training count of sorted word hashes; rank -1 where unknown."""
        rank, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        edges = np.searchsorted(h >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)) if len(h) else np.zeros((1 << self.bits) + 1, np.int64)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            if b not in self.sizes:
                continue
            s = slice(edges[b], edges[b + 1])
            keys = array(f"{self.folder}/words-{b}", np.uint64)
            at = np.searchsorted(keys, h[s]).clip(max=len(keys) - 1)
            there = keys[at] == h[s]
            rank[s] = np.where(there, at + self.ranks[b], -1)
            count[s] = np.where(there, array(f"{self.folder}/counts-{b}", np.int64)[at], 0)
        return rank, count

    def share(self, rank: np.ndarray) -> np.ndarray:
        return np.interp(rank, *self.breaks)

    def bucket(self, keys: np.ndarray, buckets: int) -> np.ndarray:
        """Range of each pair; not less for a larger key."""
        one, two = (keys >> _32).astype(np.float64), (keys & START).astype(np.float64)
        one[one == float(START)] = self.v
        at, to = self.share(one), self.share(one + 1)
        return (np.minimum(at + (to - at) * self.share(two), 1.0) * buckets).astype(np.int64).clip(max=buckets - 1)

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        if not self.pairs or not len(keys):
            return out
        edges = np.searchsorted(keys, np.array([k for _, k in self.pairs[1:]], np.uint64))
        edges = np.concatenate([[0], edges, [len(keys)]])
        for i in np.flatnonzero(np.diff(edges)):
            b, s = self.pairs[i][0], slice(edges[i], edges[i + 1])
            have = array(f"{self.folder}/pairs-{b}", np.uint64)
            at = np.searchsorted(have, keys[s]).clip(max=len(have) - 1)
            out[s] = np.where(have[at] == keys[s], array(f"{self.folder}/paircounts-{b}", np.uint32)[at], 0)
        return out

    def contexts(self, first: np.ndarray) -> np.ndarray:
        """N1, N2, N3+ of sorted first tokens (ranks, or START)."""
        out = np.zeros((len(first), 3), np.int64)
        if not self.pairs or not len(first):
            return out
        begins = np.array([k >> 32 for _, k in self.pairs], np.uint64)
        place = np.searchsorted(begins, first, side="right") - 1
        for i in np.unique(place[place >= 0]).tolist():
            s = np.flatnonzero(place == i)
            table = array(f"{self.folder}/contexts-{self.pairs[i][0]}", np.uint32).reshape(-1, 4)
            at = np.searchsorted(table[:, 0], first[s]).clip(max=len(table) - 1)
            there = table[at, 0] == first[s]
            out[s] = np.where(there[:, None], table[at, 1:], 0)
        for j in np.flatnonzero(np.isin(first, np.array([*self.split], np.uint64))):
            out[j] = self.split[int(first[j])]
        return out

    def continuations(self, rank: np.ndarray) -> np.ndarray:
        """t(w) of sorted ranks."""
        out = np.zeros(len(rank), np.int64)
        place = rank // self.width
        for b in np.unique(place).tolist():
            s = place == b
            out[s] = array(f"{self.folder}/continuations-{b}", np.uint32)[rank[s] - b * self.width]
        return out


def _merge_words(folder: str):
    """Writes a range of the vocabulary; returns its size, tokens, and its words of a 64th of them or more."""

    def run(batches):
        out = []
        for b, keys, counts in _arrays(batches):
            keys, counts = _summed(keys, counts)
            put(f"{folder}/words-{b}", [keys])
            put(f"{folder}/counts-{b}", [counts])
            often = np.flatnonzero(counts * 64 >= counts.sum())
            out.append((b, len(keys), int(counts.sum()), often.tolist(), counts[often].tolist()))
        cols = list(zip(*out)) or [()] * 5
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["bucket", "words", "tokens", "often", "counts"])

    return run


def _word_counts(bits: int):
    def run(batches):
        edges = np.arange((1 << bits) + 1, dtype=np.uint64)
        for column in scan.gathered(batches, 0, PIECE):
            for _, _, w in scan.scanned(column, scan.NOT_SPACE, budget=PIECE):
                keys, counts = _counted(_tokens(w)[0])
                yield _rows([*_cut(keys, counts, np.searchsorted(keys >> np.uint64(64 - bits), edges))])

    return run


def _ranked(model: Model, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and training count of each token."""
    h, back = np.unique(tokens, return_inverse=True)
    rank, count = model.vocabulary(h)
    return rank[back], count[back]


def _pair_keys(rank: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Previous and own rank of each token."""
    before = np.empty(len(rank), np.uint64)
    before[1:] = rank[:-1].astype(np.uint64)
    before[heads[:-1]] = START
    return (before << _32) | (rank.astype(np.uint64) & START)


def _pair_counts(model: Model, buckets: int):
    def run(batches):
        for column in scan.gathered(batches, 0, PIECE):
            for _, _, w in scan.scanned(column, scan.NOT_SPACE, budget=PIECE):
                tokens, heads = _tokens(w)
                keys, counts = _counted(_pair_keys(_ranked(model, tokens)[0], heads))
                yield _rows([*_cut(keys, counts, np.searchsorted(model.bucket(keys, buckets), np.arange(buckets + 1)))])

    return run


_PAIR_META = "kind string, bucket int, keys binary, counts binary, first decimal(20,0), numbers array<long>, ends array<long>"


def _merge_pairs(model: Model):
    """Writes a range of pairs and its first words; returns counts of counts and, by range of rank, what it adds to t(w)."""

    def run(batches):
        out = []
        for b, keys, counts in _arrays(batches):
            keys, counts = _summed(keys, counts)
            put(f"{model.folder}/pairs-{b}", [keys])
            put(f"{model.folder}/paircounts-{b}", [counts.astype(np.uint32)])
            one = keys >> _32
            heads = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
            table = np.empty((len(heads), 4), np.uint32)
            table[:, 0] = one[heads]
            for k, is_so in enumerate((counts == 1, counts == 2, counts >= 3)):
                table[:, k + 1] = np.add.reduceat(is_so.astype(np.int64), heads)
            put(f"{model.folder}/contexts-{b}", [table])
            ends = [*map(int, table[0]), *map(int, table[-1])]
            out.append(("meta", b, None, None, int(keys[0]), [len(keys), *(int((counts == k).sum()) for k in (1, 2, 3, 4))], ends))
            two, types = _counted(keys & START)
            edges = np.searchsorted(two, np.arange(0, model.v + model.width, model.width, dtype=np.uint64))
            out += [("types", r, k, c, None, None, None) for r, k, c in _cut(two, types, edges)]
            yield meta(out)
            out = []

    def meta(out):
        cols = list(zip(*out)) or [()] * 7
        from decimal import Decimal

        cols[4] = [None if x is None else Decimal(x) for x in cols[4]]
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.decimal128(20, 0), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["kind", "bucket", "keys", "counts", "first", "numbers", "ends"])

    return run


def _merge_types(model: Model):
    def run(batches):
        out = []
        for b, keys, counts in _arrays(batches):
            keys, counts = _summed(keys, counts)
            dense = np.zeros(min(model.width, model.v - b * model.width), np.uint32)
            dense[keys.astype(np.int64) - b * model.width] = counts
            put(f"{model.folder}/continuations-{b}", [dense])
            out.append((b, int(counts.sum()), *(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts >= 3).sum())))
        cols = list(zip(*out)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["bucket", "types", "n1", "n2", "n3", "n4", "over"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    n = (n1, n2, n3, n4)
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * n1 / (n1 + 2 * n2) * n[k] / n[k - 1] if n1 and n[k - 1] else -1.0
        out.append(d if 0 <= d <= k else k / 2)
    return tuple(out)


def _sorted(df: DataFrame, buckets: int) -> DataFrame:
    return df.repartition(buckets, "bucket").sortWithinPartitions("bucket")


def train(texts: DataFrame, text: str = "text") -> Model:
    """Counts a model over all rows."""
    spark = texts.sparkSession
    texts = texts.select(F.col(f"`{text}`").alias("text"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(3, (buckets - 1).bit_length())
    model = Model(fresh(spark, "model"), bits)
    docs = texts.count()
    words = texts.mapInArrow(_word_counts(bits), _ROW)
    with arrow_batches(spark):
        meta = stored(_sorted(words, 1 << bits).mapInArrow(_merge_words(model.folder), "bucket int, words long, tokens long, often array<long>, counts array<long>"), "meta").orderBy("bucket").collect()
    model.docs, model.n, model.v = docs, sum(r.tokens for r in meta), sum(r.words for r in meta)
    if not meta:
        return model
    if model.v >= int(START) - 1:
        raise ValueError("more distinct words than ranks of 32 bits")
    at, mass, xs, ys = 0, 0.0, [0.0], [0.0]
    for r in meta:
        model.sizes[r.bucket], model.ranks[r.bucket] = r.words, at
        rare = (r.tokens - sum(r.counts)) / max(1, r.words - len(r.often))
        last = 0
        for i, c in zip(r.often, r.counts):
            mass += rare * (i - last)
            xs, ys = [*xs, at + i, at + i + 1], [*ys, mass, mass + c]
            mass, last = mass + c, i + 1
        mass += rare * (r.words - last)
        at += r.words
        xs, ys = [*xs, at], [*ys, mass]
    xs, ys = [*xs, at + 1], [*ys, mass + docs]
    model.breaks = (np.array(xs), np.array(ys) / ys[-1])
    model.width = -(-model.v // buckets)
    pairs = texts.mapInArrow(_pair_counts(model, buckets), _ROW)
    with arrow_batches(spark):
        found = stored(_sorted(pairs, buckets).mapInArrow(_merge_pairs(model), _PAIR_META), "pairs")
    meta = found.where("kind = 'meta'").select("bucket", "first", "numbers", "ends").orderBy("first").collect()
    model.pairs = [(r.bucket, int(r.first)) for r in meta]
    ends: dict[int, list] = {}
    for r in meta:
        sides = {r.ends[0]: r.ends[1:4], r.ends[4]: r.ends[5:8]}
        for first, stats in sides.items():
            ends.setdefault(first, []).append(stats)
    model.split = {k: tuple(map(sum, zip(*v))) for k, v in ends.items() if len(v) > 1}
    with arrow_batches(spark):
        types = stored(_sorted(found.where("kind = 'types'").select("bucket", "keys", "counts"), buckets).mapInArrow(_merge_types(model), "bucket int, types long, n1 long, n2 long, n3 long, n4 long, over long"), "types").collect()
    model.types = sum(r.types for r in types)
    low = discounts(*(sum(r[k] for r in types) for k in ("n1", "n2", "n3", "n4")))
    model.discounts = (discounts(*(sum(r.numbers[k] for r in meta) for k in (1, 2, 3, 4))), low)
    model.free = sum(d * sum(r[k] for r in types) for d, k in zip(low, ("n1", "n2", "over"))) / model.types
    return model


def _probabilities(model: Model, tokens: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 P of each token after the one before it, and its training count."""
    h, back = np.unique(tokens, return_inverse=True)
    rank, count = model.vocabulary(h)
    known = rank >= 0
    t = np.zeros(len(h), np.int64)
    t[known] = model.continuations(rank[known]) if known.any() else 0
    d = np.array([0.0, *model.discounts[1]])
    p = np.full(len(h), model.free / (model.v + 1))
    if model.types:
        p += np.maximum(t - d[np.minimum(t, 3)], 0) / model.types
    p = p[back]
    own = rank[back]
    before = np.empty(len(own), np.int64)
    before[1:] = own[:-1]
    before[heads[:-1]] = int(START)
    first, to_first = np.unique(before, return_inverse=True)
    total = np.zeros(len(first))
    stats = np.zeros((len(first), 3), np.int64)
    seen = first >= 0
    stats[seen] = model.contexts(first[seen].astype(np.uint64))
    by_rank = np.zeros(len(first), np.int64)
    order = np.argsort(rank[known])
    places = np.searchsorted(rank[known][order], first)
    inside = seen & (first != int(START))
    by_rank[inside] = count[known][order][places[inside]]
    total = np.where(first == int(START), model.docs, by_rank).astype(float)
    use = (total > 0) & (stats.sum(axis=1) > 0)
    d = np.array([0.0, *model.discounts[0]])
    free = np.where(use, stats @ d[1:] / np.maximum(total, 1), 1.0)
    c = np.zeros(len(own), np.int64)
    both = (before >= 0) & (own >= 0)
    keys, to_key = np.unique((before[both].astype(np.uint64) << _32) | own[both].astype(np.uint64), return_inverse=True)
    c[both] = model.pair_counts(keys)[to_key]
    p = free[to_first] * p + np.where(use[to_first], np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(total, 1)[to_first], 0.0)
    return np.log10(p), count[back]


def _scores(model: Model):
    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for _, _, w in scan.scanned(batch.column(batch.num_columns - 1), scan.NOT_SPACE, budget=PIECE):
                tokens, heads = _tokens(w)
                p, c = _probabilities(model, tokens, heads)
                at = heads[:-1]
                out[0].append(np.diff(heads))
                out[1].append(np.add.reduceat((c > 0).astype(np.int64), at))
                out[2].append(np.add.reduceat(np.log10((c + 1) / (model.n + model.v + 1)), at))
                out[3].append(np.add.reduceat(p, at))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(np.concatenate(x)) if x else pa.array([], k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64())))],
                names=[*batch.schema.names[:-1], "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def score(model: Model, docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of each row, n_tokens, n_known, base_score (add-one unigrams) and score, both log10; perplexity is 10 ** (-score / n_tokens).

    A kept column of a result's name is left out.
    """
    keep = tuple(c for c in keep if c not in ("n_tokens", "n_known", "base_score", "score"))
    x = docs.select(*keep, F.col(f"`{text}`").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields[:-1])
    return x.mapInArrow(_scores(model), f"{kinds}, n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % 7 == 2, F.lit(False))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(~held_out()))
    scored = score(model, docs)
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


QUERIES = {"op4_language_model": op4_language_model}
ORACLES: dict[str, str] = {}
