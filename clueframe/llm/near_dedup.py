"""MinHash near-duplicate detection with exact confirmation.

A text is lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``.  Its set is
that of its distinct ``shingle``-word runs; with fewer words, the whole sequence as
one; without words or text it is empty and linked with nothing.  Two documents are
linked where ``100 * |intersection| >= percent * |union|``.

1. Texts with equal sets (by a 128-bit digest) form a class, a node with a number of its
   own, so that copies are compared once however many there are.
2. ``BANDS`` bands of ``ROWS`` universal-hash minima bucket the classes.  At a
   similarity of 0.8 a pair shares no bucket with probability (1 - 0.8^5)^40 = 1e-7.
3. In each bucket every class is paired with the least one.  A pair goes on if the
   sizes allow it and the signatures agree well enough (``LEAST_AGREE`` of 200, over five
   standard deviations below what 0.8 gives), and is a link if the full sets confirm it.
4. Connected components come from alternating large-star and small-star.
5. In buckets of more than ``BLOCK`` members that still hold several components, the members outside
   the largest are paired with one of it, another in each bucket and turn, and confirmed as above.
6. What is outside the largest component even then, the rest, is compared in blocks of about ``BLOCK``
   members, across components only, a pair in the first bucket it shares: each block of the
   rest with all blocks, so that members of the largest component are sent once for each block of the rest.
   Members with a likely partner are sent their full sets; confirmed links join components.

So no group is expanded into pairs, and each pair that shares a bucket is either
confirmed, refused, or already in one component.

Rows that share a doc_id are one document, with the links of all its texts: its classes
are linked, and its rows without a set are in their component.  Rows with
a null doc_id are compared as all others are; where no doc_id is reachable, their
component is null.  Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scan
from .components import connected
from .shared import arrow_batches, lean, passing, small, spread, stored

PERCENT = 80
BANDS, ROWS = 40, 5
LEAST_AGREE = 130
BLOCK = 512
#: Most turns of step 5.
TURNS = 2

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingle_sets(column, shingle: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the sorted distinct shingle hashes of each row) over a column."""
    for a, _, w in scan.scanned(column, scan.NOT_SPACE):
        h, counts = w.hashes(), w.counts
        runs = scan.windows(h, shingle)
        out = []
        for r, c in zip(w.rows[:-1].tolist(), counts.tolist()):
            if c >= shingle:
                x = runs[r : r + c - shingle + 1]
                x = np.sort(x)
                keep = np.empty(len(x), dtype=bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                out.append(x[keep])
            else:
                out.append(scan.windows(h[r : r + c], c) if c else h[:0])
        yield a, out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The BANDS * ROWS minima of each of some non-empty sets."""
    out = np.empty((len(_A), len(sets)), np.uint32)
    sizes = np.array([len(s) for s in sets])
    at = 0
    ends = np.cumsum(sizes)
    while at < len(sets):  # what a core's cache holds at once
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + 24_000, side="right")))
        x = (np.concatenate(sets[at:to]) >> np.uint64(32)).astype(np.uint32)
        heads = np.cumsum(sizes[at:to]) - sizes[at:to]
        y = np.empty_like(x)
        for k in range(len(_A)):
            np.multiply(x, _A[k], out=y)
            np.add(y, _B[k], out=y)
            np.minimum.reduceat(y, heads, out=out[k, at:to])
        at = to
    return np.ascontiguousarray(out.T)


def band_keys(m: np.ndarray) -> np.ndarray:
    m = m.reshape(len(m), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), m.shape[:2])
    for i in range(ROWS):
        key = scan.mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, :, i])
    return key.view(np.int64)


_SKETCH = "doc_id long, n_shingles long, digest binary, signature binary, bands array<long>"


def _sketch(shingle: int):
    """Per row: set size and digest; a signature where the task meets that digest for the first time."""

    def run(batches):
        met: set[bytes] = set()
        for batch in batches:
            n, digests, rows, new = [], [], [], []
            signatures: list = [None] * batch.num_rows
            bands: list = [None] * batch.num_rows
            for a, sets in shingle_sets(batch.column(1), shingle):
                rows, new = [], []
                for i, s in enumerate(sets):
                    n.append(len(s))
                    d = _digest(s)
                    digests.append(d)
                    if d is not None and d not in met:
                        if len(met) < 1_000_000:
                            met.add(d)
                        rows.append(a + i)
                        new.append(s)
                if new:
                    m = minima(new)
                    low = (m & np.uint32(255)).astype(np.uint8)
                    for r, s, b in zip(rows, low, band_keys(m)):
                        signatures[r], bands[r] = s.tobytes(), b
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "signature", "bands"],
            )

    return run


def _agreeing(percent: int):
    """Keeps (a, b, na, nb, sa, sb) rows whose sizes and signatures allow a link."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, na, nb, sa, sb = (batch.column(i) for i in range(6))
            na, nb = na.to_numpy(zero_copy_only=False), nb.to_numpy(zero_copy_only=False)
            x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for s in (sa, sb))
            keep = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((x == y).sum(axis=1) >= LEAST_AGREE)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep))

    return run


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            out = [s.tobytes() for _, sets in shingle_sets(batch.column(1), shingle) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "set"])

    return run


def _digest(s: np.ndarray) -> bytes | None:
    return blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _digest_sets(shingle: int):
    """Sets with their digests, each about once a task."""

    def run(batches):
        met: set[bytes] = set()
        for batch in batches:
            digests, out = [], []
            for _, sets in shingle_sets(batch.column(0), shingle):
                for s in sets:
                    d = _digest(s)
                    if d is not None and d not in met:
                        if len(met) < 1_000_000:
                            met.add(d)
                        digests.append(d)
                        out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(out, pa.binary())], names=["digest", "set"])

    return run


def _with_digest(shingle: int, text: str, into: str):
    """The rows with the digest of their set as a last column."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            digests = [_digest(s) for _, sets in shingle_sets(batch.column(at), shingle) for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=[*batch.schema.names, into])

    return run


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = []
            for p, q in zip(x, y):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q))
                common = _common(p, q)
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _common(p: np.ndarray, q: np.ndarray) -> int:
    both = np.concatenate([p, q])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _groups(batches, size: int):
    """Runs of rows with equal first two columns, as lists of columns without these; ``batches`` is sorted by them."""
    key, held = None, [[] for _ in range(size)]
    for batch in batches:
        rows = [c.to_pylist() for c in batch.columns]
        for i, k in enumerate(zip(rows[0], rows[1])):
            if k != key:
                if held[0]:
                    yield key, held
                key, held = k, [[] for _ in range(size)]
            for h, c in zip(held, rows[2:]):
                h.append(c[i])
    if held[0]:
        yield key, held


class _Part:
    """Members of a bucket's block, or of two blocks (side 0 and side 1), and which of them may be linked."""

    def __init__(self, percent: int, side, node, comp, n, signature, bands):
        self.percent, self.side, self.node, self.comp, self.n = percent, np.array(side), np.array(node), np.array(comp), np.array(n)
        self.signature = np.frombuffer(b"".join(signature), np.uint8).reshape(-1, BANDS * ROWS)
        self.bands = np.array(bands)
        self.two = bool(self.side.any())

    def near(self, i: int, bucket: int) -> np.ndarray:
        """Of other components, those that may be linked to i and share no earlier bucket with it."""
        rest = (self.side == 1) if self.two else (np.arange(len(self.node)) > i)
        rest &= (self.comp != self.comp[i]) & (100 * np.minimum(self.n, self.n[i]) >= self.percent * np.maximum(self.n, self.n[i]))
        rest = np.flatnonzero(rest)
        if len(rest):
            rest = rest[(self.signature[rest] == self.signature[i]).sum(axis=1) >= LEAST_AGREE]
        if len(rest):
            band = int(np.flatnonzero(self.bands[i] == bucket)[0])
            rest = rest[~(self.bands[rest, :band] == self.bands[i, :band]).any(axis=1)]
        return rest


def _asking(percent: int):
    """(bucket, part, node) of the members that may be linked to one of another component."""

    def run(batches):
        for (bucket, part), columns in _groups(batches, 6):
            x = _Part(percent, *columns)
            asked = np.zeros(len(x.node), bool)
            for i in np.flatnonzero(x.side == 0):
                near = x.near(i, bucket)
                asked[near] = True
                asked[i] |= len(near) > 0
            nodes = x.node[asked]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), bucket)), pa.array(np.full(len(nodes), part)), pa.array(x.side[asked]), pa.array(nodes)], schema=_ASKED_ARROW)

    return run


_ASKED = "bucket long, part long, side int, node long"
_ASKED_ARROW = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("side", pa.int32()), ("node", pa.int64())])


def _joining(percent: int):
    """Confirmed links between components within each part, each link joining two that none before it has joined."""

    def run(batches):
        for (bucket, _), columns in _groups(batches, 7):
            sets = [np.frombuffer(v, np.uint64) for v in columns.pop()]
            x = _Part(percent, *columns)
            out = []
            for i in np.flatnonzero(x.side == 0):
                for j in x.near(i, bucket):
                    if x.comp[i] != x.comp[j]:
                        c = _common(sets[i], sets[j])
                        if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                            out.append((x.node[i], x.node[j]))
                            x.comp[x.comp == x.comp[j]] = x.comp[i]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return run


def _mixed(placed: DataFrame, turn: int) -> DataFrame:
    """Buckets of several components: m members, the largest component, one member of it, and how many are outside."""
    one = F.min(F.struct(F.xxhash64("node", "bucket", F.lit(turn)).alias("h"), "node"))
    each = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"), one.alias("one"))
    top = F.max(F.struct("n", "comp", F.col("one.node").alias("pivot"))).alias("top")
    both = each.groupBy("bucket").agg(top, F.sum("n").alias("m"), F.count("*").alias("comps")).where("comps > 1")
    return both.select("bucket", "m", F.col("top.comp").alias("major"), F.col("top.pivot").alias("pivot"), (F.col("m") - F.col("top.n")).alias("rest"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (least doc_id reachable), kept."""
    return _found(docs, shingle, percent, text).select("doc_id", "n_shingles", "component_id", "kept")


def _found(docs: DataFrame, shingle: int, percent: int, text: str) -> DataFrame:
    """The rows of ``near_duplicates`` with digest and node, the least class reachable (null where a row is a copy of nothing)."""
    with passing(docs.sparkSession), arrow_batches(docs.sparkSession, rows=2000):
        return _near_duplicates(docs, shingle, percent, text)


def _near_duplicates(docs: DataFrame, shingle: int, percent: int, text: str) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sketch = stored(texts.mapInArrow(lean(_sketch(shingle)), _SKETCH), "sketch", keep=True)
    again = stored(sketch.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    # A class is odd where its rep does not lead to one row.
    repeated = small(again).select(F.col("doc_id").alias("rep"), F.lit(True).alias("again"))
    classes = stored(
        sketch.where("digest is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.count("*").alias("rows"), F.first("signature", ignorenulls=True).alias("signature"), F.first("bands", ignorenulls=True).alias("bands"))
        .join(repeated, "rep", "left")
        .withColumn("odd", F.expr("rep is null or again is not null"))
        .drop("again")
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    known = classes.select("node", "n", "signature")
    rows = classes.select("node", F.explode("bands").alias("bucket"))
    total = BANDS * classes.count()
    shared = stored(rows.groupBy("bucket").agg(F.min("node").alias("center"), F.count("*").alias("m")).where("m > 1"), "shared")
    members = stored(spread(rows, shared, "bucket", "m", total).where("node <> center"), "members")

    def sets_of(nodes: DataFrame) -> DataFrame:
        asked = stored(nodes.distinct().join(classes.select("node", "rep", "digest", "odd"), "node"), "asked")
        plain = small(asked.where("not odd").select(F.col("rep").alias("doc_id"), "node"))
        sets = texts.join(plain, "doc_id").select("node", "text").mapInArrow(lean(_sets(shingle)), "node long, set binary")
        odd = asked.where("odd")
        if odd.limit(1).count():
            ids = small(odd.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct())
            some = texts.join(ids, "doc_id", "left_semi").select("text").union(texts.where("doc_id is null").select("text"))
            some = some.mapInArrow(lean(_digest_sets(shingle)), "digest binary, set binary").join(small(odd.select("digest", "node")), "digest")
            sets = sets.union(some.dropDuplicates(["node"]).select("node", "set"))
        return stored(sets, "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        one = known.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa"))
        two = known.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"))
        near = stored(pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lean(_agreeing(percent)), "a long, b long"), "near")
        sets = sets_of(near.select(F.col("a").alias("node")).union(near.select("b")))
        both = near.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
        return both.select("a", "b", "set_a", "set_b").mapInArrow(lean(_confirmed(percent)), "a long, b long").distinct()

    links = stored(confirmed(members.select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()), "links")
    # The classes of one doc_id are linked with the least of them.
    owned = stored(sketch.where("digest is not null").join(small(again), "doc_id", "left_semi").select("doc_id", "digest").distinct().join(classes.select("digest", "node"), "digest"), "owned")
    several = owned.limit(1).count() > 0
    if several:
        head = small(stored(owned.groupBy("doc_id").agg(F.min("node").alias("a")), "head"))
        links = stored(links.union(owned.join(head, "doc_id").where("a <> node").select("a", F.col("node").alias("b"))), "links")
    comps = connected(links)

    for turn in range(TURNS + 1):
        placed = members.where("m > 2").select("bucket", "node").join(comps, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("comp"))
        mixed = stored(_mixed(placed, turn), "mixed")
        large = mixed.where(F.col("m") > BLOCK)
        if turn == TURNS or not large.limit(1).count():
            break
        pairs = spread(placed, large, "bucket", "m", total).where("comp <> major").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
        more = stored(confirmed(pairs), "links")
        if not more.limit(1).count():
            break
        comps = connected(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    # The number of blocks follows from the bucket's size; a row is sent to each part that has its block.
    # The first blocks are of the rest, the others of the largest component; a bucket of one block is not cut.
    large = F.col("m") > BLOCK
    cut = large & (F.col("comp") == F.col("major"))
    first = F.when(large, F.ceil(F.col("rest") / BLOCK)).otherwise(1).cast("int")
    others = F.when(large, F.ceil((F.col("m") - F.col("rest")) / BLOCK)).otherwise(0).cast("int")
    hashed = F.xxhash64("node", "bucket")
    mine = F.when(cut, first + F.pmod(hashed, F.greatest(others, F.lit(1)))).otherwise(F.pmod(hashed, first)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.when(cut, first).otherwise(first + others) - 1), lambda o: F.struct(F.least(o, mine).alias("lo"), F.greatest(o, mine).alias("hi"), F.when(mine > o, 1).otherwise(0).alias("side")))
    known = classes.select("node", "n", "signature", "bands")
    parts = spread(placed, mixed, "bucket", "m", total).select("bucket", "node", "comp", F.explode(parts).alias("p"))
    parts = stored(parts.select("bucket", (F.col("p.lo") * 1_000_000 + F.col("p.hi")).alias("part"), F.col("p.side").alias("side"), "node", "comp"), "parts")
    full = ["bucket", "part", "side", "node", "comp", "n", "signature", "bands"]
    sides = lambda x: x.repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    asking = stored(sides(parts.join(known, "node").select(*full)).mapInArrow(lean(_asking(percent)), _ASKED), "asking")
    if asking.limit(1).count():
        sets = sets_of(asking.select("node"))
        asked = parts.join(asking, ["bucket", "part", "side", "node"], "left_semi").join(known, "node").join(sets, "node")
        more = stored(sides(asked.select(*full, "set")).mapInArrow(lean(_joining(percent)), "a long, b long").distinct(), "links")
        if more.limit(1).count():
            comps = connected(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    linked = stored(classes.select("digest", "node", "rep", "rows").join(comps, "node", "left").where("rows > 1 or component is not null").select("digest", "rep", F.coalesce("component", "node").alias("node")), "linked", keep=True)
    least = small(stored(linked.groupBy("node").agg(F.min("rep").alias("component")), "least", keep=True))
    found = linked.join(least, "node").select("digest", "node", "component")
    out = sketch.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
    if several:
        # A document's rows without a set are in the component of its others.
        rest = owned.join(found.select("digest", F.col("component").alias("own")), "digest", "left").groupBy("doc_id").agg(F.min("own").alias("own"))
        out = out.join(small(stored(rest, "own", keep=True)), "doc_id", "left").withColumn("component", F.coalesce("component", "own"))
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "digest", "node")


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """``docs`` with one document of each component (that of the least doc_id); same columns.

    Of rows that share a doc_id, one stays.  Rows with a null doc_id stay where they are copies of nothing;
    of a component without any doc_id one row stays, of the least digest.
    """
    with passing(docs.sparkSession):
        found = stored(_found(docs, shingle, percent, text), "components", keep=True)
    gone = small(found.where("doc_id is not null and not kept").select("doc_id").distinct())
    key = F.col("doc_id").cast("long")
    out = docs.join(gone.withColumnRenamed("doc_id", "__gone"), key == F.col("__gone"), "left_anti")
    copies = found.where("doc_id is null and node is not null")
    if copies.limit(1).count():
        one = copies.where("component_id is null").groupBy("node").agg(F.min("digest").alias("digest"))
        lost = small(stored(copies.select("digest").distinct().join(one.select("digest"), "digest", "left_anti"), "lost"))
        own = "__digest"
        nulls = docs.where(key.isNull())
        nulls = nulls.mapInArrow(_with_digest(shingle, text, own), T.StructType([*nulls.schema.fields, T.StructField(own, T.BinaryType())]))
        nulls = nulls.join(lost.withColumnRenamed("digest", "__lost"), F.col(own) == F.col("__lost"), "left_anti")
        # Of equal sets one stays; rows without a set are copies of nothing.
        nulls = nulls.where(F.col(own).isNull()).unionByName(nulls.where(F.col(own).isNotNull()).dropDuplicates([own]))
        out = out.where(key.isNotNull()).unionByName(nulls.drop(own))
    again = small(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again")))
    if again.limit(1).count():
        once = out.join(again, key == F.col("__again"), "left_semi").dropDuplicates(["doc_id"])
        out = out.join(again, key == F.col("__again"), "left_anti").unionByName(once)
    return out


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=2)


QUERIES = {"op7_near_dedup": op7_near_dedup}
ORACLES: dict[str, str] = {}
