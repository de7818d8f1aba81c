"""Line dedup by a segment-partition edit join.

A document's lines are cut at \\n; lines without a character other than white space
take no part and stay.  Equal lines are one line text.  Two texts of at least
``min_chars`` characters are linked if their edit distance (insert, delete or replace a
code point) is at most ``threshold``; shorter ones are linked with nothing.  Linked texts
form classes (connected components), and of a class only the first line stays, in
order of doc_id and line number.

The join: a text of length l is cut into threshold + 1 segments, of which any text within
the threshold must contain one unchanged, near its place.  Each text gives the keys
(length, segment number, segment) of its own segments and of those substrings of it that
can be a segment of a text up to ``threshold`` shorter (multi-match-aware selection).
Texts that share a key are compared with the least of them; links are verified by
banded bit-parallel edit distance.  Where a key's texts then still belong to several
components they are compared with each other, across components only, in blocks of at
most ``BLOCK``; a pair whose character counts differ by too much is passed over unverified.
Of the texts only those in question are shuffled, as told by a Bloom filter of their digests.

Texts go by 96-bit digests.  A null doc_id comes before all others; rows that share a doc_id
count as one document, whose equal lines of equal number are one.  Rows with a null doc_id are
documents of their own where texts are cut.  Null texts have no lines.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected
from .near_dedup import _groups
from .shared import lean, passing, small, spread, stored

THRESHOLD = 2
MIN_CHARS = 20
BLOCK = 512
#: Bytes that the filter of the lines asked for may take; beyond it the texts of all lines are shuffled.
FILTER_BYTES = 64 << 20
_SLICE_BITS, _SLICE_DIGESTS = 1 << 16, 6000
_BINS = 64
_NO_TEXT = "\ud800"  # stands in no text


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """(start, length) of each segment of a text of that length."""
    parts, out, at = threshold + 1, [], 0
    size, longer = divmod(length, parts)
    for i in range(parts):
        n = size + (i >= parts - longer)
        out.append((at, n))
        at += n
    return out


def keys_of(text: str, threshold: int) -> list[int]:
    """The distinct keys of a text longer than the threshold."""
    n, out = len(text), set()
    for length in range(max(threshold + 1, n - threshold), n + 1):
        delta = n - length
        for i, (p, size) in enumerate(segments(length, threshold)):
            rest = threshold - i
            for s in range(max(0, p - i, p + delta - rest), min(n - size, p + i, p + delta + rest) + 1):
                out.add(xxhash.xxh3_64_intdigest(text[s : s + size].encode(), seed=length * 64 + i) - (1 << 63))
    return list(out)


def within(a: str, b: str, threshold: int) -> bool:
    """Whether the edit distance is at most the threshold: bit-parallel over a diagonal band."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > threshold:
        return False
    if a == b:
        return True
    head = 0
    while head < len(a) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a:
        return len(b) <= threshold
    # Bit k of live[e], before the i-th character: a[:i] becomes b[:i - threshold + k] by e edits at most.
    full = (1 << (2 * threshold + 1)) - 1
    padded = _NO_TEXT * threshold + b + _NO_TEXT * (2 * threshold + 1)
    live = [((1 << (e + 1)) - 1) << threshold & full for e in range(threshold + 1)]
    for i, c in enumerate(a):
        band, same = padded[i : i + 2 * threshold + 1], 0
        k = band.find(c)
        while k >= 0:
            same |= 1 << k
            k = band.find(c, k + 1)
        before, new = 0, []
        for e, x in enumerate(live):
            y = x & same
            if e:
                y |= before | before >> 1 | new[-1] << 1 & full
            before = x
            new.append(y)
        live = new
        if not live[-1]:
            return False
    return bool(live[-1] >> (len(b) - len(a) + threshold) & 1)


def _digest(line: bytes) -> bytes:
    return blake2b(line, digest_size=12).digest()


def _lines(text: str | None):
    """(number, line) of the lines that take part."""
    return [(i, x) for i, x in enumerate(text.split("\n")) if x and not x.isspace()] if text else []


def _occurring(batches):
    for batch in batches:
        rows, at, digests = [], [], []
        for k, t in enumerate(batch.column(batch.schema.get_field_index("text"))):
            for i, x in _lines(t.as_py()):
                rows.append(k)
                at.append(i)
                digests.append(_digest(x.encode()))
        rows = pa.array(rows, pa.int64())
        keys = [(n, c.take(rows)) for n, c in zip(batch.schema.names, batch.columns) if n != "text"]
        yield pa.RecordBatch.from_arrays([*(c for _, c in keys), pa.array(at, pa.int32()), pa.array(digests, pa.binary())], names=[*(n for n, _ in keys), "line", "digest"])


def _keyed(threshold: int, min_chars: int):
    def run(batches):
        met: set[bytes] = set()
        for batch in batches:
            digests, keys = [], []
            for t in batch.column(0):
                for _, x in _lines(t.as_py()):
                    if len(x) >= min_chars:
                        d = _digest(x.encode())
                        if d not in met:
                            if len(met) < 1_000_000:
                                met.add(d)
                            digests.append(d)
                            keys.append(keys_of(x, threshold))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["digest", "keys"])

    return run


def _places(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number that gives the slice, four places in it) of each digest in a filter."""
    x = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 12)
    return x[:, 8:].copy().view(">u4")[:, 0].astype(np.int64), x[:, :8].copy().view("<u2").astype(np.int64)


def _filled(batches):
    for batch in batches:
        bits = []
        for digests in batch.column(1).to_pylist():
            x = np.zeros(_SLICE_BITS, bool)
            x[_places(digests)[1]] = True
            bits.append(np.packbits(x).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["slice", "bits"])


def _filter(digests: DataFrame, n: int) -> np.ndarray | None:
    """A row of bytes for each slice of a Bloom filter of ``n`` different digests; None beyond ``FILTER_BYTES``."""
    slices = max(1, -(-n // _SLICE_DIGESTS))
    if slices * _SLICE_BITS // 8 > FILTER_BYTES:
        return None
    number = F.conv(F.hex(F.substring("digest", 9, 4)), 16, 10).cast("long")
    filled = digests.groupBy(F.pmod(number, F.lit(slices)).cast("int").alias("slice")).agg(F.collect_list("digest").alias("digests"))
    out = np.zeros((slices, _SLICE_BITS // 8), np.uint8)
    for r in filled.mapInArrow(lean(_filled), "slice int, bits binary").collect():
        out[r.slice] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _among(table: np.ndarray, digests: list[bytes]) -> np.ndarray:
    """Whether each digest is in the filter; of others about one in a hundred is said to be."""
    number, places = _places(digests)
    return (table[(number % len(table))[:, None], places >> 3] >> (7 - (places & 7)) & 1).all(axis=1)


def _texts(sent):
    """(digest, text) of the lines that may be asked for; without a filter, of all."""

    def run(batches):
        for batch in batches:
            found = {_digest(x.encode()): x for t in batch.column(0) for _, x in _lines(t.as_py())}
            digests = list(found)
            if sent is not None and digests:
                digests = [d for d, keep in zip(digests, _among(sent.value, digests)) if keep]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([found[d] for d in digests], pa.string())], names=["digest", "text"])

    return run


def _linked(threshold: int):
    def run(batches):
        for batch in batches:
            keep = [within(a, b, threshold) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _profile(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("utf-32-le"), np.uint32) % _BINS, minlength=_BINS)


def _joining(threshold: int):
    """Links between components within each part; side 0 and side 1 are its two blocks, or side 0 its only one."""

    def run(batches):
        for _, (side, digest, comp, text) in _groups(batches, 4):
            side, ids = np.array(side), {c: i for i, c in enumerate(dict.fromkeys(comp))}
            comp = np.array([ids[c] for c in comp])
            size, profile = np.array([len(t) for t in text]), np.stack([_profile(t) for t in text])
            two, out = side.any(), []
            for i in np.flatnonzero(side == 0):
                rest = (side == 1) if two else (np.arange(len(text)) > i)
                rest = np.flatnonzero(rest & (comp != comp[i]) & (np.abs(size - size[i]) <= threshold))
                if len(rest):
                    rest = rest[np.abs(profile[rest] - profile[i]).sum(axis=1) <= 2 * threshold]
                for j in rest:
                    if comp[i] != comp[j] and within(text[i], text[j], threshold):
                        out.append((digest[i], digest[j]))
                        comp[comp == comp[j]] = comp[i]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], names=["a", "b"])

    return run


def near_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, text: str = "text") -> DataFrame:
    """(digest, component) of each line text that is linked with another."""
    if min_chars <= threshold:
        raise ValueError("min_chars must exceed the threshold")
    with passing(docs.sparkSession):
        return _near_lines(docs.select(F.col(f"`{text}`").alias("text")), threshold, min_chars)


def _near_lines(texts: DataFrame, threshold: int, min_chars: int) -> DataFrame:
    keyed = stored(texts.mapInArrow(lean(_keyed(threshold, min_chars)), "digest binary, keys array<long>"), "keyed")
    rows = keyed.select("digest", F.explode("keys").alias("key"))
    total = keyed.agg(F.sum(F.size("keys"))).first()[0] or 0
    shared = stored(rows.groupBy("key").agg(F.min("digest").alias("center"), F.max("digest").alias("other"), F.count("*").alias("m")).where("center <> other").select("key", "center", "m"), "shared")
    members = stored(spread(rows, shared, "key", "m", total).where("digest <> center").select("key", "digest", "center").distinct(), "members")

    def texts_of(digests: DataFrame) -> DataFrame:
        asked = stored(digests.distinct(), "asked")
        table = _filter(asked, asked.count())
        sent = None if table is None else texts.sparkSession.sparkContext.broadcast(table)
        return stored(texts.mapInArrow(lean(_texts(sent)), "digest binary, text string").join(asked, "digest", "left_semi").dropDuplicates(["digest"]), "texts")

    pairs = stored(members.select(F.col("center").alias("a"), F.col("digest").alias("b")).distinct(), "pairs")
    found = texts_of(pairs.select(F.col("a").alias("digest")).union(pairs.select("b")))
    both = pairs.join(found.select(F.col("digest").alias("b"), F.col("text").alias("tb")), "b").join(found.select(F.col("digest").alias("a"), F.col("text").alias("ta")), "a")
    links = stored(both.select("a", "b", "ta", "tb").mapInArrow(lean(_linked(threshold)), "a binary, b binary"), "links")
    comps = connected(links)

    placed = members.select("key", "digest").join(comps.withColumnRenamed("node", "digest"), "digest", "left").select("key", "digest", F.coalesce("component", "digest").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m")).where("x <> y").select("key", "m")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("digest", "key"), blocks).cast("int")
    parts = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, mine).alias("lo"), F.greatest(o, mine).alias("hi"), F.when(mine > o, 1).otherwise(0).alias("side")))
    dealt = spread(placed, stored(mixed, "mixed"), "key", "m", total).select("key", "digest", "comp", F.explode(parts).alias("p"))
    dealt = dealt.select("key", (F.col("p.lo") * 1_000_000 + F.col("p.hi")).alias("part"), F.col("p.side").alias("side"), "digest", "comp").join(found, "digest")
    dealt = dealt.select("key", "part", "side", "digest", "comp", "text").repartition("key", "part").sortWithinPartitions("key", "part")
    more = stored(dealt.mapInArrow(lean(_joining(threshold)), "a binary, b binary").distinct(), "links")
    if more.limit(1).count():
        comps = connected(links.union(more))
    return stored(comps.withColumnRenamed("node", "digest"), "near", keep=True)


def line_classes(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, line, digest, class, near) of each line that takes part, and (doc_id, line, class) of each class's first."""
    lines = _classed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")), threshold, min_chars)
    first = lines.groupBy("class").agg(F.min(F.struct("doc_id", "line")).alias("f")).select("f.doc_id", "f.line", "class")
    return lines, first


def _classed(docs: DataFrame, threshold: int, min_chars: int, keys: str = "doc_id long") -> DataFrame:
    """The keys of each line's row, its number, digest, class and near; ``docs`` are the keys and the text."""
    near = small(near_lines(docs, threshold, min_chars), 80)
    lines = stored(docs.mapInArrow(lean(_occurring), f"{keys}, line int, digest binary"), "lines", keep=True)
    return lines.join(near, "digest", "left").select(*(c for c in docs.columns if c != "text"), "line", "digest", F.coalesce("component", "digest").alias("class"), F.col("component").isNotNull().alias("near"))


def _numbered(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with __row: a number of each row whose doc_id is null, a hash of the text of any other."""
    key, row = F.col("doc_id").cast("long"), F.md5(F.col(f"`{text}`").cast("binary"))
    nulls = docs.where(key.isNull())
    if not nulls.limit(1).count():
        return docs.withColumn("__row", row)
    nulls = stored(nulls.withColumn("__row", F.monotonically_increasing_id().cast("string")), "nulls")
    return docs.where(key.isNotNull()).withColumn("__row", row).unionByName(nulls)


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, text: str = "text") -> DataFrame:
    """``docs`` whose texts hold each class's first line only; same columns.

    Lines are cut from the row that holds them.  Of rows with a null doc_id and lines of equal number, any may be first.
    """
    docs_ = _numbered(docs, text)
    key = F.col("doc_id").cast("long")
    lines = _classed(docs_.select(key.alias("doc_id"), F.col("__row").alias("row"), F.col(f"`{text}`").alias("text")), threshold, min_chars, "doc_id long, row string")
    lines = lines.withColumn("own", F.expr("if(doc_id is null, row, '')"))
    first = lines.groupBy("class").agg(F.min(F.struct("doc_id", "line", "digest", "own")).alias("f")).select("f.*", "class")
    same = F.col("l.doc_id").eqNullSafe(F.col("f.doc_id"))
    for c in ("line", "digest", "own", "class"):
        same &= F.col(f"l.{c}") == F.col(f"f.{c}")
    gone = lines.alias("l").join(first.alias("f"), same, "left_anti").groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__at")).agg(F.collect_set("line").alias("__gone"))
    joined = docs_.join(gone, key.eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__at")), "left")
    cut = F.array_join(F.filter(F.split(F.col(f"`{text}`"), "\n", -1), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    return joined.withColumn(text, F.when(F.col("__gone").isNull(), F.col(f"`{text}`")).otherwise(cut)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those in classes of several texts, those that are the first of their class, and the rest.

    near_classes: the classes of several texts that the document has lines of, each by its first line (doc_id:line).
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lines, first = line_classes(docs)
    counts = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("near").alias("n_near_lines"))
    firsts = first.groupBy("doc_id").agg(F.count("*").alias("n_kept_lines"))
    near = stored(lines.where("near").groupBy("doc_id", "class").agg(F.min("line").alias("line")), "near", keep=True)
    names = near.groupBy("class").agg(F.min(F.struct("doc_id", "line")).alias("f"), F.count("*").alias("m"))
    names = names.select("class", F.concat_ws(":", F.coalesce(F.col("f.doc_id").cast("string"), F.lit("")), F.col("f.line").cast("string")).alias("name"), "m")
    classes = spread(near, stored(names, "names", keep=True), "class", "m", near.count()).groupBy("doc_id").agg(F.sort_array(F.collect_set("name")).alias("near_classes"))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().alias("d")
    for name, part in (("c", counts), ("f", firsts), ("n", classes)):
        x = x.join(part.alias(name), F.expr(f"d.doc_id <=> {name}.doc_id"), "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return x.select(
        "d.doc_id",
        n(F.col("n_lines")).alias("n_lines"),
        n(F.col("n_near_lines")).alias("n_near_lines"),
        n(F.col("n_kept_lines")).alias("n_kept_lines"),
        (n(F.col("n_lines")) - n(F.col("n_kept_lines"))).alias("n_removed_lines"),
        F.coalesce("near_classes", F.array().cast("array<string>")).alias("near_classes"),
    )


QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLES: dict[str, str] = {}
