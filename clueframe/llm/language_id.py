"""Language identification by fusing evidence about a page.

The posterior of language l for a page is, up to a constant, the product of

* its text's likelihood: byte trigrams of the lower-cased text under per-language
  tables with additive smoothing, counted on a bounded sample of labelled texts, with a weight
  (``TEMPER``) that allows for the dependence of neighbouring trigrams;
* P(declared markup language | l) and P(address suffix | l), from tables of soft counts:
  the sums of text-only posteriors over the pages with that value, smoothed;
* the host's prior: soft counts of the host's other pages, backed off to its
  registered domain (last two labels) and then to the whole corpus, each with ``KAPPA``
  pseudo-counts.  A page's own posterior is taken out of its host's counts.

All counts are grouped aggregates with partial sums, so a host or suffix that holds a
third of all pages is a few rows by the time it is shuffled; the sums are then sent to all
tasks if they are few (a checked number), so that such a host's pages stay where they are.

A page without text has a flat likelihood; a missing declaration, address or host gives
no evidence of its kind.  Without labelled texts there are no languages, and the result is
``und`` with probability 1.  Rows are independent given the counts; repeated rows count twice
and get equal results.  Of languages of equal probability the first in the alphabet is given.  A kept
column of a result's name is left out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scan
from .shared import small, stored

SAMPLE = 4000
TEMPER = 0.15
KAPPA = 5.0
SMOOTH = 0.5
_BITS = 16
_SLICES = 16


class Trigrams:
    """log P of byte trigrams, hashed to 2^16 columns, by language."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        table = np.stack([counts[x] for x in self.languages], axis=1) + SMOOTH if counts else np.ones((1 << _BITS, 1))
        table = np.log(table / table.sum(axis=0))
        self.table = (table - table.mean(axis=1, keepdims=True)).astype(np.float32)

    def scores(self, column) -> np.ndarray:
        data, offsets = scan.text_buffer(column)
        out = [np.zeros((0, self.table.shape[1]))]
        for a, b in scan.pieces(offsets):
            at = offsets[a : b + 1] - offsets[a]
            g = grams(data[offsets[a] : offsets[b]])
            total = np.zeros((len(g) + 1, self.table.shape[1]))
            np.cumsum(self.table[g], axis=0, dtype=np.float64, out=total[1:])
            ends = np.minimum(np.maximum(at[1:] - 2, at[:-1]), len(g))
            out.append(total[ends] - total[np.minimum(at[:-1], len(g))])
        return np.concatenate(out)


def grams(data: np.ndarray) -> np.ndarray:
    """The column of each byte trigram; those across two rows are for the caller to leave out."""
    d = scan.LOWER[data].astype(np.uint32)
    if len(d) < 3:
        return np.zeros(0, np.int64)
    x = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
    return ((x * np.uint32(2654435761)) >> np.uint32(32 - _BITS)).astype(np.int64)


def _counts(batches):
    """(lang, slice, counts) of the task's texts: a row for each slice of a language's table."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offsets = scan.text_buffer(batch.column(1))
        for i, x in enumerate(batch.column(0).to_pylist()):
            held[x] = held.get(x, 0) + np.bincount(grams(data[offsets[i] : offsets[i + 1]]), minlength=1 << _BITS)
    for x, counts in held.items():
        parts = counts.astype(np.int64).reshape(_SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.array([x] * _SLICES, pa.string()), pa.array(range(_SLICES), pa.int32()), pa.array([v.tobytes() for v in parts], pa.binary())], names=["lang", "slice", "counts"])


def _summed(batches):
    """One row for each language and slice that the task is given."""
    held: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for x, i, v in zip(*(c.to_pylist() for c in batch.columns)):
            held[x, i] = held.get((x, i), 0) + np.frombuffer(v, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.string()), pa.array([i for _, i in held], pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["lang", "slice", "counts"])


def train(labelled: DataFrame, rows: int = SAMPLE, text: str = "text", lang: str = "lang") -> Trigrams:
    """Tables from at most ``rows`` different labelled texts, those of least hash: the same on every run.

    The hashes alone are ordered; texts are then taken up to the last one.  The driver gets one table of
    counts for each language, summed by the executors, however many tasks counted.
    """
    x = labelled.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null and text is not null")
    h = F.xxhash64("text", "lang")
    last = x.select(h.alias("h")).distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    x = x.where(h <= last).dropDuplicates() if last is not None else x
    counts: dict[str, np.ndarray] = {}
    kind = "lang string, slice int, counts binary"
    for r in x.mapInArrow(_counts, kind).repartition("lang", "slice").mapInArrow(_summed, kind).collect():
        counts.setdefault(r.lang, np.zeros((_SLICES, (1 << _BITS) // _SLICES), np.int64))[r.slice] = np.frombuffer(bytes(r.counts), np.int64)
    counts = {x: v.reshape(-1) for x, v in counts.items()}
    return Trigrams(counts)


def page_evidence(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` with a struct ``evidence``: text, declared, host, domain and suffix, all nullable."""
    h = F.col(f"`{html}`")
    # Comments, scripts and tags that aren't closed run to the end, so that each alternative passes over a page once.
    body = F.regexp_replace(h, r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*+(?:\z|>.*?(?:</\1\s*>|\z))|<[a-z/!?][^>]*+(?:>|\z)", " ")
    tag = F.regexp_extract(h, r"(?i)<html\b([^>]*)", 1)
    declared = F.nullif(F.lower(F.regexp_extract(tag, r"""(?i)(?<![\w-])lang\s*=\s*["']?([A-Za-z]{2,3})""", 1)), F.lit(""))
    host = F.nullif(F.lower(F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    return pages.withColumn("evidence", F.struct(body.alias("text"), declared.alias("declared"), host.alias("host"), F.substring_index(host, ".", -2).alias("domain"), F.substring_index(host, ".", -1).alias("suffix")))


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def identify(rows: DataFrame, model: Trigrams, keep: tuple[str, ...]) -> DataFrame:
    """The ``keep`` columns of rows with an ``evidence`` struct, lang, probability, text_lang and posterior."""
    langs = model.languages
    keep = tuple(c for c in keep if c not in ("lang", "probability", "text_lang", "posterior"))
    if not langs:
        return rows.select(*keep, F.lit("und").alias("lang"), F.lit(1.0).alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.array(F.lit(1.0)).alias("posterior"))
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = TEMPER * sent.value.scores(batch.column(batch.num_columns - 1))
            s = np.exp(s - s.max(axis=1, keepdims=True)) if len(s) else s
            s = np.maximum(s, 1e-12)
            s /= s.sum(axis=1, keepdims=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * len(langs), pa.int32()), pa.array(s.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "p"])

    x = rows.select(*keep, *(F.col(f"evidence.{c}").alias(f"__{c}") for c in ("declared", "host", "domain", "suffix", "text")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields[:-1])
    x = stored(x.mapInArrow(run, f"{kinds}, p array<double>"), "evidence")

    k = len(langs)
    sums = lambda: [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(k)]
    vector = lambda name: F.array(*(F.col(f"s{i}") for i in range(k))).alias(name)
    whole = x.agg(*sums()).first()
    if whole.s0 is None:
        whole = [0.0] * k
    mass = float(sum(whole)) or 1.0
    base = F.array(*(F.lit((float(s) + SMOOTH) / (mass + k * SMOOTH)) for s in whole))
    totals = F.array(*(F.lit(float(s)) for s in whole))

    def given(column: str) -> DataFrame:
        """log P(value | l) of each value of a column, smoothed over the values met."""
        x2 = x.where(F.col(column).isNotNull()).groupBy(column).agg(*sums())
        n = F.lit(float(x2.count() + 1))
        return x2.select(column, F.transform(F.zip_with(vector("v"), totals, lambda a, t: (a + SMOOTH) / (t + SMOOTH * n)), lambda q: F.log(q)).alias(f"log{column}"))

    hosts = x.where("__host is not null").groupBy("__host", "__domain").agg(*sums()).select("__host", "__domain", vector("at_host"))
    domains = hosts.groupBy("__domain").agg(*(F.sum(F.col("at_host")[i]).alias(f"s{i}") for i in range(k))).select("__domain", vector("at_domain"))
    # A page's own share is in the sums of its host and domain: it is taken out of both.
    prior = small(stored(hosts.join(domains, "__domain").select("__host", "at_host", "at_domain"), "hosts"), 64 + 32 * k)
    full = x.join(prior, "__host", "left").join(small(given("__declared"), 64 + 16 * k), "__declared", "left").join(small(given("__suffix"), 64 + 16 * k), "__suffix", "left")
    zero = F.array(*[F.lit(0.0)] * k)
    less = lambda name: F.transform(F.zip_with(F.coalesce(name, zero), F.when(F.col(name).isNotNull(), F.col("p")).otherwise(zero), lambda a, b: a - b), lambda v: F.greatest(v, F.lit(0.0)))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, y: a + y)
    smoothed = lambda v, prior: F.zip_with(v, prior, lambda a, q: (a + KAPPA * q) / (total(v) + KAPPA))
    full = full.withColumns({"__h": less("at_host"), "__d": less("at_domain")})
    full = full.withColumn("__prior", smoothed(F.col("__h"), smoothed(F.col("__d"), base)))
    plus = lambda a, b: F.zip_with(a, b, lambda u, v: u + v)
    logs = [F.transform("p", lambda q: F.log(q)), F.transform("__prior", lambda q: F.log(q)), F.coalesce("log__declared", zero), F.coalesce("log__suffix", zero)]
    full = full.withColumn("__scores", reduce(plus, logs)).withColumn("posterior", _softmax(F.col("__scores")))
    names = F.array(*(F.lit(x) for x in langs))
    best = lambda v: F.element_at(names, F.array_position(v, F.array_max(v)).cast("int"))
    return full.select(*keep, best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("probability"), best(F.col("p")).alias("text_lang"), "posterior")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by all evidence, and documents with their source as host; one of page_id and doc_id is null."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    model = train(docs)
    pages = page_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", F.lit(None).cast("long").alias("doc_id"), "evidence")
    none = F.lit(None).cast("string")
    texts = docs.select(F.lit(None).cast("long").alias("page_id"), "doc_id", F.struct(F.col("text"), none.alias("declared"), F.col("source").alias("host"), F.col("source").alias("domain"), none.alias("suffix")).alias("evidence"))
    return identify(pages.unionByName(texts), model, ("page_id", "doc_id"))


QUERIES = {"op8_language_id": op8_language_id}
ORACLES: dict[str, str] = {}
