"""Mixing to target weights with soft memberships.

A classifier trained on a labelled table gives each document a posterior over domains.
With n_d the tokens of document d, p_dk its posteriors and N all tokens, document rates
r_d >= 0 minimise the weighted squared distance between the domains' expected shares
S_k = sum_d r_d n_d p_dk / N and their targets.  Projected gradient from r = 1 in the metric
of the documents' token shares:

    r_d <- max(least, r_d - sum_k p_dk u_k),   u = A^+ (S - target),   A = sum_d n_d p_d p_d^T / N

where A^+ makes the step length 1 safe.  As the bound holds more and more documents, longer steps
are better: a step that closes the gap lets the next one be longer, one that doesn't is taken back.
A rate depends on its document's posteriors and the short history of u alone, so that each round
is one aggregate over the posteriors (written once, a few numbers a document) and no rates are
ever stored, joined or sent to the driver.

``least`` (0 to 1) is a rate that every document has at least: with 1 a mixture is made by repeats alone.
Rounds end when each domain is within ``TOLERANCE`` of its own target; where that can't be
reached, or takes more than ``ROUNDS``, a warning names the shares reached.

The targets are shares of ``anchor``'s tokens over its own target, so that the anchor's
documents keep a rate near 1; without an anchor they are shares of all tokens.

A null or empty text has no tokens: it has posteriors and a rate, and weighs nothing.
Without labels, or with those of one domain only, that domain (or the first) has posterior 1.
Rates of documents without a share in a domain that needs more can't help it: its target is
then missed by as little as possible.  Rows are independent, so repeated rows get equal rates.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashed_text as ht
from .shared import lean, stored

DOMAINS = ("clean", "toxic", "poor")
TARGETS = {"clean": 0.90, "toxic": 0.02, "poor": 0.08}
ROUNDS = 60
#: Of a domain's own target.
TOLERANCE = 5e-3
L2 = 1e-4


def domains_of(labels: DataFrame) -> DataFrame:
    """doc_id and label (an index into DOMAINS) from quality and toxic ratings."""
    return labels.select("doc_id", F.when(F.col("toxic") > 0, 1).when(F.col("quality") == 0, 2).when((F.col("quality") > 0) & (F.col("toxic") == 0), 0).alias("label"))


class Classifier:
    """Multinomial logistic regression over hashed features."""

    def __init__(self, features: list[np.ndarray], labels: np.ndarray, classes: int):
        self.classes, self.constant = classes, None
        present = np.unique(labels)
        if len(present) < 2:
            self.constant = int(present[0]) if len(present) else 0
            return
        truth = (labels[:, None] == np.arange(classes)).astype(float)
        d = ht.Design(features, truth)
        f = len(d.keys)
        share = truth.mean(axis=0).clip(0.5 / len(labels))

        def gradient(x):
            w, b = x[: f * classes].reshape(f, classes), x[f * classes :]
            s = np.stack([d.times(w[:, k]) for k in range(classes)], axis=1) + b
            p = np.exp(s - s.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - truth) / len(labels)
            return np.concatenate([(np.stack([d.back(g[:, k]) for k in range(classes)], axis=1) + L2 * w).reshape(-1), g.sum(axis=0)])

        x = ht.minimise(gradient, np.concatenate([np.zeros(f * classes), np.log(share)]))
        self.keys, self.weights, self.bias = d.keys, x[: f * classes].reshape(f, classes), x[f * classes :]

    def posteriors(self, features: np.ndarray, begins: np.ndarray) -> np.ndarray:
        n = len(begins) - 1
        if self.constant is not None:
            return np.tile((np.arange(self.classes) == self.constant).astype(float), (n, 1))
        s = ht.row_sums(self.keys, self.weights, features, begins) + self.bias
        p = np.exp(s - s.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def train(docs: DataFrame, labels: DataFrame, classes: int, rows: int = ht.SAMPLE, text: str = "text") -> Classifier:
    """A classifier of labels (doc_id, label); ``rows`` bounds the sample."""
    features, y = ht.sample(docs, labels, rows, text)
    return Classifier(features, y, classes)


_KIND = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("posteriors", T.ArrayType(T.DoubleType()))])


def _member(model, text: str, into: str):
    def run(batches):
        m = model.value
        for batch in batches:
            p, n = [np.zeros((0, m.classes))], [np.zeros(0, np.int64)]
            for f, at, counts in ht.over_rows(batch.column(batch.schema.get_field_index(text))):
                p.append(m.posteriors(f, at))
                n.append(counts)
            p = np.concatenate(p)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * m.classes, pa.int32()), pa.array(p.reshape(-1)))
            result = pa.StructArray.from_arrays([pa.array(np.concatenate(n).astype(np.int64)), lists], names=["n_tokens", "posteriors"])
            kept = [(x, c) for x, c in zip(batch.schema.names, batch.columns) if x != into]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), result], names=[*(x for x, _ in kept), into])

    return run


def memberships(docs: DataFrame, model: Classifier, text: str = "text", into: str = "membership") -> DataFrame:
    """``docs`` with a struct: n_tokens (words) and posteriors."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != into), T.StructField(into, _KIND)])
    return docs.mapInArrow(lean(_member(sent, text, into)), schema)


def rate(posteriors: Column, history: Sequence[Sequence[float]], least: float = 0.0) -> Column:
    """The rate that a history of steps gives to a document."""
    r = F.lit(1.0)
    if not history:
        return r
    steps = F.array(*(F.array(*(F.lit(float(x)) for x in u)) for u in history))
    dot = lambda u: F.aggregate(F.zip_with(posteriors, u, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(steps, r, lambda a, u: F.greatest(F.lit(float(least)), a - dot(u)))


def fit_rates(members: DataFrame, targets: Sequence[float], anchor: int | None = None, rounds: int = ROUNDS, least: float = 0.0) -> tuple[list[list[float]], np.ndarray, np.ndarray]:
    """(history of steps, reached shares, aimed shares) over rows n_tokens, posteriors."""
    if not 0 <= least <= 1:
        raise ValueError("least: 0 to 1")
    k = len(targets)
    p = lambda i: F.col("posteriors")[i]
    n = F.col("n_tokens").cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def shares(history) -> np.ndarray:
        x = members.select("n_tokens", "posteriors", rate(F.col("posteriors"), history, least).alias("r"))
        got = x.agg(*(F.sum(n * F.col("r") * p(i)).alias(f"s{i}") for i in range(k))).first()
        return np.array([got[f"s{i}"] for i in range(k)]) / total

    first = members.agg(F.sum(n).alias("n"), *(F.sum(n * p(i) * p(j)).alias(f"a{i}_{j}") for i, j in pairs)).first()
    total = first.n or 0.0
    if not total:
        return [], np.zeros(k), np.zeros(k)
    gram = np.array([[first[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / total
    metric = np.linalg.pinv(gram, rcond=1e-6, hermitian=True)
    share = shares([])
    goal = np.array(targets, float) / sum(targets)
    if anchor is not None and goal[anchor] > 0:
        goal = goal * (share[anchor] / goal[anchor])
    near = TOLERANCE * np.where(goal > 0, goal, goal[goal > 0].min())
    history: list[list[float]] = []
    length = 1.0
    for _ in range(rounds):
        gap = share - goal
        if (np.abs(gap) <= near).all():
            break
        step = metric @ gap
        new = shares([*history, (length * step).tolist()])
        if length > 1 and (new - goal) @ metric @ (new - goal) > gap @ step:
            length = max(1.0, length / 4)
            continue
        history.append((length * step).tolist())
        still = np.abs(new - share).max() <= 1e-3 * near.min()
        share, length = new, length * 1.6
        if still:
            break
    if (np.abs(share - goal) > near).any():
        warnings.warn(f"shares reached: {share.round(6).tolist()}, aimed at: {goal.round(6).tolist()}", stacklevel=2)
    return history, share, goal


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], anchor: str | None = "clean", rounding: str = "random", text: str = "text", rows: int = ht.SAMPLE) -> DataFrame:
    """``mix_domains`` for the domains of a table of quality and toxic ratings."""
    return mix_domains(docs, domains_of(labels), DOMAINS, targets, anchor, rounding, text, rows)


def mix_domains(docs: DataFrame, labels: DataFrame, domains: Sequence[str], targets: Mapping[str, float], anchor: str | None = None, rounding: str = "random", text: str = "text", rows: int = ht.SAMPLE, least: float = 0.0) -> DataFrame:
    """``docs``, each row as many times as its rate says; same columns.

    ``labels``: doc_id and label, an index into ``domains``.  ``rounding``: "random" rounds up with the
    probability of the fraction (by a hash of doc_id and text, the same on every run), "nearest" rounds to the nearest integer.
    """
    own = "__membership"
    goal = [float(targets.get(d, 0.0)) for d in domains]
    with_posteriors = memberships(docs, train(docs, labels, len(domains), rows, text), text, own)
    members = stored(with_posteriors.select(f"{own}.n_tokens", f"{own}.posteriors"), "members")
    history, _, _ = fit_rates(members, goal, list(domains).index(anchor) if anchor else None, least=least)
    r = rate(F.col(f"{own}.posteriors"), history, least)
    names = [F.col(f"`{c}`") for c in docs.columns]
    if rounding == "nearest":
        copies = F.floor(r + 0.5)
    else:
        copies = F.floor(r) + (F.pmod(F.xxhash64(F.lit("mixing"), "doc_id", f"`{text}`"), F.lit(1 << 30)) < (r - F.floor(r)) * (1 << 30)).cast("long")
    out = with_posteriors.select(*names, copies.cast("int").alias("__copies")).where("__copies > 0")
    return out.select(*names, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).select(*names)


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet")), len(DOMAINS))
    m = memberships(docs, model)
    members = stored(m.select("doc_id", "membership.n_tokens", "membership.posteriors"), "members")
    history, _, _ = fit_rates(members, [TARGETS[d] for d in DOMAINS], DOMAINS.index("clean"))
    r = members.withColumn("rate", rate(F.col("posteriors"), history))
    return r.select("doc_id", "n_tokens", *(F.col("posteriors")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)), "rate", (F.col("rate") * F.col("n_tokens")).alias("expected_tokens"))


QUERIES = {"op6_soft_mixing": op6_soft_mixing}
ORACLES: dict[str, str] = {}
