"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades come from the labels table: 0 poor (quality 0), 1 sound but toxic, 2 sound and
not toxic.  With one weight for each hashed feature (see ``hashed_text``) and ordered
thresholds, P(grade >= k) = 1 / (1 + exp(threshold_k - weights . features)).  The model is
fitted on a bounded sample of labelled rows; every document then gets its expected
grade and tail probabilities, and is kept if P(grade >= ``least``) reaches ``at``.

A null or empty text is scored by its shape features alone.  Labels with a null
rating or id are left out; where all labels are of one grade, or there are none,
all documents are kept with that grade (or the best) for certain.  Repeated rows are
scored alike; an input column of the result's name is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashed_text as ht
from .shared import lean

GRADES = 3
LEAST, AT = 2, 0.5
L2 = 1e-4

RESULT = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.ArrayType(T.DoubleType())), T.StructField("kept", T.BooleanType())])


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and label: the grade of each rating."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when((F.col("quality") > 0) & F.col("toxic").isNotNull(), F.when(F.col("toxic") > 0, 1).otherwise(2)).alias("label"))


class Ordinal:
    """Weights and thresholds; ``constant`` where only one grade is known."""

    def __init__(self, features: list[np.ndarray], grades: np.ndarray, levels: int = GRADES):
        self.levels, self.constant = levels, None
        present = np.unique(grades)
        if len(present) < 2:
            self.constant = int(present[0]) if len(present) else levels - 1
            return
        d = ht.Design(features, grades[:, None] >= np.arange(1, levels))
        n, low = len(grades), np.array([np.mean(grades >= k).clip(0.5 / len(grades), 1 - 0.5 / len(grades)) for k in range(1, levels)])
        start = np.log(1 / low - 1)
        gaps = np.log(np.maximum(np.diff(start), 0.1))

        def gradient(x):
            w, theta = x[: len(d.keys)], self._thresholds(x[len(d.keys) :])
            s = d.times(w)
            tails = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(theta - s[:, None], -500, 500))), np.zeros((n, 1))], axis=1)
            slopes = tails * (1 - tails)
            rows = np.arange(n)
            p = np.maximum(tails[rows, grades] - tails[rows, grades + 1], 1e-12)
            by_score = -(slopes[rows, grades] - slopes[rows, grades + 1]) / p / n
            by_theta = np.zeros((n, levels + 1))
            by_theta[rows, grades] += slopes[rows, grades] / p / n
            by_theta[rows, grades + 1] -= slopes[rows, grades + 1] / p / n
            g = by_theta.sum(axis=0)[1:levels]
            tail_sums = np.cumsum(g[::-1])[::-1]
            raw = x[len(d.keys) :]
            return np.concatenate([d.back(by_score) + L2 * w, [tail_sums[0]], tail_sums[1:] * np.exp(raw[1:])])

        x = ht.minimise(gradient, np.concatenate([np.zeros(len(d.keys)), start[:1], gaps]))
        self.keys, self.weights, self.theta = d.keys, x[: len(d.keys), None], self._thresholds(x[len(d.keys) :])

    @staticmethod
    def _thresholds(raw: np.ndarray) -> np.ndarray:
        return raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])

    def tails(self, features: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """P(grade >= k) of each row, k from 1."""
        if self.constant is not None:
            return np.tile((self.constant >= np.arange(1, self.levels)).astype(float), (len(begins) - 1, 1))
        s = ht.row_sums(self.keys, self.weights, features, begins)
        return 1 / (1 + np.exp(np.clip(self.theta - s, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ht.SAMPLE, text: str = "text") -> Ordinal:
    """A model of labels (doc_id, label); ``rows`` bounds the sample."""
    return Ordinal(*ht.sample(docs, labels, rows, text))


def _scorer(model, text: str, into: str, least: int, at: float):
    def run(batches):
        m = model.value
        for batch in batches:
            tails = [m.tails(f, b) for f, b, _ in ht.over_rows(batch.column(batch.schema.get_field_index(text)))]
            tails = np.concatenate(tails) if tails else np.zeros((0, m.levels - 1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(tails) + 1) * tails.shape[1], pa.int32()), pa.array(tails.reshape(-1)))
            result = pa.StructArray.from_arrays([pa.array(tails.sum(axis=1)), lists, pa.array(tails[:, least - 1] >= at)], names=["expected_grade", "tail", "kept"])
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != into]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), result], names=[*(n for n, _ in kept), into])

    return run


def score_quality(docs: DataFrame, model: Ordinal, text: str = "text", into: str = "quality", least: int = LEAST, at: float = AT) -> DataFrame:
    """``docs`` with a struct: expected_grade, tail (P(grade >= 1), P(grade >= 2), ...) and kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != into), T.StructField(into, RESULT)])
    return docs.mapInArrow(lean(_scorer(sent, text, into, least, at)), schema)


def select_quality(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = ht.SAMPLE) -> DataFrame:
    """``docs`` without the rejected ones; same columns.  ``labels``: the table of quality and toxic ratings."""
    own = "__quality"
    scored = score_quality(docs, fit(docs, graded(labels), rows, text), text, own)
    return scored.where(f"{own}.kept").select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    q = score_quality(docs, model)
    return q.select("doc_id", F.col("quality.expected_grade").alias("expected_grade"), F.col("quality.tail")[0].alias("p_sound"), F.col("quality.tail")[1].alias("p_clean"), F.col("quality.kept").alias("kept"))


QUERIES = {"op9_ordinal_quality": op9_ordinal_quality}
ORACLES: dict[str, str] = {}
