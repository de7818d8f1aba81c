"""Top candidates of each observation and their confidence."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import dealt

#: Distinct signatures up to which results are broadcast: one takes about two kilobytes.
SIGNATURES = 30_000


def top_k(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark keeps k rows a task and group before it shuffles."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def softmax_percent(scores: Column, temperature: float) -> Column:
    """Shares of an array of scores, the first of them the highest, under a softmax: percentages of one decimal."""
    e = F.transform(scores, lambda x: F.exp((x - F.element_at(scores, 1)) / temperature))
    return F.transform(e, lambda x: F.round(x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y) * 100, 1))


def unrolled(rows: DataFrame, key: str, best: str, temperature: float, fields: Mapping[str, Column], k: int = 5) -> DataFrame:
    """A row for each of the first k entries of the array ``best``, with rank, the ``fields`` (of the struct ``b``), score and confidence over these k alone."""
    top = rows.select(key, F.slice(best, 1, k).alias("__top"))
    top = top.withColumn("__share", softmax_percent(F.transform("__top", lambda x: F.lit(0.0) - x["worse"]), temperature))
    each = top.select(key, F.posexplode(F.arrays_zip("__top", "__share")).alias("__at", "__b"))
    each = each.select(key, (F.col("__at") + 1).alias("rank"), F.col("__b.__top").alias("b"), F.col("__b.__share").alias("confidence"))
    return each.select(key, "rank", F.col("b.code").alias("code"), (F.lit(0.0) - F.col("b.worse")).alias("score"), "confidence", *(c.alias(n) for n, c in fields.items()))


def once_each(rows: DataFrame, key: str, score: Callable[[DataFrame, str], DataFrame], limit: int = SIGNATURES) -> DataFrame:
    """``score(rows, key)`` of rows (key, s), whose result (key, rank, ...) follows from ``s`` alone, worked out once for each distinct ``s``.

    The rows are read three times: to count signatures, to list them, and to look each row's result up.  Where there
    are more than ``limit`` of them, by estimate, each row is scored by itself, as it is in a stream.
    """
    if rows.isStreaming or rows.agg(F.approx_count_distinct(F.xxhash64("s"))).first()[0] > limit:
        return score(dealt(rows), key)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # Signatures are few bytes and long work: without a number of partitions, Spark would merge them into one.
    found = score(rows.select("s").distinct().repartition(4 * cores), "s")
    found = found.groupBy("s").agg(F.array_sort(F.collect_list(F.struct(*(c for c in found.columns if c != "s")))).alias("__best"))
    return dealt(rows).join(F.broadcast(found), "s").select(key, F.inline("__best"))


def first_of_each(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return top_k(rows, key, [F.asc(o) for o in order], 1, "__n").drop("__n")


def sampled(rows: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str], k: int = 5, into: str = "samples") -> DataFrame:
    """Up to k rows of each key as a list of structs, in order."""
    first = top_k(rows, key, [F.asc(o) for o in order], k, "__n")
    packed = F.sort_array(F.collect_list(F.struct("__n", *values)))
    return first.groupBy(*key).agg(F.transform(packed, lambda x: F.struct(*(x[v].alias(v) for v in values))).alias(into))
