"""Statistics of numeric arrays: within the row, or as histograms of a group's arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _known(values: Column) -> Column:
    return F.filter(F.transform(values, lambda e: e.cast("double")), lambda e: e.isNotNull())


def mean(values: Column) -> Column:
    """Mean of the elements that aren't null; null without any."""
    known = _known(values)
    return F.aggregate(known, F.lit(0.0), lambda a, e: a + e) / F.nullif(F.size(known), F.lit(0))


def deviation(values: Column) -> Column:
    """Standard deviation of the population of elements that aren't null; null without any."""
    known = _known(values)
    folded = F.aggregate(known, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")), _welford)
    return F.sqrt(folded["m2"] / F.nullif(folded["n"], F.lit(0.0)))


def _welford(a: Column, e: Column) -> Column:
    step = e - a["mean"]
    center = a["mean"] + step / (a["n"] + 1)
    return F.struct((a["n"] + 1).alias("n"), center.alias("mean"), (a["m2"] + step * (e - center)).alias("m2"))


def first_largest(values: Column) -> Column:
    """Place, from 1, of the first largest element; null without any."""
    return F.array_position(values, F.array_max(values)).cast("int")


def share_above(values: Column, threshold: float) -> Column:
    """Per cent of the elements that aren't null above a threshold; null without any."""
    known = _known(values)
    return F.size(F.filter(known, lambda e: e > threshold)) * 100 / F.nullif(F.size(known), F.lit(0))


def histogram(df: DataFrame, key: str, values: str, low: float, high: float, bins: int) -> DataFrame:
    """(key, bin, n) of each key for all bins from ``low`` to ``high``; what lies beyond counts in the outer ones, nulls nowhere.

    Counts are columns of one partial aggregation, so that empty bins need no join.
    """
    x = df.select(key, F.explode(values).alias("__e"))
    at = F.least(F.greatest(F.floor((F.col("__e").cast("double") - low) * (bins / (high - low))), F.lit(0)), F.lit(bins - 1))
    at = F.when(F.col("__e").isNotNull(), at)
    counts = x.groupBy(key).agg(*(F.count_if(at == i).alias(f"__{i}") for i in range(bins)))
    return counts.select(key, F.posexplode(F.array(*(f"__{i}" for i in range(bins)))).alias("bin", "n"))
