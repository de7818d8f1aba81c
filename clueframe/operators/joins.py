"""Join helpers: a side is broadcast only once its size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has no more rows than that; else Spark chooses the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_default(left: DataFrame, right: DataFrame, on: str, column: str, default) -> DataFrame:
    """Left join of one column, with a value for rows that have no match."""
    return left.join(right.select(on, column), on, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def shared_first(pairs: DataFrame, members: DataFrame, a: str, b: str, group: str, order: str, into: str) -> DataFrame:
    """``pairs`` with the first group (by order) that has both codes as members; null where there is none."""
    x = members.select(F.col("code").alias(a), F.col(group).alias("__g"), F.col(order).alias("__o"))
    y = members.select(F.col("code").alias(b), F.col(group).alias("__g"))
    both = pairs.select(a, b).distinct().join(x, a).join(y, [b, "__g"])
    found = both.groupBy(a, b).agg(F.min_by("__g", "__o").alias(into))
    return pairs.join(found, [a, b], "left")


def nearest(points: DataFrame, places: DataFrame, key: str, name: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """``points`` with the name of the nearest place by squared degrees, ties by name.

    Places are a small table (centres); they are carried as one array and searched in the row, without a join.
    """
    table = places.select(F.collect_list(F.struct(F.col(lat).alias("y"), F.col(lng).alias("x"), F.col(name).alias("n"))).alias("__places"))
    d = lambda p: (F.col(lat) - p["y"]) * (F.col(lat) - p["y"]) + (F.col(lng) - p["x"]) * (F.col(lng) - p["x"])
    best = F.array_min(F.transform("__places", lambda p: F.struct(d(p).alias("d"), p["n"].alias("n"))))
    return points.crossJoin(F.broadcast(table)).withColumn("nearest", best["n"]).withColumn("nearest_d", best["d"]).drop("__places")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows``, dealt to all cores if they come in fewer partitions: for rows that are small next to what is computed from them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.isStreaming or rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, dealt to all cores whatever their size: after a shuffle of few bytes Spark would leave long work to one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
