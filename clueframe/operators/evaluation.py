"""Evaluation of predictions: accuracy, distance, and how near a wrong country is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, kilometres
from ..plans import values as v
from .joins import shared_first, small

NEAR_KM = 300


def cluster_members(spark) -> DataFrame:
    """(cluster, ord, code) in order of declaration."""
    return spark.createDataFrame([(n, i, c) for i, (n, codes) in enumerate(v.CLUSTERS.items()) for c in codes.split()], "cluster string, ord int, code string")


def verdicts(rounds: DataFrame, edges: DataFrame, members: DataFrame | None = None, true: str = "true_code", predicted: str = "predicted_code") -> DataFrame:
    """``rounds`` with correct and verdict: EXACT, NEIGHBOR, REGIONAL CLUSTER (the first one in order), DIFFERENT REGION.

    ``edges`` are directed (src, dst): a prediction is a neighbour if an edge leads to it from the truth.
    An empty or null code is of a different region.
    """
    members = cluster_members(rounds.sparkSession) if members is None else members
    code = lambda c: F.nullif(F.upper(F.trim(F.col(c))), F.lit(""))
    x = rounds.withColumns({"__t": code(true), "__p": code(predicted)})
    near = small(edges.select(F.col("src").alias("__t"), F.col("dst").alias("__p")).distinct().withColumn("__near", F.lit(True)))
    x = x.join(near, ["__t", "__p"], "left")
    x = shared_first(x, members, "__t", "__p", "cluster", "ord", "__cluster")
    same, bordering, clustered = F.col("__t") == F.col("__p"), F.col("__near"), F.col("__cluster").isNotNull()
    verdict = (
        F.when(same, F.lit("EXACT"))
        .when(bordering, F.concat(F.lit("NEIGHBOR (borders "), "__t", F.lit(")")))
        .when(clustered, F.concat(F.lit("REGIONAL CLUSTER ("), "__cluster", F.lit(")")))
        .otherwise("DIFFERENT REGION")
    )
    return x.withColumns({"correct": F.coalesce(same | bordering | clustered, same, F.lit(False)), "verdict": verdict}).drop("__t", "__p", "__near", "__cluster")


def calibration(rounds: DataFrame, edges: DataFrame) -> DataFrame:
    """Rounds with truth and prediction (true_code, lat, lng, predicted_code): exact, neighbour, and distance to the prediction's centre."""
    spark = rounds.sparkSession
    centers = spark.createDataFrame([(c, *x) for c, x in v.CENTERS.items()], "predicted_code string, __lat double, __lng double")
    x = rounds.join(F.broadcast(centers), "predicted_code", "left")
    near = small(edges.select(F.col("src").alias("true_code"), F.col("dst").alias("predicted_code")).distinct().withColumn("__near", F.lit(True)))
    x = x.join(near, ["true_code", "predicted_code"], "left")
    km = haversine_km(F.col("lat"), F.col("lng"), F.coalesce("__lat", F.lit(0.0)), F.coalesce("__lng", F.lit(0.0)))
    exact = F.coalesce(F.col("true_code") == F.col("predicted_code"), F.lit(False))
    return x.withColumns({"exact": exact, "neighbor": ~exact & F.coalesce("__near", F.lit(False)), "distance_km": km}).drop("__lat", "__lng", "__near")


def top_hits(predictions: DataFrame, truth: DataFrame, key: str = "obs_id", code: str = "code", true: str = "true_code") -> DataFrame:
    """Per observation: whether the first, and whether one of the first three candidates is right."""
    x = predictions.join(truth.select(key, true), key)
    hit = F.col(code) == F.col(true)
    return x.groupBy(key).agg(F.coalesce(F.bool_or(hit & (F.col("rank") == 1)), F.lit(False)).alias("is_top1"), F.coalesce(F.bool_or(hit & (F.col("rank") <= 3)), F.lit(False)).alias("is_top3"))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """A percentage; 0 of nothing is 0."""
    return F.round(F.coalesce(F.try_divide(part.cast("double") * 100, whole), F.lit(0.0)), digits)


def mean(value: str, digits: int = 1) -> Column:
    """A rounded average that the order of the rows doesn't change: decimals are summed as such, so that half-way means go up, and what they leave of a value by itself."""
    x = F.col(value)
    part = x.try_cast("decimal(28,9)")
    exact = (F.sum(part).cast("double") + F.sum(x - part.cast("double"))) / F.count(x)
    return F.round(F.when(F.count(part) == F.count(x), exact).otherwise(F.avg(x)), digits)


def accuracy(results: DataFrame) -> DataFrame:
    """One row: rounds, hits, accuracies of first and first three, and mean time, over results (is_top1, is_top3, elapsed_ms)."""
    n, one, three = F.count("*"), F.count_if("is_top1"), F.count_if("is_top3")
    return results.agg(n.alias("rounds"), one.alias("top1"), three.alias("top3"), percent(one, n).alias("top1_pct"), percent(three, n).alias("top3_pct"), F.coalesce(mean("elapsed_ms"), F.lit(0.0)).alias("mean_ms"))


def running(results: DataFrame, order: str, by: list[str] | None = None, hit: str = "hit", points: str | None = None) -> DataFrame:
    """Accuracy and total of points after each round.

    Without ``by`` the rounds are of one match: a single sequence, which one task has to see in order.
    """
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = results.withColumn("running_pct", F.round(F.avg(F.col(hit).cast("int")).over(w) * 100, 1))
    return out.withColumn("running_total", F.sum(points).over(w)) if points else out


def scoreboard(rounds: DataFrame, by: list[str]) -> DataFrame:
    """Of each match: rounds, total score, mean distance, matches and match rate, from (score_points, distance_km, is_match)."""
    n, m = F.count("*"), F.count_if("is_match")
    return rounds.groupBy(*by).agg(n.alias("rounds"), F.sum("score_points").alias("total_score"), mean("distance_km").alias("mean_km"), m.alias("matches"), percent(m, n, 0).alias("match_pct"))


def live_round(rounds: DataFrame, metres: str = "distance_m") -> DataFrame:
    """Distance in kilometres, and whether it is near."""
    x = rounds.withColumn("distance_km", kilometres(F.col(metres)))
    return x.withColumn("near", F.col("distance_km") < NEAR_KM)


def merged_hemisphere(front_angle: Column, back_angle: Column, front: Column, back: Column) -> Column:
    """Where the sun is, from the brightness of a front and a rotated view and their sun angles."""
    return (
        F.when((front_angle == "high") | (back_angle == "high"), "overhead")
        .when((front > 225) & (front > back + 12), "north")
        .when((back > 225) & (back > front + 12), "south")
        .otherwise("neutral")
    )


def playable(rounds: DataFrame, pano: str = "panoId", code: str = "countryCode") -> DataFrame:
    """Rounds that have a panorama and a true country."""
    return rounds.where(F.col(pano).isNotNull() & (F.col(pano) != "") & F.col(code).isNotNull() & (F.col(code) != ""))
