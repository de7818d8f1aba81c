"""Distances and directions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance, one decimal."""
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlng / 2) * F.sin(dlng / 2)
    return F.round(F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a)), 1)


def squared_degrees(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Squared difference in degrees; longitude isn't wrapped."""
    return (lat1 - lat2) * (lat1 - lat2) + (lng1 - lng2) * (lng1 - lng2)


def heading_turn(current: Column, target: Column) -> Column:
    """Signed eighths of a turn from one compass eighth to another: positive is a turn to the left, half a turn is to the right."""
    ahead = F.pmod(target - current + 8, F.lit(8))
    return F.when(ahead <= 4, -ahead).otherwise(8 - ahead)


def nearest_label(offset: Column, labels: Column) -> Column:
    """Of an array of (label, offset), the label nearest to an offset; the first of equals."""
    ranked = F.transform(labels, lambda x, i: F.struct(F.abs(x["offset"] - offset).alias("d"), i.alias("i"), x["label"].alias("label")))
    return F.array_min(ranked)["label"]


def kilometres(metres: Column) -> Column:
    return F.round(metres / 1000, 1)
