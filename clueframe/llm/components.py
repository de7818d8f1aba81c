"""Connected components by alternating large-star and small-star.

Each round is a few joins and grouped minima over the edge table, written to the
shared folder; no node's neighbours are ever gathered in one row, and nothing but a
count and a checksum reaches the driver.  The hub of a star doesn't meet its neighbours in one task: the
least neighbours of hubs are broadcast (see ``shared.spread``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import passing, spread, stored

MOST_ROUNDS = 60


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of the edges (a, b): component is its least node.

    Null ends, loops and repeated edges don't matter; without edges there are no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u <> v").distinct()
    with passing(edges.sparkSession):
        e = stored(e, "edges")
        state = _state(e)
        for _ in range(MOST_ROUNDS):
            with passing(edges.sparkSession):
                large = stored(_large_star(e, state[0]), "large")
                e = stored(_small_star(large, large.count()), "edges", keep=True)
            before, state = state, _state(e)
            if state == before:
                found = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
                return stored(found, "components", keep=True)
    raise RuntimeError(f"no fixed point in {MOST_ROUNDS} rounds")


def _large_star(e: DataFrame, edges: int) -> DataFrame:
    both = e.union(e.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return spread(both, least, "u", "n", 2 * edges).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame, edges: int) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    x = spread(e, least, "u", "n", edges)
    return x.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(x.select("u", F.col("m").alias("v"))).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
