"""Queries on the knowledge base: search, facets, lookup, comparison and summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hits
from ..plans import values as v
from ..sources.knowledge import clue_rows
from .ranking import top_k

GUIDE_SOURCE, OFFICIAL_SOURCE = "guide", "official"
OFFICIAL_WEIGHT = 1.5


def terms_of(query: str) -> list[str]:
    """Lower-case words of over two characters."""
    return [t.lower() for t in query.split() if len(t) > 2]


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    """How many terms a lower-cased text contains: a sum of substring tests, one pass in generated code."""
    low, out = F.lower(text), F.lit(0)
    for t in terms:
        out = out + low.contains(t).cast("int")
    return out


def search(guides: DataFrame, official: DataFrame, query: str, k: int = 5) -> DataFrame:
    """The best clues for a query: 1 for each term in a guide clue, 1.5 in an official one.

    Ties: guide before official, then code, position and id.
    """
    terms = terms_of(query)
    g = clue_rows(guides).select(F.lit(GUIDE_SOURCE).alias("source"), F.col("title").alias("country"), "code", term_hits(F.col("text"), terms).cast("double").alias("score"), "section", "text", "image_url", F.lit(0).alias("source_ord"), F.lpad(F.col("pos").cast("string"), 9, "0").alias("at"))
    both = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    code = F.coalesce("countryCode", F.lit("GLOBAL"))
    o = official.select(
        F.lit(OFFICIAL_SOURCE).alias("source"), code.alias("country"), code.alias("code"), (term_hits(both, terms) * OFFICIAL_WEIGHT).alias("score"),
        F.coalesce("category", "type", F.lit("meta")).alias("section"), F.concat("title", F.lit(": "), "description").alias("text"), "image_url", F.lit(1).alias("source_ord"), F.col("id").alias("at"),
    )
    found = g.unionByName(o).where("score > 0")
    return found.orderBy(F.desc("score"), "source_ord", "code", "at").limit(k if terms else 0).drop("source_ord", "at")


def all_text(clues: Column) -> Column:
    """All texts of a clue array, joined by blanks, in lower case."""
    return F.lower(F.array_join(F.transform(clues, lambda c: c["text"]), " "))


def countries(guides: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """What the clue scorer needs of each guide: code, title, continents, all_text, region, official_side."""
    x = guides.select("code", "title", "continents", all_text(F.col("all_clues")).alias("all_text"), F.get("regional_clues", F.lit(0))["section"].alias("region"))
    if profiles is None:
        return x.withColumn("official_side", F.lit(None).cast("string"))
    return x.join(profiles.select(F.upper("code").alias("code"), F.col("driving_side").alias("official_side")), "code", "left")


def left_by_guide(code: Column, text: Column) -> Column:
    return code.isin(v.LEFT_TRAFFIC_GUIDE) | text.contains("drives on the left") | text.contains("drive on the left") | text.contains("left-hand traffic")


def facets(guides: DataFrame, driving_side: str | None = None, continent: str | None = None, features: Sequence[str] = ()) -> DataFrame:
    """Countries of a continent and side, best first; 2 points for each feature their text has, from 1. Countries without a hit stay."""
    x = guides.select("code", "title", "continents", all_text(F.col("all_clues")).alias("t"))
    if continent:
        x = x.where(F.exists("continents", lambda c: F.lower(c) == continent.lower()))
    if driving_side:
        x = x.where(F.when(left_by_guide(F.col("code"), F.col("t")), "left").otherwise("right") == driving_side.lower())
    found = F.array_compact(F.array(*(F.when(F.col("t").contains(f.lower()), F.lit(f)) for f in features))) if features else F.array().cast("array<string>")
    x = x.withColumn("matched", found)
    return x.select("code", "title", "continents", (1.0 + 2.0 * F.size("matched")).alias("score"), "matched").orderBy(F.desc("score"), "code")


def lookup(guides: DataFrame, official: DataFrame, name: str) -> DataFrame:
    """A country by code, else by title or slug (any case), with its official clues."""
    n = name.strip()
    way = F.when(F.col("code") == n.upper(), 0).when((F.lower("title") == n.lower()) | (F.lower("slug") == n.lower()), 1)
    one = guides.withColumn("__way", way).where("__way IS NOT NULL").orderBy("__way", "code").limit(1).drop("__way")
    mine = official.groupBy(F.col("countryCode").alias("code")).agg(F.array_sort(F.collect_list(F.struct("id", "title", "description", "category", "type"))).alias("official_clues"))
    return one.join(mine, "code", "left")


def differences(guides: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (a, b) of codes: the clues of a that name b (a, b, focus, pos, tip)."""
    names = guides.select(F.col("code").alias("b"), F.lower("title").alias("other"))
    mine = clue_rows(guides).select(F.col("code").alias("a"), F.col("title").alias("focus"), "pos", F.col("text").alias("tip"))
    return pairs.join(names, "b").join(mine, "a").where(F.contains(F.lower("tip"), F.col("other"))).select("a", "b", "focus", "pos", "tip")


def compare(guides: DataFrame, pairs: DataFrame, k: int = 10) -> DataFrame:
    """Differences both ways, at most k for a pair; where there are none, each country's first tip."""
    there = differences(guides, pairs).withColumn("side", F.lit(0))
    back = differences(guides, pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("b").alias("a"), F.col("a").alias("b"), "focus", "pos", "tip", F.lit(1).alias("side"))
    found = top_k(there.unionByName(back), ["a", "b"], [F.asc("side"), F.asc("pos")], k, "n")
    none = pairs.join(found.select("a", "b").distinct(), ["a", "b"], "left_anti")
    tips = guides.where(F.size("tips") > 0).select("code", F.col("title").alias("focus"), F.col("tips")[0]["text"].alias("tip"))
    first = lambda c, side: none.join(tips.withColumnRenamed("code", c), c).select("a", "b", "focus", F.lit(0).alias("pos"), "tip", F.lit(side).alias("side"), F.lit(side + 1).alias("n"))
    return found.unionByName(first("a", 0)).unionByName(first("b", 1))


def tag_lists(guides: DataFrame) -> DataFrame:
    """Texts of each tag of a country, in order."""
    x = clue_rows(guides).select("code", "pos", "text", F.explode("tags").alias("tag"))
    return x.groupBy("code", "tag").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]).alias("texts"))


def country_summaries(guides: DataFrame) -> DataFrame:
    """Side of the road, first five tips, and clue texts (200 characters) by subject, for each country."""
    t = lambda c: F.lower(c["text"])
    subjects = {
        "poles": lambda c: F.array_contains(c["tags"], "pole") | t(c).contains("pole"),
        "bollards": lambda c: F.array_contains(c["tags"], "bollard") | t(c).contains("bollard"),
        "plates": lambda c: t(c).rlike("plate|licence|license"),
        "car_meta": lambda c: t(c).rlike("google car|antenna|roof rack|snorkel"),
    }
    pick = lambda test: F.transform(F.filter("all_clues", lambda c: F.coalesce(test(c), F.lit(False))), lambda c: F.left(c["text"], F.lit(200)))
    return guides.select(
        "code", "title", "continents",
        F.when(left_by_guide(F.col("code"), all_text(F.col("all_clues"))), "left").otherwise("right").alias("driving_side"),
        *(pick(f).alias(n) for n, f in subjects.items()),
        F.transform(F.slice("tips", 1, 5), lambda c: c["text"]).alias("top_clues"),
    )


def country_list(guides: DataFrame) -> DataFrame:
    return guides.select("title", "code", "slug").orderBy("title", "code")


def right_traffic(guides: DataFrame) -> DataFrame:
    """Codes with a guide that aren't known for left-hand traffic."""
    left = guides.sparkSession.createDataFrame([(c,) for c in v.LEFT_TRAFFIC], "code string")
    return guides.select("code").distinct().join(F.broadcast(left), "code", "left_anti")


def card(guide: DataFrame) -> DataFrame:
    """What a country's page shows: 8 tips, 6 regional clues, 4 spotlights, 6 official clues."""
    return guide.select("code", "title", "continents", F.slice("tips", 1, 8).alias("tips"), F.slice("regional_clues", 1, 6).alias("regional_clues"), F.slice("spotlights", 1, 4).alias("spotlights"), F.slice("official_clues", 1, 6).alias("official_clues"))
