"""Match dumps: game ids from feeds, rounds and clues by explode, translation, first-seen clues with sampled panoramas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_clues, unhexed
from .ranking import first_of_each, sampled

GAME_IDS = "array<struct<gameId:string,payload:string>>"


def game_ids(feed: DataFrame, payload: str = "payload") -> DataFrame:
    """Distinct game ids of feed entries whose payload is a JSON array or object, which may be a string of JSON; malformed ones are passed over."""
    once = F.try_parse_json(payload)
    text = F.try_variant_get(once, "$", "string")
    doc = F.coalesce(F.when(F.schema_of_variant(once) == "STRING", F.try_parse_json(text)), once)
    one = F.try_variant_get("d", "$.gameId", "string")
    many = F.transform(F.coalesce(F.try_variant_get("d", "$", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.coalesce(F.try_variant_get(x, "$.gameId", "string"), F.try_variant_get(x, "$.payload.gameId", "string")))
    nested = F.try_variant_get("d", "$.payload.gameId", "string")
    ids = feed.select(doc.alias("d")).select(F.explode(F.array_compact(F.concat(F.array(one, nested), many))).alias("game_id"))
    return ids.where("game_id <> ''").distinct()


def translated(keys: DataFrame, phrases: DataFrame, key: str = "key", lang: str = "en") -> DataFrame:
    """``keys`` with a phrase: the one of a language, else the first, else the key itself.  ``phrases``: key, lang, phrase, ord."""
    best = phrases.groupBy(F.col("key").alias("__k")).agg(F.min_by(F.when(F.col("lang") == lang, F.col("phrase")), F.when(F.col("lang") == lang, F.col("ord"))).alias("__one"), F.min_by("phrase", "ord").alias("__any"))
    return keys.join(best, F.col(key) == F.col("__k"), "left").withColumn("phrase", F.coalesce("__one", "__any", F.col(key))).drop("__k", "__one", "__any")


def round_rows(games: DataFrame) -> DataFrame:
    """(gameId, round, panoId, countryCode, lat, lng, clues) of games with an array of rounds; hexadecimal panorama ids are decoded."""
    x = games.select("gameId", F.posexplode("rounds").alias("__i", "r"))
    return x.select("gameId", (F.col("__i") + 1).alias("round"), unhexed(F.col("r.panoId")).alias("panoId"), F.upper("r.countryCode").alias("countryCode"), "r.lat", "r.lng", "r.clues")


def clue_catalogue(rounds: DataFrame, samples: int = 5) -> DataFrame:
    """Clues by id: the first seen of each, with up to ``samples`` of the panoramas it was seen at."""
    x = rounds.select("gameId", "round", "panoId", "lat", "lng", "countryCode", F.posexplode("clues").alias("pos", "c"))
    x = x.select("gameId", "round", "pos", "panoId", "lat", "lng", F.col("c.id").alias("id"), F.col("c.title").alias("title"), F.col("c.type").alias("type"), F.upper(F.coalesce("countryCode", F.lit("GLOBAL"))).alias("countryCode"))
    x = x.where("id IS NOT NULL")
    first = first_of_each(x, ["id"], ["gameId", "round", "pos"]).select("id", "title", "type", "countryCode")
    panos = sampled(x, ["id"], ["gameId", "round", "pos"], ["panoId", "lat", "lng", "round", "gameId"], samples, "sample_panoramas")
    return first.join(panos, "id")


def by_country(clues: DataFrame) -> DataFrame:
    """Clue ids of each country, in order; without a country they are GLOBAL."""
    code = F.upper(F.coalesce(F.nullif("countryCode", F.lit("")), F.lit("GLOBAL")))
    return clues.groupBy(code.alias("code")).agg(F.count("*").alias("clues"), F.array_sort(F.collect_list("id")).alias("ids"))


def harvest_counts(rounds: DataFrame) -> DataFrame:
    """One row: games, panoramas and distinct clues."""
    ids = rounds.select("gameId", "panoId", F.explode_outer("clues").alias("c"))
    return ids.agg(F.count_distinct("gameId").alias("games"), F.count_distinct("panoId").alias("panoramas"), F.count_distinct("c.id").alias("clues"))


def clue_texts(rounds: DataFrame, official: DataFrame) -> DataFrame:
    """Rounds with the texts of their clues, looked up by id, by alias, or by id rewritten with hyphens, else the clue's own title."""
    x = rounds.select("gameId", "round", F.posexplode("clues").alias("pos", "c")).select("gameId", "round", "pos", F.col("c.id").alias("id"), F.col("c.title").alias("own"))
    o = official.select(F.col("id").alias("k"), F.coalesce("title", "id").alias("t"))
    by = lambda c, n: o.select(F.col("k").alias(c), F.col("t").alias(n))
    x = x.withColumns({"low": F.lower("id"), "dash": F.replace(F.lower("id"), F.lit("_"), F.lit("-"))})
    x = x.join(by("id", "t1"), "id", "left").join(by("low", "t2"), "low", "left").join(by("dash", "t3"), "dash", "left")
    text = F.coalesce("t1", "t2", "t3", "own", "id")
    lists = x.groupBy("gameId", "round").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", text.alias("t")))), lambda s: s["t"]).alias("texts"))
    return lists.withColumn("texts", clean_clues(F.col("texts")))
