"""Evidence scoring of clue lists against a knowledge base.

An observation has driving_side, continent, clues and cv_clues (arrays) and a struct params
(driving_side, car_meta, red_soil_pct, road_sign, hemisphere_deduction), all nullable.  Flags of an
observation are computed once, before it meets the candidates.  What depends on a clue's text and
a candidate (official clues, demonyms, guide text) is computed for the distinct texts, which are
few next to the observations, and joined back by text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_contains, normalize, whole_word, words_longer
from ..plans import values as v
from ..plans.rules import Arm, pooled, ranked_pool
from .joins import small, spread
from .ranking import once_each, unrolled

TEMPERATURE = 8.0
PARAMS = "driving_side string, car_meta string, red_soil_pct double, road_sign string, hemisphere_deduction string"

_SOUTH_AFRICA, _LATIN, _NORTH_AMERICA, _ISLES = "ZA BW SZ LS NA", "MX BR CO AR CL", "US CA", "GB IE"
_YELLOW_WHITE = "s.white AND NOT s.yellow"

CHAINS = {
    "side": [Arm("s.side = c.side", add=12, reason="driving side"), Arm("s.side IS NOT NULL", mul=0.02)],
    "snorkel": [Arm("s.own_snorkel", "KE", 150, reason="snorkel of the car, seen here only"), Arm("s.own_snorkel", "UG TZ RW", 15), Arm("s.own_snorkel", mul=0.01)],
    "red_hood": [
        Arm("s.red_hood", "UA", 90, reason="red car hood (UA)"),
        Arm("s.red_hood", "RU", 65, reason="red car hood (RU)"),
        Arm("s.red_hood", "BE", 15),
        Arm("s.red_hood", mul=0.1),
    ],
    "sun": [
        Arm("s.sun_south AND c.north", add=12, reason="sun in the south"),
        Arm("s.sun_south AND c.south AND NOT c.equatorial", mul=0.04),
        Arm("s.sun_south"),
        Arm("s.sun_north AND c.south", add=18, reason="sun in the north"),
        Arm("s.sun_north AND c.north AND NOT c.equatorial", mul=0.04),
        Arm("s.sun_north"),
        Arm("s.sun_over AND c.equatorial", add=20, reason="high sun"),
        Arm("s.sun_over AND (c.white_europe OR c.high_north)", mul=0.2),
        Arm("s.sun_over"),
        Arm("s.sun_low AND c.high_north", add=10, reason="low sun"),
        Arm("s.sun_low AND c.equatorial", mul=0.25),
    ],
    "red_soil": [
        Arm("s.red_soil AND c.w_red IS NOT NULL", add="c.w_red * 2", reason="red soil"),
        Arm("s.red_soil AND c.says_red", add=3, reason="red soil in the guide"),
        Arm("s.red_soil AND c.white_europe AND s.white", add=8),
        Arm("s.red_soil", mul=0.3),
    ],
    "concrete": [
        Arm("s.concrete", _NORTH_AMERICA, 20, reason="concrete roads of North America"),
        Arm("s.concrete", "MX BR AR CL", 8, reason="concrete roads of Latin America"),
        Arm("s.concrete", "ES GR IT TR PT HR BE", 12, reason="pale roads of southern Europe"),
    ],
    "yellow": [
        Arm("s.yellow AND c.w_yellow IS NOT NULL", add="c.w_yellow * 2", reason="yellow lines"),
        Arm("s.yellow AND c.white_europe AND c.code NOT IN ('NO', 'FI', 'IS', 'GB', 'IE')", mul=0.1),
        Arm("s.yellow AND c.says_yellow", add=2),
    ],
    "layout": [
        Arm("s.yellow AND s.yellow_center", _NORTH_AMERICA, 70, reason="yellow centre, white edges"),
        Arm("s.yellow AND s.yellow_center", _LATIN, 25, reason="yellow centre of the Americas"),
        Arm("s.yellow AND s.yellow_center", f"{_ISLES} {_SOUTH_AFRICA}", mul=0.15),
        Arm("s.yellow AND s.yellow_center"),
        Arm("s.yellow AND s.edges AND s.southern_africa", _SOUTH_AFRICA, 70, reason="white centre, yellow edges (southern Africa)"),
        Arm("s.yellow AND s.edges AND NOT s.southern_africa", "IE", 75, reason="yellow edges (British Isles)"),
        Arm("s.yellow AND s.edges AND NOT s.southern_africa", "GB", 45, reason="yellow edges (British Isles)"),
        Arm("s.yellow AND s.edges AND NOT s.southern_africa", _NORTH_AMERICA, mul=0.2),
        Arm("s.yellow AND s.edges AND c.white_europe AND c.code NOT IN ('IE', 'GB')", mul=0.15),
        Arm("s.yellow AND s.edges"),
        Arm("s.yellow AND s.curbs", _ISLES, 55, reason="white lines, yellow curbs"),
        Arm("s.yellow AND s.curbs", _NORTH_AMERICA, 6),
        Arm("s.yellow AND s.curbs"),
        Arm("s.yellow AND s.white AND s.southern_road", _SOUTH_AFRICA, 55, reason="yellow edges, white centre"),
        Arm("s.yellow AND s.white AND s.side = 'left'", "JP", 15),
        Arm("s.yellow AND s.white", _NORTH_AMERICA, 42, reason="yellow centre, white edges"),
        Arm("s.yellow AND s.white", _LATIN, 24, reason="yellow centre of the Americas"),
        Arm("s.yellow AND s.white", _ISLES, 35, reason="white lines, yellow edges"),
        Arm("s.yellow AND s.white"),
        Arm("s.yellow AND NOT s.red_soil", _NORTH_AMERICA, 16, reason="yellow centre line"),
    ],
    "sign": [
        Arm("s.sign", _NORTH_AMERICA, 70, reason="yellow diamond signs"),
        Arm("s.sign", "MX", 45, reason="yellow diamond signs (MX)"),
        Arm("s.sign", "AU NZ IE BR", 15),
        Arm("s.sign AND c.white_europe AND c.code NOT IN ('SE', 'PL', 'IS')", mul=0.08),
    ],
    "mediterranean": [
        Arm("s.mediterranean", "TR GR ES", 55, reason="dry Mediterranean landscape"),
        Arm("s.mediterranean", "IT PT CY HR ME AL", 35, reason="dry Mediterranean landscape"),
        Arm("s.mediterranean", "JO IL TN EG", 30, reason="dry Levantine landscape"),
        Arm("s.mediterranean", mul=0.2),
    ],
    "white_concrete": [Arm(f"{_YELLOW_WHITE} AND s.concrete", _NORTH_AMERICA, 8, reason="white lines on concrete")],
    "white": [
        Arm(f"{_YELLOW_WHITE} AND s.sign", _NORTH_AMERICA, 25, reason="white lines of North America"),
        Arm(f"{_YELLOW_WHITE} AND s.sign"),
        Arm(f"{_YELLOW_WHITE} AND c.white_europe", add=30, reason="white lines of Europe"),
        Arm(f"{_YELLOW_WHITE} AND (s.side = 'left' OR s.sun_north)", "AU NZ", 22, reason="white lines of Oceania"),
        Arm(_YELLOW_WHITE, "RU KZ TR MN KG", 18, reason="white lines of Eurasia"),
        Arm(_YELLOW_WHITE, "IN LK BD TH MY ID PH VN KH JP TW KR", 18, reason="white lines of Asia"),
        Arm(f"{_YELLOW_WHITE} AND s.sun_north", "ZA BW NA", 18, reason="white lines of southern Africa"),
        Arm(_YELLOW_WHITE, "CL AR UY", 14, reason="white lines of the southern cone"),
        Arm(_YELLOW_WHITE, _NORTH_AMERICA, 4, reason="white lines of North America"),
        Arm(_YELLOW_WHITE, "MX BR CO PE", 4, reason="white lines of Latin America"),
        Arm("s.white AND s.yellow AND c.white_europe", add=6, reason="white lines"),
        Arm("s.white AND s.yellow", "AU NZ JP GB IE", 6, reason="white lines"),
        Arm("s.white AND s.yellow", "US CA MX BR CO", 2),
    ],
    "temperate": [
        Arm("s.temperate", v.TEMPERATE, 10, reason="temperate vegetation"),
        Arm("s.temperate", "CR TH MY ID PH VN SG", mul=0.25),
        Arm("s.temperate", "AE QA OM EG JO SA", mul=0.1),
    ],
    "arid": [Arm("s.arid AND c.w_arid IS NOT NULL", add="c.w_arid * 2.5", reason="desert"), Arm("s.arid", mul=0.2)],
    "lush": [
        Arm("s.lush AND s.tropical AND c.w_tropical IS NOT NULL", add="c.w_tropical * 2.2", reason="tropical foliage"),
        Arm("s.lush AND c.w_lush IS NOT NULL", add="c.w_lush * 1.5", reason="lush foliage"),
        Arm("s.lush", "AE QA OM EG JO SA MN KG KZ BW NA", mul=0.1),
    ],
    "unpaved": [Arm("s.unpaved AND NOT s.yellow AND NOT s.white AND c.w_unpaved IS NOT NULL", add="c.w_unpaved * 2.5", reason="dirt roads are common")],
    "gutter": [
        Arm("s.gutter", _NORTH_AMERICA, 20, reason="concrete curbs of North America"),
        Arm("s.gutter", "AU NZ", 10, reason="concrete curbs of Oceania"),
        Arm("s.gutter", "CO MX BR AR CL PE", 7, reason="concrete curbs of Latin America"),
    ],
    "outback": [
        Arm("s.outback AND s.unpaved", "BR NG UG KE GH MG SN BO PY CO", 65, reason="laterite dirt road"),
        Arm("s.outback AND NOT s.unpaved AND (s.sun_south OR NOT s.sun_north)", "US MX", 58, reason="red desert of North America"),
        Arm("s.outback", "AU", 55, reason="red outback soil"),
        Arm("s.outback", "NG UG KE GH MG SN ZA BW BR NA", 40, reason="red soil of Africa and the south"),
        Arm("s.outback AND NOT s.unpaved", "US MX", 48, reason="red desert of North America"),
        Arm("s.outback", mul=0.05),
    ],
    "sandstone": [
        Arm("s.sandstone", _ISLES, 35, reason="red sandstone houses"),
        Arm("s.sandstone", "US CA NL BE DE", 14, reason="brick houses"),
        Arm("s.sandstone", mul=0.4),
    ],
    "panels": [Arm("s.panels", "MN RU KZ KG UA BY BG", 42, reason="panel blocks"), Arm("s.panels", mul=0.1)],
    "poles": [
        Arm("s.poles", _NORTH_AMERICA, 18, reason="wooden poles of North America"),
        Arm("s.poles", "CO MX BR PE", 14, reason="poles of the Americas"),
        Arm("s.poles AND s.curbs"),
        Arm("s.poles", "GB IE DE FR NL BE DK SE NO", mul=0.65),
    ],
    "red_car": [Arm("s.red_car", "UA", 55, reason="red car"), Arm("s.red_car", "BE", 15, reason="red car (rare)"), Arm("s.red_car", mul=0.05)],
    "any_snorkel": [
        Arm("s.snorkel", "KE", 65, reason="snorkel"),
        Arm("s.snorkel", "MN", 25, reason="snorkel (older cars)"),
        Arm("s.snorkel", "CW", 20),
        Arm("s.snorkel", mul=0.1),
    ],
    "tape": [Arm("s.tape", "GH", 65, reason="black tape on the roof rack"), Arm("s.tape", mul=0.1)],
}


def candidate_table(countries: DataFrame) -> DataFrame:
    """One row for each country of a guide (code, title, continents, all_text, region, official_side): what the rules look up."""
    spark = countries.sparkSession
    weights = {"w_red": v.RED_SOIL, "w_yellow": v.YELLOW_LINES, "w_arid": v.ARID, "w_tropical": v.TROPICAL_LUSH, "w_lush": v.LUSH, "w_unpaved": v.UNPAVED}
    codes = sorted({*v.PRIORS, *v.CENTERS, *(c for w in weights.values() for c in w)})
    rows = [(c, v.PRIORS.get(c, v.PRIOR_DEFAULT), *v.CENTERS.get(c, (0.0, 0.0)), *(w.get(c) for w in weights.values())) for c in codes]
    known = spark.createDataFrame(rows, "code string, prior double, lat double, lng double, " + ", ".join(f"{w} int" for w in weights))
    x = countries.join(F.broadcast(known), "code", "left")
    inside = lambda codes: F.col("code").isin(codes)
    spoken = F.col("all_text").rlike("drives? on the left|left-hand traffic")
    return x.select(
        "code",
        "title",
        "all_text",
        F.coalesce("region", F.lit("General")).alias("region"),
        F.coalesce("prior", F.lit(v.PRIOR_DEFAULT)).alias("prior"),
        F.coalesce("lat", F.lit(0.0)).alias("lat"),
        F.coalesce("lng", F.lit(0.0)).alias("lng"),
        *weights,
        F.coalesce(F.nullif(F.lower("official_side"), F.lit("")), F.when(inside(v.LEFT_TRAFFIC_GUIDE) | spoken, "left").otherwise("right")).alias("side"),
        *(inside(s).alias(n) for n, s in (("north", v.NORTHERN), ("south", v.SOUTHERN), ("equatorial", v.EQUATORIAL), ("high_north", v.HIGH_NORTH), ("white_europe", v.WHITE_LINES_EUROPE))),
        F.contains("all_text", F.lit("red soil")).alias("says_red"),
        F.contains("all_text", F.lit("yellow")).alias("says_yellow"),
    )


def _context(name: str) -> Column:
    """Whether an observation is said to be of a continent: by its own field, or by a clue that names it without a qualifier after it."""
    qualified = rf"\b{name}\s+({'|'.join(v.CONTINENT_QUALIFIERS)})"
    return F.coalesce(F.col("continent").contains(name), F.lit(False)) | F.exists("__norm", lambda c: whole_word(c, name) & ~c.rlike(qualified))


def signals(observations: DataFrame, key: str = "obs_id") -> DataFrame:
    """(key, explicit, s): the clues that are not generic signals, and the flags of an observation."""
    none = F.array().cast("array<string>")
    generic = lambda c: F.lower(c).isin(list(v.GENERIC_SIGNALS))
    x = observations.select(key, "driving_side", F.lower("continent").alias("continent"), F.coalesce("clues", none).alias("clues"), F.coalesce("cv_clues", none).alias("cv"), "params")
    x = x.withColumn("explicit", F.filter("clues", lambda c: ~generic(c)))
    cv = F.concat("cv", F.filter("clues", lambda c: generic(c) & ~F.array_contains("cv", c)))
    x = x.withColumn("all", F.concat("explicit", cv))
    has = lambda *needles: any_contains(F.col("all"), *needles)
    p = lambda name: F.col(f"params.{name}")
    said = F.coalesce(F.nullif("driving_side", F.lit("")), F.nullif(p("driving_side"), F.lit("")))
    side = F.lower(F.coalesce(said, F.when(has("driving on the right"), "right").when(has("driving on the left"), "left")))
    is_so = lambda c: F.coalesce(c, F.lit(False))
    deduced = F.coalesce(p("hemisphere_deduction"), F.lit(""))
    norm = F.transform("all", normalize)
    flags = {
        "sun_south": has("sun visible to the south", "sun-to-south", "sun to south"),
        "sun_north": has("sun visible to the north", "sun-to-north", "sun to north"),
        "sun_over": has("sun overhead", "sun visible overhead", "high sun angle"),
        "sun_low": has("low sun angle"),
        "side": side,
        "own_snorkel": F.exists("all", lambda c: F.lower(c).contains("kenya") & F.lower(c).contains("snorkel")) | is_so(p("car_meta") == "kenya snorkel"),
        "red_hood": has("red google car", "red car hood") | is_so(p("car_meta") == "red car hood"),
        "red_soil": has("red soil") | is_so(p("red_soil_pct") > 3.5),
        "yellow": has("yellow road line"),
        "white": has("white road line"),
        "concrete": has("concrete road pavement", "concrete pavement"),
        "arid": has("arid", "desert"),
        "lush": has("lush"),
        "unpaved": has("unpaved", "dirt"),
        "red_car": has("red google car", "red car"),
        "snorkel": has("snorkel"),
        "tape": has("black tape", "tape on roof rack"),
        "yellow_center": has("yellow center line"),
        "edges": has("white center line with yellow edge markings", "yellow edge markings with white road lines"),
        "curbs": has("dominant white road markings with yellow curb lines"),
        "sign": has("yellow hazard sign", "warning marker") | is_so(p("road_sign") == "North American yellow sign"),
        "mediterranean": has("arid mediterranean", "anatolian"),
        "temperate": has("temperate vegetation"),
        "hot": has("tropical", "equatorial") | deduced.contains("Equatorial"),
        "gutter": has("concrete curb"),
        "outback": has("outback terrain", "distinctive red soil"),
        "sandstone": has("british red sandstone"),
        "panels": has("post-soviet panel"),
        "poles": has("north american utility poles"),
        "deduced_south": deduced.contains("Southern Hemisphere"),
    }
    context = [_context(name).alias("on_" + name.replace(" ", "_")) for name in v.CONTINENTS]
    x = x.select(key, "explicit", "continent", norm.alias("__norm"), F.struct(*(c.alias(n) for n, c in flags.items())).alias("f"))
    left = is_so(F.col("f.side") == "left")
    return x.select(
        key,
        "explicit",
        F.struct(
            "f.*",
            *context,
            (F.col("f.hot") | F.col("f.sun_over")).alias("tropical"),
            (left | F.col("f.sun_north") | F.col("f.deduced_south")).alias("southern_africa"),
            (left | F.col("f.sun_north") | (~F.col("f.sun_south") & F.col("f.red_soil") & ~is_so(F.col("f.side") == "right"))).alias("southern_road"),
        ).alias("s"),
    )


def official_points(texts: DataFrame, official: DataFrame) -> DataFrame:
    """(clue, code, points, reason, id) of each normalised clue text and official clue (code, id, title, description, kind) that match: the first way that applies."""
    o = official.select("code", "id", "title", "kind", normalize(F.col("id")).alias("i"), normalize(F.col("title")).alias("t"))
    words = F.slice(words_longer(F.col("t"), 4, v.STOP_WORDS), 1, 2)
    o = o.withColumn("w", words).withColumn("generic", F.col("t").isin(list(v.GENERIC_TITLES)))
    # What doesn't depend on both sides is worked out before they meet, and without a lambda, which would be interpreted for each pair.
    o = o.withColumns({"w1": F.get("w", F.lit(0)), "w2": F.get("w", F.lit(1)), "t_long": F.length("t") > 6}).drop("w")
    u, i, t = F.col("clue"), F.col("i"), F.col("t")
    by_id = (i != "") & ((i == u) | F.contains(u, i) | ((F.length(u) > 6) & F.contains(i, u)))
    by_title = (t != "") & (t == u)
    by_part = (t != "") & ~F.col("generic") & (F.contains(u, t) | (F.col("t_long") & F.contains(t, u)))
    by_words = F.contains(u, F.col("w1")) & F.contains(u, F.col("w2"))
    points = F.when(by_id, 60.0).when(by_title, F.when(F.col("generic"), 15.0).otherwise(50.0)).when(by_part, 35.0).when(by_words, 25.0)
    asked = spread(texts).where((u != "") & ~u.isin(list(v.UNTELLING_CLUES))).withColumn("u_long", F.length("clue") > 6)
    found = asked.crossJoin(small(o)).withColumn("points", points).where("points IS NOT NULL")
    return found.select("clue", "code", "points", F.concat_ws(" ", F.lit("official clue:"), "title").alias("reason"), "id")


WORDS_KEPT = 200_000


def guide_points(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(raw, code, points, reason): a guide that holds a clue's text, or two of its longer words.

    Words are few next to texts: a worker looks a word up in the guides once, and then adds what it knows of a text's words.
    Texts go as bytes, as Spark compares them.
    """
    guides = [(r.code, bytes(r.t)) for r in candidates.where("all_text IS NOT NULL").select("code", F.col("all_text").cast("binary").alias("t")).collect()]
    codes = [c for c, _ in guides]

    def run(batches):
        known: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, out = batch.slice(at, 1000), []
                for raw, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    n = np.zeros(len(guides), np.int32)
                    for w in words:
                        if w not in known:
                            if len(known) >= WORDS_KEPT:
                                known.clear()
                            known[w] = np.array([w in t for _, t in guides], bool)
                        n += known[w]
                    whole = [raw in t for _, t in guides]
                    out += [(raw, codes[i], whole[i], int(n[i])) for i in np.flatnonzero(whole | (n >= 2))]
                fields = zip(*out) if out else ((),) * 4
                kinds = (pa.binary(), pa.string(), pa.bool_(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(f, k) for f, k in zip(fields, kinds)], names=["raw", "code", "whole", "n"])

    words = F.transform(words_longer(F.col("raw"), 4, v.STOP_WORDS), lambda w: w.cast("binary"))
    x = spread(texts.where("raw IS NOT NULL").select(F.col("raw").cast("binary").alias("raw"), words.alias("words"))).mapInArrow(run, "raw binary, code string, whole boolean, n int")
    x = x.withColumn("raw", F.col("raw").cast("string"))
    return x.select("raw", "code", F.when(F.col("whole"), 8.0).otherwise(F.col("n") * 2.5).alias("points"), F.when(F.col("whole"), F.col("raw")).otherwise(F.format_string("guide text (%d terms)", "n")).alias("reason"))


def _demonyms(spark) -> DataFrame:
    return spark.createDataFrame([(c, d) for c, ds in v.DEMONYMS.items() for d in ds.split("|")], "code string, demonym string")


def clue_evidence(seen: DataFrame, candidates: DataFrame, official: DataFrame, key: str) -> DataFrame:
    """(key, code, points, named, reasons, official_ids): what single clues say of single countries."""
    spark = seen.sparkSession
    clues = seen.select(key, F.posexplode("explicit").alias("pos", "text")).select(key, "pos", F.lower("text").alias("raw"), normalize(F.col("text")).alias("clue"))
    distinct = clues.select("clue").distinct()
    by_official = clues.join(official_points(distinct, official), "clue").select(key, "code", "points", F.lit(False).alias("named"), "reason", F.lit(1).alias("part"), "id")
    names = spread(distinct).join(F.broadcast(_demonyms(spark)), F.expr(r"contains(clue, demonym) AND clue rlike concat('\\b', demonym, '\\b')"))
    by_name = clues.join(names, "clue").select(key, "code", "demonym").distinct()
    by_name = by_name.select(key, "code", F.lit(120.0).alias("points"), F.lit(True).alias("named"), F.concat(F.lit("named: "), "demonym").alias("reason"), F.lit(2).alias("part"), F.lit(None).cast("string").alias("id"))
    # Only a hyphenated or a lone code names a country: ordinary words ("in ", "no ") don't.
    prefix = F.upper(F.coalesce(F.nullif(F.regexp_extract("raw", r"^\s*([a-z]{2})-", 1), F.lit("")), F.nullif(F.regexp_extract("raw", r"^\s*([a-z]{2})\s*$", 1), F.lit(""))))
    coded = clues.select(key, prefix.alias("code")).where("code IS NOT NULL").groupBy(key, "code").agg(F.count("*").alias("n"))
    by_code = coded.select(key, "code", F.least(F.lit(130.0), 50.0 + 30.0 * F.col("n")).alias("points"), F.lit(True).alias("named"), F.concat(F.lit("code: "), "code").alias("reason"), F.lit(3).alias("part"), F.lit(None).cast("string").alias("id"))
    by_guide = clues.join(guide_points(clues.select("raw").distinct(), candidates), "raw").select(key, "code", "points", F.lit(False).alias("named"), "reason", F.lit(4).alias("part"), F.lit(None).cast("string").alias("id"))
    every = by_official.unionByName(by_name).unionByName(by_code).unionByName(by_guide)
    texts = F.transform(F.array_sort(F.collect_set(F.struct("part", "reason"))), lambda x: x["reason"])
    return every.groupBy(key, "code").agg(F.sum("points").alias("points"), F.bool_or("named").alias("named"), texts.alias("texts"), F.array_sort(F.collect_set("id")).alias("official_ids"))


def _continents() -> tuple[str, str, str]:
    adds, factors, texts = [], [], []
    for name, codes in v.CONTINENTS.items():
        on, members = "s.on_" + name.replace(" ", "_"), ", ".join(map(repr, codes))
        adds.append(f"IF({on} AND c.code IN ({members}), 25D, 0D)")
        factors.append(f"IF({on} AND c.code NOT IN ({members}) AND NOT coalesce(e.named, false), 0.15D, 1D)")
        texts.append(f"IF({on} AND c.code IN ({members}), 'continent: {name}', NULL)")
    return " + ".join(adds), " * ".join(factors), f"array_compact(array({', '.join(texts)}))"


_BASE = "1D + c.prior * 1.5D"
_NO_TEXTS = "CAST(array() AS ARRAY<STRING>)"


def score_flags(seen: DataFrame, pool: DataFrame, key: str = "obs_id") -> DataFrame:
    """The five best candidates of each row (key, s) by the rules alone: key, rank, code, score, confidence."""

    def best(rows, key):
        rows = rows.crossJoin(F.broadcast(pooled(pool)))
        return unrolled(rows.select(key, ranked_pool(CHAINS, _BASE, why=None).alias("best")), key, "best", TEMPERATURE, {})

    return once_each(seen.select(key, "s"), key, best)


def score_clues(observations: DataFrame, countries: DataFrame, official: DataFrame, key: str = "obs_id") -> DataFrame:
    """Per observation: the five best countries (key, rank, code, title, region, score, confidence, reasons, lat, lng, official_ids).

    A country without a reason is none; where no country is left, the first five by code are given.
    """
    pool = candidate_table(countries)
    seen = signals(observations, key)
    evidence = clue_evidence(seen, pool, official, key)
    # A map by code for each observation, of no more entries than there are countries.
    evidence = evidence.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("code", F.struct("points", "named", "texts", "official_ids")))).alias("evidence"))
    rows = seen.select(key, "s").join(evidence, key, "left")
    first = F.expr("slice(array_sort(collect_list(struct(code, title, region, lat, lng))), 1, 5)")
    sides = pool.groupBy().agg(F.collect_list(F.struct(*(c for c in pool.columns if c != "all_text"))).alias("pool"), first.alias("first"))
    rows = rows.crossJoin(F.broadcast(sides))
    add, factor, texts = _continents()
    why = lambda listed: f"array_distinct(concat({listed}, coalesce(e.texts, {_NO_TEXTS}), {texts}))"
    best = ranked_pool(CHAINS, _BASE, plus=f"coalesce(e.points, 0D) + {add}", times=factor, evidence="try_element_at(evidence, c.code)", why=why, need_reason=True)
    kind = "array<struct<worse: double, code: string, c: struct<title: string, region: string, lat: double, lng: double>, reasons: array<string>, ids: array<string>>>"
    place = "named_struct('title', x.{0}title, 'region', x.{0}region, 'lat', x.{0}lat, 'lng', x.{0}lng)"
    rows = rows.select(key, "first", F.slice(best, 1, 5).alias("best"))
    found = F.expr(f"transform(best, x -> named_struct('worse', x.worse, 'code', x.code, 'c', {place.format('c.')}, 'reasons', x.reasons, 'ids', coalesce(x.e.official_ids, {_NO_TEXTS})))")
    plain = F.expr(f"transform(first, x -> named_struct('worse', -1D, 'code', x.code, 'c', {place.format('')}, 'reasons', array('no telling clue'), 'ids', {_NO_TEXTS}))")
    rows = rows.select(key, F.when(F.size("best") > 0, found.cast(kind)).otherwise(plain.cast(kind)).alias("best"))
    place = {c: F.col(f"b.c.{c}") for c in ("title", "region", "lat", "lng")}
    best = unrolled(rows, key, "best", TEMPERATURE, {**place, "reasons": F.col("b.reasons"), "official_ids": F.col("b.ids")})
    fallback = official.groupBy("code").agg(F.slice(F.array_sort(F.collect_set("id")), 1, 3).alias("__first"))
    best = best.join(small(fallback), "code", "left")
    ids = F.when(F.size("official_ids") > 0, F.slice("official_ids", 1, 4)).otherwise(F.coalesce("__first", F.array().cast("array<string>")))
    return best.withColumn("official_ids", ids).drop("__first")


def reasoning(title: Column, reasons: Column) -> Column:
    """A sentence on a prediction."""
    return F.concat(title, F.lit(" scored highest: "), F.array_join(F.slice(reasons, 1, 4), ", "), F.lit("."))
