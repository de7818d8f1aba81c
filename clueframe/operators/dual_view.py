"""Evidence scoring of dual-view features: filters, additive points, and factors for exclusive hardware.

An observation has hemisphere, driving_side, road_type, road_lines, biome, hardware
(array) and the metrics red_soil_pct and horizon_std; absent values are neutral ones.  All
candidates are broadcast as one array, and filtered, scored and ranked within the observation's row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import values as v
from ..plans.rules import Arm, level, pooled, ranked_pool
from .joins import dealt
from .ranking import once_each, unrolled

TEMPERATURE = 12.0
FALLBACK = ("US", 1.0)
POLE, SNORKEL = "tw_diagonal_striped_pole", "kenya_snorkel"


def candidates(codes: DataFrame) -> DataFrame:
    """The profile of each code (columns code and, if known, title): place, side, biome and marking flags."""
    spark = codes.sparkSession
    centers = spark.createDataFrame([(k, *x) for k, x in v.CENTERS.items()], "code string, __lat double, __lng double")
    x = codes.join(F.broadcast(centers), "code", "left")
    lat = F.coalesce("__lat", F.lit(0.0))
    inside = lambda name: F.col("code").isin(v.PROFILE_SETS[name])
    x = x.select(
        "code",
        F.coalesce(F.col("title") if "title" in codes.columns else F.lit(None).cast("string"), "code").alias("title"),
        lat.alias("lat"),
        F.coalesce("__lng", F.lit(0.0)).alias("lng"),
        F.when(lat < -12, "south").when(lat > 18, "north").otherwise("equator").alias("hemisphere"),
        F.when(F.col("code").isin(v.LEFT_TRAFFIC), "left").otherwise("right").alias("driving_side"),
        (lat.between(-15, 20) & inside("tropical")).alias("is_tropical"),
        ((lat >= 45) & inside("boreal")).alias("is_boreal"),
        inside("savanna").alias("is_savanna"),
        *(inside(n).alias(n) for n in ("yellow_center", "white_only", "red_soil", "unpaved", "flat")),
    )
    north = (F.col("lat") > 20) & ~F.col("is_boreal") & ~F.col("is_tropical")
    return x.withColumn("is_temperate", north | ((F.col("lat") < -20) & ~F.col("is_savanna")))


CHAINS = {
    "side": [Arm("s.driving_side = 'LEFT'", add=40, reason="drives on the left"), Arm("s.driving_side = 'RIGHT'", add=20, reason="drives on the right")],
    "sun": [
        Arm("s.hemisphere = 'NORTHERN' AND c.hemisphere = 'north'", add=30, reason="northern hemisphere"),
        Arm("s.hemisphere = 'SOUTHERN' AND c.hemisphere = 'south'", add=45, reason="southern hemisphere"),
        Arm("s.hemisphere = 'NEUTRAL' AND c.hemisphere = 'equator'", add=25, reason="near the equator"),
    ],
    "lines": [
        Arm("s.road_lines = 'us_yellow_center_white_edge'", "US", 80, reason="yellow centre and white edge lines"),
        Arm("s.road_lines = 'us_yellow_center_white_edge'", "CA MX", 40, reason="yellow centre lines of the continent"),
        Arm("s.road_lines = 'us_yellow_center_white_edge' AND c.yellow_center", add=20),
        Arm("s.road_lines = 'us_yellow_center_white_edge'", add=-40),
        Arm("s.road_lines = 'irish_yellow_dashed_edge'", "IE", 120, reason="dashed yellow edge lines"),
        Arm("s.road_lines = 'irish_yellow_dashed_edge'", "GB", 20),
        Arm("s.road_lines = 'irish_yellow_dashed_edge'", add=-40),
        Arm("s.road_lines = 'white_lines' AND c.white_only", add=35, reason="white lines only"),
        Arm("s.road_lines = 'white_lines' AND c.yellow_center", add=-25),
        Arm("s.road_lines = 'yellow_center' AND c.yellow_center", add=35, reason="yellow centre line"),
        Arm("s.road_lines = 'yellow_center' AND c.white_only", add=-30),
    ],
    "surface": [Arm("s.road_type = 'unpaved_dirt' AND c.unpaved", add=45, reason="dirt roads are common"), Arm("s.road_type = 'unpaved_dirt'", add=-35)],
    "soil": [
        Arm("s.red_soil_pct > 15 AND c.red_soil", add=40, reason="red soil"),
        Arm("s.red_soil_pct > 15", add=-30),
        Arm("s.red_soil_pct < 2 AND s.biome = 'steppe'", "AU", -20),
    ],
    "biome": [
        Arm("s.biome = 'boreal' AND c.is_boreal", add=50, more="IF(c.code = 'RU', 20D, 0D)", reason="boreal forest"),
        Arm("s.biome = 'boreal'", add=-35),
        Arm("s.biome = 'tropical' AND c.is_tropical", add=50, more="IF(c.code = 'ID', 15D, 0D)", reason="tropical forest"),
        Arm("s.biome = 'tropical' AND c.is_savanna", add=-20),
        Arm("s.biome = 'tropical'", add=-40),
        Arm("s.biome = 'savanna' AND c.is_savanna", add=45, reason="savanna"),
        Arm("s.biome = 'savanna'", add=-25),
        Arm("s.biome = 'steppe'", "MN AU KG KZ AR CL", 50, more="IF(c.code = 'MN' AND s.road_type = 'unpaved_dirt', 20D, 0D)", reason="open steppe"),
        Arm("s.biome = 'steppe'", add=-25),
        Arm("s.biome = 'temperate' AND c.is_temperate AND s.horizon_std < 14 AND c.flat", add=55, reason="flat temperate farmland"),
        Arm("s.biome = 'temperate' AND c.is_temperate", add=30, reason="temperate landscape"),
        Arm("s.biome = 'temperate' AND c.is_tropical", add=-25),
    ],
    "pasture": [
        Arm("s.hemisphere = 'SOUTHERN' AND s.biome = 'temperate' AND s.red_soil_pct < 10", "NZ", 35, reason="green southern pasture"),
        Arm("s.hemisphere = 'SOUTHERN' AND s.biome = 'temperate' AND s.red_soil_pct < 10", "AU", -25),
    ],
}

#: Exclusive hardware, in the order in which it is met: (name, country, neighbours).
HARDWARE = ((POLE, "TW", "JP KR"), (SNORKEL, "KE", "UG TZ"))


def _hardware(score: str) -> str:
    """Points of own and neighbouring countries, else a factor, for each item of hardware in turn."""
    step = "acc"
    cases = []
    for name, own, near in HARDWARE:
        codes = ", ".join(map(repr, near.split()))
        cases.append(f"WHEN h = '{name}' THEN CASE WHEN c.code = '{own}' THEN {step} + 450D WHEN c.code IN ({codes}) THEN {step} + 30D ELSE {step} * 0.05D END")
    return f"aggregate(s.hardware, {score}, (acc, h) -> CASE {' '.join(cases)} ELSE acc END)"


def score_dual_view(observations: DataFrame, profiles: DataFrame, key: str = "obs_id", reread: bool = False) -> DataFrame:
    """Per observation: the five best candidates (key, rank, code, title, score, confidence, reasons, lat, lng).

    With ``reread``, for observations that cost little to read again, those that the rules can't tell apart are scored once (``once_each``).
    """
    text = lambda c, d: F.coalesce(c, F.lit(d)).alias(c)
    metrics = {"red_soil_pct": 0.0, "horizon_std": 20.0}
    seen = observations.withColumns({m: F.coalesce(F.col(m).cast("double"), F.lit(d)) for m, d in metrics.items()}).select(
        key,
        F.struct(
            text("hemisphere", "NEUTRAL"),
            text("driving_side", "UNKNOWN"),
            text("road_type", "asphalt"),
            text("road_lines", "none"),
            text("biome", "temperate"),
            F.filter(F.coalesce("hardware", F.array().cast("array<string>")), lambda h: h.isin([n for n, _, _ in HARDWARE])).alias("hardware"),
            *(F.expr(level(CHAINS, m)).alias(m) for m in metrics),
        ).alias("s"),
    )
    best = lambda rows, key: _best(rows, profiles, key)
    return once_each(seen, key, best) if reread else best(dealt(seen), key)


def _best(seen: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    where = """(s.driving_side NOT IN ('LEFT', 'RIGHT') OR lower(s.driving_side) = c.driving_side)
        AND NOT (s.hemisphere = 'NORTHERN' AND c.hemisphere = 'south') AND NOT (s.hemisphere = 'SOUTHERN' AND c.hemisphere = 'north')"""
    exclusive = ", ".join(f"IF(array_contains(s.hardware, '{n}') AND c.code = '{own}', 'hardware seen here only: {n}', NULL)" for n, own, _ in reversed(HARDWARE))
    why = lambda listed: f"concat(array_compact(array({exclusive})), {listed})"
    rows = seen.crossJoin(F.broadcast(pooled(profiles)))
    rows = rows.select(key, ranked_pool(CHAINS, "10D", where=where, then=_hardware, why=why).alias("best"))
    lat, lng = v.CENTERS[FALLBACK[0]]
    place = "c struct<title: string, lat: double, lng: double>"
    lone = F.array(F.struct(F.lit(-FALLBACK[1]).alias("worse"), F.lit(FALLBACK[0]).alias("code"), F.struct(F.lit(FALLBACK[0]).alias("title"), F.lit(lat).alias("lat"), F.lit(lng).alias("lng")).alias("c"), F.array(F.lit("no candidate is left")).alias("reasons")))
    found = F.transform("best", lambda x: F.struct(x["worse"].alias("worse"), x["code"].alias("code"), F.struct(x["c"]["title"].alias("title"), x["c"]["lat"].alias("lat"), x["c"]["lng"].alias("lng")).alias("c"), x["reasons"].alias("reasons")))
    kind = f"array<struct<worse: double, code: string, {place.replace(' struct', ': struct', 1)}, reasons: array<string>>>"
    rows = rows.select(key, F.slice(found, 1, 5).alias("best"))
    rows = rows.select(key, F.when(F.size("best") > 0, F.col("best").cast(kind)).otherwise(lone.cast(kind)).alias("best"))
    return unrolled(rows, key, "best", TEMPERATURE, {"title": F.col("b.c.title"), "lat": F.col("b.c.lat"), "lng": F.col("b.c.lng"), "reasons": F.col("b.reasons")})


def profile_codes(guides: DataFrame, official: DataFrame) -> DataFrame:
    """(code, title, n_clues) of each code that has a guide or official clues; n_clues counts both sources' clues."""
    told = guides.where("code IS NOT NULL").groupBy("code").agg(F.min("title").alias("title"), F.sum(F.coalesce(F.array_size("all_clues"), F.lit(0))).alias("__g"))
    master = official.where("countryCode IS NOT NULL").groupBy(F.col("countryCode").alias("code")).agg(F.count("*").alias("__o"))
    n = F.coalesce("__g", F.lit(0)) + F.coalesce("__o", F.lit(0))
    return told.join(master, "code", "full_outer").select("code", "title", n.alias("n_clues"))


def code_table(spark: SparkSession, codes=None) -> DataFrame:
    return spark.createDataFrame([(c,) for c in (codes or v.CENTERS)], "code string")
