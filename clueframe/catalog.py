"""Every query of the library and its SQL twin, over the driver's tables.

The tables hold no countries or guides, so both sides of a comparison build them alike:
a nation stands for a country code of ``CODES``, its guide is made of all documents whose
doc_id leaves the nation's key modulo 25, and the benchmark items are official clues.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays, geo, text
from .operators import clue_scorer, dual_view, evaluation, images, joins, knowledge_base, matches, ranking
from .plans import values as v
from .sources import knowledge

CODES = "US CA MX BR AR CL CO PE GB IE FR ES DE IT PL UA RU TR ZA KE TH ID JP AU NZ".split()
NAMES = "the of and tion ing der die ung heit das la los que ción ado le les eau ment oi ent ed er es re".split()
QUERY = "tion the that und"

# ---- fixtures ----


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _pick(items, index) -> F.Column:
    return F.get(F.array(*(F.lit(x) for x in items)), F.pmod(index, F.lit(len(items))).cast("int"))


def guides(spark: SparkSession, d: str, clues: DataFrame | None = None) -> DataFrame:
    """A guide for each nation: one clue for each of its documents (or other rows with these columns), in order of doc_id."""
    docs = _read(spark, d, "documents") if clues is None else clues
    docs = docs.select(F.pmod("doc_id", F.lit(25)).cast("int").alias("k"), "doc_id", "text", "lang", "source")
    section = F.concat(_pick(["Identifying ", "Regional ", "Spotlight ", "More "], F.crc32("source")), "source")
    clue = F.struct("doc_id", section.alias("section"), knowledge.category(section).alias("category"), F.array("lang").alias("tags"), "text", F.lit(None).cast("string").alias("image_url"))
    clues = docs.groupBy("k").agg(F.sort_array(F.collect_list(clue)).alias("c"))
    clues = clues.withColumn("c", F.transform("c", lambda x: x.dropFields("doc_id")))
    nation, region = _read(spark, d, "nation"), _read(spark, d, "region")
    n = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").alias("k"), F.lower("n_name").alias("slug"), "r_name")
    x = n.join(clues, "k", "left").withColumn("c", F.coalesce("c", F.array().cast(f"array<{knowledge.CLUE}>")))
    part = lambda name: F.filter("c", lambda e: e["category"] == name)
    return x.select(_pick(NAMES, F.col("k")).alias("title"), "slug", _pick(CODES, F.col("k")).alias("code"), F.array("r_name").alias("continents"), part("identifying").alias("tips"), part("regional").alias("regional_clues"), part("spotlight").alias("spotlights"), F.col("c").alias("all_clues"))


def official(spark: SparkSession, d: str) -> DataFrame:
    b = _read(spark, d, "benchmark")
    null = F.lit(None).cast("string")
    return b.select(F.concat(F.lit("item-"), "item_id").alias("id"), F.concat(F.lit("Item "), "item_id").alias("title"), F.col("text").alias("description"), _pick(CODES, F.col("item_id")).alias("countryCode"), null.alias("category"), F.lit("meta").alias("type"), null.alias("image_url"))


_SQL_LIST = lambda items: "[" + ", ".join(f"'{x}'" for x in items) + "]"
_CODE = lambda k: f"{_SQL_LIST(CODES)}[({k}) % 25 + 1]"
_NAME = lambda k: f"{_SQL_LIST(NAMES)}[({k}) % 25 + 1]"
# crc32 picks the section word of a source; SQL has it as a table.
def _section_sql() -> str:
    from zlib import crc32

    words = ["Identifying ", "Regional ", "Spotlight ", "More "]
    cases = " ".join(f"WHEN 'src{i}' THEN '{words[crc32(f'src{i}'.encode()) % 4]}src{i}'" for i in range(20))
    return f"CASE source {cases} END"


_CLUES = f"""clues AS (SELECT {_CODE('doc_id')} AS code, {_NAME('doc_id')} AS title, row_number() OVER (PARTITION BY doc_id % 25 ORDER BY doc_id) - 1 AS pos,
  {_section_sql()} AS section, lang, text FROM documents WHERE text IS NOT NULL OR true)"""
_CATEGORY = "CASE WHEN contains(lower(section), 'identifying') THEN 'identifying' WHEN contains(lower(section), 'region') THEN 'regional' WHEN contains(lower(section), 'spotlight') THEN 'spotlight' ELSE 'other' END"


def _hits_sql(column: str, query: str = QUERY) -> str:
    return " + ".join(f"CASE WHEN contains(lower({column}), '{t}') THEN 1 ELSE 0 END" for t in knowledge_base.terms_of(query))


# ---- queries ----

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {_CLUES}, f AS (
  SELECT 'guide' AS source, title AS country, code, ({_hits_sql('text')})::DOUBLE AS score, section, text, 0 AS o, lpad(pos::VARCHAR, 9, '0') AS w FROM clues
  UNION ALL SELECT 'official', {_CODE('item_id')}, {_CODE('item_id')}, 1.5 * ({_hits_sql("('Item ' || item_id || ' ' || text)")}), 'meta', 'Item ' || item_id || ': ' || text, 1, 'item-' || item_id FROM benchmark)
SELECT source, country, code, score, section, text FROM f WHERE score > 0 ORDER BY score DESC, o, code, w LIMIT 10""")
def kb_search_topk(spark, d):
    return knowledge_base.search(guides(spark, d), official(spark, d), QUERY, 10).drop("image_url")


@query(f"""WITH {_CLUES} SELECT code, {_CATEGORY} AS category, count(*) AS n FROM clues GROUP BY ALL""")
def clue_category_counts(spark, d):
    return knowledge.clue_rows(guides(spark, d)).groupBy("code", "category").agg(F.count("*").alias("n"))


@query(f"""WITH {_CLUES} SELECT code, lang AS tag, count(*)::INT AS n, arg_min(text, pos) AS first FROM clues GROUP BY ALL""")
def tag_group_lists(spark, d):
    return knowledge_base.tag_lists(guides(spark, d)).select("code", "tag", F.size("texts").alias("n"), F.col("texts")[0].alias("first"))


@query(f"""WITH {_CLUES}, t AS (SELECT code, any_value(title) AS title, lower(string_agg(text, ' ' ORDER BY pos)) AS t FROM clues GROUP BY code),
n AS (SELECT {_CODE('n_nationkey')} AS code, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT code, title, 1.0::DOUBLE + 2 * (contains(t, 'idiot')::INT + contains(t, 'ciónado')::INT + contains(t, 'zzz')::INT) AS score
FROM t JOIN n USING (code) WHERE lower(r_name) = 'asia' AND code NOT IN ({', '.join(map(repr, v.LEFT_TRAFFIC_GUIDE))})""")
def facet_filter(spark, d):
    return knowledge_base.facets(guides(spark, d), "right", "Asia", ["idiot", "ciónado", "zzz"]).select("code", "title", "score")


@query(f"""WITH {_CLUES}, p AS (SELECT {_CODE('n_nationkey')} AS a, {_CODE('n_nationkey * 7 + 3')} AS b, {_NAME('n_nationkey * 7 + 3')} AS other FROM nation)
SELECT a, b, count(*) AS n, min(pos)::INT AS first FROM p JOIN clues ON code = a WHERE contains(lower(text), other) GROUP BY ALL""")
def diff_pairs(spark, d):
    k = F.col("n_nationkey")
    pairs = _read(spark, d, "nation").select(_pick(CODES, k).alias("a"), _pick(CODES, k * 7 + 3).alias("b"))
    return knowledge_base.differences(guides(spark, d), pairs).groupBy("a", "b").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


@query(f"""WITH {_CLUES}, p AS (SELECT {_CODE('n_nationkey')} AS a, {_CODE('n_nationkey * 7 + 3')} AS b, {_NAME('n_nationkey')} AS na, {_NAME('n_nationkey * 7 + 3')} AS nb FROM nation),
f AS (SELECT a, b, 0 AS side, pos, text FROM p JOIN clues ON code = a WHERE contains(lower(text), nb) UNION ALL SELECT a, b, 1, pos, text FROM p JOIN clues ON code = b WHERE contains(lower(text), na)),
t AS (SELECT code, arg_min(text, pos) AS text FROM clues WHERE {_CATEGORY} = 'identifying' GROUP BY code), o AS (SELECT a, b FROM p EXCEPT SELECT a, b FROM f)
SELECT a, b, n::INT AS n, md5(text) AS tip FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY side, pos) AS n FROM f) WHERE n <= 10
UNION ALL SELECT a, b, 1, md5(text) FROM o JOIN t ON code = a UNION ALL SELECT a, b, 2, md5(text) FROM o JOIN t ON code = b""")
def compare_pairs(spark, d):
    k = F.col("n_nationkey")
    pairs = _read(spark, d, "nation").select(_pick(CODES, k).alias("a"), _pick(CODES, k * 7 + 3).alias("b"))
    return knowledge_base.compare(guides(spark, d), pairs).select("a", "b", "n", F.md5(F.col("tip").cast("binary")).alias("tip"))


@query(f"""WITH {_CLUES} SELECT code, title, CASE WHEN code IN ({', '.join(map(repr, v.LEFT_TRAFFIC_GUIDE))}) THEN 'left' ELSE 'right' END AS driving_side,
count_if(regexp_matches(lower(text), 'plate|licence|license'))::INT AS n_plates, count_if(contains(lower(text), 'pole'))::INT AS n_poles,
least(5, count_if({_CATEGORY} = 'identifying'))::INT AS n_top FROM clues GROUP BY code, title""")
def country_summaries(spark, d):
    x = knowledge_base.country_summaries(guides(spark, d))
    return x.select("code", "title", "driving_side", F.size("plates").alias("n_plates"), F.size("poles").alias("n_poles"), F.size("top_clues").alias("n_top"))


@query(f"""SELECT {_NAME('n_nationkey')} AS title, {_CODE('n_nationkey')} AS code, lower(n_name) AS slug FROM nation""")
def country_list(spark, d):
    return knowledge_base.country_list(guides(spark, d))


@query(f"""SELECT {_CODE('n_nationkey')} AS code FROM nation WHERE {_CODE('n_nationkey')} NOT IN ({', '.join(map(repr, v.LEFT_TRAFFIC))})""")
def right_traffic(spark, d):
    return knowledge_base.right_traffic(guides(spark, d))


@query(f"""WITH {_CLUES} SELECT 'BR' AS code, 'tion' AS title, (SELECT count(*) FROM clues WHERE code = 'BR')::INT AS n_clues, (SELECT count(*) FROM benchmark WHERE item_id % 25 = 3)::INT AS n_official""")
def country_lookup(spark, d):
    x = knowledge_base.lookup(guides(spark, d), official(spark, d), " Nation_3 ")
    return x.select("code", "title", F.size("all_clues").alias("n_clues"), F.size("official_clues").alias("n_official"))


_PLAIN = "trim(regexp_replace(lower(regexp_replace(strip_accents({0}), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""SELECT page_id, title, {_PLAIN.format('title')} AS plain, coalesce(nullif(regexp_extract(url, 'duels/([a-zA-Z0-9\\-]+)', 1), ''), trim(url)) AS token
FROM (SELECT page_id, url, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages)""")
def page_title(spark, d):
    x = _read(spark, d, "pages").select("page_id", "url", knowledge.page_title(F.col("html")).alias("title"))
    return x.select("page_id", "title", text.normalize(F.col("title")).alias("plain"), text.game_token(F.col("url")).alias("token"))


@query(f"""SELECT doc_id, md5({_PLAIN.format('text')}) AS plain,
len(list_filter(list_transform(string_split(text, ','), lambda p: trim(p, ' ')), lambda p: p <> ''))::INT AS parts FROM documents WHERE text IS NOT NULL""")
def normalized_documents(spark, d):
    x = _read(spark, d, "documents").where("text IS NOT NULL")
    return x.select("doc_id", F.md5(text.normalize(F.col("text")).cast("binary")).alias("plain"), F.size(text.comma_parts(F.col("text"))).alias("parts"))


# An event as a dual-view observation: fields follow from its id and user.
_CHOICES = {
    "hemisphere": ("event_id", ["NORTHERN", "SOUTHERN", "NEUTRAL"]),
    "driving_side": ("user_id", ["LEFT", "RIGHT", "UNKNOWN"]),
    "road_type": ("event_id + user_id", ["asphalt", "unpaved_dirt"]),
    "road_lines": ("user_id * 3 + event_id", ["none", "white_lines", "yellow_center", "us_yellow_center_white_edge", "irish_yellow_dashed_edge"]),
    "biome": ("event_id * 7 + user_id", ["temperate", "boreal", "tropical", "savanna", "steppe"]),
}


def event_observations(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events").select(F.col("event_id").alias("obs_id"), "event_id", "user_id", "value")
    hardware = F.when(F.col("obs_id") % 11 == 0, F.array(F.lit(dual_view.POLE))).when(F.col("obs_id") % 13 == 0, F.array(F.lit(dual_view.SNORKEL))).otherwise(F.array().cast("array<string>"))
    return e.select("obs_id", *(_pick(items, F.expr(k)).alias(c) for c, (k, items) in _CHOICES.items()), hardware.alias("hardware"), (F.col("value") / 4).alias("red_soil_pct"), (F.col("user_id") % 30).cast("double").alias("horizon_std"))


def _profile_sql() -> str:
    rows = ", ".join(f"('{c}', {y}, {x})" for c, (y, x) in v.CENTERS.items())
    inside = lambda codes: f"code IN ({', '.join(map(repr, codes))})"
    s = v.PROFILE_SETS
    return f"""c0 AS (SELECT code, lat::DOUBLE AS lat, lng::DOUBLE AS lng FROM (VALUES {rows}) AS t(code, lat, lng)),
c1 AS (SELECT code, lat, lng, CASE WHEN lat < -12 THEN 'south' WHEN lat > 18 THEN 'north' ELSE 'equator' END AS hemisphere, CASE WHEN {inside(v.LEFT_TRAFFIC)} THEN 'left' ELSE 'right' END AS driving_side,
  lat BETWEEN -15 AND 20 AND {inside(s['tropical'])} AS is_tropical, lat >= 45 AND {inside(s['boreal'])} AS is_boreal, {inside(s['savanna'])} AS is_savanna,
  {', '.join(f"{inside(s[n])} AS {n}" for n in ('yellow_center', 'white_only', 'red_soil', 'unpaved', 'flat'))} FROM c0),
c AS (SELECT *, (lat > 20 AND NOT is_boreal AND NOT is_tropical) OR (lat < -20 AND NOT is_savanna) AS is_temperate FROM c1)"""


def _observation_sql() -> str:
    picks = ", ".join(f"{_SQL_LIST(items)}[({k}) % {len(items)} + 1] AS {c}" for c, (k, items) in _CHOICES.items())
    return f"s AS (SELECT event_id AS obs_id, {picks}, value / 4 AS red_soil_pct, (user_id % 30)::DOUBLE AS horizon_std FROM events)"


def _chains_sql(chains) -> tuple[str, str]:
    """Sum and product of chains, written out: the SQL twin evaluates each arm's condition where it stands."""
    plain = lambda x: x.replace("20D", "20.0").replace("15D", "15.0").replace(", 0D)", ", 0.0)").replace("25D", "25.0").replace("1D", "1.0")
    add, mul = [], []
    for arms in chains.values():
        add.append("CASE " + " ".join(f"WHEN {a.condition()} THEN ({a.add}){' + ' + plain(a.more) if a.more else ''}" for a in arms) + " ELSE 0 END")
        if any(a.mul != 1 for a in arms):
            mul.append("CASE " + " ".join(f"WHEN {a.condition()} THEN {a.mul}::DOUBLE" for a in arms) + " ELSE 1 END")
    return " + ".join(add), " * ".join(mul or ["1.0"])


def _top_sql(temperature: float, extra: str = "") -> str:
    return f"""t AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY score DESC, code) AS rank FROM x),
e AS (SELECT *, exp((score - max(score) OVER (PARTITION BY obs_id)) / {temperature}) AS e FROM t WHERE rank <= 5)
SELECT obs_id, rank::INT AS rank, code, score, round(e / sum(e) OVER (PARTITION BY obs_id) * 100, 1) AS confidence{extra} FROM e"""


_DUAL_ADD, _ = _chains_sql(dual_view.CHAINS)


@query(f"""WITH {_profile_sql()}, {_observation_sql()}, b AS (
  SELECT s.obs_id, c.code, 10.0::DOUBLE + {_DUAL_ADD} AS score FROM s CROSS JOIN c
  WHERE (s.driving_side NOT IN ('LEFT', 'RIGHT') OR lower(s.driving_side) = c.driving_side) AND NOT (s.hemisphere = 'NORTHERN' AND c.hemisphere = 'south') AND NOT (s.hemisphere = 'SOUTHERN' AND c.hemisphere = 'north')),
x AS (SELECT obs_id, code, CASE WHEN obs_id % 11 = 0 THEN CASE WHEN code = 'TW' THEN score + 450 WHEN code IN ('JP', 'KR') THEN score + 30 ELSE score * 0.05 END
  WHEN obs_id % 13 = 0 THEN CASE WHEN code = 'KE' THEN score + 450 WHEN code IN ('UG', 'TZ') THEN score + 30 ELSE score * 0.05 END ELSE score END AS score FROM b), {_top_sql(12.0)}""")
def evidence_score_softmax(spark, d):
    pool = dual_view.candidates(dual_view.code_table(spark))
    return dual_view.score_dual_view(event_observations(spark, d), pool, reread=True).select("obs_id", "rank", "code", "score", "confidence")


_FLAGS = [f for f in "sun_south sun_north sun_over sun_low own_snorkel red_hood red_soil yellow white concrete arid lush unpaved red_car snorkel tape yellow_center edges curbs sign mediterranean temperate tropical gutter outback sandstone panels poles southern_africa southern_road".split()]
_BOOLS = {"north": v.NORTHERN, "south": v.SOUTHERN, "equatorial": v.EQUATORIAL, "high_north": v.HIGH_NORTH, "white_europe": v.WHITE_LINES_EUROPE}
_WEIGHTS = {"w_red": v.RED_SOIL, "w_yellow": v.YELLOW_LINES, "w_arid": v.ARID, "w_tropical": v.TROPICAL_LUSH, "w_lush": v.LUSH, "w_unpaved": v.UNPAVED}


def _clue_candidates_sql() -> str:
    rows = ", ".join(f"('{c}', {v.PRIORS.get(c, v.PRIOR_DEFAULT)}, " + ", ".join(str(w.get(c, "NULL")) for w in _WEIGHTS.values()) + ")" for c in CODES)
    bools = ", ".join(f"code IN ({', '.join(map(repr, s))}) AS {n}" for n, s in _BOOLS.items())
    return f"""{_CLUES}, g AS (SELECT code, lower(string_agg(text, ' ' ORDER BY pos)) AS t FROM clues GROUP BY code),
c AS (SELECT k.*, CASE WHEN code IN ({', '.join(map(repr, v.LEFT_TRAFFIC_GUIDE))}) OR regexp_matches(t, 'drives? on the left|left-hand traffic') THEN 'left' ELSE 'right' END AS side, {bools},
  contains(t, 'red soil') AS says_red, contains(t, 'yellow') AS says_yellow FROM (VALUES {rows}) AS k(code, prior, {', '.join(_WEIGHTS)}) JOIN g USING (code))"""


_RULE_ADD, _RULE_MUL = _chains_sql(clue_scorer.CHAINS)


@query(f"""WITH {_clue_candidates_sql()}, s AS (SELECT event_id AS obs_id, CASE user_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END AS side, {', '.join(f"(event_id * {i + 3} + user_id) % {5 + i % 7} = 0 AS {f}" for i, f in enumerate(_FLAGS))} FROM events),
x AS (SELECT s.obs_id, c.code, (1 + c.prior::DOUBLE * 1.5 + {_RULE_ADD}) * {_RULE_MUL} AS score FROM s CROSS JOIN c), {_top_sql(8.0)}""")
def multiplicative_score(spark, d):
    pool = clue_scorer.candidate_table(knowledge_base.countries(guides(spark, d))).drop("all_text")
    e = _read(spark, d, "events")
    side = F.when(F.col("user_id") % 3 == 0, "left").when(F.col("user_id") % 3 == 1, "right")
    flags = [((F.col("event_id") * (i + 3) + F.col("user_id")) % (5 + i % 7) == 0).alias(f) for i, f in enumerate(_FLAGS)]
    rows = e.select(F.col("event_id").alias("obs_id"), F.struct(side.alias("side"), *flags).alias("s"))
    return clue_scorer.score_flags(rows, pool)


@query()
def clue_scores(spark, d):
    """Conversations as observations, their turns as clues; the guides are those of the benchmark's items."""
    c = _read(spark, d, "conversations").where("text IS NOT NULL")
    obs = c.groupBy(F.col("conv_id").alias("obs_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("clues"))
    obs = obs.select("obs_id", F.lit(None).cast("string").alias("driving_side"), F.lit(None).cast("string").alias("continent"), "clues", F.array(F.lit("white road lines")).alias("cv_clues"), F.from_json(F.lit("{}"), clue_scorer.PARAMS).alias("params"))
    kinds = official(spark, d).select("id", "title", "description", F.col("countryCode").alias("code"), F.col("type").alias("kind"))
    items = _read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("item").alias("lang"), F.lit("items").alias("source"))
    return clue_scorer.score_clues(obs, knowledge_base.countries(guides(spark, d, items)), kinds).select("obs_id", "rank", "code", "title", "region", "score", "confidence", "reasons", "official_ids")


_ROUNDS = f"r AS (SELECT event_id, {_CODE('event_id')} AS true_code, {_CODE('event_id * 7 + user_id')} AS predicted_code, event_type, value, user_id FROM events)"
_EDGES = f"(SELECT {_CODE('n_nationkey')} AS src, {_CODE('n_nationkey + 1')} AS dst FROM nation)"


def _rounds(spark, d) -> DataFrame:
    k = F.col("event_id")
    return _read(spark, d, "events").select("event_id", _pick(CODES, k).alias("true_code"), _pick(CODES, k * 7 + F.col("user_id")).alias("predicted_code"), "event_type", "value", "user_id")


def _edges(spark, d) -> DataFrame:
    k = F.col("n_nationkey")
    return _read(spark, d, "nation").select(_pick(CODES, k).alias("src"), _pick(CODES, k + 1).alias("dst"))


_MEMBERS = "(VALUES " + ", ".join(f"('{n}', {i}, '{c}')" for i, (n, codes) in enumerate(v.CLUSTERS.items()) for c in codes.split()) + ") AS m(cluster, ord, code)"


@query(f"""WITH {_ROUNDS}, m AS (SELECT * FROM {_MEMBERS}), k AS (SELECT a.code AS t, b.code AS p, arg_min(a.cluster, a.ord) AS cluster FROM m a JOIN m b USING (cluster) GROUP BY ALL)
SELECT verdict, correct, count(*) AS n FROM (SELECT CASE WHEN true_code = predicted_code THEN 'EXACT' WHEN e.src IS NOT NULL THEN 'NEIGHBOR (borders ' || true_code || ')' WHEN k.cluster IS NOT NULL THEN 'REGIONAL CLUSTER (' || k.cluster || ')' ELSE 'DIFFERENT REGION' END AS verdict,
  true_code = predicted_code OR e.src IS NOT NULL OR k.cluster IS NOT NULL AS correct FROM r LEFT JOIN {_EDGES} e ON src = true_code AND dst = predicted_code LEFT JOIN k ON k.t = true_code AND k.p = predicted_code) GROUP BY ALL""")
def neighbour_and_cluster_eval(spark, d):
    return evaluation.verdicts(_rounds(spark, d), _edges(spark, d)).groupBy("verdict", "correct").agg(F.count("*").alias("n"))


_KM = "round(12742.0 * atan2(sqrt({a}), sqrt(1 - ({a}))), 1)"
_A = "pow(sin(radians(y - lat) / 2), 2) + cos(radians(lat)) * cos(radians(y)) * pow(sin(radians(x - lng) / 2), 2)"


@query(f"""WITH {_ROUNDS}, c AS (SELECT code, y::DOUBLE AS y, x::DOUBLE AS x FROM (VALUES {', '.join(f"('{c}', {y}, {x})" for c, (y, x) in v.CENTERS.items())}) AS t(code, y, x))
SELECT event_id, true_code = predicted_code AS exact, true_code <> predicted_code AND src IS NOT NULL AS neighbor, {_KM.format(a=_A)} AS distance_km
FROM (SELECT *, (value % 160) - 80 AS lat, (user_id * 7 % 360 - 180)::DOUBLE AS lng FROM r) q JOIN c ON code = predicted_code LEFT JOIN {_EDGES} e ON src = true_code AND dst = predicted_code""")
def haversine_eval(spark, d):
    r = _rounds(spark, d).withColumns({"lat": F.col("value") % 160 - 80, "lng": (F.col("user_id") * 7 % 360 - 180).cast("double")})
    return evaluation.calibration(r, _edges(spark, d)).select("event_id", "exact", "neighbor", "distance_km")


@query(f"""WITH c AS (SELECT code, y::DOUBLE AS y, x::DOUBLE AS x FROM (VALUES {', '.join(f"('{c}', {y}, {x})" for c, (y, x) in v.CENTERS.items())}) AS t(code, y, x)),
p AS (SELECT c_custkey, (c_custkey * 37 % 180 - 90)::DOUBLE AS lat, (c_custkey * 91 % 360 - 180)::DOUBLE AS lng FROM customer)
SELECT c_custkey, arg_min(code, {{'d': (lat - y) * (lat - y) + (lng - x) * (lng - x), 'n': code}}) AS nearest, round(min((lat - y) * (lat - y) + (lng - x) * (lng - x)), 6) AS nearest_d FROM p CROSS JOIN c GROUP BY c_custkey""")
def nearest_centroid(spark, d):
    k = F.col("c_custkey")
    points = _read(spark, d, "customer").select("c_custkey", (k * 37 % 180 - 90).cast("double").alias("lat"), (k * 91 % 360 - 180).cast("double").alias("lng"))
    places = spark.createDataFrame([(c, *x) for c, x in v.CENTERS.items()], "code string, lat double, lng double")
    return joins.nearest(points, places, "c_custkey", "code").select("c_custkey", "nearest", F.round("nearest_d", 6).alias("nearest_d"))


@query(f"""WITH {_ROUNDS} SELECT count(*) AS rounds, count_if(true_code = predicted_code) AS top1, count_if(true_code = predicted_code OR event_type = 'view') AS top3,
round(count_if(true_code = predicted_code)::DOUBLE * 100 / count(*), 1) AS top1_pct, round(count_if(true_code = predicted_code OR event_type = 'view')::DOUBLE * 100 / count(*), 1) AS top3_pct, round(avg(value), 1) AS mean_ms FROM r""")
def topk_accuracy(spark, d):
    hit = F.col("true_code") == F.col("predicted_code")
    return evaluation.accuracy(_rounds(spark, d).select(hit.alias("is_top1"), (hit | (F.col("event_type") == "view")).alias("is_top3"), F.col("value").alias("elapsed_ms")))


@query("""SELECT user_id, event_id, round(avg((event_type = 'click')::INT) OVER w * 100, 1) AS running_pct, sum(event_id % 5000) OVER w AS running_total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def running_accuracy(spark, d):
    e = _read(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "click").alias("hit"), (F.col("event_id") % 5000).alias("points"))
    return evaluation.running(e, "event_id", ["user_id"], points="points").select("user_id", "event_id", "running_pct", "running_total")


@query("""SELECT user_id, count(*) AS rounds, sum(event_id % 5000) AS total_score, round(avg(value), 1) AS mean_km, count_if(event_type = 'click') AS matches, round(count_if(event_type = 'click')::DOUBLE * 100 / count(*), 0) AS match_pct FROM events GROUP BY user_id""")
def scoreboard(spark, d):
    e = _read(spark, d, "events").select("user_id", (F.col("event_id") % 5000).alias("score_points"), F.col("value").alias("distance_km"), (F.col("event_type") == "click").alias("is_match"))
    return evaluation.scoreboard(e, ["user_id"])


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1""")
def first_seen(spark, d):
    return ranking.first_of_each(_read(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""SELECT user_id, list(event_id ORDER BY n) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 5 GROUP BY user_id""")
def cap5_per_group(spark, d):
    x = ranking.sampled(_read(spark, d, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], ["event_id"])
    return x.select("user_id", F.transform("samples", lambda s: s["event_id"]).alias("ids"))


@query("""SELECT DISTINCT 'g' || (props->>'k') AS game_id FROM events WHERE props->>'k' IS NOT NULL""")
def json_nested_ids(spark, d):
    k = F.get_json_object("props", "$.k")
    one, many = F.format_string('{"gameId":"g%s"}', k), F.format_string('[{"payload":{"gameId":"g%s"}}]', k)
    twice = F.to_json(F.struct(one.alias("x")))
    payload = F.when(F.col("event_id") % 4 == 0, one).when(F.col("event_id") % 4 == 1, many).when(F.col("event_id") % 4 == 2, F.regexp_extract(twice, '^\\{"x":(.*)\\}$', 1)).otherwise(F.concat(one, F.lit("")))
    feed = _read(spark, d, "events").where(k.isNotNull()).select(payload.alias("payload"))
    return matches.game_ids(feed.union(spark.createDataFrame([("{broken",), (None,)], "payload string")))


@query("""WITH p AS (SELECT conv_id, role, text, turn FROM conversations)
SELECT k AS key, md5(coalesce((SELECT arg_min(text, turn) FROM p WHERE conv_id = k AND role = 'assistant' AND text IS NOT NULL), (SELECT arg_min(text, turn) FROM p WHERE conv_id = k AND text IS NOT NULL), k::VARCHAR)) AS phrase FROM (SELECT DISTINCT conv_id AS k FROM conversations UNION SELECT -1)""")
def translation_fallback(spark, d):
    c = _read(spark, d, "conversations")
    phrases = c.where("text IS NOT NULL").select(F.col("conv_id").alias("key"), F.col("role").alias("lang"), F.col("text").alias("phrase"), F.col("turn").alias("ord"))
    keys = c.select(F.col("conv_id").alias("key")).distinct().union(spark.createDataFrame([(-1,)], "key long"))
    x = matches.translated(keys.withColumn("name", F.col("key").cast("string")), phrases.withColumn("key", F.col("key").cast("string")), "name", "assistant")
    return x.select("key", F.md5(F.col("phrase").cast("binary")).alias("phrase"))


@query("""SELECT n_nationkey, n_name AS decoded, 'zz' || n_name AS kept FROM nation""")
def hex_decode(spark, d):
    x = _read(spark, d, "nation")
    return x.select("n_nationkey", text.unhexed(F.hex("n_name")).alias("decoded"), text.unhexed(F.concat(F.lit("zz"), "n_name")).alias("kept"))


@query("""SELECT source, count(*) AS documents, count(quality) AS labelled, coalesce(sum(quality), 0)::BIGINT AS sound FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def label_join_quality(spark, d):
    x = _read(spark, d, "documents").select("doc_id", "source").join(_read(spark, d, "labels"), "doc_id", "left")
    return x.groupBy("source").agg(F.count("*").alias("documents"), F.count("quality").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).alias("sound"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT vec_id, round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS sd, arg_max(i, {'e': e, 'i': -i})::INT AS argmax, round(avg((e > 0.1)::INT) * 100, 4) AS mask_pct, list(e ORDER BY i)[1] IS NOT NULL AS filled FROM x GROUP BY vec_id""")
def array_mask_metrics(spark, d):
    e = F.col("embedding")
    x = _read(spark, d, "embeddings").where(F.size(e) > 0)
    return x.select("vec_id", F.round(arrays.mean(e), 6).alias("mean"), F.round(arrays.deviation(e), 6).alias("sd"), arrays.first_largest(e).alias("argmax"), F.round(arrays.share_above(e, 0.1), 4).alias("mask_pct"), e[0].isNotNull().alias("filled"))


@query("""WITH b AS (SELECT label, least(greatest(floor((e + 0.5) * 10), 0), 9)::INT AS bin FROM (SELECT label, unnest(embedding)::DOUBLE AS e FROM embeddings)),
c AS (SELECT label, bin, count(*) AS n FROM b GROUP BY ALL)
SELECT l.label, r.bin::INT AS bin, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT label FROM embeddings) l CROSS JOIN range(10) r(bin) LEFT JOIN c ON c.label IS NOT DISTINCT FROM l.label AND c.bin = r.bin""")
def fixed_bin_histogram(spark, d):
    return arrays.histogram(_read(spark, d, "embeddings"), "label", "embedding", -0.5, 0.5, 10)


@query("""SELECT a.i AS current, b.i AS target, CASE WHEN (b.i - a.i + 8) % 8 <= 4 THEN -((b.i - a.i + 8) % 8) ELSE 8 - (b.i - a.i + 8) % 8 END AS turn FROM (SELECT DISTINCT n_nationkey % 8 AS i FROM nation) a CROSS JOIN (SELECT DISTINCT n_nationkey % 8 AS i FROM nation) b""")
def heading_turns(spark, d):
    x = _read(spark, d, "nation").select((F.col("n_nationkey") % 8).alias("i")).distinct()
    return x.select(F.col("i").alias("current")).crossJoin(F.broadcast(x.select(F.col("i").alias("target")))).withColumn("turn", geo.heading_turn(F.col("current"), F.col("target")))


def _match_rounds(spark, d) -> DataFrame:
    """Events as rounds: a user is a game, an event a round, its clues follow from its number."""
    e = _read(spark, d, "events")
    clue = lambda i: F.struct(F.concat(F.lit("C_"), ((F.col("event_id") * i) % 97).cast("string")).alias("id"), F.lit("t").alias("title"), F.col("event_type").alias("type"))
    return e.select(F.col("user_id").alias("gameId"), F.col("event_id").alias("round"), F.concat(F.lit("p"), "event_id").alias("panoId"), F.col("value").alias("lat"), F.col("value").alias("lng"), _pick(CODES, F.col("event_id")).alias("countryCode"), F.array(clue(1), clue(3)).alias("clues"))


_MATCH = f"""c AS (SELECT user_id, event_id, {_CODE('event_id')} AS code, 'C_' || (event_id * i % 97) AS id, i FROM events, (VALUES (1), (3)) AS t(i))"""


@query(f"""WITH {_MATCH}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY user_id, event_id, i) AS n FROM c)
SELECT id, max(CASE WHEN n = 1 THEN code END) AS "countryCode", list('p' || event_id ORDER BY n) FILTER (WHERE n <= 5) AS panos FROM n GROUP BY id""")
def clue_catalogue(spark, d):
    x = matches.clue_catalogue(_match_rounds(spark, d))
    return x.select("id", "countryCode", F.transform("sample_panoramas", lambda p: p["panoId"]).alias("panos"))


@query(f"""WITH {_MATCH} SELECT count(DISTINCT user_id) AS games, count(DISTINCT event_id) AS panoramas, count(DISTINCT id) AS clues FROM c""")
def harvest_counts(spark, d):
    return matches.harvest_counts(_match_rounds(spark, d))


@query(f"""WITH {_MATCH}, o AS (SELECT DISTINCT 'c-' || (item_id % 97) AS k, 'Item of ' || (item_id % 97) AS t FROM benchmark)
SELECT user_id AS "gameId", event_id AS round, list(coalesce(t, 't') ORDER BY i) AS texts FROM (SELECT c.*, CASE WHEN length(coalesce(o.t, 't')) > 3 THEN o.t END AS t FROM c LEFT JOIN o ON o.k = replace(lower(c.id), '_', '-')) WHERE t IS NOT NULL GROUP BY ALL
UNION ALL SELECT user_id, event_id, [] FROM c LEFT JOIN o ON o.k = replace(lower(c.id), '_', '-') GROUP BY user_id, event_id HAVING count(o.k) = 0""")
def clue_texts(spark, d):
    b = _read(spark, d, "benchmark")
    k = (F.col("item_id") % 97).cast("string")
    o = b.select(F.concat(F.lit("c-"), k).alias("id"), F.concat(F.lit("Item of "), k).alias("title")).distinct()
    return matches.clue_texts(_match_rounds(spark, d), o)


IMAGES_AT_ONCE = 8


def _drawn(e) -> bytes:
    e = np.array(e).reshape(8, 8)
    c = (np.abs(np.stack([e[:, :3].sum(1), e[:, 3:6].sum(1), e[:, 6:].sum(1)], axis=1) * 900) % 256).astype(np.uint8)
    rows = np.repeat(c, [60, 60, 30, 30, 60, 60, 60, 40], axis=0)
    x = np.repeat(rows[:, None, :], 800, axis=1).copy()
    x[260:360, 390:410] = (40, 200, 220)
    return x.tobytes()


def drawn_batches(batches):
    """Images of batches (vec_id, embedding).  A row becomes a megabyte: few are held at a time, however many come in a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, IMAGES_AT_ONCE):
            part = batch.slice(at, IMAGES_AT_ONCE)
            out = [_drawn(e) for e in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in part.column(0).to_pylist()]), *(pa.array([k] * len(out), pa.int32()) for k in (400, 800, 3)), pa.array(out, pa.binary())], names=["path", "height", "width", "channels", "data"])


def synthetic_images(spark: SparkSession, d: str) -> DataFrame:
    """An image of coloured blocks for each embedding: sky, horizon, road and hood follow from its numbers."""
    # The few rows of one file are dealt to all cores first.
    rows = _read(spark, d, "embeddings").select("vec_id", "embedding").repartition(4 * spark.sparkContext.defaultParallelism, "vec_id")
    return rows.mapInArrow(drawn_batches, "path string, height int, width int, channels int, data binary")


@query()
def image_single_view(spark, d):
    x = images.single_view(images.measure_single(synthetic_images(spark, d)))
    return x.select("path", "clues", "parameters.*")


def _pairs(spark, d) -> DataFrame:
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("pair_id"), F.col("vec_id").cast("string").alias("north"), (F.col("vec_id") - F.col("vec_id") % 2 + (F.col("vec_id") + 1) % 2).cast("string").alias("south"))


@query()
def image_pair_merge(spark, d):
    x = images.merged_views(_pairs(spark, d), images.single_view(images.measure_single(synthetic_images(spark, d))))
    return x.select("pair_id", "clues", "parameters.hemisphere_deduction", "parameters.road_type")


@query()
def image_dual_view_scores(spark, d):
    obs = images.dual_view(_pairs(spark, d), images.measure_dual(synthetic_images(spark, d)))
    return dual_view.score_dual_view(obs, dual_view.candidates(dual_view.code_table(spark))).select("obs_id", "rank", "code", "score", "confidence", "reasons")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_score_softmax(spark, sf_dir)
