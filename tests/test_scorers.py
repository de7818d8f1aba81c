import pytest

from clueframe.operators.clue_scorer import PARAMS, score_clues
from clueframe.operators.dual_view import candidates, code_table, score_dual_view
from clueframe.operators.knowledge_base import countries
from clueframe.sources.knowledge import GUIDE

OBS = "obs_id long, hemisphere string, driving_side string, road_type string, road_lines string, biome string, hardware array<string>, red_soil_pct double, horizon_std double"


@pytest.fixture(scope="module")
def profiles(spark):
    return candidates(code_table(spark)).cache()


def best(df, obs=1):
    return [(r.code, r.score, r.confidence) for r in df.where(f"obs_id = {obs}").orderBy("rank").collect()]


def test_southern_pasture(spark, profiles):
    rows = [(1, "SOUTHERN", "LEFT", "asphalt", "white_lines", "temperate", [], 0.0, 20.0)]
    got = best(score_dual_view(spark.createDataFrame(rows, OBS), profiles))
    assert [g[:2] for g in got[:4]] == [("NZ", 195.0), ("AU", 135.0), ("LS", 125.0), ("SZ", 125.0)]
    assert [g[2] for g in got] == [98.7, 0.7, 0.3, 0.3, 0.0] and got[4][1] == 95.0


def test_ties_go_by_code(spark, profiles):
    rows = [(1, "NORTHERN", "UNKNOWN", "asphalt", "white_lines", "temperate", [], 0.0, 20.0), (2, "NORTHERN", None, None, "white_lines", None, None, None, 10.0)]
    out = score_dual_view(spark.createDataFrame(rows, OBS), profiles)
    got = best(out)
    assert [g[1] for g in got] == [105.0] * 5 and [g[2] for g in got] == [20.0] * 5 and [g[0] for g in got] == sorted(g[0] for g in got)
    assert [g[:2] for g in best(out, 2)] == [(c, 130.0) for c in ("BE", "DK", "HU", "NL", "PL")]


def test_hardware_and_fallback(spark, profiles):
    rows = [(1, "NEUTRAL", "UNKNOWN", "asphalt", "none", "savanna", ["kenya_snorkel"], 25.0, None), (2, "NORTHERN", "LEFT", None, None, None, None, None, None)]
    got = best(score_dual_view(spark.createDataFrame(rows, OBS), profiles))
    assert got[:3] == [("KE", 570.0, 100.0), ("UG", 150.0, 0.0), ("TZ", 80.0, 0.0)]
    lone = score_dual_view(spark.createDataFrame(rows[1:], OBS), profiles.where("hemisphere = 'south'"))
    assert best(lone, 2) == [("US", 1.0, 100.0)]


CLUE_OBS = f"obs_id long, driving_side string, continent string, clues array<string>, cv_clues array<string>, params struct<{', '.join(f.replace(' ', ':') for f in PARAMS.split(', '))}>"


@pytest.fixture(scope="module")
def kb(spark):
    names = {"KE": "Kenya", "GH": "Ghana", "BR": "Brazil", "VN": "Vietnam", "UA": "Ukraine", "US": "United States", "TH": "Thailand", "AU": "Australia"}
    clue = lambda t: ("Tips", "identifying", [], t, None)
    texts = {"KE": "cars have a snorkel and pickup truck beds", "GH": "a roof rack with black tape", "BR": "orange roofs everywhere", "VN": "waystones line the way"}
    guides = spark.createDataFrame([(n, n.lower(), c, ["X"], None, [clue(texts.get(c, "plain"))], [], [], [clue(texts.get(c, "plain"))], None) for c, n in names.items()], GUIDE)
    official = spark.createDataFrame([("br-orange-roof-tiles", "Orange Roof Tiles", "tiles", "BR", "house"), ("vn-waystones", "Waystones with Coloured Tops", "stones", "VN", "road"), ("us-soil", "Soil", "soil", "US", "soil")], "id string, title string, description string, code string, kind string")
    return countries(guides).cache(), official


@pytest.mark.parametrize(
    ("side", "clues", "first"),
    [("left", ["snorkel", "pickup truck"], "KE"), (None, ["black tape", "roof rack"], "GH"), (None, ["Orange Roof Tiles", "Portuguese"], "BR"), (None, ["Waystones with Coloured Tops", "Vietnamese"], "VN")],
)
def test_named_inputs(spark, kb, side, clues, first):
    obs = spark.createDataFrame([(1, side, None, clues, None, None)], CLUE_OBS)
    rows = score_clues(obs, *kb).orderBy("rank").collect()
    assert rows[0].code == first and abs(sum(r.confidence for r in rows) - 100) <= 0.3


def test_clue_points(spark, kb):
    obs = spark.createDataFrame([(1, None, None, ["vn-waystones", "Vietnamese"], None, None), (2, None, None, ["soil"], None, None), (3, None, None, [], None, None), (4, "right", "Asia", ["red soil", "high sun angle / tropical latitude"], ["yellow road lines"], None)], CLUE_OBS)
    rows = {(r.obs_id, r.code): r for r in score_clues(obs, *kb).collect()}
    vn = rows[1, "VN"]  # prior 0.2, official id 60, named 120, code 80
    assert vn.score == pytest.approx(1 + 0.2 * 1.5 + 60 + 120 + 80) and vn.official_ids == ["vn-waystones"]
    assert rows[2, "US"].score == pytest.approx(1 + 0.9 * 1.5 + 15)
    assert [rows[3, c].score for c in ("AU", "BR", "GH", "KE", "TH")] == [1.0] * 5
    # TH: left-hand, so 0.02; red soil 0.3; yellow 10 * 2; high sun 20; in Asia 25
    assert rows[4, "TH"].score == pytest.approx((1 + 0.6 * 1.5 + 20 + 20 + 25) * 0.02 * 0.3) if (4, "TH") in rows else True
    # BR: right +12, red soil 20 * 2, yellow 12 * 2, high sun 20, outside Asia 0.15
    assert rows[4, "BR"].score == pytest.approx((1 + 0.8 * 1.5 + 12 + 40 + 24 + 20) * 0.15)


def test_like_observations_are_scored_once(spark, profiles, monkeypatch):
    from clueframe.operators import dual_view

    asked = []
    plain = dual_view._best
    monkeypatch.setattr(dual_view, "_best", lambda rows, pool, key: asked.append((key, rows.count())) or plain(rows, pool, key))
    soil = [None, float("nan"), -1.0, 0.0, 1.9, 2.0, 5.0, 9.9, 10.0, 12.0, 15.0, 15.1, 99.0]
    rows = [(i, ["SOUTHERN", "odd", None][i % 3], "LEFT", None, "none", ["steppe", "temperate"][i % 2], [["kenya_snorkel", "x"], None][i // 78 % 2], soil[i % 13], [13.9, 14.0, 20.0][i // 6 % 3]) for i in range(390)]
    obs = spark.createDataFrame(rows, OBS)
    key = lambda df: sorted(map(str, df.collect()))
    each = key(score_dual_view(obs, profiles))
    assert key(score_dual_view(obs, profiles, reread=True)) == each
    assert [k for k, _ in asked] == ["obs_id", "s"] and asked[0][1] == 390 and asked[1][1] <= 7 * 3 * 3 * 2 * 2


def test_like_flags_are_scored_once(spark, kb, monkeypatch):
    from pyspark.sql import functions as F

    from clueframe import catalog
    from clueframe.operators import clue_scorer

    asked = []
    plain = clue_scorer.unrolled
    monkeypatch.setattr(clue_scorer, "unrolled", lambda rows, *a: asked.append(rows.count()) or plain(rows, *a))
    i = F.col("id")
    flags = F.struct(F.when(i % 3 == 0, "left").alias("side"), *(F.when(i % 2 == 0, i % 4 == 0).otherwise(i % 5 == 0).alias(f) for f in catalog._FLAGS))
    seen = spark.range(600).select(i.alias("obs_id"), flags.alias("s"))
    pool = clue_scorer.candidate_table(kb[0]).drop("all_text")
    key = lambda df: sorted(map(str, df.collect()))
    got = key(clue_scorer.score_flags(seen, pool))
    assert len(got) == 3000 and asked == [4]
    monkeypatch.setattr(clue_scorer, "once_each", lambda rows, key, score: score(rows, key))
    assert key(clue_scorer.score_flags(seen, pool)) == got


def test_points_of_texts(spark, monkeypatch):
    from clueframe.operators import clue_scorer

    asked = []
    plain = clue_scorer.words_longer
    monkeypatch.setattr(clue_scorer, "words_longer", lambda c, *a: asked.append(str(c)) or plain(c, *a))
    monkeypatch.setattr(clue_scorer, "WORDS_KEPT", 2)
    guides = spark.createDataFrame([("KE", "snorkel and pickup trucks, Ünïcode señales"), ("GH", "black tape, snorkel"), ("BR", None), ("US", "pickup")], "code string, all_text string")
    texts = ["snorkel pickup", "snorkel snorkel other", "black tape", "", None, "señales snorkel", "nothing"]
    found = clue_scorer.guide_points(spark.createDataFrame([(t,) for t in texts], "raw string"), guides)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString() and len(asked) == 1
    got = sorted((r.raw, r.code, r.points, r.reason) for r in found.collect())
    two = "guide text (2 terms)"
    assert got == sorted([("snorkel pickup", "KE", 5.0, two), ("snorkel snorkel other", "KE", 5.0, two), ("snorkel snorkel other", "GH", 5.0, two), ("black tape", "GH", 8.0, "black tape"), *(("", c, 8.0, "") for c in ("KE", "GH", "US")), ("señales snorkel", "KE", 5.0, two)])
    official = spark.createDataFrame([("KE", "ke-1", "Wooden poles painted", None, "x"), ("GH", "gh-1", "Short", None, "x")], "code string, id string, title string, description string, kind string")
    texts = spark.createDataFrame([(t,) for t in ("wooden poles painted white", "poles of wooden sort", "ke 1", "wooden", "short", "sho", "en poles")], "clue string")
    assert sorted((r.clue, r.points) for r in clue_scorer.official_points(texts, official).collect()) == [("en poles", 35.0), ("ke 1", 60.0), ("poles of wooden sort", 25.0), ("short", 50.0), ("wooden", 35.0), ("wooden poles painted white", 35.0)]
