import json

from pyspark.sql import functions as F

from clueframe.functions import geo, text
from clueframe.operators import evaluation, knowledge_base, matches
from clueframe.sources import knowledge as k


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalize(spark):
    rows = {"Straße": "strae", " Curaçao — São Tomé!": "curacao sao tome", "ﬁne ½": "fine 1 2", None: "", "İstanbul Привет": "istanbul", "a__b": "a b"}
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = {r.t: r.x for r in df.select("t", text.normalize(F.col("t")).alias("x")).collect()}
    import re
    import unicodedata

    for t, x in got.items():
        plain = unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode()
        assert x == re.sub("[^a-z0-9]+", " ", plain.lower()).strip(), (t, x)


def test_scalars(spark):
    assert one(spark, text.game_token(F.lit("https://h/en/duels/abc-123/summary"))) == "abc-123"
    assert one(spark, text.game_token(F.lit("  x "))) == "x"
    assert one(spark, text.unhexed(F.hex(F.lit("panö")))) == "panö" and one(spark, text.unhexed(F.lit("zz"))) == "zz"
    assert one(spark, text.comma_parts(F.lit("a, ,b ,"))) == ["a", "b"]
    assert [one(spark, geo.heading_turn(F.lit(0), F.lit(t))) for t in (4, 1, 7, 0)] == [-4, -1, 1, 0]
    assert one(spark, text.image_type(F.lit("a.PNG"))) == "image/png"
    assert one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == 20015.1


PAGE = {
    "title": "Land", "slug": "land", "code": "LA", "continents": ["X"], "heroImage": "/h.png",
    "steps": [
        {"title": "Identifying the land", "items": [{"text": "a pole", "texts": ["and more"], "tags": ["pole"], "imageUrl": "/i.png"}, {"text": "", "texts": None}]},
        {"title": "Regional clues", "items": [{"text": "north", "tags": None, "image": "http://x/y.png"}]},
        {"title": "Rest", "items": None},
    ],
}


def test_parse_guides(spark):
    page = lambda d: f'<html><script id="D" type="x">{json.dumps(d)}</script></html>'
    rows = [(page(PAGE),), (page({**PAGE, "code": "XX-1"}),), ("<p>none</p>",), (None,), ('<script id="D">{broken</script>',)]
    got = k.parse_guides(spark.createDataFrame(rows, "html string"), "D", "https://b").collect()
    assert [g.code for g in got] == ["LA"]
    clues = [(c.section, c.category, c.tags, c.text, c.image_url) for c in got[0].all_clues]
    assert clues == [("Identifying the land", "identifying", ["pole"], "a pole and more", "https://b/i.png"), ("Regional clues", "regional", [], "north", "http://x/y.png")]
    assert len(got[0].tips) == 1 and len(got[0].regional_clues) == 1


def test_read_json_is_lenient(spark, tmp_path):
    assert k.read_guides(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "g.json").write_text(json.dumps([{"title": "A", "code": "AA", "all_clues": [{"text": "t"}]}, {"title": "B"}]))
    assert {(g.title, g.code) for g in k.read_guides(spark, f"{tmp_path}/g.json").collect()} == {("A", "AA"), ("B", None)}
    (tmp_path / "c.json").write_text(json.dumps({"payload": {"clues_by_id": {"x": {"title": "T"}}}}))
    got = k.read_keyed(spark, f"{tmp_path}/c.json", "struct<title:string>", ["all_clues", "clues_by_id"]).collect()
    assert [(r.key, r.value.title) for r in got] == [("x", "T")]


def test_bundle_and_literals(spark):
    entry = 'code:"{}",capital:"C{}",currency:"M",drivingSide:"left",domain:".x",callingCode:"+1",languages:["i18n:en","fr"]'
    bundle = "junk{a:1};x={" + entry.format("gb", 1) + "},{" + entry.format("fr", 2) + "}marker more{" + entry.format("de", 3) + "}"
    got = k.profiles_from_bundle(spark.createDataFrame([(bundle,)], "text string"), 'capital:"C1"').collect()
    assert [(r.code, r.capital, r.languages) for r in got] == [("GB", "C1", ["en", "fr"]), ("FR", "C2", ["en", "fr"]), ("DE", "C3", ["en", "fr"])]
    steps = k.tutorial_steps(spark.createDataFrame([("{lesson:'l1',on:!0,list:[1,2,],}",), ("{bad",)], "literal string"), spark.createDataFrame([("l1", "First")], "key string, label string")).collect()
    assert [s.lesson_name for s in steps] == ["First"]


def guides(spark):
    clue = lambda s, t, tags=(): (s, "identifying", list(tags), t, None)
    rows = [
        ("Land", "land", "LA", ["Asia"], None, [clue("S", "Unlike Other, a pole"), clue("S", "bollards")], [], [], [clue("S", "Unlike Other, a pole", ["pole"]), clue("S", "bollards")], None),
        ("Other", "other", "OT", ["Europe"], None, [clue("S", "they drive on the left")], [], [], [clue("S", "they drive on the left")], None),
        ("Third", "third", "TH", ["asia"], None, [], [], [], [], None),
    ]
    return spark.createDataFrame(rows, k.GUIDE)


def test_queries(spark):
    g = guides(spark)
    o = spark.createDataFrame([("o1", "Bollard", "white pole", "LA", None, "sign", None)], "id string, title string, description string, countryCode string, category string, type string, image_url string")
    found = knowledge_base.search(g, o, "a pole bollard").collect()
    assert [(r.source, r.score) for r in found] == [("official", 3.0), ("guide", 1.0), ("guide", 1.0)]
    assert knowledge_base.search(g, o, "a an").count() == 0
    assert [(r.code, r.score) for r in knowledge_base.facets(g, "right", "ASIA", ["pole", "nothing"]).collect()] == [("LA", 3.0)]
    assert [r.code for r in knowledge_base.facets(g, "left").collect()] == ["OT", "TH"]
    assert knowledge_base.lookup(g, o, " ot ").first().title == "Other" and knowledge_base.lookup(g, o, "LAND").first().official_clues[0].id == "o1"
    pairs = spark.createDataFrame([("LA", "OT"), ("OT", "TH")], "a string, b string")
    assert [(r.a, r.b, r.tip) for r in knowledge_base.compare(g, pairs).orderBy("a", "n").collect()] == [("LA", "OT", "Unlike Other, a pole"), ("OT", "TH", "they drive on the left")]
    s = {r.code: r for r in knowledge_base.country_summaries(g).collect()}
    assert s["LA"].poles == ["Unlike Other, a pole"] and s["LA"].bollards == ["bollards"] and s["OT"].driving_side == "left"


def test_verdicts(spark):
    edges = spark.createDataFrame([("LV", "EE"), ("IS", "GB")], "src string, dst string")
    rows = [("LV", "EE"), ("IS", "GB"), ("GB", "IS"), ("GB", "PT"), (" fr", "FR"), ("", "FR"), (None, None)]
    got = evaluation.verdicts(spark.createDataFrame(rows, "true_code string, predicted_code string"), edges).collect()
    want = {("LV", "EE"): "NEIGHBOR (borders LV)", ("IS", "GB"): "NEIGHBOR (borders IS)", ("GB", "IS"): "REGIONAL CLUSTER (northern_europe)", ("GB", "PT"): "DIFFERENT REGION", (" fr", "FR"): "EXACT", ("", "FR"): "DIFFERENT REGION", (None, None): "DIFFERENT REGION"}
    assert {(r.true_code, r.predicted_code): r.verdict for r in got} == want and sum(r.correct for r in got) == 4
    assert evaluation.accuracy(spark.createDataFrame([], "is_top1 boolean, is_top3 boolean, elapsed_ms double")).first().top1_pct == 0


def test_matches(spark):
    feed = spark.createDataFrame([('{"gameId":"a"}',), ('"[{\\"gameId\\":\\"b\\"},{\\"payload\\":{\\"gameId\\":\\"c\\"}}]"',), ("broken{",), (None,), ('{"gameId":"a"}',), ("3",)], "payload string")
    assert sorted(r.game_id for r in matches.game_ids(feed).collect()) == ["a", "b", "c"]
    keys = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key string")
    phrases = spark.createDataFrame([("k1", "de", "eins", 0), ("k1", "en", "one", 1), ("k2", "de", "zwei", 0)], "key string, lang string, phrase string, ord int")
    assert {r.key: r.phrase for r in matches.translated(keys, phrases).collect()} == {"k1": "one", "k2": "zwei", "k3": "k3"}
