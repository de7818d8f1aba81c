import json
import struct
import zlib

import numpy as np
import pytest

from clueframe import cli
from clueframe.operators.dual_view import candidates, code_table, profile_codes, score_dual_view
from clueframe.streaming.scoring import score_stream

OBS = "obs_id long, hemisphere string, driving_side string, road_type string, road_lines string, biome string, hardware array<string>, red_soil_pct double, horizon_std double"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, ["NORTHERN", "SOUTHERN", "NEUTRAL"][i % 3], ["LEFT", "RIGHT"][i % 2], None, "white_lines", "temperate", None, 0.0, None) for i in range(12)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], OBS).write.mode("append").json(f"{tmp_path}/in")
    profiles = candidates(code_table(spark))
    stream = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 2).json(f"{tmp_path}/in")
    score_stream(stream, profiles, f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    want = score_dual_view(spark.createDataFrame(rows, OBS), profiles)
    key = lambda df: sorted((r.obs_id, r["rank"], r.code, r.score) for r in df.collect())
    assert key(got) == key(want)


def test_command_line(spark, tmp_path):
    clue = {"section": "S", "category": "identifying", "tags": [], "text": "a snorkel and Ghana", "image_url": None}
    guides = [{"title": "Kenya", "slug": "kenya", "code": "KE", "continents": ["Africa"], "tips": [clue], "all_clues": [clue]}, {"title": "Ghana", "slug": "ghana", "code": "GH", "continents": ["Africa"], "tips": [], "all_clues": []}]
    (tmp_path / "g.json").write_text(json.dumps(guides))
    ask = lambda *a: cli.run(spark, [f"{tmp_path}/g.json", *a]).collect()
    assert [r.code for r in ask("list")] == ["GH", "KE"]
    assert ask("country", "kenya")[0].code == "KE" and ask("search", "snorkel")[0].country == "Kenya"
    assert [r.focus for r in ask("compare", "ke", "gh")] == ["Kenya"]
    assert [r.code for r in ask("facets", "--side", "left", "snorkel")] == ["KE"]
    assert ask("locate", "kenya snorkel, left hand", "--side", "left")[0].code == "KE"


def _png(path, x):
    h, w, _ = x.shape
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + x[i].tobytes() for i in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b""))


def test_command_line_images(spark, tmp_path):
    guides = [{"title": "Kenya", "slug": "kenya", "code": "KE", "all_clues": []}, {"title": "Japan", "slug": "japan", "code": "JP", "all_clues": []}]
    (tmp_path / "g.json").write_text(json.dumps(guides))
    (tmp_path / "o.json").write_text(json.dumps([{"id": "C1", "title": "Plate", "countryCode": "AU"}]))
    x = np.full((400, 800, 3), 100, np.uint8)
    x[200:] = (180, 100, 50)
    _png(tmp_path / "n.png", x)
    x[:140] = 255
    _png(tmp_path / "s.png", x)
    ask = lambda *a: cli.run(spark, [f"{tmp_path}/g.json", "--official", f"{tmp_path}/o.json", "image", *a]).collect()
    pair = ask(f"{tmp_path}/n.png", f"{tmp_path}/s.png")
    assert {r.code for r in pair} <= {"KE", "JP", "AU"} and pair[0]["rank"] == 1
    lone = ask(f"{tmp_path}/n.png", "--clues", "snorkel, kenya")
    assert lone[0].code == "KE"
    with pytest.raises(ValueError):
        ask(*[f"{tmp_path}/n.png"] * 3)
    (tmp_path / "bad.png").write_bytes(b"no image")
    with pytest.raises(ValueError, match="no image at"):
        ask(f"{tmp_path}/bad.png")


def test_profile_codes(spark):
    guides = spark.createDataFrame([("Kenya", "KE", [1, 2]), ("Kenia", "KE", None), ("Japan", "JP", []), (None, None, [1])], "title string, code string, all_clues array<int>")
    official = spark.createDataFrame([("KE",), ("AU",), ("AU",), (None,)], "countryCode string")
    assert sorted(map(tuple, profile_codes(guides, official).collect())) == [("AU", None, 2), ("JP", "Japan", 0), ("KE", "Kenia", 3)]
    assert profile_codes(guides.limit(0), official.limit(0)).count() == 0
