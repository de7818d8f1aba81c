"""Sources and sinks of the knowledge base: guides, profiles, official clues and match dumps.

JSON is read with explicit schemas, permissively: absent files give empty tables and
malformed records give nulls.  Pages are parsed with regular expressions and from_json, in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import absolute, plain_label

CLUE = "struct<section:string,category:string,tags:array<string>,text:string,image_url:string>"
GUIDE = (
    "title string, slug string, code string, continents array<string>, hero_image string, "
    f"tips array<{CLUE}>, regional_clues array<{CLUE}>, spotlights array<{CLUE}>, all_clues array<{CLUE}>, tags_summary map<string,array<string>>"
)
PROFILE = "code string, capital string, currency string, driving_side string, domain string, calling_code string, languages array<string>"
PANORAMA = "struct<panoId:string,lat:double,lng:double,round:int,gameId:string>"
OFFICIAL = (
    "id string, title string, description string, title_key string, description_key string, countryCode string, category string, type string, "
    f"heading double, pitch double, zoom double, image_path string, image_url string, seterraRegionIds array<string>, sample_panoramas array<{PANORAMA}>"
)
#: A page's embedded document: steps of items, each with text in one of two carriers (a string or a list).
_ITEM = "struct<text:string,texts:array<string>,tags:array<string>,imageUrl:string,image:string>"
ISLAND = f"struct<title:string,slug:string,code:string,continents:array<string>,heroImage:string,steps:array<struct<title:string,items:array<{_ITEM}>>>>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a pattern of paths, is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(len(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON files (one document each, or an array of them); an absent path is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_guides(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, GUIDE)


def read_first(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """The first of several paths that is there."""
    return read_json(spark, next((p for p in paths if exists(spark, p)), paths[-1]), schema)


def read_keyed(spark: SparkSession, path: str, value: str, names: Sequence[str], key: str = "key") -> DataFrame:
    """Entries of a JSON object of objects, which may stand under any of several names: (key, value)."""
    fields = ", ".join(f"`{n}` map<string,{value}>" for n in names)
    root = read_json(spark, path, f"{fields}, payload struct<{', '.join(f'`{n}`:map<string,{value}>' for n in names)}>")
    return root.select(F.explode(F.coalesce(*(F.col(f"`{n}`") for n in names), *(F.col(f"payload.`{n}`") for n in names))).alias(key, "value"))


def unwrapped(document: Column) -> Column:
    """A JSON document without an outer ``payload``."""
    return F.coalesce(F.get_json_object(document, "$.payload"), document)


def island(html: Column, element: str) -> Column:
    """The text of a script element by its id; null where there is none."""
    return F.nullif(F.regexp_extract(html, rf'(?s)<script[^>]*\bid="{element}"[^>]*>(.*?)</script>', 1), F.lit(""))


def page_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def category(title: Column) -> Column:
    """Category of a section, by the first word of a fixed order that its title has."""
    t = F.lower(title)
    return F.when(t.contains("identifying"), "identifying").when(t.contains("regional") | t.contains("region"), "regional").when(t.contains("spotlight"), "spotlight").otherwise("other")


def parse_guides(pages: DataFrame, element: str = "__NEXT_DATA__", base_url: str = "", html: str = "html", meta: str | None = None) -> DataFrame:
    """Guides from pages with an embedded document; fields it lacks come from the struct column ``meta``, if named.

    Steps and items are exploded, texts of both carriers joined, empty ones dropped, and image addresses made absolute.
    """
    doc = pages.select(F.from_json(island(F.col(html), element), ISLAND).alias("d"), *([F.col(meta).alias("m")] if meta else []))
    known = lambda c, raw=None: F.coalesce(F.col(f"d.{raw or c}"), F.col(f"m.{c}")) if meta else F.col(f"d.{raw or c}")
    guide = doc.select(known("title").alias("title"), known("slug").alias("slug"), known("code").alias("code"), known("continents").alias("continents"), F.col("d.heroImage").alias("hero_image"), "d.steps")
    guide = guide.where((F.col("code") != "") & ~F.startswith("code", F.lit("XX-")))

    def clue(step: Column, item: Column) -> Column:
        texts = F.concat(F.array(item["text"]), F.coalesce(item["texts"], F.array().cast("array<string>")))
        text = F.trim(F.array_join(F.filter(F.array_compact(texts), lambda t: t != ""), " "))
        image = F.coalesce(item["imageUrl"], item["image"])
        return F.struct(step["title"].alias("section"), category(step["title"]).alias("category"), F.coalesce(item["tags"], F.array().cast("array<string>")).alias("tags"), text.alias("text"), absolute(image, base_url).alias("image_url"))

    clues = F.flatten(F.transform(F.coalesce("steps", F.array().cast(f"array<struct<title:string,items:array<{_ITEM}>>>")), lambda s: F.transform(F.coalesce(s["items"], F.array().cast(f"array<{_ITEM}>")), lambda i: clue(s, i))))
    guide = guide.withColumn("all_clues", F.filter(clues, lambda c: F.coalesce(c["text"], F.lit("")) != "")).drop("steps")
    part = lambda name: F.filter("all_clues", lambda c: c["category"] == name)
    return guide.select("title", "slug", "code", "continents", "hero_image", part("identifying").alias("tips"), part("regional").alias("regional_clues"), part("spotlight").alias("spotlights"), "all_clues")


def clue_rows(guides: DataFrame) -> DataFrame:
    """(code, title, pos, section, category, tags, text, image_url): one row for each clue."""
    return guides.select("code", "title", F.posexplode("all_clues").alias("pos", "c")).select("code", "title", "pos", "c.*")


def missing(keys: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Keys that a cache has no row for: what is left to fetch."""
    return keys.join(cache.select(key).distinct(), key, "left_anti")


def profiles_from_bundle(bundles: DataFrame, marker: str, text: str = "text", span: int = 35_000) -> DataFrame:
    """Country profiles from a minified script: tuples of seven fields after the brace that opens the object around a marker."""
    at = F.locate(marker, F.col(text))
    before = F.substring(F.col(text), F.lit(1), at)
    opening = at - F.locate("{", F.reverse(before)) + 1
    window = F.when(at > 0, F.substring(F.col(text), opening, F.lit(span)))
    pattern = r'code:"([^"]*)",capital:"([^"]*)",currency:"([^"]*)",drivingSide:"([^"]*)",domain:"([^"]*)",callingCode:"([^"]*)",languages:\[([^\]]*)\]'
    tuples = F.explode(F.regexp_extract_all(window, F.lit(pattern), F.lit(0)))
    x = bundles.select(tuples.alias("t"))
    part = lambda i: plain_label(F.regexp_extract("t", pattern, i))
    names = ("code", "capital", "currency", "driving_side", "domain", "calling_code")
    return x.select(F.upper(part(1)).alias("code"), *(part(i).alias(n) for i, n in enumerate(names[1:], 2)), F.transform(F.split(F.regexp_extract("t", pattern, 7), ","), lambda w: plain_label(F.trim(w))).alias("languages"))


def repaired_json(literal: Column) -> Column:
    """A script's object literal as JSON: quoted keys, double quotes, !0 and !1, no trailing commas or undefined."""
    x = F.regexp_replace(literal, r"'((?:[^'\\]|\\.)*)'", '"$1"')
    x = F.regexp_replace(x, r"([{,]\s*)([A-Za-z_$][\w$]*)\s*:", '$1"$2":')
    x = F.regexp_replace(F.regexp_replace(x, r"!0\b", "true"), r"!1\b", "false")
    x = F.regexp_replace(F.regexp_replace(x, r"\bvoid 0\b|\bundefined\b", "null"), r",(\s*[}\]])", "$1")
    return x


def tutorial_steps(scripts: DataFrame, labels: DataFrame | None = None, text: str = "literal") -> DataFrame:
    """Object literals as variants, with lesson_name looked up by key in ``labels`` (key, label)."""
    x = scripts.select("*", F.try_parse_json(repaired_json(F.col(text))).alias("step")).where("step IS NOT NULL")
    x = x.withColumn("lesson_key", F.try_variant_get("step", "$.lesson", "string"))
    if labels is None:
        return x.withColumn("lesson_name", F.col("lesson_key"))
    return x.join(labels.select(F.col("key").alias("lesson_key"), F.col("label").alias("__l")), "lesson_key", "left").withColumn("lesson_name", F.coalesce("__l", "lesson_key")).drop("__l")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images: path, height, width, mode and data (blue, green, red bytes); files that aren't images are left out."""
    x = spark.read.format("image").option("dropInvalid", True).load(path)
    return x.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, base64, mime) of files; Spark passes over files without bytes."""
    from ..functions.text import image_type

    return spark.read.format("binaryFile").load(path).select("path", F.base64("content").alias("base64"), image_type(F.col("path")).alias("mime"))


def decoded(data: Column) -> Column:
    """Bytes of base64 text, with or without a data: address before it."""
    return F.unbase64(F.regexp_replace(data, r"^data:[^,]*,", ""))


def write_json(df: DataFrame, path: str, pretty: bool = False) -> None:
    """A table as JSON lines, or each row as an indented document."""
    if pretty:
        df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").json(path)
