"""Command line: python -m clueframe.cli GUIDES [--official FILE] [--profiles FILE] COMMAND ...

GUIDES, --official and --profiles are JSON paths that Spark reads.  Commands: list, country NAME, compare A B,
search WORDS, facets [--side S] [--continent C] [FEATURE ...], locate CLUES (comma separated) [--side S] [--continent C],
image VIEW [--clues CLUES] [--side S] [--continent C], and image NORTH SOUTH, which scores the pair of views.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import comma_parts
from .operators import clue_scorer, dual_view, images, knowledge_base
from .sources import knowledge


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="clueframe", description=__doc__)
    p.add_argument("guides")
    p.add_argument("--official", default="")
    p.add_argument("--profiles", default="")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    sub.add_parser("country").add_argument("name")
    c = sub.add_parser("compare")
    c.add_argument("a")
    c.add_argument("b")
    s = sub.add_parser("search")
    s.add_argument("words", nargs="+")
    s.add_argument("-k", type=int, default=6)
    for name, rest in (("facets", "features"), ("locate", "clues")):
        x = sub.add_parser(name)
        x.add_argument("--side")
        x.add_argument("--continent")
        x.add_argument(rest, nargs="*" if rest == "features" else None)
    x = sub.add_parser("image")
    x.add_argument("views", nargs="+")
    x.add_argument("--clues", default="")
    x.add_argument("--side")
    x.add_argument("--continent")
    return p


def _views(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Images by the number of their path; an error names a path without one."""
    found = [knowledge.read_images(spark, path).limit(1).withColumn("path", F.lit(str(i))) for i, path in enumerate(paths)]
    for path, x in zip(paths, found):
        if x.isEmpty():
            raise ValueError(f"no image at {path}")
    return found[0].union(found[1]) if len(found) == 2 else found[0]


def run(spark: SparkSession, args: Sequence[str]) -> DataFrame:
    """The table that a command line asks for."""
    a = parser().parse_args(args)
    guides = knowledge.read_guides(spark, a.guides)
    official = knowledge.read_json(spark, a.official, knowledge.OFFICIAL) if a.official else spark.createDataFrame([], knowledge.OFFICIAL)
    if a.command == "list":
        return knowledge_base.country_list(guides)
    if a.command == "country":
        return knowledge_base.card(knowledge_base.lookup(guides, official, a.name))
    if a.command == "compare":
        pair = spark.createDataFrame([(a.a.upper(), a.b.upper())], "a string, b string")
        return knowledge_base.compare(guides, pair).orderBy("n").select("focus", "tip")
    if a.command == "search":
        return knowledge_base.search(guides, official, " ".join(a.words), a.k)
    if a.command == "facets":
        return knowledge_base.facets(guides, a.side, a.continent, a.features)
    if a.command == "image" and len(a.views) > 2:
        raise ValueError("one view or two")
    if a.command == "image" and len(a.views) == 2:
        pair = spark.createDataFrame([(1, "0", "1")], "pair_id long, north string, south string")
        seen = images.dual_view(pair, images.measure_dual(_views(spark, a.views)))
        pool = dual_view.candidates(dual_view.profile_codes(guides, official))
        return dual_view.score_dual_view(seen, pool).orderBy("rank").drop("obs_id")
    profiles = knowledge.read_json(spark, a.profiles, knowledge.PROFILE) if a.profiles else None
    given = spark.createDataFrame([(1, a.side, a.continent, a.clues)], "obs_id long, driving_side string, continent string, clues string")
    if a.command == "image":
        view = images.single_view(images.measure_single(_views(spark, a.views)))
        given = given.crossJoin(view.select(F.col("clues").alias("cv_clues"), F.to_json("parameters").alias("params")))
    else:
        given = given.withColumns({"cv_clues": F.array().cast("array<string>"), "params": F.lit("{}")})
    obs = given.withColumns({"clues": comma_parts(F.col("clues")), "params": F.from_json("params", clue_scorer.PARAMS)})
    catalogue = official.select("id", "title", "description", F.col("countryCode").alias("code"), F.coalesce("type", "category").alias("kind"))
    return clue_scorer.score_clues(obs, knowledge_base.countries(guides, profiles), catalogue).orderBy("rank").drop("obs_id")


def main() -> None:
    import sys

    run(SparkSession.builder.appName("clueframe").getOrCreate(), sys.argv[1:]).show(50, truncate=80)


if __name__ == "__main__":
    main()
