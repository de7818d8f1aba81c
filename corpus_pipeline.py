"""A corpus pipeline of five stages; each reads what the one before it kept.

1. quality: documents whose P(sound and not toxic) is under one half go,
2. near duplicates (five-word shingles, similarity 0.8): one document of each group stays,
3. decontamination: documents that hold a benchmark window go,
4. mixing: languages, as told from the text, are brought to the weights of ``MIX`` by repeating
   documents; every document stays once at least,
5. tokens: the remaining documents' ids, written in range-coded segments and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clueframe.llm.decontaminate import decontaminate
from clueframe.llm.near_dedup import deduplicate
from clueframe.llm.ordinal_quality import select_quality
from clueframe.llm.shared import fresh
from clueframe.llm.soft_mixing import mix_domains
from clueframe.llm.token_output import read_tokens, write_tokens

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Target shares of the languages' tokens.  All but the anchor's are to grow, so that no document has to go.
MIX = {"en": 0.50, "de": 0.20, "fr": 0.17, "es": 0.13}
ANCHOR = "en"
#: Documents that languages are learned from.
MIX_SAMPLE = 2000


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return select_quality(docs, _labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    domains = list(MIX)
    lang = F.array_position(F.array(*(F.lit(x) for x in domains)), F.col("lang"))
    labels = docs.select("doc_id", F.when(lang > 0, lang - 1).alias("label"))
    return mix_domains(docs, labels, domains, MIX, anchor=ANCHOR, rows=MIX_SAMPLE, least=1.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = fresh(spark, "tokens")
    write_tokens(docs, path)
    return read_tokens(spark, path)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


#: Trained models, minhash groups and a range coder are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None
