"""The corpus pipeline: language ID, near duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the shared
folder and reads them again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import decontaminate, jaccard, language, mixing, secrets
from colloquy.llm.shared import load, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a determined language. The network learns from the stage's own labelled rows.

    Null, empty and letterless texts have no language and go; null ids and repeated rows are judged like others, each by
    itself; without a labelled row nothing is determined, so all go; an empty table stays empty.
    """
    return language.keep_identified(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a Jaccard similarity of 0.8 or more over 5-word shingles: that of the smallest
    id, one with a null id only where there is no other; of rows that repeat id and text, one. Wordless texts all stay."""
    return jaccard.keep_one(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents; others stay as they are. Null and wordless texts aren't contaminated; each repeated row is
    judged by itself; an empty benchmark drops nothing."""
    return decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, repeated ones too, and masks its secrets; n_chars follows the text, and stays where that is null."""
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, with ``copy`` counted from 1. A null source is a source, a null id
    an id; repeated rows of an id draw alike; documents without words are taken no time. A column of that name is replaced."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
]

#: SQL can't express the trained network of the first stage; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
