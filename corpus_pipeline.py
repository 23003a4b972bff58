"""The corpus pipeline: language ID, near-duplicate join, decontamination, personal data, source mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder
and hands the written table to the next stage. All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import decontaminate, jaccard, language, mixing, pii
from sensorloom.llm.base import prepare, table
from sensorloom.session import materialise


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a missing lang is filled in."""
    prepare(spark)
    packed = docs.select("doc_id", "text", "lang", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # own names apart from the input's
    told = language.identify(packed, language.fit(docs)).where(~F.col("rejected"))
    return told.select(*[F.coalesce("lang", "lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    prepare(spark)
    return jaccard.dedupe(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    prepare(spark)
    return decontaminate.clean(docs, decontaminate.indexes(table(spark, sf_dir, "benchmark")))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    prepare(spark)
    return pii.redact(docs, pii.train(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their number of copies."""
    prepare(spark)
    return mixing.mix(docs)


STAGES = [
    ("language_id", identified),
    ("jaccard_join", distinct),
    ("decontamination", decontaminated),
    ("pii", redacted),
    ("mixing", mixed),
]

#: Learned models and hash order have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
