"""From documents to a mixed training corpus, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hazardlake.llm import contamination, exact, language, mixing, neardup
from hazardlake.llm.common import stage

#: Stages hold choices (language models, hashed signatures, permutations) that SQL cannot redo.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found go."""
    return language.keep_identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the first document stays."""
    return exact.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the first document stays."""
    return neardup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows make up a twentieth or more go."""
    return contamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken from each document at the target weights."""
    return mixing.taken(mixing.mix_sources(docs)).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language ID", languages),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("decontamination", decontaminated),
    ("mixing", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
