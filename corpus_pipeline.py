"""The corpus pipeline: stages of operators, each reading what its predecessor wrote.

Language ID drops documents without a language and writes the language of the others to `lang`, exact and near deduplication keep one document of each group, PII
spans are replaced by marks, and packing lays what is left into sequences.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentrygrid.llm import exact_dedup, language_id, near_dedup, packing, pii
from sentrygrid.llm.common import materialize
from sentrygrid.llm.queries import tokenizer


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Profiles are fitted on the stage's own documents; documents without a language go, the others get theirs."""
    return language_id.keep_identified(spark, docs, language_id.fit(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(spark, docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(spark, docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(spark, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_pieces(spark, docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL cannot express language profiles, sketches or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(spark, docs, f"stage-{name}")
    return docs
