"""The numbered operators as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrygrid.llm import bpe, exact_dedup, html_text, language_id, licenses, media, near_dedup, packing, periodic_runs, pii, secrets, sharding, turn_repair
from sentrygrid.llm.common import documents

SHARDS = 40


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies; the path is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_pieces(spark, documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language_id.identify(spark, docs, language_id.fit(docs))
    return found.select("doc_id", F.coalesce(language_id.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.dedup_groups(spark, documents(spark, sf_dir))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_spans(pii.find_pii(spark, documents(spark, sf_dir)))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign_shards(spark, documents(spark, sf_dir), [1.0] * SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find_components(spark, documents(spark, sf_dir))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_spans(secrets.find_secrets(spark, documents(spark, sf_dir)))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``: a directory tree of two levels."""
    docs = documents(spark, sf_dir)
    path = F.concat_ws("/", docs["source"], docs["lang"], F.concat(docs["doc_id"].cast("string"), F.lit(".txt")))
    return licenses.scan(spark, docs, path)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir), with_media=False)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.report(turn_repair.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest_runs(documents(spark, sf_dir), change=periodic_runs.repeat_tails)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_language_id": op2_language_id,
    "op3_bpe": op3_bpe,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_pii": op5_pii,
    "op6_sharding": op6_sharding,
    "op7_near_dedup": op7_near_dedup,
    "op8_secrets": op8_secrets,
    "op9_licenses": op9_licenses,
    "op10_media": op10_media,
    "op11_turn_repair": op11_turn_repair,
    "op12_html_text": op12_html_text,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH hashed AS (
          SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
        )
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
        FROM hashed WINDOW g AS (PARTITION BY h)""",
}
