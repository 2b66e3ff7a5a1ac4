"""Weighted rendezvous (highest random weight) sharding in DataFrame functions only (operator 6).

Every (key, shard) pair draws ``u`` from an MD5 of both; the shard with the smallest ``-ln(u) / weight`` takes
the key.  A further shard can only win keys for itself, so growing from n to n + 1 moves about 1 / (n + 1) of
the rows and all of them into the new shard.  Equal keys always land together.

Rows get a gapless ``slot`` in their shard by two-level numbering: rows are dealt to hash buckets, numbered in
(shard, bucket), and shifted by the counts of the earlier buckets, so no shard passes through one task.

Defined results: a null key is the key ``null``; null text has no bytes; repeated rows each get their own slot;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrygrid.llm.common import buckets_for, hash_bucket, materialize

#: Bytes that a row takes besides its text.
ROW_OVERHEAD = 16


def _cost(key: Column, shard: Column, weight: Column) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(key, F.lit("null")), shard.cast("string"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / weight


def _winner(key: Column, weights: Sequence[float]) -> Column:
    """The least (cost, shard)."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    return F.array_min(F.transform(shards, lambda x: F.struct(_cost(key, x["shard"], x["weight"]).alias("cost"), x["shard"].alias("shard"))))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a string key among ``len(weights)`` shards."""
    return _winner(key, weights)["shard"]


def assign_shards(spark: SparkSession, docs: DataFrame, weights: Sequence[float], new_weight: float = 1.0, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard and slot for every row of ``docs``; a further shard is compared with the winner alone."""
    value, key = docs[text].cast("string"), docs["doc_id"].cast("long").cast("string")
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(value), F.lit(0)) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(F.coalesce(value, F.lit("")).cast("binary")).alias("text_crc32"),
        _winner(key, weights).alias("best"),
    )
    new = F.lit(len(weights))
    grown = F.when(_cost(F.col("doc_id").cast("string"), new, F.lit(float(new_weight))) < F.col("best.cost"), new).otherwise(F.col("best.shard"))
    rows = materialize(spark, rows.select("doc_id", "size", "text_crc32", F.col("best.shard").alias("shard"), grown.alias("grown_shard")), "shards")
    return number_slots(rows, ["shard"], ["doc_id", "text_crc32", "size"], rows.count())


def number_slots(rows: DataFrame, group: Sequence[str], order: Sequence[str], count: int, name: str = "slot") -> DataFrame:
    """Number the rows of each group gaplessly from 0 without bringing a group together."""
    dealt = rows.withColumn("__bucket", hash_bucket(buckets_for(count), *order))
    sizes = dealt.groupBy(*group, "__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*group, "__bucket", F.coalesce(before, F.lit(0)).alias("__start"))
    inner = F.row_number().over(Window.partitionBy(*group, "__bucket").orderBy(*order)) - 1
    return dealt.withColumn("__rank", inner).join(starts, [*group, "__bucket"]).withColumn(name, (F.col("__start") + F.col("__rank")).cast("long")).drop("__bucket", "__rank", "__start")


def write_shards(spark: SparkSession, docs: DataFrame, weights: Sequence[float], path: str) -> None:
    """Write the rows as Parquet, one folder a shard; a shard is written by as many tasks as hold its rows."""
    key = docs["doc_id"].cast("long").cast("string")
    docs.withColumn("shard", rendezvous(key, weights)).write.partitionBy("shard").parquet(path)
