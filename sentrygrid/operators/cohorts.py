"""Peer cohorts and peer-relative statistics.

An entity's cohort is its sector and size band if that has enough members, else its sector, else everyone.  Every
member belongs to three groups, so group statistics need no entity-by-entity pairs: values are repeated three times,
aggregated per group, and each entity looks up the group of its level (or everyone, if too few members have a value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrygrid.functions.stats import mean_percentile, robust_z
from sentrygrid.schema import THRESHOLDS

EVERYONE = "all"


def _band() -> Column:
    return F.concat_ws("|", F.lit("band"), "sector", "size_band")


def _sector() -> Column:
    return F.concat_ws("|", F.lit("sector"), "sector")


def cohorts(entities: DataFrame, least: int = THRESHOLDS.min_cohort) -> DataFrame:
    """entity_id, cohort_level, cohort_key, cohort_size and the groups that the entity is a member of."""
    rows = entities.select("entity_id", "sector", "size_band")
    banded = F.col("sector").isNotNull() & F.col("size_band").isNotNull()
    in_band = F.when(banded, F.count("*").over(Window.partitionBy("sector", "size_band"))).otherwise(0)
    in_sector = F.when(F.col("sector").isNotNull(), F.count("*").over(Window.partitionBy("sector"))).otherwise(0)
    total = entities.agg(F.count("*").alias("everyone"))
    out = rows.withColumn("n_band", in_band).withColumn("n_sector", in_sector).join(F.broadcast(total))  # one row
    level = F.when(F.col("n_band") >= least, "primary").when(F.col("n_sector") >= least, "sector_fallback").otherwise("global_fallback")
    return out.withColumn("cohort_level", level).select(
        "entity_id", "sector", "size_band", "cohort_level",
        F.when(F.col("cohort_level") == "primary", _band()).when(F.col("cohort_level") == "sector_fallback", _sector()).otherwise(EVERYONE).alias("cohort_key"),
        F.when(F.col("cohort_level") == "primary", F.col("n_band")).when(F.col("cohort_level") == "sector_fallback", F.col("n_sector")).otherwise(F.col("everyone")).alias("cohort_size"),
        F.array_compact(F.array(F.lit(EVERYONE), F.when(F.col("sector").isNotNull(), _sector()), F.when(banded, _band()))).alias("groups"),
    )


def peer_stats(values: DataFrame, cohort: DataFrame, value: str = "value", least: int = THRESHOLDS.min_cohort) -> DataFrame:
    """(entity_id, value) to value, cohort_level, peers, median, mad, z and percentile of every entity that has a value."""
    own = values.where(F.col(value).isNotNull()).select("entity_id", F.col(value).alias("value")).join(cohort, "entity_id")
    member = own.select("entity_id", "value", F.explode("groups").alias("key"))
    first = member.groupBy("key").agg(F.count("*").alias("peers"), F.median("value").alias("median"), F.stddev_pop("value").alias("std"))
    second = member.join(first.select("key", "median"), "key").groupBy("key").agg(F.median(F.abs(F.col("value") - F.col("median"))).alias("mad"))
    order = Window.partitionBy("key").orderBy("value")
    placed = member.select("key", "entity_id", (F.rank().over(order) - 1).alias("below"), F.count("*").over(order.rangeBetween(Window.unboundedPreceding, 0)).alias("upto"))
    stats = placed.join(first.join(second, "key"), "key")
    sized = own.join(first.select(F.col("key").alias("cohort_key"), F.col("peers").alias("n")), "cohort_key", "left")
    chosen = sized.select("entity_id", "value", "cohort_level", F.when(F.col("n") >= least, F.col("cohort_key")).otherwise(EVERYONE).alias("key"))
    return chosen.join(stats, ["key", "entity_id"]).select(
        "entity_id", "value", "cohort_level", "peers", "median", "mad",
        robust_z(F.col("value"), F.col("median"), F.col("mad"), F.col("std")).alias("z"),
        mean_percentile(F.col("below"), F.col("upto"), F.col("peers")).alias("percentile"),
    )
