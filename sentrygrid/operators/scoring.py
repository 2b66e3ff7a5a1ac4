"""Capability-area scores, risk index, tier, trend and peer percentile of every entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrygrid.operators.cohorts import cohorts, peer_stats
from sentrygrid.schema import AREA_WEIGHTS, DEFAULT_AREA, DETECTOR_AREAS, Bundle

SATURATION, DEVIATION_CAP, TREND_GAP = 45.0, 5.0, 15.0
TIER_CUTS = ((75.0, "critical"), (55.0, "high"), (35.0, "elevated"), (20.0, "moderate"))


def finding_score(severity: Column, deviation: Column, confidence: Column, feedback: Column) -> Column:
    return severity * F.least(F.abs(deviation), F.lit(DEVIATION_CAP)) * confidence * feedback


def scored(findings: DataFrame) -> DataFrame:
    return findings.withColumn("score", finding_score(F.col("severity_weight"), F.col("deviation"), F.col("confidence"), F.col("feedback_factor")))


def with_areas(findings: DataFrame) -> DataFrame:
    """One row per finding and capability area; an unknown detector counts for one default area."""
    pairs = [F.when(F.col("detector_id") == d, F.array(*map(F.lit, a))) for d, a in DETECTOR_AREAS.items()]
    return findings.withColumn("area", F.explode(F.coalesce(*pairs, F.array(F.lit(DEFAULT_AREA)))))


def index_of(total: Column) -> Column:
    return F.bround(100 * (1 - F.exp(-total / SATURATION)), 2)


def area_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(AREA_WEIGHTS.items()), "area string, weight double")


def area_scores(spark: SparkSession, findings: DataFrame, entities: DataFrame) -> DataFrame:
    """All eight areas of every entity: score, findings, leading detectors."""
    per = with_areas(scored(findings)).groupBy("entity_id", "area", "detector_id").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    sums = per.groupBy("entity_id", "area").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.slice(F.array_sort(F.collect_set("detector_id")), 1, 3).alias("top_detectors"))
    grid = entities.select("entity_id").join(F.broadcast(area_table(spark)))  # eight areas
    out = grid.join(sums, ["entity_id", "area"], "left")
    return out.select("entity_id", "area", "weight", index_of(F.coalesce("s", F.lit(0.0))).alias("score"), F.coalesce("n", F.lit(0)).alias("findings"), F.coalesce("top_detectors", F.array().cast("array<string>")).alias("top_detectors"))


def tier(index: Column) -> Column:
    return reduce(lambda acc, x: acc.when(index >= x[0], x[1]), TIER_CUTS[1:], F.when(index >= TIER_CUTS[0][0], TIER_CUTS[0][1])).otherwise("low")


def risk_index(areas: DataFrame) -> DataFrame:
    total = F.bround(F.least(F.greatest(F.sum(F.col("weight") * F.col("score")), F.lit(0.0)), F.lit(100.0)), 2)
    return areas.groupBy("entity_id").agg(total.alias("risk_index")).withColumn("risk_tier", tier(F.col("risk_index")))


def trends(findings: DataFrame, alerts: DataFrame) -> DataFrame:
    """Early against late index.  A finding counts in a half if any alert that it refers to lies there, so it may count in both."""
    ends = alerts.groupBy("entity_id").agg(F.min(F.unix_micros("created_ts")).alias("lo"), F.max(F.unix_micros("created_ts")).alias("hi"))
    halves = alerts.join(ends, "entity_id").select("entity_id", "alert_id", (F.unix_micros("created_ts") <= F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2)).alias("early"))
    refs = scored(findings).select("entity_id", "finding_id", "score", F.explode("evidence_refs").alias("ref")).withColumn("alert_id", F.substring_index("ref", ":", -1))
    seen = refs.hint("merge").join(halves, ["entity_id", "alert_id"]).groupBy("entity_id", "finding_id").agg(F.max("score").alias("score"), F.bool_or("early").alias("early"), F.bool_or(~F.col("early")).alias("late"))
    sums = seen.groupBy("entity_id").agg(F.sum(F.when(F.col("early"), F.col("score")).otherwise(0.0)).alias("e"), F.sum(F.when(F.col("late"), F.col("score")).otherwise(0.0)).alias("l"))
    out = ends.select("entity_id").join(sums, "entity_id", "left").select("entity_id", index_of(F.coalesce("e", F.lit(0.0))).alias("early_index"), index_of(F.coalesce("l", F.lit(0.0))).alias("late_index"))
    gap = F.col("late_index") - F.col("early_index")
    return out.withColumn("trend", F.when(gap > TREND_GAP, "deteriorating").when(gap < -TREND_GAP, "improving").otherwise("stable"))


def portfolio(spark: SparkSession, findings: DataFrame, bundle: Bundle) -> DataFrame:
    """One row an entity: index, tier, trend, peer percentile, cohort, area scores and details."""
    areas = area_scores(spark, findings, bundle.entities)
    risk = risk_index(areas)
    co = cohorts(bundle.entities)
    peers = peer_stats(risk.select("entity_id", F.col("risk_index").alias("value")), co).select("entity_id", F.bround("percentile", 4).alias("peer_percentile"))
    detail = areas.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("area", "score"))).alias("area_scores"), F.array_sort(F.collect_list(F.struct("area", "score", "findings", "top_detectors"))).alias("area_details"))
    counts = findings.groupBy("entity_id").agg(F.count("*").alias("finding_count"))
    out = risk.join(detail, "entity_id").join(trends(findings, bundle.alerts), "entity_id", "left").join(peers, "entity_id", "left").join(co.select("entity_id", "cohort_level", "cohort_size"), "entity_id").join(counts, "entity_id", "left")
    return out.withColumn("trend", F.coalesce("trend", F.lit("stable"))).withColumn("finding_count", F.coalesce("finding_count", F.lit(0)))


def top_concern(areas: DataFrame) -> DataFrame:
    """Each entity's area of highest score (first by name among equals)."""
    order = Window.partitionBy("entity_id").orderBy(F.desc("score"), "area")
    return areas.withColumn("r", F.row_number().over(order)).where("r = 1").select("entity_id", "area", "score")
