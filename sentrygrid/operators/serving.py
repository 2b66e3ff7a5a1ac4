"""Read queries over findings, scores and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrygrid.operators.features import asset_features
from sentrygrid.operators.scoring import scored
from sentrygrid.schema import Bundle

CANNED = {
    "severity_by_disposition": "SELECT severity, disposition, count(*) AS n FROM alerts GROUP BY severity, disposition",
    "critical_close_minutes": "SELECT entity_id, median((unix_micros(closed_ts) - unix_micros(ack_ts)) / 6e7) AS minutes FROM alerts WHERE severity = 'critical' GROUP BY entity_id",
    "top_assets": "SELECT asset_id, count(*) AS n FROM alerts GROUP BY asset_id ORDER BY n DESC, asset_id LIMIT 10",
    "quarantine_sample": "SELECT table_name, record_id, quarantine_reason FROM quarantine ORDER BY table_name, record_id LIMIT 50",
}


def _same(column: str, value: str):
    return F.upper(column) == value.upper()


def entity_list(scores: DataFrame, limit: int | None = None) -> DataFrame:
    out = scores.orderBy(F.desc("risk_index"), "entity_id")
    return out.limit(limit) if limit else out


def entity_detail(scores: DataFrame, entity: str) -> DataFrame:
    return scores.where(_same("entity_id", entity))


def find(findings: DataFrame, entity: str | None = None, category: str | None = None, detector: str | None = None, finding_id: str | None = None) -> DataFrame:
    for column, value in (("entity_id", entity), ("category", category), ("detector_id", detector), ("finding_id", finding_id)):
        if value is not None:
            findings = findings.where(_same(column, value))
    return findings


def queue_of(queue: DataFrame, entity: str, budget: int) -> DataFrame:
    return queue.where(_same("entity_id", entity)).where(F.col("rank") <= max(1, min(budget, 500)))


def distribution(scores: DataFrame, column: str) -> DataFrame:
    return scores.groupBy(column).agg(F.count("*").alias("entities"))


def area_averages(areas: DataFrame) -> DataFrame:
    return areas.groupBy("area").agg(F.bround(F.avg("score"), 2).alias("mean_score"))


def capability_profile(areas: DataFrame) -> DataFrame:
    """Each entity's areas beside the median over entities."""
    medians = areas.groupBy("area").agg(F.median("score").alias("median_score"))
    return areas.join(medians, "area").select("entity_id", "area", "score", "median_score", (F.col("score") - F.col("median_score")).alias("gap"))


def coverage_heatmap(bundle: Bundle) -> DataFrame:
    status = F.when(~F.col("monitoring_expected"), "Unmonitored").when(F.col("is_silent"), "Silent").otherwise("Normal")
    return asset_features(bundle).withColumn("status", status).groupBy("criticality", "status").agg(F.count("*").alias("assets"))


def priority_findings(findings: DataFrame, per_entity: int = 3, limit: int = 25) -> DataFrame:
    """The best finding of each entity, then the second ones, and so on."""
    rows = scored(findings).withColumn("rn", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("score"), "finding_id")))
    return rows.where(F.col("rn") <= per_entity).orderBy("rn", F.desc("score"), "finding_id").limit(limit).select("entity_id", "finding_id", "detector_id", "scope", "score", "rn")


def top_findings(findings: DataFrame, limit: int = 25) -> DataFrame:
    text = F.trim(F.regexp_replace("reason_text", r"\s+", " "))
    brief = F.when(F.char_length(text) > 180, F.concat(F.substring(text, 1, 177), F.lit("..."))).otherwise(text)
    return scored(findings).orderBy(F.desc("score"), "finding_id").limit(limit).select("finding_id", "entity_id", "detector_id", "scope", "score", brief.alias("reason"))


def top_detectors(findings: DataFrame, limit: int = 15) -> DataFrame:
    return findings.groupBy("detector_id").agg(F.count("*").alias("findings")).orderBy(F.desc("findings"), "detector_id").limit(limit)


def category_share(findings: DataFrame) -> DataFrame:
    counts = findings.groupBy("category").agg(F.count("*").alias("findings"))  # three categories
    return counts.withColumn("share", F.col("findings") / F.sum("findings").over(Window.partitionBy()))


def indicators(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """Counts for the head of a dashboard."""
    f = findings.agg(F.count("*").alias("findings"), F.count_if(F.col("peer_percentile") >= 0.9).alias("extreme"), F.count_if(F.col("severity_weight") >= 5).alias("severe"))
    return f.join(F.broadcast(scores.agg(F.count_if(F.col("risk_tier").isin("high", "critical")).alias("risky_entities"))))
