"""Budgeted review queues: most of the budget to findings, spread over detectors, the rest to randomly picked alerts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrygrid.operators.scoring import scored
from sentrygrid.schema import DETECTOR_AREAS

RISK_SHARE, DETECTOR_SHARE, SEED = 0.85, 0.35, 42
SCOPES = ("alert", "case", "asset", "entity", "category", "period", "analyst", "table")


def split_budget(budget: int) -> tuple[int, int, int]:
    """Places for findings, for controls, and the places that one detector may take at first."""
    risk = max(1, round(RISK_SHARE * budget))
    return risk, max(1, budget - risk), max(2, math.ceil(DETECTOR_SHARE * risk))


def target_type(scope: Column) -> Column:
    head = F.lower(F.substring_index(scope, ":", 1))
    return F.when((F.instr(scope, ":") > 0) & head.isin(*SCOPES), head).otherwise("alert")


def detector_order() -> Column:
    return F.coalesce(*[F.when(F.col("detector_id") == d, i) for i, d in enumerate(DETECTOR_AREAS)], F.lit(len(DETECTOR_AREAS)))


def risk_items(findings: DataFrame, budget: int) -> DataFrame:
    """Round robin over detectors by score, each up to its share; then the best of the rest."""
    risk, _, cap = split_budget(budget)
    rows = scored(findings).withColumn("det", detector_order())
    within = Window.partitionBy("entity_id", "det").orderBy(F.desc("score"), "finding_id")
    rows = rows.withColumn("rn", F.row_number().over(within))
    first = F.col("rn") <= cap
    order = Window.partitionBy("entity_id").orderBy(F.when(first, 0).otherwise(1), F.when(first, F.col("rn").cast("double")).otherwise(-F.col("score")), F.when(first, F.col("det")).otherwise(0), "det", "finding_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= risk)


def control_items(alerts: DataFrame, picked: DataFrame, budget: int, seed: int = SEED) -> DataFrame:
    """Alerts in an order that a hash of seed, entity and id fixes; those that picked findings refer to come in only if there are too few others."""
    _, control, _ = split_budget(budget)
    refs = picked.select("entity_id", F.explode("evidence_refs").alias("ref")).select("entity_id", F.substring_index("ref", ":", -1).alias("alert_id")).distinct().withColumn("flagged", F.lit(True))
    taken = picked.groupBy("entity_id").agg(F.count("*").alias("taken"))
    pool = alerts.select("entity_id", "alert_id").join(refs, ["entity_id", "alert_id"], "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    free = pool.groupBy("entity_id").agg(F.count_if(~F.col("flagged")).alias("free"))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), "entity_id", "alert_id"))
    # Nobody needs more than these of either kind; Spark keeps so many an entity before it shuffles.
    first = F.row_number().over(Window.partitionBy("entity_id", "flagged").orderBy(draw, "alert_id"))
    drawn = pool.withColumn("first", first).where(F.col("first") <= max(control, budget)).drop("first")
    sized = drawn.join(free, "entity_id").join(taken, "entity_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    sized = sized.withColumn("need", F.greatest(F.lit(control), F.lit(budget) - F.col("taken")))
    usable = sized.where(~F.col("flagged") | (F.col("free") < F.col("need")))
    order = Window.partitionBy("entity_id").orderBy(draw, "alert_id")
    return usable.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= F.col("need")).select("entity_id", "alert_id", "pick", "taken")


def build_queues(findings: DataFrame, alerts: DataFrame, budget: int = 50, seed: int = SEED) -> DataFrame:
    picked = risk_items(findings, budget)
    control = control_items(alerts, picked, budget, seed)
    columns = ["entity_id", "rank", "bucket", "finding_id", "detector_id", "scope", "score", "reason_text", "evidence_refs"]
    risk = picked.select("entity_id", "rank", F.lit("risk").alias("bucket"), "finding_id", "detector_id", "scope", F.bround("score", 2).alias("score"), "reason_text", "evidence_refs")
    none = F.lit(None).cast("string")
    other = control.select("entity_id", (F.col("taken") + F.col("pick")).cast("int").alias("rank"), F.lit("control").alias("bucket"), none.alias("finding_id"), none.alias("detector_id"), F.concat(F.lit("alert:"), "alert_id").alias("scope"), F.lit(1.0).alias("score"), F.lit("random control sample").alias("reason_text"), F.array(F.concat(F.lit("alerts:"), "alert_id")).alias("evidence_refs"))
    both = risk.select(*columns).unionByName(other.select(*columns))
    return both.withColumn("item_id", F.concat(F.lit("QI-"), "entity_id", F.lit("-"), F.lpad(F.col("rank").cast("string"), 3, "0"))).withColumn("target_type", target_type(F.col("scope")))
