"""Claimed indicators against the evidence of the records."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrygrid.operators.features import alert_features, asset_features, ch, rate
from sentrygrid.schema import CLAIMS, Bundle

GRACE, SPAN = 0.05, 0.45


def evidence(bundle: Bundle) -> DataFrame:
    """One row an entity: what the records say about each claimed metric, null without a basis."""
    af = alert_features(bundle)
    seen = af.groupBy("entity_id").agg(
        F.median(F.when(ch(), F.col("closure_duration_min"))).alias("mttc_min"),
        (100 * rate(F.coalesce(F.col("disposition") == "false_positive", F.lit(False)))).alias("fp_rate_pct"),
        (100 * rate(F.when(ch(), F.col("is_escalated")))).alias("escalation_pct"),
    )
    cover = asset_features(bundle).where("criticality = 'critical' and monitoring_expected").groupBy("entity_id").agg((100 * rate(~F.col("is_silent"))).alias("coverage_pct"))
    return bundle.entities.select("entity_id").join(seen, "entity_id", "left").join(cover, "entity_id", "left").select("entity_id", *[m for m, _, _ in CLAIMS])


def credibility(exaggeration: Column) -> Column:
    """1 up to the grace, then falling over the span; half as fast for understatement."""
    over = 1 - (exaggeration - GRACE) / SPAN
    under = 1 - 0.5 * (-exaggeration - GRACE) / SPAN
    return F.least(F.greatest(F.when(exaggeration > 0, over).otherwise(under), F.lit(0.0)), F.lit(1.0))


def compare(bundle: Bundle) -> DataFrame:
    """One row per entity and metric with both sides."""
    ids = ["entity_id"]
    claimed = bundle.entities.select("entity_id", *[F.col(c).cast("double").alias(m) for m, c, _ in CLAIMS]).unpivot(ids, [m for m, _, _ in CLAIMS], "metric", "claimed").where("claimed is not null")
    observed = evidence(bundle).unpivot(ids, [m for m, _, _ in CLAIMS], "metric", "observed")
    both = claimed.join(observed, ["entity_id", "metric"], "left").where("observed is not null")
    better = [m for m, _, up in CLAIMS if up]
    sign = F.when(F.col("metric").isin(*better), 1.0).otherwise(-1.0)
    gap = sign * (F.col("claimed") - F.col("observed")) / F.greatest(F.abs(F.col("observed")), F.lit(1e-9))
    return both.withColumn("exaggeration", gap).select("entity_id", "metric", F.bround("claimed", 2).alias("claimed"), F.bround("observed", 2).alias("observed"), F.bround("exaggeration", 4).alias("exaggeration"), F.bround(credibility(F.col("exaggeration")), 4).alias("credibility"))


def verdict(index: Column) -> Column:
    return F.when(index >= 85, "substantiated").when(index >= 60, "partially substantiated").otherwise("not substantiated")


def claim_index(compared: DataFrame) -> DataFrame:
    out = compared.groupBy("entity_id").agg(F.bround(100 * F.avg("credibility"), 1).alias("credibility_index"), F.count_if(F.col("exaggeration") > GRACE).alias("exaggerated"), F.count_if(F.col("credibility") >= 0.999).alias("substantiated"), F.count("*").alias("claims"))
    return out.withColumn("verdict", verdict(F.col("credibility_index")))


def summary(indexed: DataFrame) -> DataFrame:
    names = ("substantiated", "partially substantiated", "not substantiated")
    counts = [F.count_if(F.col("verdict") == n).alias(n.replace(" ", "_") + "_entities") for n in names]
    return indexed.agg(F.count("*").alias("entities"), F.bround(F.avg("credibility_index"), 1).alias("mean_index"), F.sum("exaggerated").alias("exaggerated_claims"), *counts)


