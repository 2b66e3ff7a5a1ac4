"""Per-alert, per-asset, per-entity and per-month features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrygrid.functions.stats import entropy_bits, gini
from sentrygrid.schema import Bundle

WEEK_DAYS, SLA_MINUTES = 7, (55, 60)
TEMPLATE = "Automated triage complete"


def seconds(later: Column, earlier: Column) -> Column:
    """Fractional seconds between two times, never negative, null if either is."""
    gap = (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6
    return F.when(gap.isNotNull(), F.greatest(gap, F.lit(0.0)))


def ch() -> Column:
    return F.col("severity").isin("critical", "high")


def durations(alerts: DataFrame) -> DataFrame:
    closure = seconds(F.col("closed_ts"), F.col("ack_ts"))
    return alerts.withColumns(
        {
            "ack_latency_sec": seconds(F.col("ack_ts"), F.col("created_ts")),
            "closure_duration_sec": closure,
            "closure_duration_min": closure / 60,
            "total_lifecycle_sec": seconds(F.col("closed_ts"), F.col("created_ts")),
            "closed_minute": F.minute("closed_ts"),
            "closed_hour": F.hour("closed_ts"),
            "closed_dayofweek": F.weekday("closed_ts"),
            "is_sla_window": F.coalesce((closure / 60).between(*SLA_MINUTES), F.lit(False)),
        }
    )


def repeats(alerts: DataFrame) -> DataFrame:
    """Time since the alert before with the same entity, asset and category, and how many came within a week so far."""
    order = Window.partitionBy("entity_id", "asset_id", "category").orderBy("created_ts", "alert_id")
    days = (F.unix_micros("created_ts") - F.unix_micros("prev_created_ts")) / 86_400e6
    out = alerts.withColumn("prev_created_ts", F.lag("created_ts").over(order)).withColumn("days_since_prev", days)
    out = out.withColumn("is_repeat_7d", F.coalesce(F.col("days_since_prev"), F.lit(999.0)) <= WEEK_DAYS)
    return out.withColumn("repeat_streak_7d", F.sum(F.col("is_repeat_7d").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def linked_cases(bundle: Bundle) -> DataFrame:
    """One case an alert (the first by id, where several name the same alert), with its events counted and whether it was escalated.

    Here and below, sides that grow with the alerts are joined by merging: by the size of their compressed files Spark would broadcast millions of rows."""
    events = bundle.workflow_events.groupBy("case_id").agg(F.count("*").alias("workflow_event_count"))
    escalated = bundle.escalations.select("case_id").distinct().withColumn("is_escalated", F.lit(True))
    worked = bundle.cases.where("alert_id is not null").select("alert_id", "case_id", "analyst_id", "closure_code", "notes_text").join(events.hint("merge"), "case_id", "left").join(escalated.hint("merge"), "case_id", "left")
    first = F.min_by(F.struct("case_id", "analyst_id", "closure_code", "notes_text", "workflow_event_count", "is_escalated"), "case_id")
    return worked.groupBy("alert_id").agg(first.alias("c")).select("alert_id", "c.*")  # in the partitions in which alerts are joined


def alert_features(bundle: Bundle) -> DataFrame:
    out = repeats(durations(bundle.alerts)).join(linked_cases(bundle).hint("merge"), "alert_id", "left")
    return out.withColumns({"has_case": F.col("case_id").isNotNull(), "workflow_event_count": F.coalesce("workflow_event_count", F.lit(0)), "is_escalated": F.coalesce("is_escalated", F.lit(False))})


def asset_features(bundle: Bundle) -> DataFrame:
    counts = bundle.alerts.groupBy("asset_id").agg(F.count("*").alias("total_alerts"), F.count_if(F.col("severity") == "critical").alias("critical_alerts"), F.count_if(F.col("severity") == "high").alias("high_alerts"))
    out = bundle.assets.join(counts.hint("merge"), "asset_id", "left").fillna(0, ["total_alerts", "critical_alerts", "high_alerts"])
    silent = F.col("total_alerts") == 0
    return out.withColumn("is_silent", silent).withColumn("is_critical_silent", silent & (F.col("criticality") == "critical"))


def zero_runs(alerts: DataFrame) -> DataFrame:
    """Each entity's runs of days without alerts between days with alerts: start, end, days."""
    days = alerts.where("entity_id is not null and created_ts is not null").select("entity_id", F.to_date("created_ts").alias("day")).distinct()
    nxt = F.lead("day").over(Window.partitionBy("entity_id").orderBy("day"))
    gaps = days.withColumn("next", nxt).withColumn("days", F.datediff("next", "day") - 1)
    return gaps.where("days > 0").select("entity_id", F.date_add("day", 1).alias("start"), F.col("next").alias("end"), "days")


def rate(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def analyst_counts(af: DataFrame) -> DataFrame:
    return af.where(ch() & F.col("analyst_id").isNotNull() & F.col("entity_id").isNotNull()).groupBy("entity_id", "analyst_id").agg(F.count("*").alias("n"))


def entity_cases(bundle: Bundle, alerts: DataFrame | None = None) -> DataFrame:
    """Cases with the entity of their alert; ``alerts``: the bundle's, where they were written."""
    owner = (bundle.alerts if alerts is None else alerts).groupBy("alert_id").agg(F.min("entity_id").alias("entity_id"))
    return bundle.cases.join(owner.hint("merge"), "alert_id")


def _whole(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("long")


def asset_places(assets: DataFrame) -> DataFrame:
    """Each entity's assets by what is expected of them and whether they were silent."""
    crit, mon = F.col("criticality") == "critical", F.col("monitoring_expected")
    return assets.groupBy("entity_id").agg(
        F.count("*").alias("total_assets"),
        F.count_if(crit).alias("crit_assets"),
        F.count_if(crit & mon).alias("monitored_crit"),
        F.count_if(crit & mon & F.col("is_silent")).alias("silent_crit_assets"),
        F.count_if(~F.col("is_silent")).alias("active_assets"),
    )


def _per_asset() -> Column:
    return _whole("total_alerts") / F.greatest(_whole("total_assets"), F.lit(1))


def _crit_coverage() -> Column:
    return F.when(_whole("crit_assets") > 0, F.least((_whole("crit_assets") - _whole("silent_crit_assets")) / _whole("crit_assets"), _whole("monitored_crit") / _whole("crit_assets"))).otherwise(1.0)


def entity_volumes(entities: DataFrame, alerts: DataFrame, assets: DataFrame) -> DataFrame:
    """Of ``entity_features`` what the detectors of volume and coverage read."""
    counts = alerts.groupBy("entity_id").agg(F.count("*").alias("total_alerts"))
    seen = assets.join(alerts.select("asset_id").distinct().withColumn("seen", F.lit(True)).hint("merge"), "asset_id", "left").withColumn("is_silent", F.col("seen").isNull())
    out = entities.select("entity_id").join(counts, "entity_id", "left").join(asset_places(seen), "entity_id", "left")
    return out.select("entity_id", _per_asset().alias("alerts_per_asset"), _crit_coverage().alias("crit_coverage_ratio"))


def entity_features(bundle: Bundle, af: DataFrame | None = None) -> DataFrame:
    af = alert_features(bundle) if af is None else af
    sev = lambda s: F.col("severity") == s
    base = af.groupBy("entity_id").agg(
        F.count("*").alias("total_alerts"),
        F.median(F.when(sev("critical"), F.col("closure_duration_sec"))).alias("crit_median_close_sec"),
        F.percentile(F.when(sev("critical"), F.col("closure_duration_sec")), 0.05).alias("crit_p5_close_sec"),
        F.median(F.when(sev("high"), F.col("closure_duration_sec"))).alias("high_median_close_sec"),
        rate(F.when(sev("critical"), F.col("is_escalated"))).alias("crit_esc_rate"),
        rate(F.when(sev("high"), F.col("is_escalated"))).alias("high_esc_rate"),
        rate(F.when(ch(), F.col("is_escalated"))).alias("crithigh_esc_rate"),
        rate(F.col("workflow_event_count") == 0).alias("unworked_ratio"),
        rate(F.col("is_sla_window")).alias("sla_bunching_ratio"),
        F.count_if(ch()).alias("ch_alerts"),
    )
    counts = analyst_counts(af)
    top1 = counts.groupBy("entity_id").agg(F.max("n").alias("top1"))
    places = asset_places(asset_features(bundle))
    ec = entity_cases(bundle)
    notes = ec.where("notes_text is not null").groupBy("entity_id").agg(rate(F.contains("notes_text", F.lit(TEMPLATE))).alias("template_ratio"))
    gaps = zero_runs(bundle.alerts).groupBy("entity_id").agg(F.max("days").alias("gap"))
    parts = [
        base,
        places,
        top1,
        gini(counts, ["entity_id"], "n", "analyst_gini"),
        entropy_bits(ec, ["entity_id"], "closure_code", "closure_code_entropy"),
        entropy_bits(ec.withColumn("lead40", F.substring("notes_text", 1, 40)), ["entity_id"], "lead40", "notes_entropy"),
        notes,
        gaps,
    ]
    out = bundle.entities.select("entity_id", "sector", "size_band", "soc_model")
    for p in parts:
        out = out.join(p, "entity_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    whole = _whole
    share = lambda n, d, empty: F.when(whole(d) > 0, whole(n) / whole(d)).otherwise(empty)
    return out.select(
        "entity_id", "sector", "size_band", "soc_model",
        whole("total_alerts").alias("total_alerts"), whole("total_assets").alias("total_assets"),
        _per_asset().alias("alerts_per_asset"),
        "crit_median_close_sec", "crit_p5_close_sec", "high_median_close_sec", "crit_esc_rate", "high_esc_rate", "crithigh_esc_rate",
        zero("unworked_ratio").alias("unworked_ratio"), zero("analyst_gini").alias("analyst_gini"),
        share("top1", "ch_alerts", 0.0).alias("top1_analyst_share"),
        zero("sla_bunching_ratio").alias("sla_bunching_ratio"), zero("closure_code_entropy").alias("closure_code_entropy"), zero("notes_entropy").alias("notes_entropy"), zero("template_ratio").alias("template_ratio"),
        whole("silent_crit_assets").alias("silent_crit_assets"), share("active_assets", "total_assets", 0.0).alias("coverage_ratio"),
        _crit_coverage().alias("crit_coverage_ratio"),
        F.when(whole("total_alerts") > 0, F.coalesce("gap", F.lit(0))).otherwise(999).cast("long").alias("max_consecutive_zero_days"),
    )


def entity_month_features(af: DataFrame) -> DataFrame:
    """Assets are counted apart: a distinct count beside the median would make a buffer of durations for each asset and month."""
    crit, month = F.col("severity") == "critical", ["entity_id", "year_month"]
    dated = af.where("entity_id is not null and created_ts is not null").withColumn("year_month", F.date_format("created_ts", "yyyy-MM"))
    base = dated.groupBy(*month).agg(
        F.count("*").alias("monthly_volume"),
        F.count_if(crit).alias("crit_volume"),
        F.coalesce(F.median(F.when(crit, F.col("closure_duration_sec"))), F.lit(0.0)).alias("crit_median_close_sec"),
        F.coalesce(rate(F.when(ch(), F.col("is_escalated"))), F.lit(0.0)).alias("ch_esc_rate"),
        rate(F.col("workflow_event_count") == 0).alias("unworked_ratio"),
        rate(F.col("is_sla_window")).alias("sla_window_ratio"),
        rate(F.coalesce(F.col("disposition") == "false_positive", F.lit(False))).alias("fp_rate"),
    )
    assets = dated.groupBy(*month, "asset_id").agg(F.lit(1)).groupBy(*month).agg(F.count("asset_id").alias("unique_assets_alerted"))
    return base.join(assets, month)


def numbered(rows: DataFrame, key: str, coarse: list[Column], order: list[Column | str], name: str) -> DataFrame:
    """Positions from 1 within each key, ordered by ``coarse``, whose values are never null, and then ``order``.

    Rows are numbered within each coarse value and shifted by the counts of earlier ones, so that a key's rows are spread over tasks."""
    parts = [f"__c{i}" for i in range(len(coarse))]
    dealt = rows.withColumns(dict(zip(parts, coarse, strict=True)))
    counts = dealt.groupBy(key, *parts).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(key).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, *parts, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(key, *parts).orderBy(*order))
    return dealt.withColumn("__r", within).join(starts, [key, *parts]).withColumn(name, (F.col("__before") + F.col("__r")).cast("int")).drop(*parts, "__n", "__r", "__before")
