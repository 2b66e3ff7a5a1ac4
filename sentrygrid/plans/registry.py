"""Every operator as a named query over the driver's tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrygrid.functions.stats import correlation_p, entropy_bits, gini, poisson_cdf, spearman
from sentrygrid.operators import anomaly, audit, claims, cohorts, detectors, evaluation, features, feedback, generators, quarantine, review_queue, robustness, scoring, serving
from sentrygrid.operators.detectors import Context
from sentrygrid.schema import FINDING, Bundle
from sentrygrid.sources import driver_tables, scratch, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Detectors whose findings the scoring and queue queries over the given tables use: all but the one that learns, which ``planted`` queries score.
BASIC = [d for d in detectors.METRICS if d != "NOV-01"]
BUDGET = 40


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def ctx(spark: SparkSession, d: str) -> Context:
    return Context(driver_tables.bundle(spark, d))


SOURCES = ("nation", "region", "customer", "supplier", "part", "orders", "lineitem")


def basic_findings(spark: SparkSession, d: str) -> DataFrame:
    """The findings over the tables, written once a session by this step and read by scores, queues and reports, as in a whole run.
    Tables that were written anew have another fingerprint, so their findings are made again."""
    name = f"findings-{scratch.fingerprint(spark, [f'{d}/{t}.parquet' for t in SOURCES])}"
    return scratch.kept_as(spark, name, lambda: _findings(spark, d), FINDING)


def _worked(spark: SparkSession, d: str) -> Bundle:
    """The tables with the cases written, which are made of all order lines: detectors and examiners' orders read them several times."""
    b = driver_tables.bundle(spark, d)
    return b.replace(cases=scratch.written(spark, b.cases, "cases"))


def _findings(spark: SparkSession, d: str) -> Iterator[DataFrame]:
    return detectors.each_detector(_worked(spark, d), BASIC, keep=scratch.folder(spark, "features"))


def _register_findings(detector: str) -> None:
    def rows(spark: SparkSession, d: str) -> DataFrame:
        f = detectors.findings(detector, ctx(spark, d))
        return f.select("finding_id", "entity_id", "scope", "category", "severity_weight", F.round("deviation", 3).alias("deviation"), F.round("peer_percentile", 4).alias("peer_percentile"), "confidence", joined("evidence_refs").alias("refs"))

    rows.__name__ = f"findings_{detector.replace('-', '').lower()}"
    query(rows)


def joined(refs: str) -> Column:
    return F.array_join(F.array_sort(refs), ",")


for _d in BASIC:
    _register_findings(_d)


@query
def findings_by_detector(spark, d):
    return basic_findings(spark, d).groupBy("detector_id").agg(F.count("*").alias("findings"))


# ---------------------------------------------------------------- sources
@query
def scan_store_counts(spark, d):
    return quarantine.counts(driver_tables.bundle(spark, d))


def _canned(spark: SparkSession, d: str, name: str) -> DataFrame:
    b = driver_tables.bundle(spark, d)
    sql = serving.CANNED[name]
    for table in ("alerts", "quarantine"):
        sql = sql.replace(f"FROM {table}", f"FROM {{{table}}}")
    return spark.sql(sql, alerts=b.alerts)


@query
def sql_sev_disp(spark, d):
    return _canned(spark, d, "severity_by_disposition")


@query
def sql_crit_mttc(spark, d):
    return rounded(_canned(spark, d, "critical_close_minutes"), "minutes")


@query
def sql_top_assets(spark, d):
    return _canned(spark, d, "top_assets")


@query
def sql_quarantine_sample(spark, d):
    return spark.sql(serving.CANNED["quarantine_sample"].replace("FROM quarantine", "FROM {quarantine}"), quarantine=_orphaned(spark, d).quarantine)


@query
def store_roundtrip(spark, d):
    """Rows of each table, and alerts by severity through SQL, of a store written and read back."""
    path = scratch.folder(spark, "store")
    store.write_store(driver_tables.bundle(spark, d), path)
    by_severity = store.query(spark, path, "SELECT concat('severity ', severity) AS table_name, count(*) AS rows FROM alerts GROUP BY severity")
    return quarantine.counts(store.load_bundle(spark, path)).unionByName(by_severity)


def _from_text(spark: SparkSession, d: str, fmt: str) -> DataFrame:
    """Valid and quarantined alerts by reason of a dataset written as text and loaded."""
    path = scratch.folder(spark, fmt)
    driver_tables.dirty_alerts(spark, d).write.option("header", True).format(fmt).save(f"{path}/alerts.{fmt}")
    loaded = store.load_dataset(spark, path)
    parts = [loaded.alerts.select(F.lit("valid").alias("reason")), loaded.quarantine.select(F.col("quarantine_reason").alias("reason"))]
    return parts[0].unionByName(parts[1]).groupBy("reason").agg(F.count("*").alias("n"))


@query
def csv_source(spark, d):
    return _from_text(spark, d, "csv")


@query
def json_source(spark, d):
    return _from_text(spark, d, "json")


@query
def sql_grouping_sets(spark, d):
    b = driver_tables.bundle(spark, d)
    return spark.sql("SELECT entity_id, severity, count(*) AS n FROM {alerts} GROUP BY GROUPING SETS ((entity_id, severity), (severity), ())", alerts=b.alerts)


@query
def infer_entities(spark, d):
    b = driver_tables.bundle(spark, d)
    return quarantine.infer_entities(b.alerts, b.assets).select("entity_id", "sector", "size_band", "soc_model")


@query
def legacy_adapt(spark, d):
    a = driver_tables.alerts(spark, d)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    wide = a.select("alert_id", F.col("entity_id").alias("cse_id"), "asset_id", F.upper("severity").alias("severity"), F.col("category").alias("alert_type"), text("created_ts").alias("alert_time"), text("ack_ts").alias("ack_time"), text("ack_ts").alias("investigation_start"), text("closed_ts").alias("closure_time"), F.when(F.col("severity") == "critical", "Yes").otherwise("No").alias("escalated"), F.when(F.col("disposition") == "true_positive", "yes").alias("root_cause_found"), F.col("category").alias("investigation_notes"), "disposition")
    t = store.adapt_legacy_alerts(wide)
    return t["alerts"].select("alert_id", "entity_id", "severity", "category", "created_ts").join(t["cases"].select("alert_id", "case_id", "closure_code", "notes_text"), "alert_id").join(t["escalations"].select("case_id", "outcome"), "case_id", "left")


# ---------------------------------------------------------------- validation
@query
def quarantine_reason(spark, d):
    judged = quarantine.with_reason("alerts", driver_tables.dirty_alerts(spark, d))
    return judged.select("row_pos", "alert_id", "quarantine_reason")


@query
def quarantine_counts(spark, d):
    return quarantine_reason(spark, d).groupBy("quarantine_reason").agg(F.count("*").alias("n"))


@query
def dedup_pk(spark, d):
    good, _ = quarantine.validate("alerts", driver_tables.dirty_alerts(spark, d))
    return good.select("alert_id", "entity_id", "severity")


def _orphaned(spark: SparkSession, d: str) -> Bundle:
    """Some parents are taken away, so that references break in a cascade."""
    b = driver_tables.bundle(spark, d)
    return quarantine.enforce_references(b.replace(entities=b.entities.where("entity_id not in ('N3', 'N7')")))


def _by_reason(spark: SparkSession, d: str, name: str) -> DataFrame:
    return _orphaned(spark, d).quarantine.where(F.col("table_name") == name).groupBy("table_name", "quarantine_reason").agg(F.count("*").alias("n"))


@query
def ri_alerts(spark, d):
    return _by_reason(spark, d, "alerts")


@query
def ri_cases(spark, d):
    return _by_reason(spark, d, "cases")


@query
def ri_workflow(spark, d):
    return _by_reason(spark, d, "workflow_events")


@query
def ri_escalations(spark, d):
    return _by_reason(spark, d, "escalations")


# ---------------------------------------------------------------- features
@query
def alert_durations(spark, d):
    f = features.durations(driver_tables.alerts(spark, d))
    return longs(rounded(f.select("alert_id", "ack_latency_sec", "closure_duration_sec", "closure_duration_min", "total_lifecycle_sec", "closed_minute", "closed_hour", "closed_dayofweek"), "closure_duration_min"), "closed_minute", "closed_hour", "closed_dayofweek")


@query
def sla_window(spark, d):
    f = features.durations(driver_tables.alerts(spark, d))
    return f.groupBy("entity_id").agg(F.count_if("is_sla_window").alias("in_window"), F.count("*").alias("n"))


@query
def repeat_7d(spark, d):
    f = features.repeats(driver_tables.alerts(spark, d))
    return rounded(f.select("alert_id", "days_since_prev", "is_repeat_7d"), "days_since_prev")


@query
def repeat_running(spark, d):
    return features.repeats(driver_tables.alerts(spark, d)).select("alert_id", "repeat_streak_7d")


@query
def case_link(spark, d):
    return ctx(spark, d).alerts.select("alert_id", "case_id", "has_case", "analyst_id", "closure_code", "notes_text")


@query
def workflow_count(spark, d):
    return ctx(spark, d).alerts.select("alert_id", "workflow_event_count")


@query
def escalated_flag(spark, d):
    return ctx(spark, d).alerts.groupBy("entity_id", "severity").agg(F.count_if("is_escalated").alias("escalated"), F.count("*").alias("n"))


@query
def asset_features(spark, d):
    return ctx(spark, d).assets.select("asset_id", "entity_id", "total_alerts", "critical_alerts", "high_alerts", "is_silent", "is_critical_silent")


@query
def entity_features(spark, d):
    c = ctx(spark, d)
    doubles = ["alerts_per_asset", "crit_median_close_sec", "crit_p5_close_sec", "high_median_close_sec", "crit_esc_rate", "high_esc_rate", "crithigh_esc_rate", "unworked_ratio", "analyst_gini", "top1_analyst_share", "sla_bunching_ratio", "closure_code_entropy", "notes_entropy", "template_ratio", "coverage_ratio", "crit_coverage_ratio"]
    return rounded(c.entities.drop("soc_model"), *doubles)


@query
def entity_month(spark, d):
    return rounded(ctx(spark, d).months, "crit_median_close_sec", "ch_esc_rate", "unworked_ratio", "sla_window_ratio", "fp_rate")


@query
def daily_gaps(spark, d):
    g = features.zero_runs(driver_tables.alerts(spark, d))
    return longs(g.select("entity_id", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "days"), "days")


@query
def closure_entropy(spark, d):
    return rounded(entropy_bits(features.entity_cases(driver_tables.bundle(spark, d)), ["entity_id"], "closure_code", "bits"), "bits")


@query
def analyst_gini(spark, d):
    return rounded(gini(features.analyst_counts(ctx(spark, d).alerts), ["entity_id"], "n", "gini"), "gini")


@query
def template_ratio(spark, d):
    ec = features.entity_cases(driver_tables.bundle(spark, d))
    return rounded(ec.groupBy("entity_id").agg(features.rate(F.contains("notes_text", F.lit("ch"))).alias("ratio")), "ratio")


@query
def category_pivot(spark, d):
    counts = driver_tables.alerts(spark, d).groupBy("entity_id").pivot("category", [f"CAT{i}" for i in range(6)]).count()
    return counts.fillna(0)


@query
def system_of_tiers(spark, d):
    return driver_tables.bundle(spark, d).assets.groupBy("criticality", "monitoring_expected").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- cohorts and kernels
@query
def cohort_levels(spark, d):
    return longs(ctx(spark, d).cohorts.select("entity_id", "cohort_level", "cohort_key", "cohort_size"), "cohort_size")


def _peer(df: DataFrame, *more: str) -> DataFrame:
    return longs(rounded(df.select("entity_id", "value", "cohort_level", "peers", "median", "mad", "z", "percentile", *more), "value", "median", "mad", "z", "percentile"), "peers")


@query
def peer_robust_z(spark, d):
    c = ctx(spark, d)
    values = c.bundle.alerts.groupBy("entity_id").agg(F.count("*").cast("double").alias("value"))
    return _peer(cohorts.peer_stats(values, c.cohorts)).select("entity_id", "value", "median", "mad", "z")


@query
def peer_pct_rank(spark, d):
    c = ctx(spark, d)
    values = c.bundle.alerts.groupBy("entity_id").agg(F.count("*").cast("double").alias("value"))
    return _peer(cohorts.peer_stats(values, c.cohorts)).select("entity_id", "cohort_level", "peers", "percentile")


@query
def poisson_tail(spark, d):
    counts = driver_tables.alerts(spark, d).groupBy("entity_id", "severity").agg(F.count("*").alias("n"))
    return rounded(counts.withColumn("p", poisson_cdf(F.col("n"), F.col("n") * 1.1)), "p")


@query
def volume_ratio(spark, d):
    return rounded(detectors.ns04(ctx(spark, d)).select("entity_id", "value", "median", "ratio"), "value", "median", "ratio")


@query
def spearman_rank(spark, d):
    a = driver_tables.alerts(spark, d).groupBy("entity_id").agg(F.count("*").alias("x"), F.count_if(F.col("severity") == "critical").alias("y"))
    return rounded(spearman(a, "x", "y"), "rho")


@query
def spearman_p(spark, d):
    """Volume against share of critical alerts, with the p-value."""
    a = driver_tables.alerts(spark, d).groupBy("entity_id").agg(F.count("*").alias("x"), F.avg((F.col("severity") == "critical").cast("int")).alias("y"))
    return rounded(spearman(a, "x", "y").withColumn("p", correlation_p(F.col("rho"), F.col("n"))), "rho", "p")


# ---------------------------------------------------------------- detectors
@query
def eg01(spark, d):
    return rounded(detectors.eg01(ctx(spark, d)).drop("cohort_level"), "dur", "p5", "median", "z", "percentile")


@query
def eg02(spark, d):
    return _peer(detectors.eg02(ctx(spark, d)), "hit")


@query
def eg03(spark, d):
    return longs(detectors.eg03(ctx(spark, d)), "ordinal")


@query
def eg04(spark, d):
    return rounded(detectors.eg04(ctx(spark, d)), "share", "similarity", "entropy")


@query
def eg05(spark, d):
    return detectors.eg05(ctx(spark, d))


@query
def eg06(spark, d):
    return _peer(detectors.eg06(ctx(spark, d)), "hit")


@query
def eg07(spark, d):
    return _peer(detectors.eg07(ctx(spark, d)), "analyst_id", "hit")


@query
def eg08(spark, d):
    return rounded(detectors.eg08(ctx(spark, d)), "cusum", "first_rate", "last_rate")


@query
def ns01(spark, d):
    return detectors.ns01(ctx(spark, d))


@query
def ns02(spark, d):
    return rounded(detectors.ns02(ctx(spark, d)), "mu", "p")


@query
def ns03(spark, d):
    return detectors.ns03(ctx(spark, d))


@query
def ns04(spark, d):
    return _peer(detectors.ns04(ctx(spark, d)), "hit")


@query
def ns05(spark, d):
    runs = detectors.ns05(ctx(spark, d))
    return longs(runs.select("entity_id", F.col("start").cast("string").alias("start"), "days", "hit"), "days")


@query
def ns06(spark, d):
    return _peer(detectors.ns06(ctx(spark, d)), "hit")


@query
def nov01_scaled(spark, d):
    return rounded(anomaly.scaled(ctx(spark, d).months), *anomaly.FEATURES)


@query
def nov01_lof(spark, d):
    """As a logarithm: among repeated points the factor has many digits before the point."""
    out = anomaly.lof(anomaly.scaled(ctx(spark, d).months))
    return rounded(out.select("entity_id", "year_month", F.log10("lof").alias("log_lof")), "log_lof", digits=5)


@query
def nov01_iforest(spark, d):
    return rounded(anomaly.isolation_forest(anomaly.scaled(ctx(spark, d).months)), "forest_score")


@query
def nov01_months(spark, d):
    """Every month with both scores, its leading features, and whether it is novel."""
    out = anomaly.novelty(ctx(spark, d).months)
    out = rounded(out.select("entity_id", "year_month", "forest_score", F.log10("lof").alias("log_lof"), joined("drivers").alias("drivers"), "hit"), "forest_score")
    return rounded(out, "log_lof", digits=5)


# ---------------------------------------------------------------- findings and scores
@query
def finding_ids(spark, d):
    return basic_findings(spark, d).select("finding_id", "detector_id", "entity_id", "scope")


@query
def finding_score(spark, d):
    return rounded(scoring.scored(basic_findings(spark, d)).select("finding_id", "score"), "score")


@query
def area_scores(spark, d):
    out = scoring.area_scores(spark, basic_findings(spark, d), driver_tables.entities(spark, d))
    return rounded(out.select("entity_id", "area", "score", "findings", F.array_join("top_detectors", ",").alias("top_detectors")), "score", digits=2)


@query
def risk_index(spark, d):
    out = scoring.risk_index(scoring.area_scores(spark, basic_findings(spark, d), driver_tables.entities(spark, d)))
    return out.select("entity_id", "risk_index")


@query
def risk_tier(spark, d):
    out = scoring.risk_index(scoring.area_scores(spark, basic_findings(spark, d), driver_tables.entities(spark, d)))
    return serving.distribution(out, "risk_tier")


@query
def qoq_trend(spark, d):
    return scoring.trends(basic_findings(spark, d), driver_tables.alerts(spark, d))


@query
def trend_distribution(spark, d):
    return serving.distribution(scoring.trends(basic_findings(spark, d), driver_tables.alerts(spark, d)), "trend")


@query
def peer_percentile(spark, d):
    return rounded(scoring.portfolio(spark, basic_findings(spark, d), driver_tables.bundle(spark, d)).select("entity_id", "peer_percentile", "finding_count"), "peer_percentile")


@query
def top_concern(spark, d):
    return scoring.top_concern(scoring.area_scores(spark, basic_findings(spark, d), driver_tables.entities(spark, d)))


# ---------------------------------------------------------------- queues
@query
def queue_risk(spark, d):
    return longs(review_queue.risk_items(basic_findings(spark, d), BUDGET).select("entity_id", "rank", "finding_id"), "rank")


@query
def queue_control(spark, d):
    f = basic_findings(spark, d)
    out = review_queue.control_items(driver_tables.alerts(spark, d), review_queue.risk_items(f, BUDGET), BUDGET)
    return longs(out.select("entity_id", "alert_id", "pick"), "pick")


@query
def queue_full(spark, d):
    q = review_queue.build_queues(basic_findings(spark, d), driver_tables.alerts(spark, d), BUDGET)
    return longs(q.select("entity_id", "rank", "item_id", "bucket", "scope", "target_type"), "rank")


# ---------------------------------------------------------------- claims
@query
def claim_evidence(spark, d):
    return rounded(claims.evidence(driver_tables.bundle(spark, d)), "mttc_min", "coverage_pct", "fp_rate_pct", "escalation_pct")


@query
def claim_compare(spark, d):
    return rounded(claims.compare(driver_tables.bundle(spark, d)), "claimed", "observed", "exaggeration", "credibility", digits=3)


@query
def claim_index(spark, d):
    return claims.claim_index(claims.compare(driver_tables.bundle(spark, d)))


@query
def claim_summary(spark, d):
    return claims.summary(claims.claim_index(claims.compare(driver_tables.bundle(spark, d))))


# ---------------------------------------------------------------- feedback and audit
def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Decisions by a rule: orders are confirmed or dismissed by their key."""
    rows = driver_tables.table(spark, d, "orders")
    k = F.col("o_orderkey")
    return rows.select(k.alias("feedback_id"), F.concat(F.lit("FND-"), (k % 200).cast("string")).alias("finding_id"), F.concat(F.lit("N"), (k % 25).cast("string")).alias("entity_id"), F.element_at(F.array(*map(F.lit, ("EG-03", "EG-08", "NS-03"))), (k % 3 + 1).cast("int")).alias("detector_id"), F.when(k % 7 < 4, "dismiss").otherwise("confirm").alias("decision"), F.lit("examiner").alias("examiner"), F.lit("").alias("comment"), k.cast("string").alias("created_at"))


@query
def feedback_weights(spark, d):
    return longs(feedback.weights(ledger(spark, d)).select("entity_id", "detector_id", F.round("factor", 4).alias("factor"), "version"), "version")


@query
def feedback_apply(spark, d):
    out = feedback.apply(basic_findings(spark, d), feedback.weights(ledger(spark, d)))
    return out.groupBy("entity_id", "detector_id").agg(F.count_if(F.col("feedback_factor") != 1).alias("weighed"), F.count("*").alias("n"))


@query
def feedback_latest(spark, d):
    return feedback.latest(ledger(spark, d)).select("finding_id", "feedback_id", "decision")


@query
def feedback_history(spark, d):
    return feedback.history(ledger(spark, d), entity="N3", limit=50).select("feedback_id", "detector_id", "decision")


@query
def queue_decisions(spark, d):
    """Queue items with the last of up to two decisions on their finding, which the last digits of its id fix."""
    f = basic_findings(spark, d)
    tail = F.right("finding_id", F.lit(1))
    once = f.where(tail < "8").select("finding_id", F.lit(1).alias("feedback_id"), F.when(F.substring("finding_id", -2, 1) < "8", "confirm").otherwise("dismiss").alias("decision"))
    again = f.where(tail < "4").select("finding_id", F.lit(2).alias("feedback_id"), F.lit("dismiss").alias("decision"))
    q = feedback.decided(review_queue.build_queues(f, driver_tables.alerts(spark, d), BUDGET), once.unionByName(again))
    return longs(q.select("entity_id", "rank", "bucket", "scope", "decision", "decided_by"), "rank", "decided_by")


@query
def expert_agreement(spark, d):
    k = F.col("o_orderkey")
    ids = driver_tables.table(spark, d, "orders").select(F.concat(F.lit("FND-"), k.cast("string")).alias("finding_id"), F.lit("EG-03").alias("detector_id"), F.concat(F.lit("N"), (k % 25).cast("string")).alias("entity_id"), (k % 5 / 8).alias("confidence"))
    return rounded(feedback.agreement(ledger(spark, d), ids, "entity_id"), "confirm_rate", "coverage", "confidence_confirmed", "confidence_dismissed", digits=4)


@query
def chain_verify(spark, d):
    """A chain of an entry a nation, the 9th linked wrongly and the 25th altered; the few nations are chained on the driver."""
    names = driver_tables.table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").limit(25).collect()
    rows, last = [], audit.GENESIS
    for k, name in names:
        entry = {"entry_id": k + 1, "timestamp": "2026-01-01", "event_type": "run", "run_id": name, "data_hash": hashlib.md5(name.encode()).hexdigest(), "prev_hash": "broken" if k == 8 else last}
        last = "altered" if k == 24 else audit.entry_hash(entry)
        rows.append((*entry.values(), last))
    chained = spark.createDataFrame(rows, "entry_id long, timestamp string, event_type string, run_id string, data_hash string, prev_hash string, entry_hash string")
    return audit.verify(chained).select("entry_id", "link_ok", "hash_ok")


# ---------------------------------------------------------------- evaluation
def truth(spark: SparkSession, d: str) -> DataFrame:
    """Faults by a rule: every 40th alert, and one broad fault for some entities."""
    k = F.substring("alert_id", 2, 20).cast("long")
    narrow = driver_tables.alerts(spark, d).where(k % 40 == 0).select("entity_id", F.lit("EG-03").alias("detector_expected"), F.concat(F.lit("alert:"), "alert_id").alias("scope"), F.when(k % 80 == 0, "strong").otherwise("subtle").alias("intensity"))
    broad = driver_tables.entities(spark, d).where("sector = 'ASIA'").select("entity_id", F.lit("NS-03").alias("detector_expected"), F.concat(F.lit("entity:"), "entity_id").alias("scope"), F.lit("strong").alias("intensity"))
    return narrow.unionByName(broad)


@query
def match_findings(spark, d):
    items = basic_findings(spark, d).select("entity_id", F.col("finding_id").alias("item_id"), "detector_id", "scope", "evidence_refs")
    return evaluation.matched(items, truth(spark, d)).select("item_id", "detector_id")


@query
def precision_at_k(spark, d):
    order = Window.partitionBy("entity_id").orderBy(F.desc("score"), "finding_id")
    ranked = scoring.scored(basic_findings(spark, d)).withColumn("rank", F.row_number().over(order)).select("entity_id", F.col("finding_id").alias("item_id"), "detector_id", "scope", "evidence_refs", "rank")
    t = truth(spark, d)
    sizes = driver_tables.alerts(spark, d).groupBy("entity_id").agg(F.count("*").alias("alerts")).join(t.groupBy("entity_id").agg(F.count("*").alias("faults")), "entity_id")
    return longs(evaluation.precision_at(ranked.select("entity_id", "item_id", "rank"), evaluation.matched(ranked.drop("rank"), t), sizes), "true_positives", "items")


@query
def uniform_baseline(spark, d):
    return evaluation.uniform_sample(driver_tables.alerts(spark, d)).select("entity_id", "alert_id")


@query
def random_baseline(spark, d):
    a = driver_tables.alerts(spark, d)
    hits = truth(spark, d).where("scope like 'alert:%'").select(F.substring("scope", 7, 20).alias("alert_id"))
    return rounded(evaluation.random_baseline(a, hits), "expected_precision")


@query
def stratified_order(spark, d):
    return longs(evaluation.stratified_order(driver_tables.alerts(spark, d)), "position")


@query
def checklist_score(spark, d):
    return longs(evaluation.checklist(driver_tables.bundle(spark, d)), "position")


def case_truth(spark: SparkSession, d: str) -> DataFrame:
    """The faults, and every 90th case."""
    cases = driver_tables.bundle(spark, d)
    owned = features.entity_cases(cases).where(F.substring("case_id", 2, 20).cast("long") % 90 == 7)
    return truth(spark, d).select("entity_id", "scope").unionByName(owned.select("entity_id", F.concat(F.lit("case:"), "case_id").alias("scope")))


@query
def case_hits(spark, d):
    return evaluation.alert_hits(driver_tables.bundle(spark, d), case_truth(spark, d))


def _manual(spark: SparkSession, d: str) -> DataFrame:
    b = _worked(spark, d)
    hits = scratch.written(spark, evaluation.alert_hits(b, case_truth(spark, d)), "hits")
    parts = [scratch.written(spark, evaluation.manual_precision(o, hits).withColumn("baseline", F.lit(n)), "baseline") for n, o in (("stratified", evaluation.stratified_order(b.alerts)), ("checklist", evaluation.checklist(b)))]
    return parts[0].unionByName(parts[1])


@query
def manual_baselines(spark, d):
    return longs(_manual(spark, d), "items", "true_positives")


@query
def lift_over_manual(spark, d):
    return rounded(evaluation.lifts(precision_at_k(spark, d), _manual(spark, d)), "lift", digits=4)


@query
def ablation(spark, d):
    return evaluation.ablation(basic_findings(spark, d)).groupBy("suite").agg(F.count("*").alias("findings"))


@query
def ablation_precision(spark, d):
    t = truth(spark, d)
    sizes = driver_tables.alerts(spark, d).groupBy("entity_id").agg(F.count("*").alias("alerts")).join(t.groupBy("entity_id").agg(F.count("*").alias("faults")), "entity_id")
    return longs(evaluation.ablation_precision(basic_findings(spark, d), t, sizes), "findings", "items", "true_positives")


@query
def fault_intensity(spark, d):
    return evaluation.fault_intensity(truth(spark, d))


@query
def most_faulty(spark, d):
    return evaluation.most_faulty(truth(spark, d))


# ---------------------------------------------------------------- robustness
@query
def messy_catch_rate(spark, d):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    raw = driver_tables.alerts(spark, d).select(F.substring("alert_id", 2, 20).cast("long").alias("row_pos"), "alert_id", "entity_id", "asset_id", "category", "severity", text("created_ts"), text("ack_ts"), text("closed_ts"), "disposition")
    judged = quarantine.with_reason("alerts", robustness.corrupt(raw))
    known = driver_tables.entities(spark, d).select("entity_id").withColumn("known", F.lit(True))
    both = judged.join(known, "entity_id", "left").withColumn("quarantine_reason", F.coalesce("quarantine_reason", F.when(F.col("known").isNull(), robustness.CORRUPTIONS["ghost_entity"])))
    return rounded(robustness.catch_rate(both), "rate")


@query
def lane_survival(spark, d):
    b = driver_tables.bundle(spark, d)
    after = robustness.tidy(b, "N5")
    pick = lambda x: detectors.run_detectors(x, ["EG-03", "NS-01", "NS-03"])
    return rounded(robustness.lane_survival(pick(b), pick(after), "N5"), "survival")


@query
def sparse_cohorts(spark, d):
    b = robustness.sparse(driver_tables.bundle(spark, d))
    return longs(cohorts.cohorts(b.entities).select("entity_id", "cohort_level", "cohort_size"), "cohort_size")


@query
def rank_stability(spark, d):
    f = basic_findings(spark, d)
    ents = driver_tables.entities(spark, d)
    score = lambda x: scoring.risk_index(scoring.area_scores(spark, x, ents))
    return rounded(robustness.rank_stability(score(f), score(f.where("detector_id <> 'EG-08'"))), "rho")


# ---------------------------------------------------------------- serving
def _areas(spark: SparkSession, d: str) -> DataFrame:
    return scoring.area_scores(spark, basic_findings(spark, d), driver_tables.entities(spark, d))


@query
def entity_list(spark, d):
    return serving.entity_list(scoring.risk_index(_areas(spark, d)), 10)


@query
def findings_filtered(spark, d):
    return serving.find(basic_findings(spark, d), entity="n4", detector="eg-03").select("finding_id", "scope")


@query
def area_averages(spark, d):
    return rounded(serving.area_averages(_areas(spark, d)), "mean_score", digits=1)


@query
def coverage_heatmap(spark, d):
    return serving.coverage_heatmap(driver_tables.bundle(spark, d))


@query
def priority_findings(spark, d):
    return longs(serving.priority_findings(basic_findings(spark, d)).select("entity_id", "finding_id", "detector_id", "rn"), "rn")


@query
def concept_share(spark, d):
    return rounded(serving.category_share(basic_findings(spark, d)), "share")


@query
def top_findings(spark, d):
    return serving.top_findings(basic_findings(spark, d)).select("finding_id", "entity_id", "detector_id", "scope")


@query
def top_detectors(spark, d):
    return serving.top_detectors(basic_findings(spark, d))


@query
def capability_profile(spark, d):
    return rounded(serving.capability_profile(_areas(spark, d)), "score", "median_score", "gap", digits=2)


@query
def indicators(spark, d):
    f = basic_findings(spark, d)
    return serving.indicators(f, scoring.risk_index(scoring.area_scores(spark, f, driver_tables.entities(spark, d))))


@query
def all_findings(spark, d):
    """Every detector over the tables."""
    path = scratch.folder(spark, "all-findings")
    scratch.write_parts(detectors.each_detector(_worked(spark, d), keep=scratch.folder(spark, "features")), path)
    return spark.read.schema(FINDING).parquet(path).groupBy("detector_id").agg(F.count("*").alias("findings"))


@query
def scale_generator(spark, d):
    b = generators.scale_bundle(spark, 20_000)
    return b.alerts.groupBy("severity").agg(F.count("*").alias("n"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitored critical assets that fell silent."""
    return detectors.findings("NS-01", ctx(spark, sf_dir))
