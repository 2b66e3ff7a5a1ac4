"""Queries over the tables with faults of every kind planted in them, and their SQL: each detector has something to find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrygrid.operators import detectors, evaluation, faults, review_queue, scoring
from sentrygrid.operators.detectors import Context
from sentrygrid.plans.oracles import CTES, PLAIN, needs
from sentrygrid.plans.registry import BASIC, BUDGET, SOURCES, Query, joined, longs, rounded
from sentrygrid.schema import FINDING, Bundle
from sentrygrid.sources import driver_tables, scratch

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: A kind each for the first entities; the others are sound.
SCHEDULE = {f"N{i}": kind for i, kind in enumerate(faults.KINDS)}


def bundle(spark: SparkSession, d: str) -> Bundle:
    return faults.plant(driver_tables.bundle(spark, d), SCHEDULE)


def _fingerprint(spark: SparkSession, d: str) -> str:
    return scratch.fingerprint(spark, [f"{d}/{t}.parquet" for t in SOURCES])


def kept_bundle(spark: SparkSession, d: str) -> Bundle:
    """The same, its alerts and cases written once a session: findings, queues and truth read them."""
    at = _fingerprint(spark, d)
    return faults.plant(driver_tables.bundle(spark, d), SCHEDULE, lambda name, df: scratch.kept_as(spark, f"planted-{name}-{at}", lambda: df, df.schema))


# ---------------------------------------------------------------- the same plants in SQL: tables named as before, over the given ones
_ENTITY = {kind: f"entity_id = '{e}'" for e, kind in SCHEDULE.items()}


def _draw(kind: str, key: str) -> str:
    return f"(('0x' || substr(md5('{kind}:' || {key}), 1, 8))::BIGINT % 100)"


def _slot(kind: str, share: int, more: str = "true", key: str = "alert_id") -> str:
    return f"({_ENTITY[kind]} AND {more} AND {_draw(kind, key)} < {share})"


_SEVERE = "severity IN ('critical', 'high')"
_MONTH = f"((year(make_timestamp(created_us)) - {faults.DRIFT_FROM}) * 12 + month(make_timestamp(created_us)) - 1)"
_ODD = f"({_ENTITY['NOV-01']} AND strftime(make_timestamp(created_us), '%Y-%m') = '{faults.ODD_MONTH}')"
OVERLAY = {
    "assets": f"SELECT * REPLACE (monitoring_expected AND NOT {_slot('NS-06', 80, "criticality = 'critical'", 'asset_id')} AS monitoring_expected) FROM assets_given",
    "alerts": f"""
SELECT k, o_totalprice, alert_id, entity_id, asset_id,
  CASE WHEN {_ENTITY['EG-05']} THEN '{faults.CATEGORY}' WHEN {_ENTITY['NS-02']} AND category = '{faults.CATEGORY}' THEN '{faults.OTHER_CATEGORY}' ELSE category END AS category,
  CASE WHEN {_ODD} THEN 'critical' ELSE severity END AS severity, created_us + away AS created_us, ack_us + away AS ack_us,
  CASE WHEN {_ENTITY['EG-08']} AND {_draw('EG-08', 'alert_id')} < least({_MONTH} * {faults.DRIFT_STEP}, 90) THEN 'false_positive' ELSE disposition END AS disposition,
  CASE WHEN {_slot('EG-01', 33, _SEVERE)} THEN ack_us + 20000000 WHEN {_slot('EG-06', 50)} THEN ack_us + 3480000000 WHEN {_ODD} THEN ack_us + 86400000000 ELSE closed_us + away END AS closed_us
FROM (SELECT *, CASE WHEN {_ENTITY['EG-05']} THEN epoch_us(TIMESTAMP '{faults.BURST}') + {_draw('EG-05', 'alert_id')} * 17280000000 - created_us ELSE 0 END AS away FROM alerts_given)
WHERE NOT {_slot('NS-01', 25, key='asset_id')} AND NOT {_slot('NS-04', 70)} AND NOT ({_ENTITY['NS-05']} AND make_timestamp(created_us)::DATE BETWEEN DATE '{faults.SILENCE[0]}' AND DATE '{faults.SILENCE[1]}')""",
    "cases": f"""
SELECT c.case_id, c.alert_id, CASE WHEN {_slot('EG-07', 80)} THEN '{faults.LEAD}' ELSE analyst_id END AS analyst_id, CASE WHEN {_ENTITY['EG-04']} THEN 'standard' ELSE closure_code END AS closure_code,
  CASE WHEN {_ENTITY['EG-04']} THEN '{faults.NOTE}' ELSE notes_text END AS notes_text
FROM cases_given c JOIN (SELECT alert_id AS about, entity_id, severity FROM alerts) ON about = c.alert_id WHERE NOT {_slot('NS-03', 33, _SEVERE)}""",
    "wf": f"SELECT w.* FROM wf_given w JOIN cases USING (case_id) JOIN (SELECT alert_id, entity_id FROM alerts) USING (alert_id) WHERE NOT {_slot('EG-03', 50)}",
    "esc": f"SELECT e.* FROM esc_given e JOIN cases USING (case_id) JOIN (SELECT alert_id, entity_id FROM alerts) USING (alert_id) WHERE NOT {_ENTITY['EG-02']}",
}
OVERLAY |= {
    "findings": CTES["findings"].removesuffix(")") + " UNION ALL SELECT finding_id, detector_id, category, entity_id, scope, sev::DOUBLE, dev::DOUBLE, pct::DOUBLE, conf::DOUBLE, refs FROM f_nov01)",
    "truth": f"""
SELECT entity_id, det, scope, intensity, CASE intensity WHEN 'strong' THEN 2.0 ELSE 1.0 END AS w FROM (
  SELECT entity_id, ['{"', '".join(SCHEDULE.values())}'][substr(entity_id, 2)::INT + 1] AS det, 'entity:' || entity_id AS scope, CASE WHEN {" OR ".join(_ENTITY[k] for k in ("EG-06", "EG-08", "NS-04"))} THEN 'subtle' ELSE 'strong' END AS intensity
  FROM entities WHERE {" OR ".join(_ENTITY[k] for k in ("EG-02", "EG-04", "EG-06", "EG-07", "EG-08", "NS-03", "NS-04", "NS-06"))}
  UNION ALL SELECT entity_id, 'EG-01', 'alert:' || alert_id, 'strong' FROM alerts WHERE {_slot('EG-01', 33, _SEVERE)}
  UNION ALL SELECT entity_id, 'EG-03', 'alert:' || a.alert_id, 'strong' FROM alerts a JOIN (SELECT alert_id AS about FROM cases) ON about = a.alert_id WHERE {_slot('EG-03', 50)}
  UNION ALL SELECT DISTINCT entity_id, 'EG-05', 'asset:' || asset_id, 'strong' FROM alerts WHERE {_ENTITY['EG-05']}
  UNION ALL SELECT DISTINCT entity_id, 'NS-01', 'asset:' || asset_id, 'strong' FROM alerts_given WHERE {_slot('NS-01', 25, key='asset_id')}
  UNION ALL SELECT entity_id, 'NS-02', 'category:{faults.CATEGORY}', 'strong' FROM entities WHERE {_ENTITY['NS-02']}
  UNION ALL SELECT entity_id, 'NS-05', 'period:{faults.SILENCE[0]}', 'strong' FROM entities WHERE {_ENTITY['NS-05']}
  UNION ALL SELECT entity_id, 'NOV-01', 'period:{faults.ODD_MONTH}', 'strong' FROM entities WHERE {_ENTITY['NOV-01']})""",
    "suites": "SELECT unnest(['full', CASE WHEN detector_id IN ('EG-03', 'EG-05', 'NS-01', 'NS-03', 'NS-05') THEN 'rules' WHEN detector_id = 'NOV-01' THEN 'learned' ELSE 'statistics' END]) AS suite, * FROM findings",
}
PLANTED_CTES: dict[str, str] = {}
_names, _from, _to = list(CTES), list(CTES).index("findings"), list(CTES).index("nov")
for _name in _names[:_from] + _names[_to:] + _names[_from:_to]:  # the months' detector before the findings
    _sql = CTES[_name]
    if _name in ("findings", "truth", "suites"):
        PLANTED_CTES[_name] = OVERLAY[_name]
    elif _name in OVERLAY:
        PLANTED_CTES |= {f"{_name}_given": _sql, _name: OVERLAY[_name]}
    else:
        PLANTED_CTES[_name] = _sql


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = needs(sql, ctes=PLANTED_CTES)
        return f

    return add


def parameters(column: str) -> Column:
    """Parameters as text: names in order, numbers with six digits."""
    entries = F.map_entries(F.from_json(column, "map<string,string>"))
    number = lambda v: F.format_string("%.6f", F.round(v.try_cast("double"), 6))
    value = lambda v: F.when(v.try_cast("double").isNull(), v).otherwise(number(v))
    return F.array_join(F.array_sort(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), value(e["value"])))), ",")


def whole(f: DataFrame) -> DataFrame:
    """A finding's columns, reasons and parameters among them, in a comparable form."""
    return f.select("finding_id", "entity_id", "scope", "category", "severity_weight", F.round("deviation", 3).alias("deviation"), F.round("peer_percentile", 4).alias("peer_percentile"), "confidence", joined("evidence_refs").alias("refs"), "reason_text", parameters("parameters").alias("params"))


_WHOLE = "SELECT finding_id, entity_id, scope, category, sev::DOUBLE AS severity_weight, round(dev, 3) AS deviation, round(pct, 4) AS peer_percentile, conf::DOUBLE AS confidence, array_to_string(list_sort(refs), ',') AS refs, reason_text, params FROM {}"


def _register(detector: str) -> None:
    short = detector.replace("-", "").lower()

    def rows(spark: SparkSession, d: str) -> DataFrame:
        return whole(detectors.findings(detector, Context(bundle(spark, d))))

    rows.__name__ = f"planted_{short}"
    query(_WHOLE.format(f"f_{short}"))(rows)


for _d in BASIC:
    _register(_d)


@query(_WHOLE.format("f_nov01").removesuffix(", params FROM f_nov01") + " FROM f_nov01")
def planted_nov01(spark, d):
    return whole(detectors.findings("NOV-01", Context(bundle(spark, d)))).drop("params")


@query("SELECT 'alerts' AS name, count(*) AS n FROM alerts UNION ALL SELECT 'cases', count(*) FROM cases UNION ALL SELECT 'events', count(*) FROM wf UNION ALL SELECT 'escalations', count(*) FROM esc UNION ALL SELECT 'monitored', count(*) FILTER (monitoring_expected) FROM assets UNION ALL SELECT 'false positives', count(*) FILTER (disposition = 'false_positive') FROM alerts")
def planted_counts(spark, d):
    b = bundle(spark, d)
    n = lambda name, df: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    out = n("alerts", b.alerts)
    for name, df in (("cases", b.cases), ("events", b.workflow_events), ("escalations", b.escalations), ("monitored", b.assets.where("monitoring_expected")), ("false positives", b.alerts.where("disposition = 'false_positive'"))):
        out = out.unionByName(n(name, df))
    return out


@query("SELECT entity_id, det AS detector_expected, scope, intensity FROM truth")
def planted_truth(spark, d):
    given = driver_tables.bundle(spark, d)
    return faults.truth(faults.plant(given, SCHEDULE), given, SCHEDULE).select("entity_id", "detector_expected", "scope", "intensity")


@query("SELECT detector_id, count(*) AS findings, count(*) FILTER (entity_id = 'N' || det) AS at_the_faulty FROM findings JOIN det_order USING (detector_id) GROUP BY 1")
def planted_by_detector(spark, d):
    """Findings of each detector, and how many are at the entity that has its fault."""
    at = F.create_map(*[F.lit(x) for e, k in SCHEDULE.items() for x in (k, e)])
    return longs(findings(spark, d).groupBy("detector_id").agg(F.count("*").alias("findings"), F.count_if(F.col("entity_id") == at[F.col("detector_id")]).alias("at_the_faulty")), "findings")


# ---------------------------------------------------------------- scores, queues and evaluation over all fifteen detectors
def findings(spark: SparkSession, d: str) -> DataFrame:
    """All findings over the planted tables, written once a session."""
    return scratch.kept_as(spark, f"planted-{_fingerprint(spark, d)}", lambda: detectors.each_detector(kept_bundle(spark, d), list(detectors.METRICS), keep=scratch.folder(spark, "features")), FINDING)


def _sizes(b: Bundle, t: DataFrame) -> DataFrame:
    return b.alerts.groupBy("entity_id").agg(F.count("*").alias("alerts")).join(t.groupBy("entity_id").agg(F.count("*").alias("faults")), "entity_id")


def _truth(spark: SparkSession, d: str) -> tuple[Bundle, DataFrame]:
    b = kept_bundle(spark, d)
    return b, faults.truth(b, driver_tables.bundle(spark, d), SCHEDULE)


@query(PLAIN["area_scores"])
def planted_area_scores(spark, d):
    out = scoring.area_scores(spark, findings(spark, d), driver_tables.entities(spark, d))
    return rounded(out.select("entity_id", "area", "score", "findings", F.array_join("top_detectors", ",").alias("top_detectors")), "score", digits=2)


@query("SELECT entity_id, risk_tier FROM risk")
def planted_risk_tier(spark, d):
    return scoring.risk_index(scoring.area_scores(spark, findings(spark, d), driver_tables.entities(spark, d))).select("entity_id", "risk_tier")


@query(PLAIN["queue_full"])
def planted_queue(spark, d):
    q = review_queue.build_queues(findings(spark, d), kept_bundle(spark, d).alerts, BUDGET)
    return longs(q.select("entity_id", "rank", "item_id", "bucket", "scope", "target_type"), "rank")


@query(PLAIN["match_findings"])
def planted_matches(spark, d):
    items = findings(spark, d).select("entity_id", F.col("finding_id").alias("item_id"), "detector_id", "scope", "evidence_refs")
    return evaluation.matched(items, _truth(spark, d)[1]).select("item_id", "detector_id")


@query(PLAIN["precision_at_k"])
def planted_precision(spark, d):
    b, t = _truth(spark, d)
    order = Window.partitionBy("entity_id").orderBy(F.desc("score"), "finding_id")
    ranked = scoring.scored(findings(spark, d)).withColumn("rank", F.row_number().over(order)).select("entity_id", F.col("finding_id").alias("item_id"), "detector_id", "scope", "evidence_refs", "rank")
    return longs(evaluation.precision_at(ranked.select("entity_id", "item_id", "rank"), evaluation.matched(ranked.drop("rank"), t), _sizes(b, t)), "true_positives", "items")


@query(PLAIN["ablation_precision"])
def planted_ablation(spark, d):
    """Each suite of detectors alone, the learned one among them."""
    b, t = _truth(spark, d)
    return longs(evaluation.ablation_precision(findings(spark, d), t, _sizes(b, t)), "findings", "items", "true_positives")
