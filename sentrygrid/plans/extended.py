"""Queries of joins over time, recursion, reach, sketches, merged state, layouts, sinks and serving, with their SQL."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import functions as F

from sentrygrid.operators import features, feedback_state, intervals, quarantine, reach, review_queue, scoring, serving, sketches
from sentrygrid.plans.oracles import needs
from sentrygrid.plans.registry import BUDGET, Query, basic_findings, ledger, longs, rounded
from sentrygrid.schema import FINDING
from sentrygrid.sources import bucketed, driver_tables, scratch, store

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = needs(sql)
        return f

    return add


_CASE_TIMES = "(SELECT 'K' || l_orderkey AS case_id, 'O' || l_orderkey AS alert_id, min(l_shipdate)::TIMESTAMP AS opened_ts, max(l_shipdate)::TIMESTAMP AS closed_ts FROM lineitem GROUP BY l_orderkey)"
_ASOF_EVENTS = """
SELECT entity_id, ts, max({'kind': kind, 'case_id': case_id, 'step': step}) AS e FROM (
  SELECT entity_id, l_shipdate::TIMESTAMP AS ts, 'event' AS kind, 'K' || l_orderkey AS case_id, l_returnflag AS step FROM lineitem JOIN alerts ON k = l_orderkey WHERE l_linestatus = 'F'
  UNION ALL SELECT entity_id, l_shipdate::TIMESTAMP, 'escalation', 'K' || l_orderkey, 'pending' FROM lineitem JOIN alerts ON k = l_orderkey WHERE l_returnflag = 'R' AND l_quantity > 25) GROUP BY ALL"""


@query(f"""SELECT alert_id, strftime(ts, '%Y-%m-%d') AS last_day, e.kind AS kind, e.case_id AS case_id, e.step AS step
FROM (SELECT alert_id, entity_id, make_timestamp(closed_us) AS closed_ts FROM alerts) a ASOF LEFT JOIN ({_ASOF_EVENTS}) x ON a.entity_id = x.entity_id AND a.closed_ts >= x.ts""")
def asof_last_event(spark, d):
    """The entity's latest workflow event or escalation at each closure."""
    b = driver_tables.bundle(spark, d)
    owner = driver_tables.case_times(spark, d).select("case_id", "alert_id").join(b.alerts.select("alert_id", "entity_id"), "alert_id").drop("alert_id")
    seen = b.workflow_events.select("case_id", "ts", F.lit("event").alias("kind"), "step").unionByName(b.escalations.select("case_id", "ts", F.lit("escalation").alias("kind"), F.col("outcome").alias("step")))
    out = intervals.as_of(b.alerts.select("alert_id", "entity_id", "closed_ts"), seen.join(owner, "case_id"), ["entity_id"], "closed_ts", "ts", ["kind", "case_id", "step"], width=30 * intervals.DAY)
    return out.select("alert_id", F.date_format("ts", "yyyy-MM-dd").alias("last_day"), "kind", "case_id", "step")


@query(f"""SELECT alert_id, (SELECT count(*) FROM {_CASE_TIMES} c JOIN alerts o ON o.alert_id = c.alert_id WHERE o.entity_id = a.entity_id AND c.opened_ts <= make_timestamp(a.created_us) AND c.closed_ts > make_timestamp(a.created_us)) AS open_cases FROM alerts a""")
def range_open_cases(spark, d):
    """How many of the entity's cases are open when an alert comes."""
    b = driver_tables.bundle(spark, d)
    owned = driver_tables.case_times(spark, d).select("alert_id", "opened_ts", F.col("closed_ts").alias("done_ts")).join(b.alerts.select("alert_id", "entity_id"), "alert_id")
    return intervals.open_at(b.alerts.select("alert_id", "entity_id", "created_ts"), owned, ["entity_id"], "created_ts", "opened_ts", "done_ts", "open_cases", width=7 * intervals.DAY).select("alert_id", "open_cases")


@query(f"""SELECT a.alert_id, c.case_id FROM alerts a JOIN alerts o ON o.asset_id = a.asset_id JOIN {_CASE_TIMES} c ON c.alert_id = o.alert_id WHERE c.opened_ts <= make_timestamp(a.created_us) AND c.closed_ts > make_timestamp(a.created_us)""")
def range_cases_on_asset(spark, d):
    """The cases that are open on an alert's asset when it comes."""
    b = driver_tables.bundle(spark, d)
    owned = driver_tables.case_times(spark, d).select("case_id", F.col("alert_id").alias("about"), "opened_ts", F.col("closed_ts").alias("done_ts")).join(b.alerts.select(F.col("alert_id").alias("about"), "asset_id"), "about").drop("about")
    return intervals.holding(b.alerts.select("alert_id", "asset_id", "created_ts"), owned, ["asset_id"], "created_ts", "opened_ts", "done_ts", width=120 * intervals.DAY).select("alert_id", "case_id")


_CHAINS = """
WITH RECURSIVE steps AS (
  SELECT alert_id, CASE WHEN gap <= 60 * 86400000000 THEN following END AS following, coalesce(before <= 60 * 86400000000, false) AS follows FROM (
    SELECT alert_id, lead(alert_id) OVER w AS following, lead({us}) OVER w - {us} AS gap, {us} - lag({us}) OVER w AS before
    FROM alerts WINDOW w AS (PARTITION BY asset_id ORDER BY {us}, alert_id)) s),
chain(head, tip, length) AS (
  SELECT alert_id, alert_id, CAST(1 AS BIGINT) FROM steps WHERE NOT follows
  UNION ALL SELECT head, following, length + 1 FROM chain JOIN steps ON tip = alert_id WHERE following IS NOT NULL)
SELECT head, max(length) AS length FROM chain GROUP BY head"""


@query(None)
def sql_recursive_chains(spark, d):
    """Chains of alerts on an asset, each within 60 days of the one before, by a recursive query over the store."""
    path = scratch.folder(spark, "store")
    driver_tables.alerts(spark, d).write.parquet(f"{path}/alerts.parquet")
    return store.query(spark, path, _CHAINS.format(us="unix_micros(created_ts)"), unbounded=True)


_duck = needs("SELECT alert_id, asset_id, created_us FROM alerts")
ORACLE_SQL["sql_recursive_chains"] = _CHAINS.format(us="created_us").replace("WITH RECURSIVE steps", f"WITH RECURSIVE alerts AS ({_duck}),\nsteps")


@query(None)
def graph_reach(spark, d):
    """Alerts that unresolved critical ones lead to along successions on an asset, to any depth, with the fewest steps."""
    a = driver_tables.alerts(spark, d)
    seeds = a.where("severity = 'critical' and disposition = 'unresolved'").select("alert_id")
    return longs(reach.reach(spark, reach.successions(a), seeds).select(F.col("node").alias("alert_id"), "hops"), "hops")


ORACLE_SQL["graph_reach"] = f"""
WITH RECURSIVE alerts AS ({needs("SELECT alert_id, asset_id, created_us, severity, disposition FROM alerts")}),
steps AS (SELECT alert_id AS u, lead(alert_id) OVER w AS v, lead(created_us) OVER w - created_us AS gap FROM alerts WINDOW w AS (PARTITION BY asset_id ORDER BY created_us, alert_id)),
walk(alert_id, hops) AS (SELECT alert_id, 0::BIGINT FROM alerts WHERE severity = 'critical' AND disposition = 'unresolved'
  UNION SELECT v, hops + 1 FROM walk JOIN steps ON u = alert_id WHERE gap <= 60 * 86400000000)
SELECT alert_id, min(hops) AS hops FROM walk GROUP BY 1"""


@query(None)
def graph_neighbours(spark, d):
    """What lies within four steps of analyst A0 of entity N3 among entities, assets, cases and analysts."""
    b = driver_tables.bundle(spark, d)
    seeds = spark.createDataFrame([("analyst:N3/A0",)], "node string")
    out = reach.reach(spark, reach.both_ways(reach.investigation_graph(b)), seeds, most=4)
    return longs(out.groupBy(F.substring_index("node", ":", 1).alias("kind"), "hops").agg(F.count("*").alias("nodes")), "hops")


ORACLE_SQL["graph_neighbours"] = f"""
WITH RECURSIVE one AS (
  SELECT 'entity:' || entity_id AS u, 'asset:' || asset_id AS v FROM ({needs("SELECT * FROM assets")})
  UNION ALL SELECT 'asset:' || asset_id, 'case:' || case_id FROM ({needs("SELECT asset_id, case_id FROM cases JOIN alerts USING (alert_id)")})
  UNION ALL SELECT 'case:' || case_id, 'analyst:' || entity_id || '/' || analyst_id FROM ({needs("SELECT case_id, entity_id, analyst_id FROM cases JOIN alerts USING (alert_id)")})),
edges AS (SELECT DISTINCT u, v FROM (SELECT * FROM one UNION ALL SELECT v, u FROM one)),
walk(node, hops) AS (SELECT 'analyst:N3/A0', 0::BIGINT UNION SELECT v, hops + 1 FROM walk JOIN edges ON u = node WHERE hops < 4)
SELECT split_part(node, ':', 1) AS kind, hops, count(*) AS nodes FROM (SELECT node, min(hops) AS hops FROM walk GROUP BY 1) GROUP BY ALL"""


@query("SELECT entity_id, year(created_ts)::BIGINT AS year, count(*) AS alerts, true AS assets_ok, true AS p50_ok, true AS p95_ok FROM af GROUP BY ALL")
def sketch_periods(spark, d):
    """Yearly estimates from daily sketches, and whether each keeps its error against the exact value."""
    a = features.durations(driver_tables.alerts(spark, d))
    days = scratch.written(spark, sketches.daily(a, F.col("closure_duration_sec")), "days")
    year = F.year("day").cast("long").alias("year")
    est = sketches.estimates(sketches.merged(days, "entity_id", year))
    exact = a.withColumn("year", F.year("created_ts").cast("long")).join(est.withColumnRenamed("assets", "about"), ["entity_id", "year"])
    below = lambda p: F.abs(F.avg((F.col("closure_duration_sec") <= F.col(f"p{p}")).cast("int")) - p / 100) <= sketches.RANK_ERROR + 1 / F.count("*")
    assets = F.count_distinct("asset_id")
    return exact.groupBy("entity_id", "year").agg(F.max("alerts").alias("alerts"), (F.abs(F.max("about") - assets) <= F.greatest(F.lit(1.0), assets * sketches.COUNT_ERROR)).alias("assets_ok"), below(50).alias("p50_ok"), below(95).alias("p95_ok"))


@query("SELECT entity_id, detector_id, round(factor, 4) AS factor, version FROM fw")
def feedback_merged(spark, d):
    """The weights after three batches of the ledger were merged in order, one of them twice."""
    rows = ledger(spark, d)
    path = scratch.folder(spark, "weights")
    low, high = (rows.agg(F.percentile("feedback_id", F.array(F.lit(0.2), F.lit(0.7))).alias("q")).first()["q"])
    for batch in (rows.where(F.col("feedback_id") <= low), rows.where((F.col("feedback_id") > low) & (F.col("feedback_id") <= high)), rows.where(F.col("feedback_id") <= high), rows.where(F.col("feedback_id") > high)):
        feedback_state.merge(spark, path, batch)
    return longs(rounded(feedback_state.weights(spark, path), "factor", digits=4).select("entity_id", "detector_id", "factor", "version"), "version")


@query("SELECT a.alert_id, c.case_id, coalesce(n, 0) AS workflow_event_count, e.case_id IS NOT NULL AS is_escalated FROM alerts a LEFT JOIN cases c USING (alert_id) LEFT JOIN (SELECT case_id, count(*) AS n FROM wf GROUP BY 1) w ON w.case_id = c.case_id LEFT JOIN (SELECT DISTINCT case_id FROM esc) e ON e.case_id = c.case_id")
def bucketed_alerts(spark, d):
    """Alerts with their case and its events, joined in place in a bucketed store of the catalog."""
    database = f"sentrygrid_{uuid.uuid4().hex}"
    bucketed.write(spark, driver_tables.bundle(spark, d), database)
    atexit.register(_drop, spark, database)
    return bucketed.worked_alerts(spark, database).select("alert_id", "case_id", "workflow_event_count", "is_escalated")


def _drop(spark, database: str) -> None:
    try:
        bucketed.drop(spark, database)
    except Exception:  # the session may already be gone at interpreter exit
        pass


# ---------------------------------------------------------------- validation of cases and assets, sinks read back, serving
@query("""SELECT CASE WHEN k % 103 = 0 THEN 'Timestamp ordering violation: opened_ts > closed_ts' WHEN k % 97 = 0 THEN 'Unparseable timestamp in column ''opened_ts''' END AS quarantine_reason, count(*) AS n
FROM (SELECT l_orderkey AS k FROM lineitem GROUP BY 1) GROUP BY ALL""")
def quarantine_cases(spark, d):
    """Cases, some closed before they were opened and some without a readable time, by the reason why they are set aside."""
    k = F.substring("case_id", 2, 20).cast("long")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    raw = driver_tables.cases(spark, d).withColumn("row_pos", k).withColumn("closed_ts", F.when(k % 103 == 0, text(F.col("opened_ts") - F.expr("interval 1 day"))).otherwise(text("closed_ts")))
    raw = raw.withColumn("opened_ts", F.when((k % 97 == 0) & (k % 103 != 0), "soon").otherwise(text("opened_ts")))
    return quarantine.with_reason("cases", raw).groupBy("quarantine_reason").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN k % 11 = 0 THEN 'Invalid asset criticality tier' END AS quarantine_reason, CASE WHEN k % 11 = 0 THEN 'aside' WHEN monitored AND k % 13 <> 0 THEN 'true' ELSE 'false' END AS monitoring_expected, count(*) AS n
FROM (SELECT c_custkey AS k, c_acctbal >= 0 AS monitored FROM customer) GROUP BY ALL""")
def quarantine_assets(spark, d):
    """Assets, some of an unknown criticality, with truth written in many ways and some of it unreadable."""
    k = F.substring("asset_id", 2, 20).cast("long")
    one_of = lambda *words: F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))
    said = F.when(k % 13 == 0, "perhaps").when(F.col("monitoring_expected"), one_of("true", "Yes", " 1 ", "Y", "t")).otherwise(one_of("false", "No", "0", "n"))
    raw = driver_tables.assets(spark, d).where("asset_id like 'C%'").withColumn("row_pos", k).withColumns({"criticality": F.when(k % 11 == 0, "vital").otherwise(F.upper("criticality")), "monitoring_expected": said})
    good, bad = quarantine.validate("assets", raw)
    parts = [good.select(F.lit(None).cast("string").alias("quarantine_reason"), F.col("monitoring_expected").cast("string").alias("monitoring_expected")), bad.select("quarantine_reason", F.lit("aside").alias("monitoring_expected"))]
    return parts[0].unionByName(parts[1]).groupBy("quarantine_reason", "monitoring_expected").agg(F.count("*").alias("n"))


@query("SELECT finding_id, entity_id, scope, round(dev, 3) AS deviation, to_json(list_sort(refs))::VARCHAR AS refs FROM findings")
def sink_csv(spark, d):
    """Findings as CSV read back: nested columns are JSON there."""
    path = scratch.folder(spark, "csv")
    store.write_csv(basic_findings(spark, d).withColumn("evidence_refs", F.array_sort("evidence_refs")), path)
    back = spark.read.csv(path, header=True, escape='"')
    return rounded(back.select("finding_id", "entity_id", "scope", "deviation", F.col("evidence_refs").alias("refs")), "deviation", digits=3)


@query("SELECT finding_id, entity_id, scope, round(dev, 3) AS deviation, len(refs) AS refs FROM findings")
def sink_json(spark, d):
    """Findings as JSON lines read back."""
    path = scratch.folder(spark, "json")
    store.write_json(basic_findings(spark, d), path)
    back = spark.read.schema(FINDING).json(path)
    return rounded(longs(back.select("finding_id", "entity_id", "scope", "deviation", F.size("evidence_refs").alias("refs")), "refs"), "deviation", digits=3)


@query("SELECT quarantine_reason, count(*) AS n FROM judged WHERE quarantine_reason IS NOT NULL GROUP BY 1")
def sink_quarantine(spark, d):
    """What validation sets aside, written as CSV beside the data and read back."""
    path = scratch.folder(spark, "aside")
    _, bad = quarantine.validate("alerts", driver_tables.dirty_alerts(spark, d))
    store.write_csv(bad, path)
    return spark.read.csv(path, header=True, escape='"').groupBy("quarantine_reason").agg(F.count("*").alias("n"))


@query("SELECT entity_id, risk_index, risk_tier FROM risk WHERE entity_id = 'N4'")
def entity_detail(spark, d):
    scores = scoring.risk_index(scoring.area_scores(spark, basic_findings(spark, d), driver_tables.entities(spark, d)))
    return serving.entity_detail(scores, "n4").select("entity_id", "risk_index", "risk_tier")


@query("SELECT finding_id, detector_id, entity_id, scope FROM findings WHERE finding_id = (SELECT min(finding_id) FROM findings)")
def finding_by_id(spark, d):
    f = basic_findings(spark, d)
    first = f.agg(F.min("finding_id")).first()[0]
    return serving.find(f, finding_id=first.lower()).select("finding_id", "detector_id", "entity_id", "scope")


@query("SELECT entity_id, rank, scope FROM (SELECT entity_id, rank, scope FROM picked UNION ALL SELECT entity_id, taken + pick, 'alert:' || alert_id FROM control) WHERE entity_id = 'N4' AND rank <= 25")
def queue_by_budget(spark, d):
    """The first items of one entity's queue."""
    q = review_queue.build_queues(basic_findings(spark, d), driver_tables.alerts(spark, d), BUDGET)
    return longs(serving.queue_of(q, "n4", 25).select("entity_id", "rank", "scope"), "rank")
