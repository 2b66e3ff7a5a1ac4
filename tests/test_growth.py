"""What must not grow faster than the tables: repeated work, broadcasts, bounds of other engines."""

import re
import uuid
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from helpers import alert, asset, bundle, case
from pyspark.sql import functions as F

from sentrygrid.operators import anomaly, evaluation, faults, features, histograms, reach, scoring, sketches
from sentrygrid.operators.detectors import Context, each_detector, ns01, run_detectors
from sentrygrid.plans import extended
from sentrygrid.sources import driver_tables, scratch

DATA = Path("/root/testdata/sf0.001")


def counted(spark, df):
    """``df`` and an accumulator of the rows that were made from it."""
    made = spark.sparkContext.accumulator(0)

    def tell(parts):
        for pdf in parts:
            made.add(len(pdf))
            yield pdf

    return df.mapInPandas(tell, df.schema), made


def test_matching_broadcasts_no_side(spark):
    texts = [("E1", f"alert:e1-{i}") for i in range(50)] + [("E1", "x" * 40 + "long tail of a scope, longer than a piece"), ("E2", "alert:e1-7"), ("E1", "ab")]
    parts = [("E1", f"e1-{i}") for i in range(0, 50, 7)] + [("E1", "xx" + "long tail of a scope, longer than a piece"), ("E1", "xy" + "long tail of a scope, longer than a piece"), ("E1", "b"), ("E2", ""), ("E2", "alert:e1-77")]
    out = evaluation.contained(spark.createDataFrame(texts, "entity_id string, text string"), spark.createDataFrame(parts, "entity_id string, part string"))
    want = {(e, t, p) for e, t in texts for f, p in parts if e == f and p and p in t}
    rows = [(r.entity_id, r.text, r.part) for r in out.collect()]
    assert len(rows) == len(want) and set(rows) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_recursion_beyond_the_bounds_of_spark(spark, tmp_path):
    day = datetime(1995, 1, 1)
    orders = [(i, 1, day + timedelta(days=i), "1-URGENT", "F", 10.0) for i in range(150)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 3)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    before = spark.conf.get("spark.sql.cteRecursionLevelLimit")
    rows = extended.QUERIES["sql_recursive_chains"](spark, str(tmp_path)).collect()
    assert [(r["head"], r["length"]) for r in rows] == [("O0", 150)]
    assert spark.conf.get("spark.sql.cteRecursionLevelLimit") == before


def test_counts_of_many_sketches_keep_their_error(spark):
    assets = spark.range(600 * 6000).select((F.col("id") % 600).cast("string").alias("entity_id"), F.concat(F.lit("C"), "id").alias("asset_id"), F.lit(datetime(2026, 3, 1)).alias("created_ts"), F.lit(1.0).alias("s"))
    got = sketches.estimates(sketches.daily(assets, F.col("s")), (0.5,))
    assert got.where(F.abs(F.col("assets") - 6000) > 6000 * sketches.COUNT_ERROR).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_times_of_cases_need_no_parts(spark, tmp_path, monkeypatch):
    for t in ("orders", "customer", "lineitem", "nation", "region", "supplier"):
        (tmp_path / f"{t}.parquet").symlink_to(DATA / f"{t}.parquet")
    times = {tuple(r) for r in driver_tables.case_times(spark, str(tmp_path)).collect()}
    assert times == {tuple(r) for r in driver_tables.cases(spark, str(DATA)).select("case_id", "alert_id", "opened_ts", "closed_ts").collect()}
    monkeypatch.setattr(driver_tables, "cases", lambda spark, d: spark.createDataFrame([], "case_id string, alert_id string, opened_ts timestamp, closed_ts timestamp"))
    assert extended.QUERIES["range_cases_on_asset"](spark, str(tmp_path)).count() > 0


def test_edges_are_written_without_a_shuffle(spark, monkeypatch):
    plans = []
    real = scratch.written
    monkeypatch.setattr(scratch, "written", lambda s, df, tag: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(s, df, tag))[1])
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 1), (2, 2)], "u long, v long")
    got = {(r["node"], r["hops"]) for r in reach.reach(spark, edges, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {(1, 0), (2, 1), (3, 2)} and "Exchange" not in plans[0]


def test_novelty_makes_months_once(spark):
    months = [(f"E{i % 4}", f"20{i // 48 + 10}-{i // 4 % 12 + 1:02d}", *[float(i * 7919 % 101 + f) for f in range(len(anomaly.FEATURES))]) for i in range(120)]
    df, made = counted(spark, spark.createDataFrame(months, "entity_id string, year_month string, " + ", ".join(f"{f} double" for f in anomaly.FEATURES)))
    assert anomaly.novelty(df).count() == 120
    assert made.value == 120


def worked(spark):
    b = bundle(spark, alerts=[alert(i, e, f"A{e}{i % 5}") for e in ("E1", "E2", "E3") for i in range(40)], assets=[asset(f"A{e}{i}", e, "critical" if i % 2 else "low", i % 3 > 0) for e in ("E1", "E2", "E3") for i in range(8)], cases=[case(f"{e}-{i}") for e in ("E1", "E2") for i in range(40)])
    return b


def test_volumes_are_those_of_the_entities_features(spark):
    b = worked(spark)
    got = {tuple(r) for r in features.entity_volumes(b.entities, b.alerts, b.assets).collect()}
    assert got == {tuple(r) for r in features.entity_features(b).select("entity_id", "alerts_per_asset", "crit_coverage_ratio").collect()}


def test_a_run_of_detectors_makes_cases_once_and_no_percentiles(spark):
    b = worked(spark)
    df, made = counted(spark, b.cases)
    keep = scratch.folder(spark, "test-features")
    assert run_detectors(b.replace(cases=df), ["EG-04", "NS-01", "NS-04", "NS-06"], keep).count() > 0
    assert made.value == 2 * 80  # for the alerts, and with their entity
    assert scratch.names(spark, keep) == ["alerts", "cases", "cohorts", "volumes"]


def test_planting_makes_cases_once(spark):
    b = worked(spark)
    df, made = counted(spark, b.cases)
    schedule = {"E1": "EG-07", "E2": "EG-03"}
    kept = faults.plant(b.replace(cases=df), schedule, lambda name, d: scratch.written(spark, d, f"test-{name}"))
    plain = faults.plant(b, schedule)
    for name, d in kept.tables().items():
        assert sorted(map(str, d.collect())) == sorted(map(str, plain.tables()[name].select(*d.columns).collect()))
    assert made.value == b.cases.count()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_sides_that_grow_with_the_alerts_are_not_broadcast(spark):
    b = driver_tables.bundle(spark, str(DATA))
    kept = faults.plant(b, {"N1": "EG-07", "N2": "EG-03"}, lambda name, d: scratch.written(spark, d, f"test-{name}"))
    frames = [b.alerts, b.cases, features.alert_features(b), features.entity_cases(b), features.asset_features(b), ns01(Context(b)), kept.cases, kept.workflow_events, kept.escalations]
    hits = evaluation.alert_hits(b, b.alerts.select("entity_id", F.concat(F.lit("alert:"), "alert_id").alias("scope")))
    frames += [hits, evaluation.random_baseline(b.alerts, hits)]
    assert [i for i, df in enumerate(frames) if "BroadcastHashJoin" in plan(df)] == []


def test_values_and_references_are_not_broadcast(spark):
    counts = scratch.written(spark, spark.range(40).selectExpr("id % 2 AS key", "id * 200.0 AS value", "id + 1 AS m"), "test-counts")
    histogram = scratch.written(spark, histograms.cumulative(counts, ["key"]), "test-histogram")
    own = scratch.written(spark, counts.selectExpr("key", "'E1' AS entity_id", "value", "m", "true AS apart", "100L AS n"), "test-own")
    placed = histograms.place(histogram, own, ["key"], "entity_id")
    assert "BroadcastHashJoin" not in plan(placed)
    assert placed.where("below <> 0 or upto <> 0").count() == 0 and placed.count() == 40  # all counts are the member's own
    alerts = scratch.written(spark, worked(spark).alerts, "test-alerts")
    found = spark.createDataFrame([("E1", "F1", 1.0, 1.0, 1.0, 1.0, ["alerts:E1-1"])], "entity_id string, finding_id string, severity_weight double, deviation double, confidence double, feedback_factor double, evidence_refs array<string>")
    trend = scoring.trends(scratch.written(spark, found, "test-found"), alerts)
    assert "SortMergeJoin [entity_id" in plan(trend) and trend.count() == 3


def test_months_count_assets_apart_from_durations(spark):
    b = worked(spark)
    months = features.entity_month_features(features.alert_features(b))
    found = months.select("entity_id", "year_month", "unique_assets_alerted", "crit_median_close_sec")
    assert {tuple(r) for r in found.collect()} == {(e, "2026-01", 5, 3600.0) for e in ("E1", "E2", "E3")}
    keys = re.findall(r"ObjectHashAggregate\(keys=\[([^\]]*)\]", plan(months))
    assert keys and not any("asset_id" in k for k in keys)


def test_findings_are_written_a_detector_at_a_time(spark):
    b = worked(spark)
    path, seen = scratch.folder(spark, "test-parts"), []

    def parts():
        for part in each_detector(b, ["NS-01", "NS-03", "EG-03"], scratch.folder(spark, "test-features")):
            seen.append(len(scratch.names(spark, path)))
            yield part

    scratch.write_parts(parts(), path)
    assert seen[0] == 0 and seen == sorted(set(seen))  # each part is on disk before the next one is made
    key = lambda df: sorted(map(str, df.collect()))
    assert key(spark.read.parquet(path)) == key(run_detectors(b, ["NS-01", "NS-03", "EG-03"]))


def test_a_table_kept_in_parts_is_whole_or_made_again(spark):
    name = f"test-kept-{uuid.uuid4().hex}"
    one = spark.range(3)

    def broken():
        yield one
        raise RuntimeError

    with pytest.raises(RuntimeError):
        scratch.kept_as(spark, name, broken, one.schema)
    assert scratch.kept_as(spark, name, lambda: [one, one], one.schema).count() == 6
    assert scratch.kept_as(spark, name, broken, one.schema).count() == 6


def test_budgets_are_counted_in_one_pass(spark):
    b = worked(spark)
    hits = b.alerts.where("asset_id like '%1'").select("entity_id", "alert_id")
    order, made = counted(spark, evaluation.stratified_order(b.alerts))
    sizes = spark.createDataFrame([(e, 40, 8) for e in ("E1", "E2", "E3")], "entity_id string, alerts long, faults long")
    got = {r.share: (r["items"], r.true_positives) for r in evaluation.precision_at(order.select("entity_id", F.col("alert_id").alias("item_id"), F.col("position").alias("rank")), hits.withColumnRenamed("alert_id", "item_id"), sizes).collect()}
    assert made.value == 120
    places = [(r.entity_id, r.alert_id, r.position) for r in evaluation.stratified_order(b.alerts).collect()]
    hit = {tuple(r) for r in hits.collect()}
    want = {s: [(e, a) in hit for e, a, p in places if p <= n] for s, n in ((0.05, 5), (0.1, 5), (0.2, 8))}
    assert got == {s: (len(x), sum(x)) for s, x in want.items()}
    order, made = counted(spark, evaluation.stratified_order(b.alerts))
    manual = {r.share: (r["items"], r.true_positives) for r in evaluation.manual_precision(order.select("entity_id", "alert_id", "position"), hits, (0.05, 0.1, 0.2)).collect()}
    assert manual == got and made.value <= 2 * 120  # for the sizes, and for all budgets
    plans = [plan(evaluation.precision_at(order.select("entity_id", F.col("alert_id").alias("item_id"), F.col("position").alias("rank")), hits.withColumnRenamed("alert_id", "item_id"), sizes)), plan(evaluation.manual_precision(order, hits))]
    assert not any("Union" in x for x in plans)  # a plan for all budgets, not one each
    none = evaluation.manual_precision(order.limit(0).select("entity_id", "alert_id", "position"), hits).collect()
    assert [(r.share, r["items"], r.true_positives, r.precision) for r in none] == [(s, 0, 0, None) for s in evaluation.BUDGETS]
