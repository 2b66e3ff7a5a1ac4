import random
from pathlib import Path

import pytest
from helpers import alert, bundle
from pyspark.sql import functions as F

from sentrygrid.operators import audit, claims, evaluation, feedback, generators, review_queue, robustness, scoring, serving
from sentrygrid.operators.detectors import run_detectors
from sentrygrid.plans.pipeline import run_all
from sentrygrid.plans.registry import QUERIES
from sentrygrid.schema import FINDING


def finding(i, detector="EG-01", entity="E1", sev=5.0, dev=-10.0, conf=0.8, scope=None, refs=()):
    return (f"F{i}", detector, "1.0.0", "EXECUTION_GAP", entity, scope or f"alert:{entity}-{i}", sev, dev, 0.05, conf, "because", list(refs), "{}", 1.0)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), FINDING)


def test_scores_and_tiers(spark):
    b = bundle(spark, alerts=[alert(i, e) for e in ("E1", "E2") for i in range(10)])
    f = frame(spark, *[finding(i, refs=[f"alerts:E1-{i}"]) for i in range(3)])
    assert scoring.scored(f).first().score == 20.0
    rows = {r.entity_id: r for r in scoring.portfolio(spark, f, b).collect()}
    assert rows["E1"].risk_index > rows["E2"].risk_index == 0 and rows["E2"].risk_tier == "low" and len(rows["E2"].area_scores) == 8
    assert rows["E1"].peer_percentile > rows["E2"].peer_percentile and rows["E1"].trend == "improving"
    cuts = spark.createDataFrame([(x,) for x in (80.0, 75.0, 60.0, 40.0, 20.0, 1.0)], "x double").select(scoring.tier(F.col("x")).alias("t"))
    assert [r.t for r in cuts.collect()] == ["critical", "critical", "high", "elevated", "moderate", "low"]
    unknown = scoring.with_areas(frame(spark, finding(1, "XX-99"))).collect()
    assert [r.area for r in unknown] == ["security_operations"]


def test_queue_fills_its_budget(spark):
    alerts = bundle(spark, alerts=[alert(i) for i in range(100)]).alerts
    f = frame(spark, *[finding(i, refs=[f"alerts:E1-{i}"]) for i in range(3)])
    one, two = (review_queue.build_queues(f, alerts, 40).orderBy("rank").collect() for _ in range(2))
    assert [r.rank for r in one] == list(range(1, 41)) and [r.scope for r in one] == [r.scope for r in two]
    assert sum(r.bucket == "risk" for r in one) == 3 and one[0].item_id == "QI-E1-001"
    assert not {r.scope for r in one if r.bucket == "control"} & {f"alert:E1-{i}" for i in range(3)}


def test_queue_spreads_over_detectors(spark):
    rows = [finding(f"{d}{i}", d, dev=-5.0 + i / 100) for d in ("EG-01", "EG-03") for i in range(60 if d == "EG-01" else 4)]
    picked = review_queue.risk_items(frame(spark, *rows), 50).collect()
    assert len(picked) == 42 and sum(r.detector_id == "EG-03" for r in picked) == 4
    assert [r.detector_id for r in sorted(picked, key=lambda r: r.rank)[:4]] == ["EG-01", "EG-03"] * 2


def test_claims_separate_liars(spark):
    base = generators.scale_bundle(spark, 6000)
    told = generators.flattering_claims(base, claims.evidence(base), ["E-0001", "E-0005"])
    rows = {r.entity_id: r for r in claims.claim_index(claims.compare(told)).collect()}
    liars = {r for r in rows if r in ("E-0001", "E-0005")}
    assert len(rows) == 12 and all(rows[e].credibility_index >= 85 for e in rows if e not in liars)
    assert all(rows[e].credibility_index < 60 and rows[e].verdict == "not substantiated" for e in liars)


def test_feedback_sequence(spark, tmp_path):
    def rows(*decisions):
        return spark.createDataFrame([(i, f"F{i}", "E1", "EG-01", d, "x", None, f"t{i}") for i, d in enumerate(decisions)], feedback.LEDGER)

    for n, factor in enumerate((0.6, 0.36, 0.3, 0.3), 1):
        w = feedback.weights(rows(*["dismiss"] * n)).first()
        assert w.factor == pytest.approx(factor) and w.version == n
    assert feedback.weights(rows("dismiss", "confirm")).first().factor == pytest.approx(1.0)
    feedback.append(spark, f"{tmp_path}/l", rows("dismiss"))
    ledger = spark.read.parquet(f"{tmp_path}/l")
    stamped = feedback.apply(frame(spark, finding(0), finding(1, "EG-02")), feedback.weights(ledger))
    assert sorted(r.feedback_factor for r in stamped.collect()) == [0.6, 1.0]
    assert feedback.history(ledger, entity="E1").count() == 1 and feedback.agreement(ledger, stamped).first().coverage == 0.5
    assert feedback.listed(feedback.weights(ledger)).count() == 1


def test_feedback_in_slices_equals_the_fold_in_order(spark):
    rng = random.Random(4)
    rows = [(i, f"F{i}", rng.choice(("E1", "E1", "E2")), "EG-01", rng.choice(("dismiss", "confirm", "note")), "x", None, f"t{i:04d}") for i in range(700)]
    rng.shuffle(rows)
    want = {}
    for r in sorted(rows):
        f, n = want.get(r[2], (1.0, 0))
        f = round(max(0.3, f * 0.6), 6) if r[4] == "dismiss" else round(min(1.0, f / 0.6), 6) if r[4] == "confirm" else f
        want[r[2]] = (f, n + 1)
    ledger = spark.createDataFrame(rows, feedback.LEDGER).repartition(5)
    for size in (40, 100_000):
        assert {r.entity_id: (r.factor, r.version) for r in feedback.weights(ledger, size).collect()} == want


def test_whole_ledger_is_weighed(spark, tmp_path):
    spark.range(6000).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    assert sum(r.version for r in QUERIES["feedback_weights"](spark, str(tmp_path)).collect()) == 6000
    assert sum(r.findings for r in QUERIES["expert_agreement"](spark, str(tmp_path)).collect()) == 6000


def test_all_findings_follow_the_tables(spark, tmp_path):
    source = Path("/root/testdata/sf0.001")
    if not source.exists():
        pytest.skip("no test tables")
    got = {}
    for d in (source, tmp_path):
        if d != source:
            for p in source.glob("*.parquet"):
                t = spark.read.parquet(str(p))
                (t.limit(0) if p.stem == "lineitem" else t).write.parquet(f"{d}/{p.name}")
        got[d] = {r.detector_id: r.findings for r in QUERIES["all_findings"](spark, str(d)).collect()}
    assert got[source] != got[tmp_path] and "NOV-01" in got[source]


def test_audit_chain(spark, tmp_path):
    path = tmp_path / "audit.jsonl"
    for i in range(3):
        audit.append_entry(path, "run", f"r{i}", "h", f"2026-01-0{i + 1}")
    assert audit.verdict(audit.verify(spark.read.json(str(path)))).first().valid
    lines = path.read_text().splitlines()
    lines[1] = lines[1].replace('"r1"', '"r9"')
    path.write_text("\n".join(lines) + "\n")
    out = audit.verdict(audit.verify(spark.read.json(str(path)))).first()
    assert not out.valid and out.errors == ["entry 2: altered"]
    assert audit.file_hash(path) == audit.file_hash(path) and audit.manifest("r", {}, {"a": str(path)}, {}, {}, {})["inputs"]["a"] == audit.file_hash(path)


def test_whole_run_finds_known_faults(spark, tmp_path):
    b, truth = generators.faulty_bundle(spark, 3000)
    out = run_all(spark, {n: df for n, df in b.tables().items()}, str(tmp_path), budget=30)
    found = {(r.detector_id, r.entity_id) for r in out["findings"].select("detector_id", "entity_id").distinct().collect()}
    assert {("EG-02", "E-0002"), ("EG-03", "E-0004"), ("EG-04", "E-0005"), ("EG-06", "E-0010"), ("NS-05", "E-0007"), ("EG-01", "E-0001")} <= found
    assert out["scores"].count() == 12 and out["queues"].count() == 12 * 30 and (tmp_path / "audit.jsonl").exists()
    items = out["queues"].select("entity_id", F.col("item_id"), "detector_id", "scope", "evidence_refs")
    assert evaluation.matched(items, truth).count() > 5
    assert serving.entity_detail(out["scores"], "e-0001").count() == 1 and serving.queue_of(out["queues"], "E-0001", 5).count() == 5
    assert "| a |" in evaluation.report([{"a": 1}])
    assert "| share |" in evaluation.report_of_run(spark, str(tmp_path), truth)
    assert (tmp_path / "manifest.json").exists()


def test_tidying_removes_lanes(spark):
    b, _ = generators.faulty_bundle(spark, 2000)
    after = robustness.tidy(b, "E-0004")
    lanes = {r.detector_id: r for r in robustness.lane_survival(run_detectors(b, ["EG-03"]), run_detectors(after, ["EG-03"]), "E-0004").collect()}
    assert lanes["EG-03"].before == 15 and lanes["EG-03"].after == 0


def test_generator_does_not_depend_on_partitions(spark):
    one = generators.scale_bundle(spark, 500).alerts.collect()
    assert sorted(one) == sorted(generators.scale_bundle(spark, 500).alerts.repartition(7).collect())


def test_positions_are_those_of_one_window(spark):
    rows = [(f"E{i % 2}", i * 7 % 5, i * 3 % 4) for i in range(60)] + [("E1", 1, 1)] * 3
    df = spark.createDataFrame(rows, "k string, a int, b int")
    got = evaluation.numbered(df, "k", [F.col("a")], ["b"], "p").collect()
    for key in ("E0", "E1"):
        mine = sorted((r.p, r.a, r.b) for r in got if r.k == key)
        assert [p for p, _, _ in mine] == list(range(1, len(mine) + 1))
        assert [(a, b) for _, a, b in mine] == sorted((a, b) for k, a, b in rows if k == key)
    assert evaluation.numbered(df.limit(0), "k", [F.col("a")], ["b"], "p").isEmpty()


def test_lift_is_one_where_a_baseline_finds_nothing(spark):
    measured = spark.createDataFrame([(0.1, 0.3)], "share double, precision double")
    base = spark.createDataFrame([(0.1, "a", 0.15), (0.1, "b", 0.0)], "share double, baseline string, precision double")
    assert {r.baseline: r.lift for r in evaluation.lifts(measured, base).collect()} == {"a": 2.0, "b": 1.0}


def test_last_decision_of_queue_items(spark):
    queue = spark.createDataFrame([("E1", 1, "F1"), ("E1", 2, "F2"), ("E1", 3, None)], "entity_id string, rank int, finding_id string")
    ledger = spark.createDataFrame([(1, "F1", "confirm"), (2, "F1", "dismiss")], "feedback_id long, finding_id string, decision string")
    assert {r["rank"]: (r.decision, r.decided_by) for r in feedback.decided(queue, ledger).collect()} == {1: ("dismiss", 2), 2: (None, None), 3: (None, None)}
