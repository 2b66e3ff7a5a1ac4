from datetime import timedelta

import pytest
from helpers import T0, alert, asset, bundle, case, entity, event, raised

from pyspark.sql import functions as F

from sentrygrid.operators import anomaly
from sentrygrid.operators.detectors import Context, finding, findings, register, run_detectors, unregister
from sentrygrid.schema import FINDING

PEERS = ("E1", "E2", "E3")


def hits(spark, detector, **rows):
    return findings(detector, Context(bundle(spark, **rows))).collect()


def test_fast_closures(spark):
    rows = [alert(i, "E1", close=60) for i in range(6)] + [alert(i, e, close=7200 + i) for e in ("E2", "E3") for i in range(10)]
    out = hits(spark, "EG-01", alerts=rows)
    assert {r.entity_id for r in out} == {"E1"} and len(out) == 6
    assert out[0].finding_id.startswith("FND-EG-01-") and len(out[0].finding_id) == 22


def test_no_fast_closures_among_equals(spark):
    assert not hits(spark, "EG-01", alerts=[alert(i, e, close=0) for e in PEERS for i in range(8)])


def test_missing_escalations(spark):
    rows = [alert(i, e) for e in PEERS for i in range(20)]
    up = {"E1": 1, "E2": 16, "E3": 16}
    out = hits(spark, "EG-02", alerts=rows, cases=[case(r[0]) for r in rows], escalations=[raised(f"{e}-{i}") for e in PEERS for i in range(up[e])])
    assert [r.entity_id for r in out] == ["E1"] and out[0].deviation == pytest.approx(-1.414, abs=0.8) and len(out[0].evidence_refs) == 10


def test_work_without_events(spark):
    rows = [alert(1, close=29 * 60), alert(2, close=29 * 60), alert(3, close=30)]
    out = hits(spark, "EG-03", alerts=rows, cases=[case(r[0]) for r in rows], workflow_events=[event("E1-2")])
    assert [r.scope for r in out] == ["alert:E1-1"]
    many = [alert(i) for i in range(30)]
    assert len(hits(spark, "EG-03", alerts=many, cases=[case(r[0]) for r in many], workflow_events=[event("OTHER")])) == 15


def test_template_notes(spark):
    rows = [alert(i, e) for e in ("E1", "E2") for i in range(12)]
    cases = [case(f"E1-{i}", note="Closed as benign after triage.") for i in range(12)] + [case(f"E2-{i}", code=f"c{i}", note=f"Quite different text number {i} {i * 7919}") for i in range(12)]
    out = hits(spark, "EG-04", alerts=rows, cases=cases)
    assert [r.entity_id for r in out] == ["E1"]


def test_similar_templates_by_cosine(spark):
    notes = ["Automated triage complete. No malicious action identified here.", "Automated triage complete. No malicious actions identified here.", "Zebras quickly jump over vexed foxes."]
    rows = [alert(i) for i in range(18)]
    out = hits(spark, "EG-04", alerts=rows, cases=[case(f"E1-{i}", note=notes[0] if i < 8 else notes[1] if i < 13 else notes[2]) for i in range(18)])
    assert len(out) == 1 and 0 < out[0].deviation < 0.1


def test_repeats(spark):
    near = [alert(i, created=T0 + timedelta(days=i)) for i in range(5)]
    far = [alert(i, "E2", created=T0 + timedelta(days=8 * i)) for i in range(5)]
    out = hits(spark, "EG-05", alerts=near + far)
    assert [(r.scope, r.deviation) for r in out] == [("asset:A1", 4.0)]


def test_bunching_before_the_hour(spark):
    ents = [entity(f"E{i}") for i in range(1, 5)]
    rows = [alert(i, f"E{e}", close=57 * 60 if e == 1 and i < 8 else 600 + 60 * e + i) for e in range(1, 5) for i in range(10)]
    assert [r.entity_id for r in hits(spark, "EG-06", alerts=rows, entities=ents)] == []  # among three constants an outlier lies 2.3 standard deviations from the median
    ents = [entity(f"E{i}") for i in range(1, 12)]
    rows = [alert(i, f"E{e}", close=57 * 60 if (e == 1 and i < 8) or i < e % 3 else 600 + i) for e in range(1, 12) for i in range(20)]
    assert [r.entity_id for r in hits(spark, "EG-06", alerts=rows, entities=ents)] == ["E1"]


def test_one_analyst(spark):
    ents = [entity(f"E{i}") for i in range(1, 8)]
    rows = [alert(i, f"E{e}") for e in range(1, 8) for i in range(20)]
    cases = [case(f"E{e}-{i}", analyst=f"AN{0 if e == 1 and i < 17 else i % (4 + e % 2)}") for e in range(1, 8) for i in range(20)]
    out = hits(spark, "EG-07", alerts=rows, cases=cases, entities=ents)
    assert [(r.entity_id, r.scope) for r in out] == [("E1", "analyst:AN0")]


def test_drift_of_dispositions(spark):
    def months(e, late):
        return [alert(f"{m}-{i}", e, created=T0 + timedelta(days=31 * m, minutes=i), disposition="false_positive" if i < (5 if m < 3 else late) else "true_positive") for m in range(6) for i in range(20)]

    assert [r.entity_id for r in hits(spark, "EG-08", alerts=months("E1", 18) + months("E2", 5))] == ["E1"]


def test_silent_assets(spark):
    out = hits(spark, "NS-01", alerts=[alert(1, asset="A1")], assets=[asset("A1"), asset("A2"), asset("A3", monitored=False), asset("A4", criticality="low")])
    assert [r.scope for r in out] == ["asset:A2"]


def test_absent_category(spark):
    rows = [alert(i, e, category="Exfiltration" if e != "E1" and i % 4 == 0 else "Malware") for e in PEERS for i in range(100)]
    out = hits(spark, "NS-02", alerts=rows)
    assert [(r.entity_id, r.scope) for r in out] == [("E1", "category:Exfiltration")]


def test_orphans(spark):
    out = hits(spark, "NS-03", alerts=[alert(1), alert(2), alert(3, "E2"), alert(4, "E2", severity="low")], cases=[case("E1-1"), case("E2-3")])
    assert [(r.entity_id, r.deviation, r.evidence_refs) for r in out] == [("E1", -1.0, ["alerts:E1-2"])]


def test_low_volume(spark):
    rows = [alert(i, e) for e in PEERS for i in range(5 if e == "E1" else 40)]
    out = hits(spark, "NS-04", alerts=rows, assets=[asset(f"{e}-A{i}", e) for e in PEERS for i in range(4)])
    assert [r.entity_id for r in out] == ["E1"]


def test_silent_days(spark):
    days = [0, 1, 2, 3, 4, 10, 11, 12, 13, 14, 15]
    out = hits(spark, "NS-05", alerts=[alert(d, created=T0 + timedelta(days=d)) for d in days] + [alert(f"s{d}", "E2", created=T0 + timedelta(days=d)) for d in (0, 5)])
    assert [(r.scope, r.deviation) for r in out] == [("period:2026-01-10_to_2026-01-15", -5.0)]


def test_thin_coverage(spark):
    ents = [entity(f"E{i}") for i in range(1, 6)]
    assets = [asset(f"E{e}-A{i}", f"E{e}", monitored=not (e == 1 and i < 5)) for e in range(1, 6) for i in range(10)]
    rows = [alert(i, f"E{e}", asset=f"E{e}-A{i}") for e in range(1, 6) for i in range(10) if not (e == 2 and i == 0) and not (e == 3 and i < 2)]
    assert [r.entity_id for r in hits(spark, "NS-06", alerts=rows, assets=assets, entities=ents)] == ["E1"]


def test_novel_months(spark):
    rows = [alert(f"{m}-{i}", e, created=T0 + timedelta(days=31 * m, minutes=5 * i), severity="critical" if i % 5 == 0 else "low", disposition="false_positive" if e == "E1" and m == 5 else "true_positive") for e in PEERS for m in range(6) for i in range(200 if e == "E1" and m == 5 else 20)]
    out = hits(spark, "NOV-01", alerts=rows)
    assert ("E1", "period:2026-06") in {(r.entity_id, r.scope) for r in out}


def test_outlier_factor_by_hand(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(12, 8)), 3)
    points = spark.createDataFrame([(f"E{i}", "2026-01", *map(float, r)) for i, r in enumerate(x)], "entity_id string, year_month string, " + ", ".join(f"{f} double" for f in anomaly.FEATURES))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = [sorted((d[i, j], f"E{j}/2026-01", j) for j in range(12) if j != i)[:5] for i in range(12)]
    kd = [n[-1][0] for n in near]
    lrd = [1 / (np.mean([max(kd[j], q) for q, _, j in n]) + 1e-10) for n in near]
    want = {f"E{i}": np.mean([lrd[j] for _, _, j in near[i]]) / lrd[i] for i in range(12)}
    got = {r.entity_id: r.lof for r in anomaly.lof(points).collect()}
    assert got == pytest.approx(want)


def test_all_detectors_on_empty_and_partial_tables(spark):
    out = run_detectors(bundle(spark, alerts=[alert(1)], cases=[case("E1-1")]))
    assert out.schema.fieldNames() == FINDING.fieldNames()
    scopes = {(r.detector_id, r.scope) for r in out.collect()}
    assert ("EG-03", "table:workflow_events") in scopes and ("NS-01", "table:assets") in scopes
    assert {d for d, _ in scopes} == {"EG-03", "NS-01"}


def test_outlier_factors_look_at_all_rows_beyond_a_block(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (2000, 8)), rng.normal(9, 0.2, (150, 8)), np.zeros((40, 8)), rng.normal(0, 30, (10, 8))])
    names = [f"E{i:04d}/2024-01" for i in range(len(x))]
    k = 20
    d = np.zeros((len(x), len(x)))
    for f in range(8):
        d += (x[:, f, None] - x[None, :, f]) ** 2
    d = np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    gaps = np.take_along_axis(d, near, axis=1)
    lrd = 1 / (np.maximum(gaps, gaps[:, -1][near]).mean(axis=1) + 1e-10)
    want = lrd[near].mean(axis=1) / lrd
    points = spark.createDataFrame([(n.split("/")[0], "2024-01", *map(float, r)) for n, r in zip(names, x, strict=True)], ["entity_id", "year_month", *anomaly.FEATURES])
    for block in (anomaly.BLOCK, 300):
        got = {r.entity_id: r.lof for r in anomaly.lof(points, k, block).collect()}
        assert len(got) == len(x)
        np.testing.assert_allclose([got[n.split("/")[0]] for n in names], want, rtol=1e-9)


def test_added_detector_runs_with_the_others(spark):
    def low_volume(c):
        few = c.bundle.alerts.groupBy("entity_id").agg(F.count("*").alias("n")).where("n < 3")
        return finding(few, "XX-01", "NEGATIVE_SPACE", F.concat(F.lit("entity:"), "entity_id"), F.lit("few"), F.lit(1.0), -F.col("n"), F.lit(0.1), F.lit(0.5), F.lit("few alerts"), F.array().cast("array<string>"), ["n"])

    register("XX-01", low_volume)
    try:
        with pytest.raises(ValueError):
            register("XX-01", low_volume)
        out = run_detectors(bundle(spark, alerts=[alert(1)], cases=[case("E1-1")]))
        assert [(r.entity_id, r.deviation) for r in out.where("detector_id = 'XX-01'").collect()] == [("E1", -1.0)]
    finally:
        unregister("XX-01")
    assert run_detectors(bundle(spark, alerts=[alert(1)]), ["NS-03"]).where("detector_id = 'XX-01'").isEmpty()
