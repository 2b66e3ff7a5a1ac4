"""Bucketed layout, containment by pieces, hash trees and logs with several writers, planted faults."""

import hashlib
import random
import threading
import uuid

import pytest
from helpers import alert, asset, bundle, case, entity, event, raised
from pyspark.sql import functions as F

from sentrygrid.operators import anomaly, audit, evaluation, faults
from sentrygrid.operators.detectors import Context, findings
from sentrygrid.sources import bucketed, scratch


@pytest.fixture
def rows(spark):
    alerts = [alert(i, entity=f"E{i % 3 + 1}") for i in range(60)]
    cases = [case(a[0]) for a in alerts[:40]] + [(f"B-{a[0]}", *case(a[0])[1:]) for a in alerts[:5]]
    return bundle(spark, alerts=alerts, cases=cases, workflow_events=[event(a[0]) for a in alerts[:20]] * 2 + [(f"B-{alerts[0][0]}", "triage", "analyst", alerts[0][5])], escalations=[raised(a[0]) for a in alerts[:10]], assets=[asset("A1")])


def test_bucketed_joins_need_no_exchange(spark, rows):
    database = f"t_{uuid.uuid4().hex}"
    bucketed.write(spark, rows, database, buckets=4)
    try:
        out = bucketed.worked_alerts(spark, database)
        want = Context(rows).alerts.select("alert_id", "case_id", "workflow_event_count", "is_escalated")
        got = out.select("alert_id", "case_id", "workflow_event_count", "is_escalated")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan.replace("BroadcastExchange", "")
        one = bucketed.alerts_of(spark, database, "E2")
        assert "SelectedBucketsCount: 1 out of 4" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 20
    finally:
        bucketed.drop(spark, database)


def test_containment_equals_all_pairs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("ab:1") for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 12])))
    texts = [(rng.choice("xy"), i, word()) for i in range(150)]
    parts = [(rng.choice("xy"), j, word()) for j in range(80)]
    a = spark.createDataFrame(texts, "entity_id string, i int, text string")
    b = spark.createDataFrame(parts, "entity_id string, j int, part string")
    got = sorted((r["i"], r["j"]) for r in evaluation.contained(a, b).collect())
    assert got == sorted((i, j) for e, i, t in texts for f, j, p in parts if e == f and p and p in t)


def test_matching_equals_all_pairs(spark):
    rng = random.Random(7)
    scope = lambda: rng.choice(["", None, "alert:A1", "Alert:A12", "asset:S3", "entity:x", "category:c", "case:C9", "period:2026-01"])
    refs = lambda: rng.choice([None, [], ["alerts:A1", None], ["cases:C9", "assets:S33"], ["alerts:A12"]])
    items = [(rng.choice("xy"), f"i{k}", rng.choice(["D1", "D2", None]), scope(), refs()) for k in range(120)]
    faults_ = [(rng.choice("xyz"), rng.choice(["D1", "D3"]), scope()) for _ in range(12)]

    def explained(e, det, s, r):
        for f_e, f_det, f in faults_:
            if f_e == e and f is not None:
                f, low = f.lower(), None if s is None else s.lower()
                one = [x.lower().replace("alerts:", "alert:").replace("cases:", "case:").replace("assets:", "asset:") for x in r or [] if x is not None]
                if low and f and (f in low or low in f) or any(f in x for x in one) or det == f_det and any(b in f for b in ("entity:", "category:", "period:")):
                    return True
        return False

    df = spark.createDataFrame(items, "entity_id string, item_id string, detector_id string, scope string, evidence_refs array<string>")
    t = spark.createDataFrame(faults_, "entity_id string, detector_expected string, scope string")
    out = evaluation.matched(df, t)
    assert out.columns == df.columns
    assert sorted(r["item_id"] for r in out.collect()) == sorted(k for e, k, d, s, r in items if explained(e, d, s, r))


def test_hash_tree_equals_a_serial_one(spark, tmp_path):
    data = {"a/part-0": b"x" * 5000, "a/part-1": b"y", "part-2": bytes(range(256)) * 9, "_SUCCESS": b"", "a/.hidden": b"1"}
    for name, body in data.items():
        p = tmp_path / "table" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def file_hash(body, block):
        return sha("".join(sha(body[i : i + block]) for i in range(0, max(len(body), 1), block)).encode())

    lines = {f"table/{n}": f"table/{n}:{len(b)}:{file_hash(b, 1000)}" for n, b in data.items() if not n.rpartition("/")[2].startswith(("_", "."))}
    parts = {}
    for name, line in lines.items():
        parts.setdefault(sha(name.encode())[:2], []).append(line)
    want = sha("".join(sha("\n".join(sorted(v)).encode()) for _, v in sorted(parts.items())).encode())
    path = f"file://{tmp_path}/table"
    assert audit.tree_hash(audit.file_hashes(spark, path, block=1000)) == want
    (tmp_path / "table" / "part-2").write_bytes(b"altered")
    assert audit.tree_hash(audit.file_hashes(spark, path, block=1000)) != want
    assert audit.shared_manifest(spark, "r", {}, {"in": path}, {}, {}, {})["inputs"].keys() == {"in"}


def test_two_writers_make_one_chain(spark):
    folder = scratch.folder(spark, "audit")
    write = lambda who: [audit.append_shared(spark, folder, "run", f"{who}-{i}", "h") for i in range(8)]
    both = [threading.Thread(target=write, args=(w,)) for w in "ab"]
    for t in both:
        t.start()
    for t in both:
        t.join()
    log = audit.entries(spark, folder)
    checked = audit.verify(log).collect()
    assert sorted(r["entry_id"] for r in checked) == list(range(1, 17)) and all(r["link_ok"] and r["hash_ok"] for r in checked)
    assert {r["run_id"] for r in checked} == {f"{w}-{i}" for w in "ab" for i in range(8)}


def test_planted_faults_are_found(spark):
    ents = [entity(f"E{i}") for i in range(6)]
    alerts = [alert(i, entity=f"E{i % 6}", asset=f"A{i % 6}", close=3000 + i % 7) for i in range(600)]
    given = bundle(spark, alerts=alerts, cases=[case(a[0], analyst=f"AN{k % 5}") for k, a in enumerate(alerts)], workflow_events=[event(a[0]) for a in alerts], escalations=[raised(a[0]) for a in alerts[::2]], assets=[asset(f"A{i}", f"E{i}") for i in range(6)], entities=ents)
    schedule = {"E0": "EG-01", "E1": "EG-03", "E2": "NS-03", "E3": "EG-07"}
    planted = faults.plant(given, schedule)
    truth = faults.truth(planted, given, schedule)
    c = Context(planted)
    for e, kind in schedule.items():
        found = {r["entity_id"] for r in findings(kind, c).collect()}
        assert e in found and not found & ({"E4", "E5"} - {e})
    quick = {r["scope"] for r in truth.where("detector_expected = 'EG-01'").collect()}
    assert quick and quick <= {r["scope"] for r in findings("EG-01", c).collect()}
    assert planted.alerts.where("entity_id in ('E4', 'E5')").exceptAll(given.alerts).isEmpty()


def test_forest_finds_the_odd_row(spark):
    rows = [("E", f"m{i}", *[float((i * 37 + j * 11) % 10) for j in range(len(anomaly.FEATURES))]) for i in range(300)] + [("E", "odd", *[500.0] * len(anomaly.FEATURES))]
    df = spark.createDataFrame(rows, "entity_id string, year_month string, " + ", ".join(f"{f} double" for f in anomaly.FEATURES))
    splits = anomaly.grow_forest(df, 301, trees=20, subsample=64).collect()
    nodes = {(r["tree"], r["node"]): r for r in splits}
    for (tree, node), r in nodes.items():
        if r["feature"] is not None:
            assert nodes[tree, 2 * node]["size"] + nodes[tree, 2 * node + 1]["size"] == r["size"]
    scores = {r["year_month"]: r["forest_score"] for r in anomaly.isolation_forest(df, trees=40, subsample=64).collect()}
    assert min(scores, key=scores.get) == "odd" and len(scores) == 301
    assert {r["forest_score"] for r in anomaly.isolation_forest(df.limit(1)).collect()} == {-0.5}
    same = df.select("entity_id", "year_month", *[F.lit(1.0).alias(f) for f in anomaly.FEATURES])
    assert len({r["forest_score"] for r in anomaly.isolation_forest(same).collect()}) == 1
