import json

import pytest
from helpers import THREE
from pyspark.sql import functions as F

from sentrygrid.operators.quarantine import enforce_references, validate
from sentrygrid.schema import TABLES
from sentrygrid.sources import store

COLUMNS = "row_pos long, alert_id string, entity_id string, asset_id string, category string, severity string, created_ts string, ack_ts string, closed_ts string, disposition string, extra string"
GOOD = ("E1", "A1", "Malware", " Critical ", "2026-01-01 10:00:00", "2026-01-01T10:05:00", "2026-01-01 11:00", "true_positive", "x")


def raw(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], COLUMNS)


def test_each_row_has_its_first_reason(spark):
    late = (*GOOD[:4], "2026-01-01 10:10:00", *GOOD[5:])
    bad_time = (*GOOD[:4], "soon", *GOOD[5:])
    rows = raw(spark, ("A1", *GOOD), ("A2", *late), ("A1", *bad_time), ("A3", *GOOD[:3], "urgent", *GOOD[4:]), ("  ", *GOOD), (None, *GOOD), ("A4", *bad_time), ("A5", *GOOD[:3], None, *GOOD[4:]))
    good, bad = validate("alerts", rows)
    assert [r.alert_id for r in good.collect()] == ["A1"]
    assert good.first().severity == "critical" and good.first().extra == "x"
    reasons = sorted((r.record_id, r.quarantine_reason) for r in bad.collect())
    assert reasons == [
        ("", "Missing primary key alert_id"),
        ("  ", "Missing primary key alert_id"),
        ("A1", "Duplicate primary key alert_id"),
        ("A2", "Timestamp ordering violation: created_ts > ack_ts"),
        ("A3", "Invalid severity tier"),
        ("A4", "Unparseable timestamp in column 'created_ts'"),
        ("A5", "Invalid severity tier"),
    ]
    assert json.loads(bad.where("record_id = 'A5'").first().row_data)["severity"] is None


def test_missing_column_sets_the_table_aside(spark):
    good, bad = validate("alerts", raw(spark, ("A1", *GOOD)).drop("severity"))
    assert good.count() == 0 and "Missing required columns: ['severity']" == bad.first().quarantine_reason


def test_booleans_and_numbers(spark):
    rows = spark.createDataFrame([(0, "S1", "E1", "HIGH", "server", "False"), (1, "S2", "E1", "low", "server", "yes"), (2, "S3", "E1", "tiny", "server", "1")], "row_pos long, asset_id string, entity_id string, criticality string, asset_type string, monitoring_expected string")
    good, bad = validate("assets", rows)
    assert {r.asset_id: r.monitoring_expected for r in good.collect()} == {"S1": False, "S2": True}
    assert bad.first().quarantine_reason == "Invalid asset criticality tier"


def test_references_cascade(spark):
    from helpers import alert, bundle, case, event, raised

    b = bundle(spark, alerts=[alert(1), alert(1, entity="GHOST")], cases=[case("E1-1"), case("GHOST-1")], workflow_events=[event("GHOST-1")], escalations=[raised("E1-1"), raised("NONE")])
    out = enforce_references(b)
    assert out.alerts.count() == 1 and out.cases.count() == 1 and out.workflow_events.count() == 0 and out.escalations.count() == 1
    assert sorted(r.quarantine_reason for r in out.quarantine.collect()) == ["Referential integrity: alert_id not in alerts", "Referential integrity: case_id not in cases", "Referential integrity: case_id not in cases", "Referential integrity: entity_id not in entities"]


def test_legacy_files(spark):
    wide = spark.createDataFrame([("L1", "CSE-1", "SRV-1", "Critical", "High", "Phishing", "2026-01-01 09:00", "2026-01-01 09:05", "2026-01-01 09:10", "2026-01-01 10:00", "Yes", "yes", "found it", "True Positive"), ("L2", "CSE-1", "SRV-2", "Low", "Low", "Scan", "2026-01-01 09:00", "2026-01-01 09:05", None, "2026-01-01 10:00", "No", "no", None, "x")], "alert_id string, cse_id string, asset_id string, asset_criticality string, severity string, alert_type string, alert_time string, ack_time string, investigation_start string, closure_time string, escalated string, root_cause_found string, investigation_notes string, disposition string")
    t = store.adapt_legacy_alerts(wide)
    b = store.load_dataset(spark, t | {"assets": store.adapt_legacy_assets(spark.createDataFrame([("CSE-1", "SRV-1", "server", "Critical", "Yes")], "cse_id string, asset_id string, asset_type string, criticality string, expected_monitoring string"))})
    assert b.alerts.count() == 2 and b.cases.count() == 2 and b.workflow_events.count() == 2 and b.escalations.count() == 1
    assert {r.closure_code for r in b.cases.collect()} == {"resolved", "standard"}
    assert b.assets.first().monitoring_expected and b.entities.first().sector == "financial"


def test_formats_and_store(spark, tmp_path):
    data = tmp_path / "data"
    rows = raw(spark, ("A1", *GOOD), ("A2", *GOOD)).drop("row_pos")
    rows.write.csv(f"{data}/alerts.csv", header=True)
    (data / "assets.json").write_text(json.dumps([{"asset_id": "A1", "entity_id": "E1", "criticality": "low", "asset_type": "server", "monitoring_expected": True}]))
    spark.createDataFrame(THREE, TABLES["entities"]).write.parquet(f"{data}/entities.parquet")
    b = store.load_dataset(spark, str(data), f"{tmp_path}/aside")
    assert b.alerts.count() == 2 and b.assets.first().monitoring_expected and b.entities.count() == 3
    store.write_store(b, f"{tmp_path}/store")
    assert set(store.list_tables(spark, f"{tmp_path}/store")) == {*TABLES, "quarantine"}
    assert store.store_summary(spark, f"{tmp_path}/store")["alerts"] == 2
    assert store.read_table(spark, f"{tmp_path}/store", "alerts", ["alert_id"]).columns == ["alert_id"]
    assert store.query(spark, f"{tmp_path}/store", "SELECT entity_id, count(*) AS n FROM alerts GROUP BY 1").first().n == 2
    assert store.load_bundle(spark, f"{tmp_path}/none").alerts.count() == 0
    with pytest.raises(ValueError):
        store.query(spark, f"{tmp_path}/store", "DROP TABLE alerts")
    with pytest.raises(FileNotFoundError):
        store.load_dataset(spark, f"{tmp_path}/nowhere")
    store.write_csv(b.alerts.withColumn("tags", F.array(F.lit("a"))), f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 2


def test_incremental_ingest(spark, tmp_path):
    from sentrygrid.streaming.ingest import ingest_new

    inbox = tmp_path / "in"
    header = ",".join(f.name for f in TABLES["workflow_events"])
    inbox.mkdir()
    args = ("workflow_events", str(inbox), f"{tmp_path}/out", f"{tmp_path}/bad", f"{tmp_path}/cp")
    for i, n in enumerate((1, 2)):
        (inbox / f"f{i}.csv").write_text(f"{header}\nC{i},triage,analyst,2026-01-01 10:00:00\nC9,x,y,never\n")
        ingest_new(spark, *args).awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == n and spark.read.parquet(f"{tmp_path}/bad").count() == n


def test_json_lines_and_json_arrays_are_read_whole(spark, tmp_path):
    lines, array = tmp_path / "lines.json", tmp_path / "array.json"
    lines.write_text('{"a": 1}\n{"a": 2}\n')
    array.write_text('[\n {"a": 1},\n {"a": 2}\n]')
    for path in (lines, array):
        assert sorted(r.a for r in store.read_raw(spark, "json", str(path)).collect()) == ["1", "2"]


def test_csv_fields_with_line_breaks(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b\n1,"two\nlines"\n')
    assert [(r.a, r.b) for r in store.read_raw(spark, "csv", str(path)).collect()] == [("1", "two\nlines")]
