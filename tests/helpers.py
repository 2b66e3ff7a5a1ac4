"""Small bundles of canonical tables for tests."""

from __future__ import annotations

from datetime import datetime, timedelta

from sentrygrid.schema import TABLES, Bundle

T0 = datetime(2026, 1, 5, 8, 0, 0)


def alert(i, entity="E1", asset="A1", category="Malware", severity="critical", created=None, ack=60, close=3600, disposition="true_positive"):
    created = created or T0 + timedelta(hours=i if isinstance(i, int) else 0)
    return (f"{entity}-{i}", entity, asset, category, severity, created, created + timedelta(seconds=ack), created + timedelta(seconds=ack + close), disposition)


def case(alert_id, analyst="AN1", code="standard", note=None):
    return (f"C-{alert_id}", alert_id, analyst, T0, T0, "closed", code, note)


def event(alert_id):
    return (f"C-{alert_id}", "triage", "analyst", T0)


def raised(alert_id):
    return (f"C-{alert_id}", "Tier-1", "Tier-2", T0, "pending")


def asset(asset_id, entity="E1", criticality="critical", monitored=True):
    return (asset_id, entity, criticality, "server", monitored)


def entity(entity_id, sector="banking", band="Tier-1"):
    return (entity_id, sector, band, "in-house", None, None, None, None)


THREE = [entity("E1"), entity("E2"), entity("E3")]


def bundle(spark, **rows) -> Bundle:
    rows = {"entities": THREE} | rows
    return Bundle(**{n: spark.createDataFrame(rows.get(n, []), s) for n, s in TABLES.items()})
