"""Canonical tables, finding schema, thresholds and fixed maps."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import types as T

S, TS, D, B = T.StringType(), T.TimestampType(), T.DoubleType(), T.BooleanType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


TABLES: dict[str, T.StructType] = {
    "alerts": _struct(alert_id=S, entity_id=S, asset_id=S, category=S, severity=S, created_ts=TS, ack_ts=TS, closed_ts=TS, disposition=S),
    "cases": _struct(case_id=S, alert_id=S, analyst_id=S, opened_ts=TS, closed_ts=TS, status=S, closure_code=S, notes_text=S),
    "workflow_events": _struct(case_id=S, step=S, actor_role=S, ts=TS),
    "escalations": _struct(case_id=S, from_tier=S, to_tier=S, ts=TS, outcome=S),
    "assets": _struct(asset_id=S, entity_id=S, criticality=S, asset_type=S, monitoring_expected=B),
    "entities": _struct(entity_id=S, sector=S, size_band=S, soc_model=S, claimed_mttc_min=D, claimed_coverage_pct=D, claimed_fp_rate_pct=D, claimed_escalation_pct=D),
}
PRIMARY_KEYS = {"alerts": "alert_id", "cases": "case_id", "assets": "asset_id", "entities": "entity_id"}
REQUIRED = {
    "alerts": ("alert_id", "entity_id", "asset_id", "category", "severity", "created_ts", "ack_ts", "closed_ts", "disposition"),
    "cases": ("case_id", "alert_id", "analyst_id", "opened_ts", "closed_ts", "status", "closure_code", "notes_text"),
    "workflow_events": ("case_id", "step", "actor_role", "ts"),
    "escalations": ("case_id", "from_tier", "to_tier", "ts", "outcome"),
    "assets": ("asset_id", "entity_id", "criticality", "asset_type", "monitoring_expected"),
    "entities": ("entity_id", "sector", "size_band", "soc_model"),
}
QUARANTINE = _struct(table_name=S, record_id=S, quarantine_reason=S, row_data=S, quarantined_at=S)
TIERS = ("low", "medium", "high", "critical")

FINDING = _struct(
    finding_id=S, detector_id=S, detector_version=S, category=S, entity_id=S, scope=S, severity_weight=D, deviation=D, peer_percentile=D, confidence=D, reason_text=S,
    evidence_refs=T.ArrayType(S), parameters=S, feedback_factor=D,
)

# Areas with their weights, and the areas that each detector speaks to.
AREA_WEIGHTS = {
    "detection": 0.18,
    "investigation": 0.16,
    "escalation": 0.14,
    "response": 0.12,
    "security_operations": 0.12,
    "governance": 0.10,
    "operational_discipline": 0.10,
    "resilience": 0.08,
}
DETECTOR_AREAS = {
    "EG-01": ("investigation", "operational_discipline"),
    "EG-02": ("escalation", "governance"),
    "EG-03": ("investigation", "operational_discipline"),
    "EG-04": ("investigation", "governance"),
    "EG-05": ("response", "resilience"),
    "EG-06": ("operational_discipline", "governance"),
    "EG-07": ("security_operations", "governance"),
    "EG-08": ("detection", "governance"),
    "NS-01": ("detection", "security_operations"),
    "NS-02": ("detection", "operational_discipline"),
    "NS-03": ("escalation", "governance"),
    "NS-04": ("detection", "security_operations"),
    "NS-05": ("operational_discipline", "resilience"),
    "NS-06": ("security_operations", "resilience"),
    "NOV-01": ("security_operations", "detection"),
}
DEFAULT_AREA = "security_operations"
SEVERITY_WEIGHTS = {"low": 1.0, "medium": 2.0, "high": 3.0, "critical": 5.0}
#: metric, claim column, and whether a higher value flatters.
CLAIMS = (
    ("mttc_min", "claimed_mttc_min", False),
    ("coverage_pct", "claimed_coverage_pct", True),
    ("fp_rate_pct", "claimed_fp_rate_pct", False),
    ("escalation_pct", "claimed_escalation_pct", True),
)


@dataclass(frozen=True)
class Thresholds:
    min_cohort: int = 3
    eg01_z: float = -2.5
    eg01_percentile: float = 0.05
    eg01_min_alerts: int = 5
    eg02_z: float = -2.0
    eg02_min_alerts: int = 5
    eg03_gap_sec: float = 60.0
    eg03_cap: int = 15
    eg04_similarity: float = 0.90
    eg04_entropy: float = 1.0
    eg04_min_notes: int = 5
    eg04_share: float = 0.35
    eg05_repeats: int = 3
    eg06_z: float = 2.5
    eg06_rate: float = 0.15
    eg07_share: float = 0.50
    eg07_z: float = 1.8
    eg07_min_analysts: int = 3
    eg07_min_alerts: int = 10
    eg08_cusum: float = 4.0
    eg08_drift: float = 0.5
    eg08_min_alerts: int = 50
    eg08_min_months: int = 3
    ns02_p: float = 0.01
    ns02_mu: float = 8.0
    ns02_min_alerts: int = 30
    ns02_min_cohort_alerts: int = 100
    ns02_share: float = 0.05
    ns04_ratio: float = 0.45
    ns04_z: float = -1.5
    ns05_days: int = 3
    ns05_span: int = 14
    ns06_z: float = -1.8
    ns06_coverage: float = 0.70
    nov01_contamination: float = 0.08
    nov01_neighbors: int = 5
    nov01_min_rows: int = 8


THRESHOLDS = Thresholds()


@dataclass(frozen=True)
class Bundle:
    """The canonical tables, and the rows that validation set aside."""

    alerts: DataFrame
    cases: DataFrame
    workflow_events: DataFrame
    escalations: DataFrame
    assets: DataFrame
    entities: DataFrame
    quarantine: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}

    def replace(self, **changes: DataFrame) -> Bundle:
        return Bundle(**(self.tables() | changes))
