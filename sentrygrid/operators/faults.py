"""Faults of every kind planted into a bundle by hash, with the ground truth made from the same rules.

A schedule names the kind of each faulty entity; which of its alerts, assets or cases are touched follows from an MD5 draw of kind
and id, so that the same rows are faulty whatever the partitioning or the engine.  Entities are disjoint, and so are the slots of alerts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrygrid.operators.features import ch
from sentrygrid.schema import Bundle

#: Kinds by the detector that should find them: what is done to the entity.
KINDS = {
    "EG-01": "a third of severe alerts close in 20 s",
    "EG-02": "no case is escalated",
    "EG-03": "half of the cases have no workflow event",
    "EG-04": "all cases carry one note and one closure code",
    "EG-05": "alerts come within 20 days, of one category",
    "EG-06": "half of the alerts close after 58 minutes",
    "EG-07": "one analyst has most cases",
    "EG-08": "more alerts are false positives every month",
    "NS-01": "a quarter of the assets are silent",
    "NS-02": "one category is filed under another",
    "NS-03": "a third of severe alerts have no case",
    "NS-04": "most alerts are missing",
    "NS-05": "two weeks are silent",
    "NS-06": "most critical assets are not monitored",
    "NOV-01": "one month is all critical and slow",
}
NOTE = "Automated triage complete, no action needed."
LEAD, CATEGORY, OTHER_CATEGORY = "A-lead", "CAT3", "CAT1"
BURST, SILENCE, ODD_MONTH = "1995-03-01", ("1995-06-05", "1995-06-18"), "1996-04"
#: The month in which drift begins; its share of false positives grows by this many hundredths a month.
DRIFT_FROM, DRIFT_STEP = 1993, 2
Schedule = dict[str, str]  # entity -> kind


def draw(kind: str, key: Column) -> Column:
    """0 to 99 for a key."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{kind}:"), key)), 1, 8), 16, 10).cast("long"), F.lit(100))


def _of(schedule: Schedule, kind: str) -> Column:
    return F.coalesce(F.col("entity_id").isin([e for e, k in schedule.items() if k == kind]), F.lit(False))


def _day(text: str) -> Column:
    return F.to_timestamp(F.lit(f"{text} 00:00:00"))


def _slots(schedule: Schedule) -> dict[str, Column]:
    """Which alerts belong to a kind's fault."""
    of, alert = lambda k: _of(schedule, k), F.col("alert_id")
    return {
        "EG-01": of("EG-01") & ch() & (draw("EG-01", alert) < 33),
        "EG-06": of("EG-06") & (draw("EG-06", alert) < 50),
        "EG-07": of("EG-07") & (draw("EG-07", alert) < 80),
        "EG-03": of("EG-03") & (draw("EG-03", alert) < 50),
        "NS-03": of("NS-03") & ch() & (draw("NS-03", alert) < 33),
        "NOV-01": of("NOV-01") & (F.date_format("created_ts", "yyyy-MM") == ODD_MONTH),
    }


def plant(bundle: Bundle, schedule: Schedule, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> Bundle:
    """``keep`` may write alerts and cases, from which several of the tables follow, and read them back."""
    of, slots = lambda k: _of(schedule, k), _slots(schedule)
    a = bundle.alerts
    gone = (of("NS-01") & (draw("NS-01", F.col("asset_id")) < 25)) | (of("NS-04") & (draw("NS-04", F.col("alert_id")) < 70)) | (of("NS-05") & F.to_date("created_ts").between(*SILENCE))
    a = a.where(~F.coalesce(gone, F.lit(False)))
    away = F.unix_micros(_day(BURST)) + draw("EG-05", F.col("alert_id")) * 17_280 * 1_000_000 - F.unix_micros("created_ts")
    moved = lambda c: F.when(of("EG-05"), F.timestamp_micros(F.unix_micros(c) + away)).otherwise(F.col(c))
    month = (F.year("created_ts") - DRIFT_FROM) * 12 + F.month("created_ts") - 1
    drifted = of("EG-08") & (draw("EG-08", F.col("alert_id")) < F.least(month * DRIFT_STEP, F.lit(90)))
    a = a.withColumns({"created_ts": moved("created_ts"), "ack_ts": moved("ack_ts"), "closed_ts": moved("closed_ts")})
    after = lambda s: F.col("ack_ts") + F.expr(f"interval {s} seconds")
    a = a.withColumns({
        "closed_ts": F.when(slots["EG-01"], after(20)).when(slots["EG-06"], after(3480)).when(slots["NOV-01"], after(86_400)).otherwise(F.col("closed_ts")),
        "category": F.when(of("EG-05"), CATEGORY).when(of("NS-02") & (F.col("category") == CATEGORY), OTHER_CATEGORY).otherwise(F.col("category")),
        "disposition": F.when(drifted, "false_positive").otherwise(F.col("disposition")),
        "severity": F.when(slots["NOV-01"], "critical").otherwise(F.col("severity")),
    })
    a = keep("alerts", a)
    owner = a.select("alert_id", "entity_id", "severity")
    cases = bundle.cases.join(owner.hint("merge"), "alert_id").where(~slots["NS-03"])
    cases = cases.withColumns({"notes_text": F.when(of("EG-04"), NOTE).otherwise(F.col("notes_text")), "closure_code": F.when(of("EG-04"), "standard").otherwise(F.col("closure_code")), "analyst_id": F.when(slots["EG-07"], LEAD).otherwise(F.col("analyst_id"))})
    cases = keep("cases", cases.select(*bundle.cases.columns, "entity_id"))
    kept = cases.select("case_id", "alert_id", "entity_id").hint("merge")  # as many as alerts, in a compressed file
    events = bundle.workflow_events.join(kept, "case_id").where(~slots["EG-03"])
    raised = bundle.escalations.join(kept, "case_id").where(~of("EG-02"))
    unseen = of("NS-06") & (F.col("criticality") == "critical") & (draw("NS-06", F.col("asset_id")) < 80)
    assets = bundle.assets.withColumn("monitoring_expected", F.col("monitoring_expected") & ~F.coalesce(unseen, F.lit(False)))
    same = lambda df, like: df.select(*like.columns)
    return bundle.replace(alerts=a, cases=same(cases, bundle.cases), workflow_events=same(events, bundle.workflow_events), escalations=same(raised, bundle.escalations), assets=assets)


def truth(planted: Bundle, given: Bundle, schedule: Schedule) -> DataFrame:
    """(entity_id, fault_type, detector_expected, scope, intensity): alerts, assets and categories where the fault has places, else the entity or period."""
    of, slots = lambda k: _of(schedule, k), _slots(schedule)

    def rows(df: DataFrame, kind: str, scope: Column, intensity: str) -> DataFrame:
        return df.select("entity_id", F.lit(KINDS[kind]).alias("fault_type"), F.lit(kind).alias("detector_expected"), scope.alias("scope"), F.lit(intensity).alias("intensity"))

    entity = F.concat(F.lit("entity:"), "entity_id")
    a = planted.alerts
    alert = F.concat(F.lit("alert:"), "alert_id")
    parts = [rows(planted.entities.where(of(k)), k, entity, "subtle" if k in ("EG-06", "EG-08", "NS-04") else "strong") for k in ("EG-02", "EG-04", "EG-06", "EG-07", "EG-08", "NS-03", "NS-04", "NS-06")]
    parts += [rows(a.where(slots["EG-01"]), "EG-01", alert, "strong")]
    unworked = planted.cases.join(a.where(slots["EG-03"]).select("alert_id", "entity_id").hint("merge"), "alert_id")
    parts += [rows(unworked, "EG-03", alert, "strong")]
    parts += [rows(a.where(of("EG-05")).select("entity_id", "asset_id").distinct(), "EG-05", F.concat(F.lit("asset:"), "asset_id"), "strong")]
    silent = given.alerts.where(of("NS-01")).select("entity_id", "asset_id").distinct().where(draw("NS-01", F.col("asset_id")) < 25)
    parts += [rows(silent, "NS-01", F.concat(F.lit("asset:"), "asset_id"), "strong")]
    parts += [rows(planted.entities.where(of("NS-02")), "NS-02", F.lit(f"category:{CATEGORY}"), "strong")]
    parts += [rows(planted.entities.where(of("NS-05")), "NS-05", F.lit(f"period:{SILENCE[0]}"), "strong")]
    parts += [rows(planted.entities.where(of("NOV-01")), "NOV-01", F.lit(f"period:{ODD_MONTH}"), "strong")]
    return reduce(DataFrame.unionByName, parts)
