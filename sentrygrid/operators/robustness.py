"""Corrupted input, adversaries who tidy their records, and sparse cohorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrygrid.functions.stats import spearman
from sentrygrid.operators.features import alert_features, ch
from sentrygrid.schema import Bundle

#: Kinds of corruption, by slice of a hash of the position, with the reason that validation should give.
CORRUPTIONS = {
    "bad_severity": "Invalid severity tier",
    "missing_severity": "Invalid severity tier",
    "bad_timestamp": "Unparseable timestamp in column 'ack_ts'",
    "reversed_timestamp": "Timestamp ordering violation: created_ts > ack_ts",
    "ghost_entity": "Referential integrity: entity_id not in entities",
    "duplicate_pk": "Duplicate primary key alert_id",
}
SLICES = 100


def slice_of(seed: int = 42) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row_pos").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(SLICES))


def corrupt(raw: DataFrame, seed: int = 42) -> DataFrame:
    """Raw alerts (strings, row_pos) with one slice spoilt in each way and ``corruption`` naming it; slices do not overlap."""
    kinds = list(CORRUPTIONS)
    kind = F.coalesce(*[F.when(slice_of(seed) == i, k) for i, k in enumerate(kinds)])
    rows = raw.withColumn("corruption", kind)
    target = F.col("corruption") == "duplicate_pk"
    untouched = rows.where("corruption is null").groupBy("entity_id").agg(F.min_by("alert_id", "row_pos").alias("__first"))
    rows = rows.join(untouched, "entity_id", "left")
    early = F.date_format(F.try_to_timestamp(F.col("created_ts")) - F.expr("interval 45 minutes"), "yyyy-MM-dd HH:mm:ss")
    is_ = lambda k: F.col("corruption") == k
    return rows.withColumns(
        {
            "alert_id": F.when(target, F.coalesce("__first", "alert_id")).otherwise(F.col("alert_id")),
            "severity": F.when(is_("bad_severity"), "P1-URGENT").when(is_("missing_severity"), "").otherwise(F.col("severity")),
            "ack_ts": F.when(is_("bad_timestamp"), "not-a-timestamp").when(is_("reversed_timestamp"), early).otherwise(F.col("ack_ts")),
            "entity_id": F.when(is_("ghost_entity"), "GHOST").otherwise(F.col("entity_id")),
        }
    ).withColumn("row_pos", F.when(target, F.col("row_pos") + (1 << 40)).otherwise(F.col("row_pos"))).drop("__first")


def catch_rate(judged: DataFrame) -> DataFrame:
    """Of each kind, how many rows were set aside for the expected reason; ``judged``: corruption, quarantine_reason."""
    expected = reduce(lambda acc, x: acc.when(F.col("corruption") == x[0], x[1]), list(CORRUPTIONS.items())[1:], F.when(F.col("corruption") == "bad_severity", CORRUPTIONS["bad_severity"]))
    return judged.where("corruption is not null").groupBy("corruption").agg(F.count("*").alias("injected"), F.count_if(F.coalesce(F.col("quarantine_reason") == expected, F.lit(False))).alias("caught")).withColumn("rate", F.col("caught") / F.col("injected"))


def rank_stability(before: DataFrame, after: DataFrame) -> DataFrame:
    """Spearman's correlation of the risk indices of entities that both runs scored."""
    both = before.select("entity_id", F.col("risk_index").alias("x")).join(after.select("entity_id", F.col("risk_index").alias("y")), "entity_id")
    return spearman(both, "x", "y")


def tidy(bundle: Bundle, entity: str, filler: int = 200) -> Bundle:
    """What an entity would send to look well: closures near the peers' median, work spread over analysts, varied notes,
    an escalation and an event for each case, and filler alerts."""
    af = alert_features(bundle)
    target = F.lit(entity)
    median = bundle.alerts.where(F.col("entity_id") != target).agg(F.median((F.unix_micros("closed_ts") - F.unix_micros("ack_ts")) / 1e6).alias("m"))
    noise = F.pmod(F.xxhash64("alert_id"), F.lit(2001)) / 10_000 - 0.1
    padded = F.timestamp_micros((F.unix_micros("ack_ts") + F.col("m") * (1 + noise) * 1e6).cast("long"))
    mine = F.col("entity_id") == target
    alerts = bundle.alerts.join(F.broadcast(median)).withColumn("closed_ts", F.when(mine & ch(), padded).otherwise(F.col("closed_ts"))).drop("m")
    owned = af.where(mine & F.col("has_case")).select("case_id", F.col("closed_ts").alias("at")).distinct()
    marked = bundle.cases.join(owned.select("case_id").withColumn("own", F.lit(True)), "case_id", "left")
    cases = marked.withColumns({"analyst_id": F.when(F.col("own"), F.concat(F.lit("AN-"), F.pmod(F.xxhash64("case_id"), F.lit(8)).cast("string"))).otherwise(F.col("analyst_id")), "notes_text": F.when(F.col("own"), F.concat(F.lit("Reviewed evidence "), F.md5("case_id"))).otherwise(F.col("notes_text"))}).select(*bundle.cases.columns)
    made = owned.select("case_id", F.lit("Tier-1").alias("from_tier"), F.lit("Tier-2").alias("to_tier"), F.col("at").alias("ts"), F.lit("escalated").alias("outcome"))
    events = owned.select("case_id", F.lit("triage").alias("step"), F.lit("analyst").alias("actor_role"), F.col("at").alias("ts"))
    span = bundle.alerts.where(mine).agg(F.min("created_ts").alias("lo"), F.max("created_ts").alias("hi"), F.min("asset_id").alias("asset_id"))
    extra = span.select(F.explode(F.sequence(F.lit(1), F.lit(filler))).alias("i"), "lo", "hi", "asset_id")
    at = F.timestamp_micros((F.unix_micros("lo") + (F.unix_micros("hi") - F.unix_micros("lo")) * F.col("i") / filler).cast("long"))
    flood = extra.withColumn("t", at).select(F.concat(F.lit(f"FILL-{entity}-"), F.col("i").cast("string")).alias("alert_id"), target.alias("entity_id"), "asset_id", F.lit("Filler").alias("category"), F.lit("low").alias("severity"), F.col("t").alias("created_ts"), (F.col("t") + F.expr("interval 5 minutes")).alias("ack_ts"), (F.col("t") + F.expr("interval 65 minutes")).alias("closed_ts"), F.lit("true_positive").alias("disposition"))
    return bundle.replace(alerts=alerts.unionByName(flood.select(*alerts.columns)), cases=cases, escalations=bundle.escalations.unionByName(made.select(*bundle.escalations.columns)), workflow_events=bundle.workflow_events.unionByName(events.select(*bundle.workflow_events.columns)))


def lane_survival(before: DataFrame, after: DataFrame, entity: str | None = None) -> DataFrame:
    """Findings of each detector before and after."""
    count = lambda df, name: (df.where(F.col("entity_id") == entity) if entity else df).groupBy("detector_id").agg(F.count("*").alias(name))
    both = count(before, "before").join(count(after, "after"), "detector_id", "full_outer").fillna(0)
    return both.withColumn("survival", F.try_divide("after", "before"))


def sparse(bundle: Bundle, keep_every: int = 3) -> Bundle:
    """Only every n-th entity, with its rows: cohorts too small for their band."""
    order = Window.partitionBy("sector").orderBy("entity_id")
    kept = bundle.entities.withColumn("r", F.row_number().over(order)).where((F.col("r") - 1) % keep_every == 0).drop("r")
    ids = kept.select("entity_id")
    return bundle.replace(entities=kept, alerts=bundle.alerts.join(ids, "entity_id", "left_semi"), assets=bundle.assets.join(ids, "entity_id", "left_semi"))
