"""Examiners' decisions: an append-only ledger, and weights that follow from it in order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FLOOR, STEP = 0.3, 0.6
#: Decisions that a slice of the ledger holds on average.
SLICE_ROWS = 50_000
LEDGER = "feedback_id long, finding_id string, entity_id string, detector_id string, decision string, examiner string, comment string, created_at string"


def append(spark: SparkSession, path: str, decisions: DataFrame) -> None:
    """Add decisions to the ledger, a folder of Parquet files."""
    decisions.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in LEDGER.split(", ")]).write.mode("append").parquet(path)


def _states() -> list[float]:
    """Every factor that decisions can lead to from 1."""
    states = [1.0]
    for f in states:
        states += [g for g in dict.fromkeys((_step(f, "dismiss"), _step(f, "confirm"))) if g not in states]
    return states


def _step(f: float, decision: str) -> float:
    return round(max(FLOOR, f * STEP), 6) if decision == "dismiss" else round(min(1.0, f / STEP), 6)


def pair_maps(ledger: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The decisions of each (entity, detector), in order, as one map from factor to factor, with their number and last time.

    Decisions are cut into slices by ascending id.  Those of a pair within a slice become one map, and a pair's maps are
    composed in order, so that no pair's decisions come into one row."""
    cut = ledger.repartitionByRange(max(1, math.ceil(ledger.count() / slice_rows)), "feedback_id").withColumn("slice", F.spark_partition_id())
    part = cut.groupBy("entity_id", "detector_id", "slice").agg(*in_order()).select("entity_id", "detector_id", "slice", as_map().alias("map"), F.size("events").alias("n"), "updated_at")
    return composed(part)


def in_order() -> list[Column]:
    """Aggregates of a slice: its decisions by ascending id and its last time."""
    return [F.array_sort(F.collect_list(F.struct("feedback_id", "decision"))).alias("events"), F.max("created_at").alias("updated_at")]


def as_map() -> Column:
    """The decisions ``events`` of a slice as one map from factor to factor."""
    states = _states()
    leads = {d: _array([states.index(_step(f, d)) for f in states]) for d in ("dismiss", "confirm")}
    return F.aggregate("events", _array(range(len(states))), lambda m, e: F.when(e["decision"] == "dismiss", _through(m, leads["dismiss"])).when(e["decision"] == "confirm", _through(m, leads["confirm"])).otherwise(m))


def _array(values) -> Column:
    return F.array(*map(F.lit, values))


def _through(m: Column, to: Column) -> Column:
    return F.transform(m, lambda i: F.get(to, i))


def composed(parts: DataFrame) -> DataFrame:
    """Maps (entity_id, detector_id, slice, map, n, updated_at) of each pair in the order of their slices, as one map."""
    maps = F.array_sort(F.collect_list(F.struct("slice", "map")))
    whole = F.aggregate("maps", _array(range(len(_states()))), lambda m, x: _through(m, x["map"]))
    return parts.groupBy("entity_id", "detector_id").agg(maps.alias("maps"), F.sum("n").cast("int").alias("n"), F.max("updated_at").alias("updated_at")).select("entity_id", "detector_id", whole.alias("map"), "n", "updated_at")


def factors(maps: DataFrame) -> DataFrame:
    """What the maps lead to from a factor of 1."""
    return maps.select("entity_id", "detector_id", F.get(_array(_states()), F.get("map", F.lit(0))).alias("factor"), F.col("n").alias("version"), "updated_at")


def weights(ledger: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Factor and version of each (entity, detector): dismissals multiply by the step down to the floor, confirmations divide up to 1."""
    return factors(pair_maps(ledger, slice_rows))


def listed(weighted: DataFrame) -> DataFrame:
    return weighted.orderBy(F.desc("updated_at"), "entity_id", "detector_id")


def history(ledger: DataFrame, entity: str | None = None, detector: str | None = None, limit: int = 100) -> DataFrame:
    for column, value in (("entity_id", entity), ("detector_id", detector)):
        if value is not None:
            ledger = ledger.where(F.col(column) == value)
    return ledger.orderBy(F.desc("feedback_id")).limit(limit)


def apply(findings: DataFrame, weighted: DataFrame) -> DataFrame:
    """Stamp the factors on findings, 1 where there is none."""
    factors = weighted.select("entity_id", "detector_id", F.col("factor").alias("__f"))
    return findings.join(factors, ["entity_id", "detector_id"], "left").withColumn("feedback_factor", F.coalesce("__f", F.lit(1.0))).select(*findings.columns)


def latest(ledger: DataFrame) -> DataFrame:
    order = Window.partitionBy("finding_id").orderBy(F.desc("feedback_id"))
    return ledger.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def decided(queue: DataFrame, ledger: DataFrame) -> DataFrame:
    """Queue items with the last decision on their finding and its id, null where there is none."""
    last = latest(ledger).select("finding_id", "decision", F.col("feedback_id").alias("decided_by"))
    return queue.join(last, "finding_id", "left")


def agreement(ledger: DataFrame, findings: DataFrame, by: str | None = None) -> DataFrame:
    """How often examiners' last words confirm findings, overall or by detector or entity, and the confidence of either kind."""
    seen = latest(ledger).select("finding_id", "decision")
    joined = findings.select("finding_id", "detector_id", "entity_id", "confidence").join(seen, "finding_id", "left")
    yes, no = F.col("decision") == "confirm", F.col("decision") == "dismiss"
    keys = [by] if by else []
    return joined.groupBy(*keys).agg(
        F.count("*").alias("findings"), F.count("decision").alias("reviewed"), F.count_if(yes).alias("confirmed"), F.bround(F.try_divide(F.count_if(yes), F.count("decision")), 4).alias("confirm_rate"),
        F.bround(F.try_divide(F.count("decision"), F.count("*")), 4).alias("coverage"), F.bround(F.avg(F.when(yes, F.col("confidence"))), 4).alias("confidence_confirmed"), F.bround(F.avg(F.when(no, F.col("confidence"))), 4).alias("confidence_dismissed"),
    )
