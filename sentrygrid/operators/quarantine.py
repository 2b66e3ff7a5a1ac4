"""Validation: every row keeps the first reason that it fails for, in one pass, and goes to the valid rows or to quarantine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrygrid.schema import PRIMARY_KEYS, QUARANTINE, REQUIRED, TABLES, TIERS, Bundle

TRUE_WORDS = ("1", "true", "yes", "y", "t")
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
ORDERINGS = {"alerts": (("created_ts", "ack_ts"), ("ack_ts", "closed_ts")), "cases": (("opened_ts", "closed_ts"),)}
DOMAINS = {"alerts": ("severity", "Invalid severity tier"), "assets": ("criticality", "Invalid asset criticality tier")}
REFERENCES = (("alerts", "entity_id", "entities"), ("cases", "alert_id", "alerts"), ("workflow_events", "case_id", "cases"), ("escalations", "case_id", "cases"))


def parse_time(value: Column) -> Column:
    """ISO times with or without fraction, seconds or time of day; null for anything else."""
    return F.coalesce(F.try_to_timestamp(value), *[F.try_to_timestamp(value, F.lit(f)) for f in FORMATS])


def with_reason(name: str, raw: DataFrame) -> DataFrame:
    """Raw rows (strings, ``row_pos``) with ``quarantine_reason``, null for valid rows."""
    key, columns = PRIMARY_KEYS.get(name), TABLES[name]
    missing = [c for c in REQUIRED[name] if c not in raw.columns]
    if missing:
        return raw.withColumn("quarantine_reason", F.lit(f"Missing required columns: {missing}"))
    checks: list[tuple[Column, str]] = []
    rows = raw
    if key:
        blank = F.col(key).isNull() | (F.trim(key) == "")
        rows = rows.withColumn("__n", F.when(~blank, F.row_number().over(Window.partitionBy(key, F.when(blank, F.col("row_pos"))).orderBy("row_pos"))))  # blank keys are no group
        checks += [(blank, f"Missing primary key {key}"), (F.col("__n") > 1, f"Duplicate primary key {key}")]
    times = [f.name for f in columns if isinstance(f.dataType, T.TimestampType) and f.name in raw.columns]
    parsed = {c: parse_time(F.col(c).cast("string")) if not isinstance(raw.schema[c].dataType, T.TimestampType) else F.col(c) for c in times}
    checks += [(parsed[c].isNull(), f"Unparseable timestamp in column '{c}'") for c in times]
    checks += [(parsed[a] > parsed[b], f"Timestamp ordering violation: {a} > {b}") for a, b in ORDERINGS.get(name, ())]
    if name in DOMAINS:
        column, reason = DOMAINS[name]
        checks.append((~F.coalesce(F.lower(F.trim(column)).isin(*TIERS), F.lit(False)), reason))
    reason = reduce(lambda acc, x: acc.when(x[0], x[1]), checks[1:], F.when(*checks[0])) if checks else F.lit(None).cast("string")
    return rows.withColumn("quarantine_reason", reason).drop("__n")


def typed(name: str, rows: DataFrame) -> DataFrame:
    """Valid raw rows in the canonical types; extra columns stay."""
    out = rows
    for f in TABLES[name]:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
        elif isinstance(f.dataType, T.TimestampType):
            out = out.withColumn(f.name, parse_time(F.col(f.name).cast("string")) if not isinstance(rows.schema[f.name].dataType, T.TimestampType) else F.col(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            out = out.withColumn(f.name, F.coalesce(F.lower(F.trim(F.col(f.name).cast("string"))).isin(*TRUE_WORDS), F.lit(False)))
        elif isinstance(f.dataType, T.DoubleType):
            number = F.col(f.name).cast("string").try_cast("double")
            out = out.withColumn(f.name, F.when(~F.isnan(number), number))
        elif f.name in ("severity", "criticality"):
            out = out.withColumn(f.name, F.lower(F.trim(f.name)))
    return out


def set_aside(name: str, rows: DataFrame) -> DataFrame:
    key = PRIMARY_KEYS.get(name)
    shown = [c for c in rows.columns if c not in ("quarantine_reason", "row_pos")]
    return rows.select(F.lit(name).alias("table_name"), (F.coalesce(F.col(key).cast("string"), F.lit("")) if key and key in rows.columns else F.lit("")).alias("record_id"), "quarantine_reason", F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in shown]), {"ignoreNullFields": "false"}).alias("row_data"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("quarantined_at"))


def validate(name: str, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows in canonical types, quarantined rows)."""
    judged = with_reason(name, raw)
    good = typed(name, judged.where("quarantine_reason is null").drop("quarantine_reason", "row_pos"))
    return good, set_aside(name, judged.where("quarantine_reason is not null"))


def enforce_references(bundle: Bundle) -> Bundle:
    """Set rows aside whose parent is not there, parents first; a check is skipped while either side is empty."""
    aside = [bundle.quarantine] if bundle.quarantine is not None else []
    for child, key, parent in REFERENCES:
        rows, keys = getattr(bundle, child), getattr(bundle, parent).select(key).distinct()
        if rows.isEmpty() or keys.isEmpty():
            continue
        orphans = rows.join(keys, key, "left_anti").withColumn("quarantine_reason", F.lit(f"Referential integrity: {key} not in {parent}"))
        aside.append(set_aside(child, orphans))
        bundle = bundle.replace(**{child: rows.join(keys, key, "left_semi").select(*rows.columns)})
    return bundle.replace(quarantine=reduce(DataFrame.unionByName, aside)) if aside else bundle


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], QUARANTINE if name == "quarantine" else TABLES[name])


def infer_entities(alerts: DataFrame, assets: DataFrame) -> DataFrame:
    ids = alerts.select("entity_id").union(assets.select("entity_id")).where("entity_id is not null").distinct()
    none = F.lit(None).cast("double")
    return ids.select("entity_id", F.lit("financial").alias("sector"), F.lit("Tier-1").alias("size_band"), F.lit("in-house").alias("soc_model"), *[none.alias(f.name) for f in TABLES["entities"] if f.name.startswith("claimed_")])


def counts(bundle: Bundle) -> DataFrame:
    """Rows of each table."""
    parts = [df.agg(F.lit(n).alias("table_name"), F.count("*").alias("rows")) for n, df in bundle.tables().items()]
    return reduce(DataFrame.unionByName, parts)
