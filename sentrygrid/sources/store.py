"""Files in and out: datasets of Parquet, CSV or JSON, legacy CSV, the Parquet store, and SQL over it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrygrid.operators.quarantine import TRUE_WORDS, empty, enforce_references, infer_entities, validate
from sentrygrid.schema import REQUIRED, TABLES, Bundle
from sentrygrid.sources.scratch import written

FORMATS = ("parquet", "csv", "json")
NAMES = (*TABLES, "quarantine")
ROW_CAP = 500


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resolve(spark: SparkSession, data_dir: str, name: str) -> tuple[str, str] | None:
    """(format, path) of a table: Parquet before CSV before JSON."""
    return next(((f, f"{data_dir}/{name}.{f}") for f in FORMATS if _exists(spark, f"{data_dir}/{name}.{f}")), None)


def _has_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field of CSV files goes on in the next line: a line then has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The wanted columns of a CSV file, those of them that it has."""
    raw = spark.read.csv(path, header=True, multiLine=_has_breaks(spark, path), escape='"')
    return raw.select(*[c for c in columns if c in raw.columns])


def _is_array(spark: SparkSession, path: str) -> bool:
    """Whether JSON files hold one array each and not an object a line."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    return first is not None and first["value"].lstrip().startswith("[")


def read_raw(spark: SparkSession, fmt: str, path: str, multi_line: bool | None = None) -> DataFrame:
    """A file as it is; text formats as strings, so that bad values survive to validation.

    ``row_pos``, where a file has none, is the scan order.  CSV fields may hold line breaks: where no line has an odd number of
    quotes there are none, and large files are split; else a file is one task.  ``multi_line`` decides without looking.  JSON is an object a line, which is split, or an array a file."""
    if fmt == "parquet":
        raw = spark.read.parquet(path)
    elif fmt == "csv":
        raw = spark.read.csv(path, header=True, multiLine=_has_breaks(spark, path) if multi_line is None else multi_line, escape='"')
    else:
        raw = spark.read.option("primitivesAsString", True).json(path, multiLine=_is_array(spark, path))
    return raw.withColumn("row_pos", F.col("row_pos").cast("long") if "row_pos" in raw.columns else F.monotonically_increasing_id())


def load_dataset(spark: SparkSession, source: str | dict[str, DataFrame], quarantine_dir: str | None = None, multi_line: bool | None = None) -> Bundle:
    """Read, validate and tie together the canonical tables of a folder or of DataFrames."""
    if isinstance(source, str) and not _exists(spark, source):
        raise FileNotFoundError(source)
    good, aside = {}, []
    for name in TABLES:
        if isinstance(source, dict):
            raw = source[name].withColumn("row_pos", F.monotonically_increasing_id()) if name in source and "row_pos" not in source[name].columns else source.get(name)
        else:
            found = resolve(spark, source, name)
            raw = read_raw(spark, *found, multi_line) if found else None
        if raw is None:
            good[name] = empty(spark, name)
        else:
            good[name], bad = validate(name, raw)
            aside.append(bad)
    if good["entities"].isEmpty():
        good["entities"] = infer_entities(good["alerts"], good["assets"])
    bundle = Bundle(**good, quarantine=reduce(DataFrame.unionByName, aside) if aside else empty(spark, "quarantine"))
    bundle = enforce_references(bundle)
    if quarantine_dir and not bundle.quarantine.isEmpty():
        write_csv(bundle.quarantine, quarantine_dir)
    return bundle


def adapt_legacy_alerts(raw: DataFrame) -> dict[str, DataFrame]:
    """One wide row an alert to alerts, cases, workflow events and escalations."""
    names = {"cse_id": "entity_id", "alert_type": "category", "alert_time": "created_ts", "closure_time": "closed_ts", "ack_time": "ack_ts"}
    wide = raw.withColumnsRenamed(names)
    if "disposition" not in wide.columns:
        wide = wide.withColumn("disposition", F.lit("unresolved"))
    has = lambda c: F.col(c) if c in wide.columns else F.lit(None).cast("string")
    truthy = lambda c: F.coalesce(F.lower(F.trim(has(c))).isin("yes", "true", "1"), F.lit(False))
    wide = wide.withColumn("severity", F.lower("severity")).withColumn("case_id", F.concat(F.lit("CASE-"), "alert_id")).withColumn("start", F.coalesce(has("investigation_start"), has("ack_ts"), has("created_ts")))
    return {
        "alerts": wide.select(*[c for c in REQUIRED["alerts"] if c in wide.columns]),
        "cases": wide.select("case_id", "alert_id", F.lit("analyst-01").alias("analyst_id"), F.col("start").alias("opened_ts"), F.coalesce(has("closed_ts"), F.col("start")).alias("closed_ts"), F.lit("closed").alias("status"), F.when(truthy("root_cause_found"), "resolved").otherwise("standard").alias("closure_code"), F.coalesce(has("investigation_notes"), F.lit("")).alias("notes_text")),
        "workflow_events": wide.select("case_id", F.lit("investigation").alias("step"), F.lit("analyst").alias("actor_role"), F.col("start").alias("ts")),
        "escalations": wide.where(truthy("escalated")).select("case_id", F.lit("Tier-1").alias("from_tier"), F.lit("Tier-2").alias("to_tier"), F.col("start").alias("ts"), F.lit("escalated").alias("outcome")),
    }


def adapt_legacy_assets(raw: DataFrame) -> DataFrame:
    out = raw.withColumnsRenamed({"cse_id": "entity_id", "expected_monitoring": "monitoring_expected"})
    return out.withColumn("criticality", F.lower("criticality")).withColumn("monitoring_expected", F.coalesce(F.lower(F.trim("monitoring_expected")).isin(*TRUE_WORDS), F.lit(False)))


def write_store(bundle: Bundle, path: str, partition_by: str | None = None) -> None:
    """One Parquet table each, empty ones too; optionally laid out by a column that every alert query filters on."""
    for name, df in bundle.tables().items():
        writer = df.write.mode("overwrite")
        if partition_by and partition_by in df.columns and name in ("alerts", "assets"):
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{path}/{name}.parquet")


def read_table(spark: SparkSession, path: str, name: str, columns: list[str] | None = None) -> DataFrame:
    file = f"{path}/{name}.parquet"
    df = spark.read.parquet(file) if _exists(spark, file) else empty(spark, name)
    return df.select(*columns) if columns else df


def list_tables(spark: SparkSession, path: str) -> list[str]:
    return [n for n in NAMES if _exists(spark, f"{path}/{n}.parquet")]


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    return Bundle(**{n: read_table(spark, path, n) for n in NAMES})


def store_summary(spark: SparkSession, path: str) -> dict[str, int]:
    return {n: read_table(spark, path, n).count() for n in list_tables(spark, path)}


def register(spark: SparkSession, bundle: Bundle) -> None:
    for name, df in bundle.tables().items():
        df.createOrReplaceTempView(name)


#: Spark's bounds on recursive queries, which it reads when they run; -1 is none.
RECURSION = ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit")


def _unbounded(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The rows of a recursive query, run to its end now."""
    before = {k: spark.conf.get(k) for k in RECURSION}
    try:
        for k in RECURSION:
            spark.conf.set(k, "-1")
        return written(spark, df, "recursion")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def query(spark: SparkSession, path: str, sql: str, limit: int | None = None, unbounded: bool = False) -> DataFrame:
    """A SELECT over the store's tables; anything else is refused.

    Spark stops a recursive query at a hundred levels or a million rows.  ``unbounded`` runs it to its end, without these bounds, and
    returns what was written; only for recursions that end."""
    bare = re.sub(r"^(\s|--[^\n]*\n|/\*.*?\*/|\()+", "", sql, flags=re.DOTALL)
    if not re.match(r"(?i)(select|with|values|from)\b", bare):
        raise ValueError("only queries are allowed")
    tables = list_tables(spark, path)
    for name in tables:
        read_table(spark, path, name).createOrReplaceTempView(name)
    try:
        out = spark.sql(sql)  # resolved here, so the names are needed no longer
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
    if unbounded:
        out = _unbounded(spark, out)
    return out.limit(limit) if limit is not None else out


def write_csv(df: DataFrame, path: str) -> None:
    flat = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c) for c in df.columns]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
