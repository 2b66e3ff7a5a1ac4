"""The canonical tables as views over a TPC-H-like schema: nations are entities, customers and suppliers assets, orders
alerts.  Suppliers have no orders, so they are the assets that never send an alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrygrid.schema import Bundle

SECOND = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _key(prefix: str, col: str) -> Column:
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    claim = lambda base, step, span: F.when(k % 7 != 6, (F.lit(base) + k * step % span).cast("double"))
    return rows.select(
        _key("N", "n_nationkey").alias("entity_id"),
        F.when(k >= 23, "OTHER").otherwise(F.col("r_name")).alias("sector"),
        F.when(k < 15, "Tier-1").otherwise("Tier-2").alias("size_band"),
        F.lit("in-house").alias("soc_model"),
        claim(40, 7, 45).alias("claimed_mttc_min"),
        claim(60, 13, 41).alias("claimed_coverage_pct"),
        claim(25, 11, 30).alias("claimed_fp_rate_pct"),
        claim(20, 17, 45).alias("claimed_escalation_pct"),
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = F.col("c_mktsegment")
    tier = F.when(seg == "BUILDING", "critical").when(seg == "MACHINERY", "high").when(seg == "HOUSEHOLD", "medium").otherwise("low")
    senders = table(spark, sf_dir, "customer").select(_key("C", "c_custkey").alias("asset_id"), _key("N", "c_nationkey").alias("entity_id"), tier.alias("criticality"), F.lit("server").alias("asset_type"), (F.col("c_acctbal") >= 0).alias("monitoring_expected"))
    kind = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    quiet = table(spark, sf_dir, "supplier").select(_key("S", "s_suppkey").alias("asset_id"), _key("N", "s_nationkey").alias("entity_id"), kind.alias("criticality"), F.lit("sensor").alias("asset_type"), (F.col("s_acctbal") >= 0).alias("monitoring_expected"))
    return senders.unionByName(quiet)


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers grow with the orders and their file is compressed, so they are not broadcast.  The join is by the asset, which also partitions an asset's alerts for windows."""
    k, lead = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    owners = table(spark, sf_dir, "customer").select(_key("C", "c_custkey").alias("asset_id"), "c_nationkey")
    rows = table(spark, sf_dir, "orders").withColumn("asset_id", _key("C", "o_custkey")).join(owners.hint("merge"), "asset_id")
    created = micros(F.col("o_orderdate")) + k * 7919 % 86400 * SECOND
    ack = created + (60 + k * 104729 % 840) * SECOND
    closed = ack + (60 + F.floor("o_totalprice") % 7140) * SECOND
    status = F.col("o_orderstatus")
    return rows.select(
        _key("O", "o_orderkey").alias("alert_id"),
        _key("N", "c_nationkey").alias("entity_id"),
        "asset_id",
        F.concat(F.lit("CAT"), (k * 31 % 6).cast("string")).alias("category"),
        F.when(lead == "1", "critical").when(lead == "2", "high").when(lead == "3", "medium").otherwise("low").alias("severity"),
        F.timestamp_micros(created).alias("created_ts"),
        F.timestamp_micros(ack).alias("ack_ts"),
        F.timestamp_micros(closed).alias("closed_ts"),
        F.when(status == "F", "false_positive").when(status == "O", "true_positive").otherwise("unresolved").alias("disposition"),
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("flag"), F.min("l_partkey").alias("p"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return lines.join(part.hint("merge"), F.col("p") == F.col("p_partkey"), "left").select(
        _key("K", "l_orderkey").alias("case_id"),
        _key("O", "l_orderkey").alias("alert_id"),
        F.concat(F.lit("A"), (F.col("s") % 8).cast("string")).alias("analyst_id"),
        F.col("first").cast("timestamp").alias("opened_ts"),
        F.col("last").cast("timestamp").alias("closed_ts"),
        F.lit("closed").alias("status"),
        F.col("flag").alias("closure_code"),
        F.col("p_name").alias("notes_text"),
    )


def case_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases' ids and times: no notes, so no join with the parts.  Grouped by the alert's id, by which cases are joined with alerts."""
    times = table(spark, sf_dir, "lineitem").groupBy(_key("O", "l_orderkey").alias("alert_id")).agg(F.min("l_orderkey").alias("k"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    return times.select(_key("K", "k").alias("case_id"), "alert_id", F.col("first").cast("timestamp").alias("opened_ts"), F.col("last").cast("timestamp").alias("closed_ts"))


def workflow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(_key("K", "l_orderkey").alias("case_id"), F.col("l_returnflag").alias("step"), F.lit("analyst").alias("actor_role"), F.col("l_shipdate").cast("timestamp").alias("ts"))


def escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 25")
    return some.select(_key("K", "l_orderkey").alias("case_id"), F.lit("Tier-1").alias("from_tier"), F.lit("Tier-2").alias("to_tier"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.lit("pending").alias("outcome"))


def bundle(spark: SparkSession, sf_dir: str) -> Bundle:
    return Bundle(*(f(spark, sf_dir) for f in (alerts, cases, workflow_events, escalations, assets, entities)))


def dirty_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw alert rows, all strings with a position, a share of which breaks each rule.  Positions follow the order key."""
    k = F.col("o_orderkey")
    raw = alerts(spark, sf_dir).withColumn("k", F.substring("alert_id", 2, 20).cast("long"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    k = F.col("k")
    return raw.select(
        k.alias("row_pos"),
        F.when(k % 101 == 0, F.lit(None)).when(k % 103 == 0, " ").when(k % 50 == 1, F.concat(F.lit("O"), (k % 500).cast("string"))).otherwise(F.col("alert_id")).alias("alert_id"),
        F.when(k % 89 == 0, "N999").otherwise(F.col("entity_id")).alias("entity_id"),
        "asset_id",
        "category",
        F.when(k % 97 == 0, "urgent").when(k % 2 == 0, F.upper("severity")).otherwise(F.col("severity")).alias("severity"),
        F.when(k % 107 == 0, "not a time").otherwise(text(F.col("created_ts"))).alias("created_ts"),
        F.when(k % 109 == 0, text(F.col("created_ts") - F.expr("interval 1 day"))).otherwise(text(F.col("ack_ts"))).alias("ack_ts"),
        F.when(k % 113 == 0, text(F.col("created_ts"))).otherwise(text(F.col("closed_ts"))).alias("closed_ts"),
        "disposition",
    )
