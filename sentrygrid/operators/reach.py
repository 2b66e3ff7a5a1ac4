"""What can be reached in a graph, to any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrygrid.schema import Bundle
from sentrygrid.sources import scratch


def reach(spark: SparkSession, edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(node, hops) of every node that directed edges (u, v) lead to from seeds (node), with the fewest hops.

    Breadth first: each round follows the last round's new nodes only and writes those not seen before beside the others, so that
    the plan is one scan whatever the depth.  Edges may be repeated: new nodes are told apart each round, so all edges need no sort or table of
    their own in memory.  ``most``: rounds, without it until nothing is new."""
    path = scratch.folder(spark, "reach")
    edges = scratch.written(spark, edges.select("u", "v").where("u is not null and v is not null and u <> v"), "edges")
    kind = edges.schema["u"].dataType
    seeds.select(F.col(seeds.columns[0]).cast(kind).alias("node")).where("node is not null").distinct().write.parquet(f"{path}/hops=0")
    at = 0
    read = lambda p: spark.read.schema(f"node {kind.simpleString()}").parquet(p)
    while most is None or at < most:
        seen = spark.read.schema(f"node {kind.simpleString()}, hops int").parquet(path)
        new = read(f"{path}/hops={at}").join(edges, F.col("node") == F.col("u")).select(F.col("v").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        new.write.parquet(f"{path}/hops={at + 1}")
        at += 1
        if read(f"{path}/hops={at}").isEmpty():
            break
    return spark.read.schema(f"node {kind.simpleString()}, hops int").parquet(path)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def investigation_graph(bundle: Bundle) -> DataFrame:
    """Edges among entities, assets, cases and analysts (of an entity), by ids with a prefix."""
    name = lambda kind, *c: F.concat(F.lit(f"{kind}:"), F.concat_ws("/", *c))
    owned = bundle.cases.select("case_id", "alert_id", "analyst_id").join(bundle.alerts.select("alert_id", "entity_id", "asset_id"), "alert_id")
    analyst = name("analyst", "entity_id", "analyst_id")
    parts = [
        bundle.assets.select(name("entity", "entity_id").alias("u"), name("asset", "asset_id").alias("v")),
        owned.select(name("asset", "asset_id").alias("u"), name("case", "case_id").alias("v")),
        owned.where("analyst_id is not null").select(name("case", "case_id").alias("u"), analyst.alias("v")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def successions(alerts: DataFrame, within_days: int = 60) -> DataFrame:
    """Edges from each alert to the next one on its asset, where that comes soon enough: paths as long as the trouble lasts."""
    from pyspark.sql import Window

    order = Window.partitionBy("asset_id").orderBy("created_ts", "alert_id")
    after = alerts.where("asset_id is not null").select(F.col("alert_id").alias("u"), F.lead("alert_id").over(order).alias("v"), (F.unix_micros(F.lead("created_ts").over(order)) - F.unix_micros("created_ts")).alias("gap"))
    return after.where(F.col("gap") <= within_days * 86_400_000_000).select("u", "v")
