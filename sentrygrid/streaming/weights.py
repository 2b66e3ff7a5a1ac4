"""Feedback weights from a stream of decisions: each closed span of time becomes one map a pair, and the maps compose to the weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sentrygrid.operators.feedback import as_map, composed, factors, in_order
from sentrygrid.sources import scratch

MAPS = "entity_id string, detector_id string, slice long, map array<int>, n int, updated_at string"


def maps(decisions: DataFrame, span: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """A map for each pair and span, once the watermark is past the span's end.

    State holds the decisions of open spans only, so a pair with a third of all decisions holds no more than it gets in
    ``span`` and ``late``.  Ids must ascend from span to span; within a span they may come in any order.  Decisions that come
    more than ``late`` behind the newest one, after their span was closed, are left out, as are those without a readable ``created_at``."""
    at = decisions.withColumn("at", F.expr("try_cast(created_at AS timestamp)")).where("at is not null").withWatermark("at", late)
    spans = at.groupBy(F.window("at", span).alias("w"), "entity_id", "detector_id").agg(*in_order())
    return spans.select("entity_id", "detector_id", F.unix_micros("w.start").alias("slice"), as_map().alias("map"), F.size("events").alias("n"), "updated_at")


def _put(batch: DataFrame, folder: str) -> None:
    batch.write.mode("overwrite").parquet(folder)


def run(decisions: DataFrame, target: str, checkpoint: str, span: str = "1 hour", late: str = "1 hour") -> StreamingQuery:
    """Handle what has come since the last call, then stop.  State and offsets are in the checkpoint, and a batch that is
    tried again overwrites its own folder, so a stop at any point counts every decision once."""
    out = maps(decisions, span, late).writeStream.outputMode("append").foreachBatch(lambda batch, i: _put(batch, f"{target}/batch={i}"))
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weights(spark: SparkSession, target: str) -> DataFrame:
    """The rows of ``feedback.weights`` over the decisions of all closed spans."""
    folders = [f"{target}/{n}" for n in scratch.names(spark, target) if n.startswith("batch=")]
    found = spark.read.schema(MAPS).parquet(*folders) if folders else spark.createDataFrame([], MAPS)
    return factors(composed(found))
