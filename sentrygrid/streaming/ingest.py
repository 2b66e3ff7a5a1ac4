"""Append-only ingest: new files are validated once and added to a Parquet table; bad rows go to quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sentrygrid.operators.quarantine import validate
from sentrygrid.schema import TABLES


def ingest_new(spark: SparkSession, name: str, inbox: str, target: str, aside: str, checkpoint: str) -> StreamingQuery:
    """Process the CSV files that came since the last call, then stop.  Each file is handled exactly once: the
    checkpoint remembers files, and a batch that is tried again overwrites its own folder."""
    schema = T.StructType([T.StructField(f.name, T.StringType()) for f in TABLES[name]])
    rows = spark.readStream.schema(schema).option("header", True).csv(inbox)

    def add(batch: DataFrame, batch_id: int) -> None:
        good, bad = validate(name, batch.withColumn("row_pos", F.monotonically_increasing_id()))
        good.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{aside}/batch={batch_id}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
