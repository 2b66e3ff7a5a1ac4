"""Weights kept up to date: batches of decisions are merged into stored maps, and only the parts that they touch are written anew.

A state lies in a folder: ``data/`` holds written parts, ``versions/`` a small file a version that names the current folder of each
part and the last decision that is in it.  A version is created if it is absent, so readers see all of a batch or nothing, and of
two writers one has to merge again on top of the other.  Decisions up to the last one are skipped: a batch that is merged twice
counts once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrygrid.operators.feedback import composed, factors, pair_maps
from sentrygrid.sources import scratch

PARTS = 32
STATE = "entity_id string, detector_id string, map array<int>, n int, updated_at string"


def current(spark: SparkSession, path: str) -> dict:
    """The last version: its number, the folders of its parts, the last decision and the number of parts."""
    found = [n for n in scratch.names(spark, f"{path}/versions") if n.endswith(".json")]
    if not found:
        return {"version": 0, "folders": {}, "last": None, "parts": PARTS}
    return json.loads(scratch.read_text(spark, f"{path}/versions/{found[-1]}"))


def _maps(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema(STATE).parquet(*folders) if folders else spark.createDataFrame([], STATE)


def merge(spark: SparkSession, path: str, batch: DataFrame, tries: int = 10) -> int:
    """Merge decisions, all later by id than those merged before or among these; returns the version that holds them."""
    for _ in range(tries):
        base = current(spark, path)
        fresh = batch if base["last"] is None else batch.where(F.col("feedback_id") > base["last"])
        last = fresh.agg(F.max("feedback_id")).first()[0]
        if last is None:
            return base["version"]
        part = F.pmod(F.xxhash64("entity_id", "detector_id"), F.lit(base["parts"])).cast("int")
        new = scratch.written(spark, pair_maps(fresh).withColumn("part", part), "maps")
        touched = [str(r["part"]) for r in new.select("part").distinct().collect()]  # at most ``parts`` numbers
        old = _maps(spark, [base["folders"][t] for t in touched if t in base["folders"]])
        both = old.withColumn("slice", F.lit(0)).unionByName(new.drop("part").withColumn("slice", F.lit(1)))
        folder = f"{path}/data/{uuid.uuid4().hex}"
        composed(both).withColumn("part", part).repartition("part").write.partitionBy("part").parquet(folder)
        then = {"version": base["version"] + 1, "folders": base["folders"] | {t: f"{folder}/part={t}" for t in touched}, "last": last, "parts": base["parts"]}
        if scratch.put_if_absent(spark, f"{path}/versions/{then['version']:08d}.json", json.dumps(then, sort_keys=True)):
            return then["version"]
        scratch.remove(spark, folder)  # another writer was first
    raise RuntimeError("the state changed too often")


def weights(spark: SparkSession, path: str) -> DataFrame:
    """The same rows as ``feedback.weights`` over all decisions that were merged."""
    return factors(_maps(spark, list(current(spark, path)["folders"].values())))
