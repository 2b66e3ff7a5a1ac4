"""The whole run: ingest, store, detect, weigh, score, queue, compare claims, write, seal."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrygrid.operators import audit, claims, feedback, quarantine, review_queue, scoring
from sentrygrid.operators.detectors import each_detector
from sentrygrid.schema import TABLES, THRESHOLDS
from sentrygrid.sources import scratch, store

ARTIFACTS = ("findings", "scores", "queues", "claims", "claim_index")


def run_all(spark: SparkSession, source: str | dict[str, DataFrame], output: str, budget: int = 50, seed: int = 42, ledger: str | None = None) -> dict[str, DataFrame]:
    """Returns the artifacts as DataFrames over what was written; ``output`` gets the store, the artifacts, the manifest and an audit line."""
    run_id = uuid.uuid4().hex
    raw = store.load_dataset(spark, source, f"{output}/quarantine")
    store.write_store(raw, f"{output}/store")
    bundle = store.load_bundle(spark, f"{output}/store")  # later stages read columns and row groups that they need
    features = f"{output}/features-{run_id}"
    found = each_detector(bundle, keep=features)
    if ledger:
        weights = scratch.written(spark, feedback.weights(spark.read.parquet(ledger)), "weights")
        found = (feedback.apply(part, weights) for part in found)
    scratch.write_parts(found, f"{output}/findings.parquet")
    scratch.remove(spark, features)
    findings = spark.read.parquet(f"{output}/findings.parquet")
    compared = claims.compare(bundle)
    parts = {"scores": scoring.portfolio(spark, findings, bundle), "queues": review_queue.build_queues(findings, bundle.alerts, budget, seed), "claims": compared, "claim_index": claims.claim_index(compared)}
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{output}/{name}.parquet")
    out = {"findings": findings} | {n: spark.read.parquet(f"{output}/{n}.parquet") for n in parts}
    for name, df in out.items():
        store.write_json(df, f"{output}/json/{name}")
    totals = {r["table_name"]: r["rows"] for r in quarantine.counts(bundle).collect()}
    digest = audit.canonical_hash({n: df.agg(F.sum(F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)"))).first()[0] for n, df in out.items()})
    config, versions = {"budget": budget, "seed": seed, **asdict(THRESHOLDS)}, {"spark": pyspark.__version__}
    inputs = {n: found[1] for n in TABLES if isinstance(source, str) and (found := store.resolve(spark, source, n))}
    outputs = {n: f"{output}/{n}.parquet" for n in out}
    local = output.removeprefix("file://")
    if "://" not in local:
        bare = lambda paths: {n: p.removeprefix("file://") for n, p in paths.items()}
        sealed = audit.manifest(run_id, config, bare(inputs), bare(outputs), totals, versions)
        Path(f"{local}/manifest.json").write_text(json.dumps(sealed, indent=2, sort_keys=True))
        audit.append_entry(f"{local}/audit.jsonl", "run", run_id, sealed["manifest_hash"])
    else:  # hashed by tasks, and an entry in a log that several runs may share
        sealed = audit.shared_manifest(spark, run_id, config, inputs, outputs, totals, versions)
        scratch.put_if_absent(spark, f"{output}/manifest-{run_id}.json", json.dumps(sealed, indent=2, sort_keys=True))
        audit.append_shared(spark, f"{output}/audit", "run", run_id, sealed["manifest_hash"])
    out["summary"] = spark.createDataFrame([(run_id, digest, pyspark.__version__, str(totals))], "run_id string, data_hash string, spark string, rows string")
    return out
