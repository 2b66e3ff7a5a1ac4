"""Run manifests and a hash-chained audit trail, on local files or on any file system that Spark reads."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrygrid.sources import scratch

GENESIS = "0" * 64
FIELDS = ("entry_id", "timestamp", "event_type", "run_id", "data_hash", "prev_hash")


def canonical_hash(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def file_hash(path: str | Path, chunk: int = 1 << 16) -> str:
    """SHA-256 of a file, or of the names and hashes of a folder's data files."""
    path = Path(path)
    if path.is_dir():
        return canonical_hash({str(p.relative_to(path)): file_hash(p) for p in sorted(path.rglob("*")) if p.is_file() and not p.name.startswith((".", "_"))})
    digest = hashlib.sha256()
    with path.open("rb") as f:
        while block := f.read(chunk):
            digest.update(block)
    return digest.hexdigest()


def manifest(run_id: str, config: dict, inputs: dict[str, str], outputs: dict[str, str], summary: dict, versions: dict[str, str]) -> dict:
    """Inputs are hashed whatever their format is."""
    body = {"run_id": run_id, "created_at": datetime.now(UTC).isoformat(), "config_hash": canonical_hash(config), "inputs": {k: file_hash(p) for k, p in inputs.items()}, "outputs": {k: file_hash(p) for k, p in outputs.items()}, "versions": versions, "summary": summary}
    return body | {"manifest_hash": canonical_hash(body)}


def entry_hash(entry: dict) -> str:
    return hashlib.sha256("|".join(str(entry[f]) for f in FIELDS).encode()).hexdigest()


def append_entry(path: str | Path, event_type: str, run_id: str, data_hash: str, timestamp: str | None = None) -> dict:
    """Append one line; one writer at a time."""
    path = Path(path)
    lines = path.read_text().splitlines() if path.exists() else []
    last = json.loads(lines[-1]) if lines else {"entry_id": 0, "entry_hash": GENESIS}
    entry = {"entry_id": last["entry_id"] + 1, "timestamp": timestamp or datetime.now(UTC).isoformat(), "event_type": event_type, "run_id": run_id, "data_hash": data_hash, "prev_hash": last["entry_hash"]}
    entry["entry_hash"] = entry_hash(entry)
    with path.open("a") as f:
        f.write(json.dumps(entry) + "\n")
    return entry


# ---------------------------------------------------------------- any file system
#: Bytes of a block of the hash tree.
BLOCK = 1 << 20


def file_hashes(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(name, size, hash) of the data files of a folder or of a file: tasks hash each file's blocks, and a file's hash is that of its blocks'.

    A file is one row, so it may have up to two gigabytes; tables are written in smaller ones.  Empty files, which Spark does not
    read, are left out, and so are hidden ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = path.rstrip("/").rpartition("/")[2]
    name = F.concat(F.lit(base), F.substring_index("path", f"/{base}", -1))
    hidden = F.exists(F.split(name, "/"), lambda part: part.startswith(".") | part.startswith("_"))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("length") / block).cast("int") - 1, F.lit(0)))
    blocks = F.transform(starts, lambda i: F.sha2(F.substring("content", i * block + 1, F.lit(block)), 256))
    return files.where(~hidden).select(name.alias("name"), F.col("length").alias("size"), F.sha2(F.array_join(blocks, ""), 256).alias("hash"))


def tree_hash(hashes: DataFrame) -> str:
    """One hash over all files: names and hashes are hashed by bucket of the name, and the buckets in order."""
    line = F.concat_ws(":", "name", F.col("size").cast("string"), "hash")
    bucket = F.substring(F.sha2("name", 256), 1, 2)
    parts = hashes.groupBy(bucket.alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("hash"))
    rows = sorted((r["bucket"], r["hash"]) for r in parts.collect())  # at most 256
    return hashlib.sha256("".join(h for _, h in rows).encode()).hexdigest()


def shared_manifest(spark: SparkSession, run_id: str, config: dict, inputs: dict[str, str], outputs: dict[str, str], summary: dict, versions: dict[str, str]) -> dict:
    """``manifest`` with hash trees, whatever file system the data lies on."""
    root = lambda paths: {k: tree_hash(file_hashes(spark, p)) for k, p in paths.items()}
    body = {"run_id": run_id, "created_at": datetime.now(UTC).isoformat(), "config_hash": canonical_hash(config), "inputs": root(inputs), "outputs": root(outputs), "versions": versions, "summary": summary}
    return body | {"manifest_hash": canonical_hash(body)}


ENTRY = "entry_id long, timestamp string, event_type string, run_id string, data_hash string, prev_hash string, entry_hash string"


def append_shared(spark: SparkSession, folder: str, event_type: str, run_id: str, data_hash: str, timestamp: str | None = None, tries: int = 100) -> dict:
    """Append an entry as a file of its own that is created if it is absent: a writer who loses a race links to the winner's entry and tries again."""
    for _ in range(tries):
        there = [n for n in scratch.names(spark, folder) if n.endswith(".json")]
        last = json.loads(scratch.read_text(spark, f"{folder}/{there[-1]}")) if there else {"entry_id": 0, "entry_hash": GENESIS}
        entry = {"entry_id": last["entry_id"] + 1, "timestamp": timestamp or datetime.now(UTC).isoformat(), "event_type": event_type, "run_id": run_id, "data_hash": data_hash, "prev_hash": last["entry_hash"]}
        entry["entry_hash"] = entry_hash(entry)
        if scratch.put_if_absent(spark, f"{folder}/{entry['entry_id']:012d}.json", json.dumps(entry)):
            return entry
    raise RuntimeError("the log changed too often")


def entries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ENTRY).json(folder)


# ---------------------------------------------------------------- verification
def verify(entries: DataFrame) -> DataFrame:
    """Each entry with whether it links to the one before and whether its own hash holds: every entry looks up its predecessor by number."""
    prior = entries.select((F.col("entry_id") + 1).alias("entry_id"), F.col("entry_hash").alias("__before"))
    entries = entries.join(prior, "entry_id", "left")
    before = F.when(F.col("entry_id") == 1, GENESIS).otherwise(F.col("__before"))
    own = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in FIELDS]), 256)
    return entries.withColumn("link_ok", F.coalesce(F.col("prev_hash") == before, F.lit(False))).withColumn("hash_ok", F.col("entry_hash") == own).drop("__before")


def verdict(checked: DataFrame) -> DataFrame:
    broken = F.when(~F.col("link_ok"), F.concat(F.lit("entry "), F.col("entry_id").cast("string"), F.lit(": broken link"))), F.when(~F.col("hash_ok"), F.concat(F.lit("entry "), F.col("entry_id").cast("string"), F.lit(": altered")))
    return checked.agg(F.count("*").alias("entries"), (F.count_if(~F.col("link_ok") | ~F.col("hash_ok")) == 0).alias("valid"), F.flatten(F.array_sort(F.collect_list(F.array_compact(F.array(*broken))))).alias("errors"))
