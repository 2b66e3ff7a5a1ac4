"""Shared helpers: scratch tables in the cluster's shared folder, text columns, Arrow text buffers."""

from __future__ import annotations

import atexit
import math
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The whitespace of all the text contracts: space, tab, LF, VT, FF, CR.
WS_CLASS = r"[\x20\x09-\x0D]"
#: Rows that one bucket of a two-level numbering holds on average.
ROWS_PER_BUCKET = 50_000
#: Parts that a join splits the rows of one key into.
SALTS = 16


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one where that is unset and all tasks run on this machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/sentrygrid-{spark.sparkContext.applicationId}"


def _drop_scratch(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may already be gone at interpreter exit; the folder then outlives it
        pass


_registered: set[str] = set()


def materialize(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    root = scratch_root(spark)
    if root not in _registered:
        _registered.add(root)
        atexit.register(_drop_scratch, spark, root)
    path = f"{root}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more; other tables stay."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            _drop_scratch(spark, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_col(df: DataFrame, name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def id_text(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Only ``doc_id`` and the text: extra columns, whatever their names, never meet the operators' own."""
    return df.select(df[doc_id].cast("long").alias("doc_id"), text_col(df, text).alias("text"))


def row_key(doc_id: Column, text: Column) -> Column:
    """A key that rows share only if they repeat id and text: the id with a hash of the text, safe at any number of rows."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.xxhash64(text).cast("string"))


def buckets_for(rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
    return max(1, math.ceil(rows / per_bucket))


def hash_bucket(n: int, *cols: Column | str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """``left`` joined with a ``right`` of distinct keys; a key's rows are spread over ``SALTS`` tasks by a hash of ``by``."""
    spread = left.withColumn("__salt", hash_bucket(SALTS, by))
    copied = right.withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return spread.join(copied, [*keys, "__salt"], how).drop("__salt")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as its UTF-8 bytes and the n + 1 offsets into them, without a copy per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20):
    """Cut a batch into runs of rows whose text stays near ``most_bytes``, so that memory is bounded by the longest row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def shared_file(path: str) -> str:
    """A file that every worker is expected to have (the tokenizers' package data)."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path
