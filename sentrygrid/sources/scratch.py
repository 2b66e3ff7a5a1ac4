"""Tables and small files in folders that all executors share."""

from __future__ import annotations

import atexit
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def root(spark: SparkSession) -> str:
    """The session's folder: below ``spark.checkpoint.dir``, or a temporary one where that is unset and all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    out = f"{base.rstrip('/')}/sentrygrid-{spark.sparkContext.applicationId}"
    if out not in _known:
        _known.add(out)
        atexit.register(_forget, spark, out)
    return out


_known: set[str] = set()


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may already be gone at interpreter exit; the folder then outlives it
        pass


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder's name."""
    return f"{root(spark)}/{tag}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to a folder of its own and read back: cuts lineage and survives lost executors."""
    path = folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, sorted; nothing where it does not exist."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, sizes and times of files, and of the files in folders: it changes when a table is written anew."""
    found, todo = [], list(paths)
    while todo:
        fs, p = _fs(spark, todo.pop())
        for s in fs.listStatus(p) if fs.exists(p) else ():
            if s.isDirectory():
                todo.append(s.getPath().toString())
            else:
                found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()[:24]


def write_parts(parts: Iterable[DataFrame], path: str) -> None:
    """A table that is made in parts, each written by a query of its own before the next one is made."""
    for i, df in enumerate(parts):
        df.write.mode("append" if i else "overwrite").parquet(path)


def kept_as(spark: SparkSession, name: str, make: Callable[[], DataFrame | Iterable[DataFrame]], schema: StructType) -> DataFrame:
    """A table of the session under a name of its own: written when it is first asked for, whole or not at all, and read from then on.
    ``make`` returns it, or its parts."""
    path = f"{root(spark)}/{name}"
    fs, p = _fs(spark, f"{path}/_WHOLE")
    if not fs.exists(p):
        made = make()
        write_parts([made] if isinstance(made, DataFrame) else made, path)
        fs.create(p).close()
    return spark.read.schema(schema).parquet(path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file whole, or leave the one that is there: of two writers, one gets True.

    A finished temporary file is linked (local files) or renamed without overwriting (other file systems, atomic where
    their rename is, as in HDFS)."""
    fs, p = _fs(spark, path)
    tmp = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    _, t = _fs(spark, tmp)
    stream = fs.create(t, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.getScheme() == "file":
        local = lambda x: x.toUri().getPath()
        try:
            os.link(local(t), local(p))
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(t, False)
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(t, p, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        fs.delete(t, False)
        return False
