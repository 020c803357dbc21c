"""Tables written to the folder that all executors share, to cut lineage and survive lost executors."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: With it, Spark deletes a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a Python worker holds at once; texts are long, and idle workers keep the memory they once took.
_ROWS, ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where a local session names none (tests), one of our own is made and kept in the session."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{_SETTING} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="framewright-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/framewright-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and return a scan of it; the shuffle files it took are deleted, Arrow batches are small."""
    spark = df.sparkSession
    path = new_path(spark, name)
    settings = {_CLEANUP: "true", _ROWS: ROWS_A_BATCH}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`df` in as many partitions as shuffles have, by hash of `keys`: for few rows whose expressions are large, which Spark would put in few tasks by their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def give_back() -> None:
    """In a Python worker at a task's end: memory that is free goes back to the system, as idle workers would keep it beside the next stages' ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` has returned, when all that was computed from them is written too."""
    for df in tables:
        drop(df.sparkSession, df.scratch_path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_all(spark: SparkSession) -> None:
    """Delete every table this application has written here; results that still read them become unreadable."""
    drop(spark, f"{shared_dir(spark)}/framewright-{spark.sparkContext.applicationId}")
