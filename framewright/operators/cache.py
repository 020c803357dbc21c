"""A table of costly features that grows by what is new: keyed by content, with a list of complete runs that is swapped last."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, through Hadoop's file system; none if it isn't there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []


def runs(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """(version, complete runs) of the newest list that was written whole; (0, []) for a new table."""
    versions = sorted(int(n[2:]) for n in _names(spark, f"{path}/runs") if n.startswith("v=") and n[2:].isdigit())
    for v in reversed(versions):
        if "_SUCCESS" in _names(spark, f"{path}/runs/v={v}"):
            return v, sorted(r.run for r in spark.read.schema("run string").parquet(f"{path}/runs/v={v}").collect())  # one row a run
    return 0, []


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """All features of complete runs; None for a new table. What a failed run has left is not read."""
    _, complete = runs(spark, path)
    return spark.read.parquet(*[f"{path}/data/run={r}" for r in complete]) if complete else None


def digest(columns: list[str]):
    """The key of a row: equal columns, nulls included, have equal keys."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(f"c{i}") for i, c in enumerate(columns)])), 256)


def refreshed(rows: DataFrame, columns: list[str], path: str, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`rows` with the features of their `columns`, of which only those that `path` has not are encoded and added to it.

    `encode` gets distinct rows of `columns` and `digest` and returns a row for each with `digest`, its features, and none of `columns`.
    New features become readable by one step at the end: until then, and if the run fails, the table stays what it was.
    Repeated rows are encoded once. One writer at a time is expected.
    """
    spark = rows.sparkSession
    version, complete = runs(spark, path)
    there = read(spark, path)
    asked = rows.select(*columns, digest(columns).alias("digest")).dropDuplicates(["digest"])
    new = asked if there is None else asked.join(there.select("digest"), "digest", "left_anti")
    run = uuid.uuid4().hex
    encode(new).write.parquet(f"{path}/data/run={run}")
    if not spark.read.parquet(f"{path}/data/run={run}").isEmpty() or not complete:
        spark.createDataFrame([(r,) for r in [*complete, run]], "run string").coalesce(1).write.parquet(f"{path}/runs/v={version + 1}")
    features = read(spark, path)
    return rows.withColumn("digest", digest(columns)).join(features, "digest").drop("digest")
