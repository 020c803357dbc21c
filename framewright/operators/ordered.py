"""Running numbers over a whole ordered table by two levels: ranges of the order, and totals of the ranges; no window over all rows.

The rows are dealt out by ranges and written once, so that a retried task finds the same ranges. Only a number or two for each range
comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright import scratch

#: Ranges, where none are asked for, by Spark's number of shuffle partitions, this many at most.
MOST = 10_000


def ranged(rows: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """`rows` with `part`, the number of their range of `order` (nulls first), written in a folder for each range.

    Rows of one place in the order share a range: with an order that is unique no range is large.
    """
    spark = rows.sparkSession
    parts = parts or min(MOST, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = scratch.new_path(spark, "ranged")
    dealt = rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    dealt.write.partitionBy("part").parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def _starts(table: DataFrame, value: str) -> list[tuple]:
    """(part, rows before, sum of value before, rows, sum) of each range, in order."""
    out, n, total = [], 0, 0
    for r in table.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s")).orderBy("part").collect():
        out.append((r.part, n, total, r.n, r.s))
        n, total = n + r.n, total + r.s
    return out


def running(rows: DataFrame, order: list[str], value=None, parts: int | None = None) -> DataFrame:
    """Adds `index` (from 0) and `before`, the sum of `value` (a long column; by default 1) over all rows before, in `order`.

    The order should be unique: equal rows get different numbers in no fixed order. Nulls in `value` count as 0; an empty table gives none.
    """
    table = ranged(rows.withColumn("_value", F.coalesce(value.cast("long"), F.lit(0).cast("long")) if value is not None else F.lit(1).cast("long")), order, parts)
    return _numbered(table, _starts(table, "_value"), order).select(*rows.columns, "index", "before")


def _numbered(table: DataFrame, starts: list[tuple], order: list[str]) -> DataFrame:
    offsets = table.sparkSession.createDataFrame([s[:3] for s in starts], "part int, _rows long, _sum long")
    own = W.partitionBy("part").orderBy(*order)
    local = table.withColumn("_n", F.row_number().over(own) - 1).withColumn("_s", F.coalesce(F.sum("_value").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # A row for each range.
    placed = local.join(F.broadcast(offsets), "part")
    return placed.withColumn("index", F.col("_rows") + F.col("_n")).withColumn("before", F.col("_sum") + F.col("_s"))


def until_full(rows: DataFrame, order: list[str], size: int, limit: int, parts: int | None = None) -> DataFrame:
    """Rows in `order` up to and with the first at which the sum of the column `size` is above `limit`; -1 keeps all.

    Of the ranges behind that row none is read again; a window runs in its range alone. Nulls in `size` count as 0.
    """
    if limit == -1:
        return rows
    table = ranged(rows.withColumn("_value", F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long"))), order, parts)
    starts = _starts(table, "_value")
    edge = next((s for s in starts if s[2] + s[4] > limit), None)
    if edge is None:
        return table.select(rows.columns)
    whole = table.filter(F.col("part") < edge[0]).select(rows.columns)
    last = _numbered(table.filter(F.col("part") == edge[0]), [edge], order).filter(F.col("before") <= limit)
    return whole.unionByName(last.select(rows.columns))


def ranks(rows: DataFrame, order: list[str], replicas: int, parts: int | None = None) -> DataFrame:
    """Adds `rank` (0 to replicas - 1) and `place`: contiguous parts of the order, all of one size.

    Rows are repeated for that, behind the last one, from the first on (from the second, if the number of rows is odd). An empty table gives none.
    """
    table = running(rows, order, parts=parts).drop("before")
    table = scratch.written(table, "ranks")
    n = table.count()
    if not n:
        return table.withColumnRenamed("index", "place").withColumn("rank", F.lit(0).cast("int")).limit(0)
    size = -(-n // replicas)
    extra, odd = size * replicas - n, n % 2
    # With fewer rows than replicas the repeats run out, as the slice of the sampler does; the first rows then come again.
    again = F.filter(F.transform(F.sequence(F.lit(0), F.lit(extra // n + 1)), lambda k: n + F.col("index") - odd + k * n), lambda p: (p >= n) & (p < n + extra))
    places = table.withColumn("place", F.explode(F.concat(F.array("index"), again))) if extra else table.withColumn("place", F.col("index"))
    return places.drop("index").withColumn("rank", F.floor(F.col("place") / size).cast("int"))
