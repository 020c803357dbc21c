"""Sharding by longest-processing-time scheduling.

Groups of equal texts stay together. Groups go, largest first, to the least-loaded shard, through a heap. The schedule
needs only how many groups there are of each size, so the driver sees one row for each distinct group size (at most
sqrt(2 * total bytes) of them, and one more for every 131,072 groups of a size), never a row for each group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright import scratch

GROUPS_A_RUN = 1 << 17
ROWS_A_BUCKET = 1 << 16


def spread_run(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` groups of `size` each shard gets from the heap; ties go to the lower shard. `loads` is updated."""
    got = [0] * len(loads)
    if count <= 8 * len(loads):
        heap = [(load, i) for i, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            load, i = heap[0]
            heapq.heapreplace(heap, (load + size, i))
            got[i] += 1
    else:
        # The heap takes the `count` smallest of load + j * size; find the level below which all of them lie.
        taken = lambda level: [max(0, (level - load) // size + 1) for load in loads]
        low, high = min(loads) - 1, max(loads) + size * count
        while high - low > 1:
            mid = (low + high) // 2
            if sum(taken(mid)) <= count:
                low = mid
            else:
                high = mid
        got = taken(low)
        rest = count - sum(got)
        for i, load in enumerate(loads):
            if rest and load + got[i] * size == high:
                got[i] += 1
                rest -= 1
    for i, n in enumerate(got):
        loads[i] += n * size
    return got


def schedule(runs: Iterable[tuple[int, int, int]], n_shards: int) -> Iterator[tuple[int, int, list[int]]]:
    """For (group size, run, count) in descending size: the same with the rank, in its run, at which each shard's share ends."""
    loads = [0] * n_shards
    for size, run, count in runs:
        ends, at = [], 0
        for n in spread_run(loads, size, count):
            at += n
            ends.append(at)
        yield size, run, ends


def shard_by_size(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """All rows of `docs` (doc_id, text) with a shard each, so that equal texts share a shard and shards hold nearly equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32 (unsigned), law ('bytes'), shard, slot (gapless from
    0 in each shard, in order of doc_id) and grown_shard (null: the law is not about growth).

    Null and empty texts are one group of size 1 a row with crc 0. Repeated rows keep a row and slot each. Very long texts
    count as what they are. An empty table gives an empty result. Columns besides doc_id and text are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = scratch.written(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("key")),
        "shard-rows",
    )
    groups = rows.groupBy("key").agg((F.max("size") * F.count(F.lit(1))).alias("total"))
    groups = scratch.written(groups, "shard-groups")
    runs_of = F.broadcast(sizes) if (sizes := groups.groupBy("total").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUPS_A_RUN)).count() < 10_000 else sizes
    run = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / GROUPS_A_RUN)))
    groups = groups.join(runs_of, "total", "left").withColumn("run", run.cast("long"))
    counted = groups.groupBy("total", "run").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("total"), "run")
    plan = pd.DataFrame(schedule(((r.total, r.run, r.n) for r in counted.toLocalIterator()), n_shards), columns=["total", "run", "ends"])
    plan = spark.createDataFrame(plan, "total long, run long, ends array<long>")
    ranked = groups.withColumn("rank", F.row_number().over(W.partitionBy("total", "run").orderBy("key")) - 1)
    placed = ranked.join(plan, ["total", "run"]).select("key", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"))
    rows = rows.join(placed, "key").drop("key")
    return with_slots(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in many tasks a shard: ranks in hashed buckets plus the rows of the buckets before."""
    rows = scratch.written(rows, "shard-placed")
    buckets = rows.count() // ROWS_A_BUCKET + 1
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    sums = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1)
    return ranked.join(before, ["shard", "bucket"]).withColumn("slot", (F.col("rank") + F.col("before")).cast("long"))
