"""Hard-negative mining: exact top rows by whole inner products, most pairs discarded by a bound in a rotated space.

Queries (anchors) are worked in blocks of bounded size, against all rows, in two passes: positives, then negatives in the range
that each positive allows. Within a task, rows and anchors are rotated onto the principal axes. The product over the leading
axes, plus the product of what is left of both norms, plus slack for rounding, bounds the true one; pairs that can't reach
an anchor's present threshold go, after LEADS[0] and again after LEADS[1] of the axes, and those left are verified by whole products.
The rotation only steers what is discarded; results are exact under any. Each task gives a bounded list for each
anchor, merged by a grouped shuffle. Only a block's anchors and positives come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright import scratch
from framewright.llm.vectors import dimension, matrix, usable, whole

SCALE = 256
#: Expected anchors in a block; pairs looked at in one step; pairs verified at once.
BLOCK, STEP, VERIFIED = 4096, 1 << 20, 1 << 17
#: Shares of the axes after which the bound is tried.
LEADS = 0.25, 0.5
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95


class Top:
    """The first `k` (score descending, vec_id, row) of each key."""

    def __init__(self, keys: int, k: int):
        self.k, self.floor = k, np.full(keys, -np.inf)
        self.rows = np.empty((0, 4), np.int64)

    def add(self, key: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        if not len(key):
            return
        both = np.concatenate([self.rows, np.stack([key, score, vec_id, row], 1)])
        both = both[np.lexsort((both[:, 3], both[:, 2], -both[:, 1], both[:, 0]))]
        start = np.r_[True, both[1:, 0] != both[:-1, 0]]
        place = np.arange(len(both)) - np.maximum.accumulate(np.where(start, np.arange(len(both)), 0))
        self.rows = both[place < self.k]
        last = both[place == self.k - 1]
        self.floor[last[:, 0]] = np.maximum(self.floor[last[:, 0]], np.nextafter(last[:, 1].astype(float), -np.inf))


def rotation(rows: DataFrame, dims: int) -> np.ndarray:
    """Principal axes of the rows, by falling variance; dims * dims sums come to the driver."""

    def moments(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            x = matrix(batch, "v", dims).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(dims), pa.int32()), "sums": pa.array(list(total), pa.list_(pa.float64()))})

    each = rows.select("v").mapInArrow(moments, "i int, sums array<double>").select("i", F.posexplode("sums").alias("j", "s"))
    total = np.zeros((dims, dims))
    for r in each.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r.i, r.j] = r.s
    return np.ascontiguousarray(np.linalg.eigh((total + total.T) / 2)[1][:, ::-1])


class Rotated:
    """Whole vectors, rotated, with their norms and what is left of the norm behind each lead."""

    def __init__(self, x: np.ndarray, axes: np.ndarray):
        dims = x.shape[1]
        self.x, self.y, self.leads = x, x.astype(float) @ axes, [max(1, round(dims * share)) for share in LEADS]
        tail = np.cumsum((self.y**2)[:, ::-1], axis=1)[:, ::-1]
        rest = lambda m: np.sqrt(tail[:, m]) if m < dims else np.zeros(len(x))
        self.rests, self.norm = [rest(m) for m in self.leads], np.sqrt((x.astype(float) ** 2).sum(1))


def slack(axes: np.ndarray) -> float:
    """How far, as a share of both norms, a bound may be off: by rounding, and by axes that are not quite orthogonal."""
    dims = len(axes)
    return 2 * float(np.abs(axes.T @ axes - np.eye(dims)).sum()) + 16 * dims**1.5 * np.finfo(float).eps


def verified(a: Rotated, b: Rotated, pairs: np.ndarray, lead: np.ndarray, share: float, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (row of a, row of b) with their products over the first lead, those that may lie in low..high of their b, and whole products."""
    found = []
    m, n = a.leads
    for at in range(0, len(pairs), VERIFIED):
        i, j = pairs[at : at + VERIFIED].T
        upto = lead[at : at + VERIFIED] + np.einsum("ij,ij->i", a.y[i, m:n], b.y[j, m:n])
        room = a.rests[1][i] * b.rests[1][j] + share * a.norm[i] * b.norm[j]
        ok = (upto + room >= low[j]) & (upto - room <= high[j])
        i, j = i[ok], j[ok]
        found.append((i, j, np.einsum("ij,ij->i", a.x[i], b.x[j])))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3))


def _records(top: Top) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(top.rows[:, k]) for k in range(4)], ["key", "score", "vec_id", "row"])


FOUND = "key long, score long, vec_id long, row long"


def _merged(rows: DataFrame, k: int) -> DataFrame:
    """The first `k` of each key over all tasks, with their rank."""
    order = W.partitionBy("key").orderBy(F.desc("score"), "vec_id", "row")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _positives(rows: DataFrame, shared, dims: int, k: int) -> DataFrame:
    """Of each anchor (key: its place in the block) the first `k` other rows of its label."""

    def task(batches):
        block = shared.value
        anchors, labels, own_rows, axes = Rotated(block["x"], block["axes"]), block["labels"], block["rows"], block["axes"]
        share, top = slack(axes), Top(len(labels), k)
        by_label = {int(v): np.nonzero(labels == v)[0] for v in np.unique(labels)}
        for batch in batches:
            x, label, vec_id, row = matrix(batch, "v", dims), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "vec_id", "row"))
            order = np.argsort(label, kind="stable")
            for own in np.split(order, np.nonzero(np.diff(label[order]))[0] + 1):
                j = by_label.get(int(label[own[0]])) if len(own) else None
                if j is None:
                    continue
                size = max(1, STEP // len(j))
                for part in (own[at : at + size] for at in range(0, len(own), size)):
                    a, b = Rotated(x[part], axes), j
                    lead = a.y[:, : a.leads[0]] @ anchors.y[b, : a.leads[0]].T
                    room = np.outer(a.rests[0], anchors.rests[0][b]) + share * np.outer(a.norm, anchors.norm[b])
                    same = row[part][:, None] == own_rows[b][None, :]
                    if len(part) > k:  # k of the rows reach their lower bounds, and so does the k-th best
                        low = np.where(same, -np.inf, lead - room)
                        top.floor[b] = np.maximum(top.floor[b], np.partition(low, len(part) - k, axis=0)[len(part) - k])
                    pairs = np.argwhere(~same & (lead + room >= top.floor[b][None, :]))
                    lead = lead[pairs[:, 0], pairs[:, 1]]
                    pairs[:, 1] = b[pairs[:, 1]]
                    i, j2, score = verified(a, anchors, pairs, lead, share, top.floor, np.full(len(labels), np.inf))
                    top.add(j2, score, vec_id[part][i], row[part][i])
        yield _records(top)

    return _merged(rows.mapInArrow(task, FOUND), k)


def _negatives(rows: DataFrame, shared, dims: int, k: int) -> DataFrame:
    """Of each (anchor, positive) (key: its place in the block's list) the first `k` rows of other labels within its range."""

    def task(batches):
        block = shared.value
        axes, anchors, labels = block["axes"], Rotated(block["x"], block["axes"]), block["labels"]
        anchor, least, most = block["anchor"], block["least"], block["most"]  # of each key; keys ascend by anchor
        share, top, n = slack(axes), Top(len(anchor), k), len(labels)
        starts, counts = np.searchsorted(anchor, np.arange(n)), np.bincount(anchor, minlength=n)
        used = np.nonzero(counts)[0]
        high = np.full(n, -np.inf)
        high[used] = np.maximum.reduceat(most.astype(float), starts[used])
        high = np.nextafter(high, np.inf)
        floor = np.nextafter(least.astype(float), -np.inf)
        size = max(1, STEP // max(1, len(used)))
        for batch in batches if len(used) else ():
            whole_x, label, vec_id, row = matrix(batch, "v", dims), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "vec_id", "row"))
            for at in range(0, len(whole_x), size):
                part = slice(at, at + size)
                a = Rotated(whole_x[part], axes)
                low = np.full(n, np.inf)
                low[used] = np.minimum.reduceat(np.maximum(floor, top.floor), starts[used])
                lead = a.y[:, : a.leads[0]] @ anchors.y[used, : a.leads[0]].T
                room = np.outer(a.rests[0], anchors.rests[0][used]) + share * np.outer(a.norm, anchors.norm[used])
                pairs = np.argwhere((label[part][:, None] != labels[used][None, :]) & (lead + room >= low[used]) & (lead - room <= high[used]))
                lead = lead[pairs[:, 0], pairs[:, 1]]
                pairs[:, 1] = used[pairs[:, 1]]
                i, j, score = verified(a, anchors, pairs, lead, share, low, high)
                for nth in range(int(counts.max())):
                    has = counts[j] > nth
                    key = starts[j[has]] + nth
                    ok = (score[has] >= least[key]) & (score[has] <= most[key])
                    top.add(key[ok], score[has][ok], vec_id[part][i[has][ok]], row[part][i[has][ok]])
        yield _records(top)

    return _merged(rows.mapInArrow(task, FOUND), k)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """For each anchor and each of its POSITIVES first positives the NEGATIVES first rows of other labels whose score is LOW to HIGH percent of the positive's.

    Scores are inner products of the vectors as whole numbers; higher ones come first, ties by smaller vec_id. Rows with a null id or
    label, or a vector that is null, empty or has a null or non-finite component, take no part, nor do vectors of another length
    than that with the smallest id. Repeated rows count as rows of their own: each is an anchor, and a positive of the others. Anchors
    without positives, and positives without negatives in range, give no row. An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = vectors.filter(usable(F.col(vector))).select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), is_anchor.alias("is_anchor"), whole(F.col(vector), SCALE).alias("v"))
    kept = kept.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    # Row numbers are fixed by being written.
    rows = scratch.written(kept.withColumn("row", F.monotonically_increasing_id()), "negatives-vectors")
    dims = dimension(rows, "vec_id", "v")
    rows = rows.filter(F.size("v") == dims)
    anchors = rows.filter("is_anchor")
    n = anchors.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    axes, path, blocks = rotation(rows, dims), scratch.new_path(spark, "negatives"), -(-n // block)
    for b in range(blocks):
        own = anchors.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "vec_id", "label", "v").orderBy("row").collect()
        if own:
            _mine_block(rows, own, axes, dims, f"{path}/block={b}")
    return spark.read.schema(RESULT).parquet(path).select(*[c.split()[0] for c in RESULT.split(", ")])


def _mine_block(rows: DataFrame, own: list, axes: np.ndarray, dims: int, path: str) -> None:
    spark = rows.sparkSession
    block = {"x": np.array([r.v for r in own], np.int64), "labels": np.array([r.label for r in own]), "rows": np.array([r.row for r in own]), "axes": axes}
    shared = spark.sparkContext.broadcast(block)
    found = sorted(_positives(rows.select("v", "label", "vec_id", "row"), shared, dims, POSITIVES).collect(), key=lambda r: (r.key, r.rank))
    shared.destroy()
    score = np.array([r.score for r in found], np.int64)
    shared = spark.sparkContext.broadcast(block | {"anchor": np.array([r.key for r in found], np.int64), "least": -((-LOW * score) // 100), "most": (HIGH * score) // 100})
    listed = [(k, own[r.key].vec_id, r.vec_id, r.score) for k, r in enumerate(found)]
    positives = spark.createDataFrame(listed, "key long, anchor_id long, positive_id long, positive_score long")
    mined = _negatives(rows.select("v", "label", "vec_id", "row"), shared, dims, NEGATIVES).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    # At most POSITIVES rows for each anchor of one block.
    done = mined.join(F.broadcast(positives), "key").select(*[c.split()[0] for c in RESULT.split(", ")])
    done.write.parquet(path)
    shared.destroy()


ORACLE = """
WITH x AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM x a JOIN x r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3
"""
