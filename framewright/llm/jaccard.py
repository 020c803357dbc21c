"""Exact Jaccard join of word-shingle sets by adaptive multi-match prefixes.

Documents with equal sets are one node. A node's shingles are put in one global order, rare ones first (by counts in a
table of fixed size, ties by hash). Sets that link share at least l shingles among their first |x| - ceil(t|x|) + l. Each
node chooses its own l by estimated cost: a longer prefix sends more shingles and demands more matches of a partner; a pair
must share as many as the smaller l of its two nodes, after which whole sets are compared.

Links are found in two passes. First each prefix shingle links its nodes with its least node only, so that groups of near
copies fall together by a number of comparisons that grows with their rows. Then pairs of nodes that share enough prefix
shingles, by whose places they can still reach the overlap, and that are not yet connected are compared. Components, not pairs within them, are the result.
Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright import scratch
from framewright.llm.components import components
from framewright.llm.native import unused
from framewright.llm.shingles import set_key, shingle_set

SHINGLE, PERCENT = 4, 85
#: Cells of the table of shingle counts.
CELLS = 1 << 18
LONGEST, VERIFY_COST = 4, 24


def _need(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def choose(order_counts: np.ndarray, n: int, percent: int) -> int:
    """The l of least cost for a node whose shingles have these counts in global order."""
    base = n - _need(n, percent)
    best, cost = 1, None
    for level in range(1, min(LONGEST, n - base) + 1):
        met = float(order_counts[: base + level].sum())
        now = met + VERIFY_COST * met / level
        if cost is None or now < cost:
            best, cost = level, now
    return best


def _keys(docs: DataFrame, k: int) -> DataFrame:
    def each(batches):
        counts = np.zeros(CELLS, np.int64)
        for b in batches:
            sets = [shingle_set(x, k) for x in b.column("text").to_pylist()]
            for s in sets:
                np.add.at(counts, s.astype(np.int64) & CELLS - 1, 1)
            n = pa.array([len(s) for s in sets], pa.int64())
            keys = pa.array([set_key(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, keys, pa.nulls(len(sets), pa.int64())], names)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at]), pa.nulls(len(at), pa.binary()), pa.array(at)], names)

    names = ["doc_id", "n", "key", "cell"]
    return docs.mapInArrow(each, "doc_id long, n long, key binary, cell long")


def _prefixes(docs: DataFrame, counts: np.ndarray, k: int, percent: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # CELLS numbers

    def each(batches):
        counts = shared.value
        for b in batches:
            keys, n, levels, heads = [], [], [], []
            for x in b.column("text").to_pylist():
                s = shingle_set(x, k)
                c = counts[s.astype(np.int64) & CELLS - 1]
                order = np.lexsort((s, c))
                level = choose(c[order], len(s), percent) if len(s) else 0
                keys.append(set_key(s))
                n.append(len(s))
                levels.append(level)
                heads.append(s[order[: len(s) - _need(len(s), percent) + level]].astype(np.int64) if len(s) else [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(levels, pa.int32()), pa.array(heads, pa.list_(pa.int64()))], ["node", "key", "n", "l", "tokens"])

    return docs.mapInArrow(each, "node long, key binary, n long, l int, tokens array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def each(batches):
        last, kept = None, None
        for b in batches:
            a_ids, b_ids, found = b.column("a").to_pylist(), b.column("b").to_pylist(), []
            for i, (x, y) in enumerate(zip(b.column("ta"), b.column("tb"), strict=True)):
                if a_ids[i] != last:
                    last, kept = a_ids[i], shingle_set(x.as_py(), k)
                s = shingle_set(y.as_py(), k)
                both = len(np.intersect1d(kept, s, assume_unique=True))
                if 100 * both >= percent * (len(kept) + len(s) - both):
                    found.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a_ids[i] for i in found], pa.int64()), pa.array([b_ids[i] for i in found], pa.int64())], ["a", "b"])

    return scratch.written(pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(each, "a long, b long"), "jaccard-links")


def classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) for each row of `docs` (doc_id, text).

    Null and empty texts and texts without words have no shingles and are their own component. Equal texts link. Repeated rows
    get a row each; rows of one doc_id with different texts are one node of the graph, linked by either. A row with a
    null doc_id makes no node: it has the component of a document with its text, or a null one, and links nothing. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    every = scratch.written(_keys(docs, shingle), "jaccard-keys")
    found = every.filter("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CELLS, np.int64)
    counts[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    rows = scratch.written(every.filter("cell is null").select("doc_id", "n", "key"), "jaccard-rows")
    scratch.discard(every)
    reps = scratch.written(rows.filter("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("node")), "jaccard-nodes")
    heads = _prefixes(docs, counts, shingle, percent).filter("n > 0").join(reps, ["key", "node"]).dropDuplicates(["key", "node"])
    heads = scratch.written(heads.select("node", "n", "l", F.posexplode("tokens").alias("pos", "token")), "jaccard-prefixes")
    centers = heads.groupBy("token").agg(F.min("node").alias("center"), F.max("node").alias("top")).filter("center < top").drop("top")
    shared = scratch.written(heads.join(centers, "token"), "jaccard-shared")
    scratch.discard(heads)
    involved = shared.select("node").distinct()
    texts = docs.withColumnRenamed("doc_id", "node").join(involved, "node").dropDuplicates(["node", "text"])
    texts = scratch.written(texts, "jaccard-texts")

    stars = shared.filter("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b"), "n").distinct()
    sizes = shared.select(F.col("node").alias("a"), F.col("n").alias("na")).distinct()
    fits = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    first = _verified(stars.join(sizes, "a").filter(fits(F.col("n"), F.col("na"))).select("a", "b").distinct(), texts, shingle, percent)

    placed = shared.drop("center").join(components(first), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = scratch.written(placed, "jaccard-placed")
    scratch.discard(shared)
    second = _verified(_candidates(placed, percent), texts, shingle, percent)
    scratch.discard(placed, texts)

    links = scratch.written(first.unionByName(second).unionByName(_same_id(rows, reps)), "jaccard-links")
    scratch.discard(first, second)
    comps = components(links)
    scratch.discard(links)
    out = rows.join(reps, "key", "left").join(comps, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("comp", "node")).otherwise(F.col("doc_id")).alias("component_id"))


def _candidates(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes in different components that may link, from their prefixes: token, node, n, l, pos, comp.

    Two sets of x and y shingles link if they share percent * (x + y) / (100 + percent). If the first that they share stands at
    places i and j of their orders, they share at most the lesser of x - i and y - j. Rows of a token that no other row of it can
    meet so are left out before rows meet. The pairs that meet go on if their prefixes share as many as the least l of both.
    """
    left = F.col("n") - F.col("pos")
    per = placed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("low"), F.max(left).alias("room"))
    per = per.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("most"), F.count(F.lit(1)).alias("comps"), F.min("low").alias("low"), F.max("room").alias("room"))
    smallest = F.greatest(F.col("low"), F.ceil(F.col("n") * percent / 100))
    reaches = (100 + percent) * F.least(left, F.col("room")) >= percent * (F.col("n") + smallest)
    open_ = scratch.written(placed.join(per.filter("comps > 1"), "token").filter(reaches).select("token", "node", "n", left.alias("left"), "comp", "most"), "jaccard-open")
    x = open_.filter("comp <> most").select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("left").alias("left_a"), F.col("comp").alias("ca"))
    y = open_.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("left").alias("left_b"), F.col("comp").alias("cb"), "most")
    apart = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("most")) | (F.col("a") < F.col("b")))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    enough = (100 + percent) * F.least("left_a", "left_b") >= percent * (F.col("na") + F.col("nb"))
    met = x.join(y, "token").filter(apart & fits & enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    met = scratch.written(met, "jaccard-met")
    heads = placed.groupBy("node").agg(F.first("l").alias("l"), F.collect_list("token").alias("tokens"))
    one = heads.select(F.col("node").alias("a"), F.col("l").alias("la"), F.col("tokens").alias("of_a"))
    other = heads.select(F.col("node").alias("b"), F.col("l").alias("lb"), F.col("tokens").alias("of_b"))
    pairs = met.join(one, "a").join(other, "b").filter(F.size(F.array_intersect("of_a", "of_b")) >= F.least("la", "lb"))
    pairs = scratch.written(pairs.select("a", "b"), "jaccard-pairs")
    scratch.discard(open_, met)
    return pairs


def _same_id(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the nodes of different texts under one doc_id."""
    both = rows.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("key"), F.max("key").alias("other"), F.count(F.lit(1)).alias("c")).filter("c > 1 and key <> other")
    again = rows.join(both.select("doc_id", F.col("key").alias("first_key")), "doc_id").filter("n > 0").select("key", "first_key").distinct()
    other = reps.select(F.col("key").alias("first_key"), F.col("node").alias("a"))
    return again.join(reps, "key").join(other, "first_key").select("a", F.col("node").alias("b"))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """`docs` with one row of each component (that with its smallest doc_id); documents without words all stay. Same columns.

    Of rows that share the smallest doc_id the one of the least text stays. Rows with a null doc_id enter the components by an id
    made of their text, beyond small doc_ids, so that a row with a doc_id is kept rather than its copies without one.
    """
    made = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2).bitwiseOR(F.lit(1 << 62))
    worded = F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0d]")
    own, row = unused(docs, "own_id", "own_row")
    named = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), made))
    found = classes(named.select(F.col(own).alias("doc_id"), "text"), shingle, percent).filter("n_shingles > 0")
    each = found.groupBy(F.col("doc_id").alias(own)).agg(F.first(F.col("doc_id") != F.col("component_id")).alias("gone"), F.count(F.lit(1)).alias("rows"))
    marked = scratch.written(each.filter("gone or rows > 1"), "jaccard-marked")
    several = scratch.written(marked.filter("not gone").select(own), "jaccard-several")  # mostly empty, so that its join sends no texts
    named = named.withColumn(own, F.when(worded, F.col(own)))
    once = named.join(marked.select(own), own, "left_anti")
    again = named.join(several, own, "left_semi").withColumn(row, F.row_number().over(W.partitionBy(own).orderBy(F.col("doc_id").isNull(), "text")))
    return once.select(docs.columns).unionByName(again.filter(F.col(row) == 1).select(docs.columns))
