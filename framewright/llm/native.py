"""Column builders shared by the operators that stay inside the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright import scratch
from framewright.operators.ordered import running

#: Bytes of text that weigh as much as a row; buckets at most; edges of buckets looked through in one step.
A_ROW, MOST_BUCKETS, STEP = 1 << 14, 1 << 17, 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once a row however often `body` names it, also inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until `df` has no column called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def split_words(text: Column, separators: str) -> Column:
    """Words of a text between runs of separators; null has none."""
    return F.array_remove(F.split(ascii_lower(text), separators, -1), "")


def windows(words: Column, k: int) -> Column:
    """A 64-bit hash for each run of k words, in order; an empty array for fewer than k words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    slide = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
    return let(hashes, lambda h: F.when(F.size(h) >= k, slide(h)).otherwise(F.array().cast("array<bigint>")))


def ordered_buckets(docs: DataFrame, bucket_rows: int, by_bytes: bool = True) -> Column:
    """A bucket number that ascends with doc_id (whole numbers), of about `bucket_rows` rows each, however the ids lie; -1 for null.

    A row counts as one for each A_ROW bytes of its text (without `by_bytes` as one, and no text is read). Ids are counted exactly, and in order by ranges; the ids at which buckets
    begin, MOST_BUCKETS at most, come to the driver. The rows of an id that fills several buckets are dealt to these by hash of the
    text, so that their order among themselves is no longer by text.
    """
    weight = F.lit(1).cast("long") if not by_bytes else F.greatest(F.lit(1), F.floor(F.octet_length(F.coalesce("text", F.lit(""))) / A_ROW)).cast("long")
    ids = docs.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sum(weight).alias("n"))
    counted = scratch.written(running(ids, ["doc_id"], F.col("n")), "ordered-ids")
    total = counted.agg(F.max(F.col("before") + F.col("n")).alias("n")).first().n
    if not total:
        return F.lit(-1).cast("long")
    size = max(bucket_rows, -(-total // MOST_BUCKETS))
    # A bucket begins at each multiple of its size: the ids in which one lies, and how many lie in each.
    first, last = F.ceil(F.col("before") / size), F.ceil((F.col("before") + F.col("n")) / size)
    edges = counted.select("doc_id", (last - F.greatest(first, F.lit(1))).alias("k")).filter("k > 0").orderBy("doc_id").collect()
    scratch.discard(counted)
    at, starts = 0, []
    for e in edges:
        starts.append((e.doc_id, at, at + e.k))
        at += e.k
    if not starts:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0).cast("long")
    groups = [starts[i : i + STEP] for i in range(0, len(starts), STEP)]
    constant = lambda x, kind: F.from_json(F.lit(json.dumps(x)), f"array<{kind}>")
    heads, table = constant([g[0][0] for g in groups], "bigint"), constant([[list(x) for x in g] for g in groups], "array<array<bigint>>")
    doc_id = F.col("doc_id").cast("long")
    # The last edge at or before the id, by two steps of at most STEP comparisons and as many groups.
    group = F.size(F.filter(heads, lambda h: h <= doc_id))
    own = lambda g: F.element_at(F.filter(g, lambda x: F.get(x, F.lit(0)) <= doc_id), -1)
    spread = lambda x: F.when((F.get(x, F.lit(0)) == doc_id) & (F.get(x, F.lit(2)) - F.get(x, F.lit(1)) > 1), F.get(x, F.lit(1)) + 1 + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.get(x, F.lit(2)) - F.get(x, F.lit(1)))).otherwise(F.get(x, F.lit(2)))
    found = F.when(group == 0, F.lit(0)).otherwise(let(F.get(table, group - 1), lambda g: let(own(g), spread)))
    return F.when(doc_id.isNull(), -1).otherwise(found).cast("long")
