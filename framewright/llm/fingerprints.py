"""Bottom-k sketches of word shingles as document fingerprints, in DataFrame functions only.

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a text's shingles. Sketches of parts merge
to the sketch of the whole, and two sketches estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright import scratch
from framewright.llm.native import let, ordered_buckets, split_words, windows

SEPARATORS = r"[\x20\x09-\x0D]+"
SHINGLE = 5
K = 128
#: Rows in one ordered bucket of neighbours.
BUCKET_ROWS = 2000


def sketch(text: Column, shingle: int = SHINGLE, k: int = K) -> Column:
    """The sketch of a text. Fewer words than a shingle are one shingle; null and texts without words have an empty sketch."""
    short = lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.array_join(w, " "))))
    hashes = lambda w: F.when(F.size(w) >= shingle, windows(w, shingle)).otherwise(short(w))
    return let(split_words(text, SEPARATORS), lambda w: F.slice(F.sort_array(F.array_distinct(hashes(w))), 1, k))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches, 0 if one is empty."""
    of = lambda m: F.size(F.array_intersect(F.array_intersect(m, a), b)) / F.size(m)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(let(merge(a, b, k), of))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated distinct shingles: exact below k, else (k - 1) over the share of the hash space that the sketch spans."""
    span = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too, from the resemblance and the three distinct counts."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_string(a: Column) -> Column:
    """Sixteen hex digits for each hash, in order."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merged(docs: DataFrame, by: str, text: str = "text", k: int = K) -> DataFrame:
    """A sketch for each value of `by` over all its rows: k rows a value and task are shuffled, however many rows it has."""
    each = docs.select(by, F.explode(sketch(F.col(text), k=k)).alias("h")).distinct()
    return each.groupBy(by).agg(F.slice(F.sort_array(F.collect_set("h")), 1, k).alias("sketch"))


def fingerprint_pairs(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every whole text and of its edited text (the last third replaced by the head of the next document).

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next document
    is that with the next lower doc_id, after the last the first: rows fall into ordered buckets, and each bucket's head
    is handed to the bucket above it, so that no task orders all rows; one task orders the buckets, native.MOST_BUCKETS at most.

    Null is the empty text; two empty texts have likeness 1. Rows with one doc_id are ordered by their texts, if they are
    so many that they fill several buckets first by hash of the text; repeated rows are each other's next. Ids are whole numbers. A table of one row is its own next, an empty one gives an empty result. Other columns are
    ignored, whatever their names.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("bucket", ordered_buckets(docs, BUCKET_ROWS))
    heads = scratch.written(docs.groupBy("bucket").agg(F.max(F.struct("doc_id", "text"))["text"].alias("head")), "fingerprint-heads")
    top = heads.agg(F.max("bucket")).first()[0]
    links = heads.select("bucket", F.coalesce(F.lead("bucket").over(W.orderBy(F.desc("bucket"))), F.lit(top)).alias("below"))
    after = links.join(heads.select(F.col("bucket").alias("below"), F.col("head").alias("after")), "below").drop("below")
    own = W.partitionBy("bucket").orderBy(F.desc("doc_id"), F.desc("text"))
    rows = docs.withColumn("following", F.lead("text").over(own)).join(after, "bucket")
    n, m = F.char_length("text"), F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - m), F.substring(F.coalesce("following", "after"), F.lit(1), m))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.coalesce("following", "after").alias("following"), sketch(F.col("text"), k=k).alias("own"), edited.alias("edited"))
    rows = rows.withColumn("changed", sketch(F.col("edited"), k=k)).withColumn("next", sketch(F.col("following"), k=k))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_string(F.col("own")).alias("fingerprint"), as_string(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"), resemblance(F.col("own"), F.col("next"), k).alias("near_next"),
    )
