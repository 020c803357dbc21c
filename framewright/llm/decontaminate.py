"""Benchmark decontamination, in DataFrame functions only.

Each benchmark item becomes its normalised word windows. Windows of all lengths of the training documents are hashed in one scan
and probed against a broadcast hash set of the items' windows, first by a bitmap of it, so that few windows leave their text's row; each hit
is verified word by word. A set of more bytes than the bound is cut into slices by hash, each of which is broadcast to a scan of its own: of the documents only hits are ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright import scratch
from framewright.llm.native import ascii_lower, let, split_words, unused, windows

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Bytes of a slice of the hash set that is broadcast, and those that a window takes besides its text.
BROADCAST_BYTES, A_WINDOW = 32 << 20, 100
#: Bits of the bitmap of a slice for each of its windows, and the most it has (as a power of two).
BITS_A_WINDOW, MOST_BITS = 16, 20


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows of (item_id, text): k (its words), window (joined by blanks), h (64-bit hash), item_ids."""
    words = items.select("item_id", split_words(F.col("text"), SEPARATORS).alias("words")).filter(F.size("words") > 0)
    k = F.least(F.lit(size), F.size("words"))
    each = words.select("item_id", k.alias("k"), F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.slice("words", i, k))).alias("window"))
    hashed = F.coalesce(*[F.when(F.col("k") == j, F.xxhash64(*[F.xxhash64(F.get("window", F.lit(i))) for i in range(j)])) for j in range(1, size + 1)])
    grouped = each.withColumn("h", hashed).withColumn("window", F.array_join("window", " ")).groupBy("k", "h", "window")
    return grouped.agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))


def slices(found: DataFrame) -> list[DataFrame]:
    """k, h and window of the items' windows, in parts by hash of about BROADCAST_BYTES at most; a part is looked at by its real size too."""
    size = F.sum(F.octet_length("window") + A_WINDOW)
    n = -(-(found.agg(size.alias("s")).first().s or 0) // BROADCAST_BYTES)
    while True:
        part = F.pmod(F.xxhash64("h", "k"), F.lit(max(1, n)))
        largest = found.groupBy(part.alias("p")).agg(size.alias("s")).agg(F.max("s").alias("s")).first().s or 0
        if n <= 1 or largest <= 2 * BROADCAST_BYTES:
            return [found.filter(part == p).select("k", "h", "window") for p in range(n)]
        n *= 2


def likely(own: DataFrame):
    """From a hash to whether it may be one of `own` (h): two bits of each hash in a bitmap, a constant of the plan of 2 ** MOST_BITS bits at most."""
    n = own.count()
    b = max(6, min(MOST_BITS, (BITS_A_WINDOW * n).bit_length()))
    places = lambda h: (F.shiftrightunsigned(h, 64 - b), h.bitwiseAND(F.lit((1 << b) - 1)))
    each = own.select(F.explode(F.array(*places(F.col("h")))).alias("i")).select(F.shiftright("i", 6).alias("word"), F.col("i").bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = [0] * (1 << b - 6)
    for r in each.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).collect():
        words[r.word] = r.bits
    bitmap = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    is_set = lambda i: F.bit_get(F.get(bitmap, F.shiftright(i, 6).cast("int")), i.bitwiseAND(F.lit(63)).cast("int")) == 1
    return lambda h: is_set(places(h)[0]) & is_set(places(h)[1])


def hits(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Verified hits by document: doc_id, row (hash of the text), covered (sorted word positions from 0), item_ids (sorted strings)."""
    found = scratch.written(item_windows(items, size), "benchmark-windows")
    sizes = [r.k for r in found.select("k").distinct().orderBy("k").collect()]
    words = docs.select("doc_id", F.xxhash64("text").alias("row"), split_words(F.col("text"), SEPARATORS).alias("words"))
    placed = lambda k: F.transform(windows(F.col("words"), k), lambda h, i: F.struct(F.lit(k).alias("k"), i.alias("at"), h.alias("h")))
    met = None
    for own in slices(found):
        may_be = likely(own)
        few = lambda k: F.filter(placed(k), lambda x: may_be(x["h"]))  # noqa: B023, E731
        each = words.select("doc_id", "row", "words", F.explode(F.concat(*map(few, sizes))).alias("x")).select("doc_id", "row", "words", "x.*")
        is_window = F.array_join(F.slice("words", F.col("at") + 1, F.col("k")), " ") == F.col("window")
        hit = each.join(F.broadcast(own), ["k", "h"]).filter(is_window).select("doc_id", "row", "k", "at", "h", "window")
        met = hit if met is None else met.unionByName(hit)
    if met is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, row long, covered array<int>, item_ids array<string>")
    # Only now the items, of which a window can have any number.
    spans = met.join(found, ["k", "h", "window"]).select("doc_id", "row", F.sequence("at", F.col("at") + F.col("k") - 1).alias("covered"), "item_ids")
    flat = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_set(c))))
    return spans.groupBy("doc_id", "row").agg(flat("covered").alias("covered"), flat("item_ids").alias("item_ids"))


def report(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; an item without words has no window, one with fewer words than `size`
    is one window. Repeated rows get a result each; rows with one doc_id and different texts are told apart. Empty tables
    give empty results (documents) or no hits (items). Other columns are ignored, whatever their names.
    """
    every = docs.select("doc_id", F.xxhash64("text").alias("row"), F.size(split_words(F.col("text"), SEPARATORS)).cast("long").alias("n_words"))
    found = hits(docs, items, size).withColumnRenamed("doc_id", "id").withColumnRenamed("row", "id_row")
    joined = every.join(found, (every.doc_id.eqNullSafe(F.col("id"))) & (every.row == F.col("id_row")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.size("covered"), F.lit(0)).cast("long")
    return joined.select("doc_id", "n_words", F.when(F.col("covered").isNull(), 0).otherwise(n_hit).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), F.col("covered").isNotNull().alias("contaminated"))


def without_words(text: Column, covered: Column) -> Column:
    """The text without the words at the sorted positions `covered` and the separators after them."""
    words, gaps = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD, -1)
    keep = lambda w, g, c: F.concat(F.get(g, F.lit(0)), F.array_join(F.transform(F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: ~F.array_contains(c, i - 1)), lambda i: F.concat(F.get(w, i - 1), F.get(g, i))), ""))
    return let(F.struct(words.alias("w"), gaps.alias("g"), covered.alias("c")), lambda x: F.when(F.size(x["w"]) == 0, text).otherwise(keep(x["w"], x["g"], x["c"])))


def decontaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, remove: str = "documents") -> DataFrame:
    """`docs` without contaminated documents (remove='documents') or without their hit words (remove='spans'); same columns.

    Documents without a hit, null texts included, stay as they are.
    """
    hit_id, hit_row, hit_at = unused(docs, "hit_id", "hit_row", "hit_at")
    found = hits(docs, items, size).select(F.col("doc_id").alias(hit_id), F.col("row").alias(hit_row), F.col("covered").alias(hit_at))
    same = docs.doc_id.eqNullSafe(F.col(hit_id)) & (F.xxhash64(docs.text) == F.col(hit_row))
    if remove == "documents":
        return docs.join(found, same, "left_anti")
    cut = F.when(F.col(hit_at).isNull(), F.col("text")).otherwise(without_words(F.col("text"), F.col(hit_at)))
    return docs.join(found, same, "left").withColumn("text", cut).select(docs.columns)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS win
       FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, ks WHERE len(ws) >= k)),
hit AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
