"""Vector code compression: product quantisation in whole numbers, exact and independent of how rows are dealt out.

Vectors become whole numbers and are written once. Each round broadcasts the codebooks (PARTS x ENTRIES entries, never more),
Arrow batches find each part's nearest entry by |x|^2 - 2xc + |c|^2 in int64, every task gives the sums and counts of its
entries, and a grouped shuffle adds these up. Only entries come to the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright import scratch
from framewright.llm.vectors import dimension, matrix, usable, whole

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Up to so many distinct labels' sums are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 100_000


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the first of equals) and its squared distance, for rows of whole vectors and each part."""
    parts, _, width = books.shape
    index, away = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
    for p in range(parts):
        own, entries = x[:, p * width : (p + 1) * width], books[p]
        d = (own * own).sum(1)[:, None] - 2 * (own @ entries.T) + (entries * entries).sum(1)[None, :]
        index[:, p] = d.argmin(1)
        away[:, p] = np.take_along_axis(d, index[:, p : p + 1], 1)[:, 0]
    return index, away


def _sums(rows: DataFrame, shared, dims: int) -> DataFrame:
    """(part, entry, at, n, s): how many parts chose an entry, and the sum of their components at one place."""

    def partial(batches):
        books = shared.value
        parts, entries, width = books.shape
        n, s = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x = matrix(batch, "v", dims)
            index, _ = nearest(x, books)
            for p in range(parts):
                chosen = (index[:, p, None] == np.arange(entries)).astype(np.int64)
                n[p] += chosen.sum(0)
                s[p] += chosen.T @ x[:, p * width : (p + 1) * width]
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(n[part, entry]), "sums": pa.array(list(s[part, entry]), pa.list_(pa.int64()))})

    each = rows.select("v").mapInArrow(partial, "part int, entry int, n long, sums array<long>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    return each.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(exact("n"), exact("s"))


def codebooks(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Final entries (parts, entries, width) of written `rows` (vec_id, v of `dims` whole numbers); fewer rows give fewer entries."""
    first = rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2).copy()
    context = rows.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(books)
        found = _sums(rows, shared, dims).collect()
        shared.destroy()
        books = books.copy()
        for r in found:
            books[r.part, r.entry, r.at] = int(r.s) // int(r.n)
    return books


def compressed(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row with a usable vector.

    Rows whose vector is null, empty, or has a null or non-finite component are left out, as are vectors of another length than
    that with the smallest id. Repeated rows get a result each; ids may repeat (equal ones are ordered by their vectors) or be
    null (these come last). Null labels form one group. An empty table gives no rows. Other columns are ignored. A length that
    can't be cut into equal parts fails the query.
    """
    kept = vectors.filter(usable(F.col(vector))).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), whole(F.col(vector), SCALE).alias("v"))
    rows = scratch.written(kept, "codes-vectors")
    dims = dimension(rows, "vec_id", "v")
    out = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, code string, error long"
    if not dims:
        return vectors.sparkSession.createDataFrame([], out.replace(f"label {kept.schema['label'].dataType.simpleString()}, ", "") + ", label_error long, codebooks_sha256 string")
    if dims % PARTS:
        raise ValueError(f"vectors of {dims} components can't be cut into {PARTS} equal parts")
    rows = rows.filter(F.size("v") == dims)
    books = codebooks(rows, dims)
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def encode(batches):
        pairs = np.array([f"{i:02x}" for i in range(ENTRIES)], "S2")
        for batch in batches:
            index, away = nearest(matrix(batch, "v", dims), shared.value)
            codes = np.ascontiguousarray(pairs[index]).view(f"S{2 * PARTS}").ravel().astype(str)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(away.sum(1))], ["vec_id", "label", "code", "error"])

    coded = scratch.written(rows.mapInArrow(encode, out), "codes")
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    if totals.count() <= BROADCAST_LABELS:
        totals = F.broadcast(totals)
    both = coded.join(totals, coded.label.eqNullSafe(F.col("_label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same in SQL: one row a vector and part, the rounds written out."""
    steps = [
        """x AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(embedding) > 0)""",
        f"p AS MATERIALIZED (SELECT vec_id, label, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS w FROM x, (SELECT unnest(range({PARTS})) AS part))",
        f"b0 AS MATERIALIZED (SELECT part, e, w AS c FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id, w) - 1 AS e, w FROM p) WHERE e < {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        away = "list_sum(list_transform(list_zip(w, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, part, w, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT vec_id, label, part, w, e, CAST({away} AS BIGINT) AS d FROM p JOIN b{r} USING (part)) GROUP BY vec_id, label, part, w)")
        if r < ROUNDS:
            steps.append(f"m{r} AS (SELECT part, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (SELECT part, e, i, CAST(sum(w[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM a{r}) GROUP BY part, e, i) GROUP BY part, e)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT part, e, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (part, e))")
    steps.append(f"k AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{ROUNDS})")
    steps.append(f"y AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id, label)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM y, k"


ORACLE = _oracle()
