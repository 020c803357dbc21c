"""Fingerprints against brute force: the same hashes by the xxhash library, edits and neighbours by plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
import xxhash

from framewright.llm import fingerprints, native


def sketch(text, k=fingerprints.K):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return []
    if len(words) < 5:
        return [signed(xxhash.xxh64_intdigest(" ".join(words).encode(), 42))]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    out = set()
    for i in range(len(h) - 4):
        seed = 42
        for x in h[i : i + 5]:
            seed = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)
        out.add(signed(seed))
    return sorted(out)[:k]


def likeness(a, b, k=fingerprints.K):
    if not a or not b:
        return float(a == b)
    union = sorted(set(a) | set(b))[:k]
    return len(set(union) & set(a) & set(b)) / len(union)


@pytest.mark.parametrize("bucket_rows", [2000, 7])
def test_fingerprints(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", bucket_rows)
    r = random.Random(5)
    words = ["".join(r.choice("abcéX😀") for _ in range(r.randint(1, 5))) for _ in range(80)]
    texts = [None, "", " \n", "one two", *[" ".join(r.choice(words) for _ in range(r.randint(1, 400))) for _ in range(50)]]
    texts += texts[5:9]
    rows = [(7 * i + i % 3, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    got = {x.doc_id: x for x in fingerprints.fingerprint_pairs(docs).collect()}
    assert len(got) == len(rows)
    down = sorted(rows, reverse=True, key=lambda x: x[0])
    hexed = lambda s: "".join(f"{h & (1 << 64) - 1:016x}" for h in s)
    for i, (d, t, _) in enumerate(down):
        t, after = t or "", down[(i + 1) % len(down)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        own, changed, following = sketch(t), sketch(edited), sketch(after)
        x = got[d]
        assert (x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(own), hexed(changed)), d
        assert x.near_edited == pytest.approx(likeness(own, changed)) and x.near_next == pytest.approx(likeness(own, following))


def test_empty_and_single(spark):
    schema = "doc_id long, text string"
    assert fingerprints.fingerprint_pairs(spark.createDataFrame([], schema)).count() == 0
    one = fingerprints.fingerprint_pairs(spark.createDataFrame([(1, "a b c")], schema)).first()
    assert one.near_next == 1.0


IDS = {"gap": "if(id < 4000, id, id + 1000000000000)", "clusters": "if(id % 2 = 0, id div 2, 9000000000000000000 - id)", "one": "7", "a third": "if(id % 3 = 0, -7, id)", "powers": "pow(1.004, id)"}


@pytest.mark.parametrize("ids", IDS)
def test_buckets_are_even_and_in_order(spark, ids):
    """However ids lie, no bucket has many more rows than asked for, and a long text fills its bucket sooner."""
    docs = spark.range(8000).select(F.expr(f"cast({IDS[ids]} as bigint)").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    found = docs.select("doc_id", native.ordered_buckets(docs, 100).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("b").collect()
    assert 60 <= len(found) <= 90 and max(r.n for r in found) <= 200 and all(a.high <= b.low for a, b in zip(found, found[1:]))


def test_buckets_by_bytes_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(native, "A_ROW", 10)
    docs = spark.range(1000).select(F.when(F.col("id") > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("x"), 1000)).alias("text"))
    found = docs.select("doc_id", native.ordered_buckets(docs, 500).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.n for r in found if r.b == -1} == {1} and max(r.n for r in found) <= 12
    assert {r.b for r in docs.limit(0).select(native.ordered_buckets(docs.limit(0), 5).alias("b")).collect()} == set()


def test_one_id_on_many_rows(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 5)
    docs = spark.range(90).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("a b c d e f "), F.col("id")).alias("text"))
    got = fingerprints.fingerprint_pairs(docs.unionByName(docs.filter("doc_id in (1, 2, 4)"))).collect()
    assert len(got) == 93
