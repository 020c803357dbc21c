"""The pipeline against plain Python over the whole smallest tables, and decontamination's edge cases."""

import hashlib
import re

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline
from framewright import scratch
from framewright.llm import bpe, decontaminate, toxicity

SF = "/root/testdata/sf0.001"
LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def near_duplicates(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LETTERS))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: t for i, t in texts.items() if find(i) == i}


def repeats(texts, length=400):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    count = {}
    for x in raw.values():
        for j in range(len(x) - length + 1):
            count[x[j : j + length]] = count.get(x[j : j + length], 0) + 1
    out = {}
    for i, x in raw.items():
        gone = bytearray(len(x))
        for j in range(len(x) - length + 1):
            if count[x[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        out[i] = bytes(c for c, g in zip(x, gone, strict=True) if not g).decode("utf-8", "ignore") if any(gone) else texts[i]
    return out


def covered(text, items, size=10):
    """Word positions of (item_id, text) windows in the text, and the items found."""
    words, hit, found = WORD.findall((text or "").translate(LETTERS)), set(), set()
    for item, t in items:
        own = WORD.findall((t or "").translate(LETTERS))
        k = min(size, len(own))
        for window in {tuple(own[j : j + k]) for j in range(len(own) - k + 1)} if k else ():
            for at in range(len(words) - k + 1):
                if tuple(words[at : at + k]) == window:
                    hit.update(range(at, at + k))
                    found.add(str(item))
    return hit, found, len(words)


def without(text, hit):
    if text is None or not hit:
        return text
    parts = [m.span() for m in WORD.finditer(text)]
    out = text[: parts[0][0]]
    for n, (s, _) in enumerate(parts):
        if n not in hit:
            out += text[s : parts[n + 1][0] if n + 1 < len(parts) else len(text)]
    return out


def test_pipeline(spark):
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    toxic = {r.doc_id for r in toxicity.scored(docs, labels).filter("predicted = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    assert texts
    texts = repeats(near_duplicates(texts))
    windows = [(r.item_id, r.text) for r in items.collect()]
    texts = {i: without(t, covered(t, windows)[0]) for i, t in texts.items()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest(), i
        assert got[i].n_tokens == len(library.encode_ordinary(t or ""))


@pytest.mark.parametrize("most", [32 << 20, 600])
def test_decontamination(spark, monkeypatch, most):
    """Nulls, short items, overlapping windows, repeated rows, clashing names, with one slice of the hash set and with several."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    long = " ".join(f"w{i}" for i in range(14))
    items = [(1, long), (2, "Short one"), (3, None), (4, "..."), (5, " ".join(f"W{i}," for i in range(5, 20)))]
    texts = ["x " + long + " y w14 w15", None, "", "a short ONE! short one", long.replace(" ", "--"), "short", "nothing here " * 20, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"]
    rows = [(i, t, 1, "k", "h") for i, t in enumerate(texts)] + [(3, texts[3], 1, "k", "h"), (3, "other", 1, "k", "h"), (None, texts[3], 1, "k", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hit_id long, row string, words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert (len(decontaminate.slices(decontaminate.item_windows(bench))) > 2) == (most == 600)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(docs, bench).collect())
    want = []
    for i, t, *_ in rows:
        hit, found, n = covered(t, items)
        want.append((str(i), n, len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want)
    cut = decontaminate.decontaminated(docs, bench, remove="spans")
    assert cut.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in cut.collect()) == sorted((str(i), str(without(t, covered(t, items)[0]))) for i, t, *_ in rows)
    assert decontaminate.decontaminated(docs, bench).count() == sum(not covered(t, items)[0] for _, t, *_ in rows)
    assert decontaminate.report(docs.limit(0), bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).filter("contaminated or n_hit > 0").count() == 0


def test_scratch_tables_go(spark, tmp_path):
    """An operator leaves what its result reads, and no more."""
    from framewright.llm import repeats as op

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made, real = [], scratch.written

    def written(df, name):
        out = real(df, name)
        made.append((name, out.scratch_path.removeprefix("file://")))
        return out

    scratch.written = written
    try:
        op.report(docs).count()
    finally:
        scratch.written = real
    import os

    assert [name for name, path in made if os.path.exists(path)] == ["repeat-spans"]


def test_no_exchange_holds_the_words_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 2000)
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontaminate.hits(docs, items)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") > 1
    physical = decontaminate.hits(docs, items)._jdf.queryExecution().executedPlan().toString()
    for line in physical.splitlines():  # what is hashed by window or document comes behind the broadcast join
        assert "Exchange hashpartitioning" not in line or "words" not in line
    above = physical[: physical.index("BroadcastHashJoin")]
    assert "Exchange" in above and "Exchange hashpartitioning" not in physical[physical.index("BroadcastHashJoin") :].split("BroadcastExchange")[0]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, hit_id string, row string, words string, key string, own_id int, bucket int, spans string"


def test_idle_workers_keep_no_words(spark):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(4)

    def words(batches):
        assert sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([len(bpe.coder(path, pattern, corpus_pipeline.REMEMBERED).known)], pa.int64())], ["id"])

    assert bpe.round_trip(docs, path, pattern, corpus_pipeline.REMEMBERED).agg({"n_tokens": "sum"}).first()[0] > 0
    assert spark.range(0, 4, 1, 4).mapInArrow(words, "id long").agg({"id": "max"}).first()[0] == 0


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and repeated texts, one id on several rows, names that operators use themselves, and empty tables."""
    long = " ".join(f"word{i}" for i in range(120))
    window = " ".join(f"w{i}" for i in range(12))
    texts = [None, "", " \n", "a", long, long, long + " tail", "x " + window + " y", "é" * 900, "z" * 5000]
    more = ("h", "r", "w", "k", 1, 2, "s")
    rows = [(i, t, "en", "web", len(t or ""), *more) for i, t in enumerate(texts)] + [(4, long, "en", "web", 1, *more), (None, long, None, None, None, *[None] * 7), (None, None, None, None, None, *[None] * 7), (3, "b", None, "web", 1, *more)]
    odd = spark.createDataFrame(rows, COLUMNS)
    tables = {
        "full": (spark.createDataFrame([(4, 1, 0), (None, 1, 1), (7, None, None), (7, 0, 0)], "doc_id long, quality int, toxic int"), spark.createDataFrame([("i1", window), (None, None), ("i2", "")], "item_id string, text string")),
        "none": (spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id string, text string")),
    }
    for name, (labels, items) in tables.items():
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        for docs in (odd, odd.limit(0)):
            for stage, f in corpus_pipeline.STAGES[:-1]:
                got = f(spark, docs, f"{tmp_path}/{name}")
                assert got.columns == odd.columns, stage
                docs = scratch.written(got, f"odd-{stage}")
            left = {(r.doc_id, r.text) for r in docs.collect()}
            encoded = corpus_pipeline.STAGES[-1][1](spark, docs, f"{tmp_path}/{name}").collect()
            assert len(encoded) == docs.count() and {r.doc_id for r in encoded} == {i for i, _ in left}
            if docs is not None and left:
                kept = dict(left)
                # One row of the class of `long` stays; what it says is not repeated anywhere else then.
                assert kept[4] == long and 5 not in kept and 6 not in kept and kept[0] is None and kept[8] is not None
                assert kept[7] == ("x y" if name == "full" else "x " + window + " y")
                assert kept[9] == ""


