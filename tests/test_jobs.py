"""Ordered numbering, selection by domination, postings, the feature cache, sub-words, languages and reports, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from framewright.operators import build, cache, datasets, languages, ordered, postings, select, subwords, summary
from framewright.operators.extract import MATCH
from framewright.sources import lisp


@pytest.mark.parametrize("n", [0, 1, 5, 97, 400])
def test_running_and_ranks(spark, n):
    r = random.Random(n)
    rows = [(i * 7 % 1009, None if i % 13 == 0 else r.randint(0, 9), "k") for i in range(n)]
    df = spark.createDataFrame(rows, "at long, size int, part_ string").repartition(6)
    got = sorted(map(tuple, ordered.running(df, ["at"], F.col("size"), parts=5).select("at", "index", "before").collect()))
    want, total = [], 0
    for k, (at, size, _) in enumerate(sorted(rows)):
        want.append((at, k, total))
        total += size or 0
    assert got == want
    # The sampler's own slices: repeats from the first or second row on.
    for replicas in (1, 3, 7):
        order = [at for at, *_ in sorted(rows)]
        size = -(-n // replicas)
        extra = size * replicas - n
        order += order[n % 2 : extra + n % 2] if n > replicas else []
        got = {(r.rank, r.place): r.at for r in ordered.ranks(df, ["at"], replicas, parts=4).collect()}
        assert len(got) == size * replicas and all(rank == place // size for rank, place in got)
        if n > replicas or not extra:
            assert [got[k // size, k] for k in range(len(order))] == order


@pytest.mark.parametrize("limit", [-1, 0, 3, 17, 10**6])
def test_until_full(spark, limit):
    rows = [(i, (i * 5) % 4) for i in range(60)]
    want, total = [], 0
    for row in rows:
        want.append(row)
        total += row[1]
        if limit != -1 and total > limit:
            break
    df = spark.createDataFrame(rows, "at long, size int").repartition(7)
    assert sorted(map(tuple, ordered.until_full(df, ["at"], "size", limit, parts=6).collect())) == want
    assert ordered.until_full(df.limit(0), ["at"], "size", limit).count() == 0


def test_no_window_over_all_rows(spark):
    plan = ordered.running(spark.range(100), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SinglePartition" not in plan


def plain_filter(items, beats, largest, greedy):
    items = sorted(items, key=lambda x: -len(x)) if greedy else items
    kept = []
    for x in items:
        if largest and len(x) != len(items[0]):
            continue
        if not any(beats(x, y) for y in (kept if greedy else items)):
            kept.append(x)
    return kept


@pytest.mark.parametrize("greedy", [True, False])
@pytest.mark.parametrize("largest", [True, False])
def test_undominated(spark, greedy, largest):
    """A rule without transitivity, so that the order and what is kept matter."""
    r = random.Random(3)
    groups = [(k, [sorted(r.sample(range(9), r.randint(1, 4))) for _ in range(r.randint(1, 12))]) for k in range(150)]
    beats = lambda x, y: x != y and sum(x) % 5 < sum(y) % 5 and len(set(x) & set(y)) > 0
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + b)
    column = lambda x, y: (x != y) & (total(x) % 5 < total(y) % 5) & F.arrays_overlap(x, y)
    df = spark.createDataFrame(groups, "k int, xs array<array<int>>")
    got = df.select("k", select.undominated(F.col("xs"), F.size, column, largest, greedy).alias("kept")).collect()
    assert {g.k: g.kept for g in got} == {k: plain_filter(xs, beats, largest, greedy) for k, xs in groups}


def test_sub_extraction(spark):
    span = "array<struct<name:string,start:int,end:int>>"
    cases = [
        ([("A", 0, 1)], [("A", 0, 1), ("B", 2, 3)], True), ([("A", 0, 2)], [("A", 0, 1), ("B", 2, 3)], False), ([], [("A", 0, 1)], True),
        ([("PP1", 0, 1), ("PP2", 2, 3)], [("PP1", 2, 3), ("PP2", 0, 1), ("A", 4, 5)], True), ([("PP1", 0, 1)], [("PP1", 2, 3), ("PP2", 0, 1)], False),
        ([("PP1", 0, 1), ("PP2", 2, 3), ("A", 4, 5)], [("PP1", 2, 3), ("PP2", 0, 1)], False),
    ]
    df = spark.createDataFrame(cases, f"a {span}, b {span}, want boolean")
    assert [r.got for r in df.select(select.sub_extraction(F.col("a"), F.col("b")).alias("got")).collect()] == [c[2] for c in cases]


ARGS = "array<struct<name:string,type:string,head_i:int,position:string,start:int,end:int,text:string>>"


def extractions(spark, rows):
    """(pred, subcat, [(type, head, position)]) as extractions whose spans are their heads."""
    out = []
    for pred, subcat, xs in rows:
        out.append((1, 0, pred, subcat, [(t, t, h, p, h, h, True, []) for t, h, p in xs], [(t, t, h, p, h, h + 1, f"w{h}") for t, h, p in xs]))
    return spark.createDataFrame(out, f"doc_id long, sent_id int, pred_i int, subcat string, xs array<{MATCH}>, args {ARGS}")


def test_choose_informative(spark):
    found = extractions(spark, [
        (0, "A", [("SUBJECT", 1, "by"), ("OBJECT", 2, "of")]), (0, "B", [("SUBJECT", 1, "by"), ("OBJECT", 2, "of")]), (0, "C", [("SUBJECT", 1, "by")]),
        (1, "A", [("PP", 1, "in"), ("OBJECT", 2, "of")]), (1, "B", [("P-ING-SC", 1, "in"), ("OBJECT", 2, "of")]),
        (2, "A", [("PP1", 1, "in"), ("PP2", 2, "on")]), (2, "B", [("PP1", 2, "on"), ("PP2", 1, "in")]),
    ])
    got = {(r.pred_i, r.subcat) for r in select.choose_informative(found).collect()}
    assert got == {(0, "A"), (1, "B"), (2, "A")}
    known = select.is_in(found, found.filter("subcat = 'A'")).collect()
    assert {(r.pred_i, r.subcat) for r in known if r.known} == {(0, "A"), (0, "B"), (1, "A"), (2, "A")}
    # A model's choice leaves the subject alone, which is an extraction too; the object alone is none.
    choice = lambda *xs: spark.createDataFrame([(1, 0, 0, h, h + 1, [t]) for t, h in xs], "doc_id long, sent_id int, pred_i int, start int, end int, types array<string>")
    assert [tuple((x.type, x.head_i) for x in r.xs) for r in select.choose_informative(found, choice(("SUBJECT", 1))).collect()] == [(("SUBJECT", 1),)]
    assert select.choose_informative(found, choice(("OBJECT", 2))).count() == 0


def test_postings_read_only_asked_buckets(spark):
    rows = [(d, 0, f"w{d % 50}", "NOUN") for d in range(500)] + [(9, 1, "Of", "ADP"), (9, 2, "Go", "VERB")]
    table = postings.written(spark.createDataFrame(rows, "doc_id long, sent_id int, orth string, pos string"))
    hits = postings.sentences_with(table, spark.createDataFrame([("w3",), ("go",), ("of",), (None,)], "lemma string"))
    assert {tuple(r) for r in hits.collect()} == {(d, 0) for d in range(3, 500, 50)} | {(9, 2)}
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert postings.sentences_with(table, spark.createDataFrame([], "lemma string")).count() == 0


def test_cache_encodes_only_what_is_new(spark, tmp_path):
    seen = []

    def encode(rows):
        seen.append(sorted(r.w or "" for r in rows.collect()))
        return rows.select("digest", F.length("w").alias("n"))

    path = str(tmp_path / "cache")
    df = lambda *ws: spark.createDataFrame([(w, i) for i, w in enumerate(ws)], "w string, i int")
    assert sorted((r.w, r.n) for r in cache.refreshed(df("a", "bb", "a"), ["w"], path, encode).collect()) == [("a", 1), ("a", 1), ("bb", 2)]
    assert sorted(r.n for r in cache.refreshed(df("bb", "ccc"), ["w"], path, encode).collect()) == [2, 3]
    assert cache.refreshed(df("a", "ccc"), ["w"], path, encode).count() == 2 and seen == [["a", "bb"], ["ccc"], []]

    def broken(rows):
        return rows.select("digest", F.when(F.col("w") == "dddd", F.raise_error(F.lit("broken"))).otherwise(F.length("w")).cast("int").alias("n"))

    with pytest.raises(Exception, match="broken"):
        cache.refreshed(df("dddd", "eeeee"), ["w"], path, broken)
    assert cache.read(spark, path).count() == 3 and cache.refreshed(df("dddd", None), ["w"], path, encode).count() == 2
    assert seen[-1] == ["", "dddd"]


PIECES = ["[PAD]", "[CLS]", "[SEP]", "[UNK]", "un", "una", "##ff", "##aff", "##able", "##a", "the", "a", "act", "##s", ".", "x"]


def longest(word):
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in PIECES:
                break
        else:
            return ["[UNK]"]
        out.append(piece)
        at = end
    return out


def test_subwords(spark):
    vocabulary = subwords.Vocabulary(subwords.with_markers(PIECES))
    r = random.Random(1)
    words = ["unaffable", "acts", "b"] + ["".join(r.choice(["un", "a", "ff", "able", "act", "s", "z"]) for _ in range(r.randint(1, 6))) for _ in range(300)]
    assert [vocabulary.pieces(w) for w in words] == [longest(w) for w in words]
    rows = [
        (1, ["The", "ácts", "unaffable", "."], 0, 1, 1, "act", "ARGS"), (2, ["The", "acts"], -1, -1, 1, "act", "NOUNS"), (3, ["x"] * 200, 0, 1, 5, "act", "ARGS"),
        (4, None, 0, 1, 2, "act", "ARGS"), (5, ["x", "a"], 0, 1, 1, None, "ARGS"), (6, ["x", "a"], 0, 1, 1, "a", "OTHER"), (7, [], 0, 0, 0, "a", "ARGS"),
    ]
    df = spark.createDataFrame(rows, "x_id int, words array<string>, arg_start_idx int, arg_end_idx int, predicate_idx int, verb string, tagset_type string")
    got = {r.x_id: r.x for r in subwords.encoded(df, PIECES, 20).collect()}
    name = [*PIECES, *("<arg>", "</arg>", "<pred>", "</pred>")]
    text = lambda x: [name[i] for i, m in zip(x.ids, x.mask) if m]
    assert text(got[1]) == ["[CLS]", "<arg>", "the", "</arg>", "<pred>", "act", "##s", "</pred>", *longest("unaffable"), ".", "[SEP]", "act", "[SEP]"]
    assert (got[1].start_arg, got[1].end_arg, got[1].start_pred, got[1].end_pred, got[1].verb_at, got[1].task) == (1, 3, 4, 7, text(got[1]).index("[SEP]") + 1, 0)
    assert text(got[2]) == ["[CLS]", "the", "<pred>", "<arg>", "act", "##s", "</arg>", "</pred>", "[SEP]"] and got[2].task == 1
    assert got[3] is None and got[4] is None and got[6] is None and len(got[1].ids) == len(got[1].mask) == 20 and got[5].verb_at == len(text(got[5]))
    assert subwords.usable(subwords.encoded(df, PIECES)).filter("x_id = 3").count() == 0
    with pytest.raises(ValueError, match="lacks"):
        subwords.encoded(df, ["a"])


def test_detected_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    got = languages.detected(docs.filter(part == 0), languages.profiles(docs.filter(part != 0)))
    rates = {r.lang: r.ok / r.n for r in got.filter("detected is not null").groupBy("lang").agg(F.count_if(F.col("lang") == F.col("detected")).alias("ok"), F.count(F.lit(1)).alias("n")).collect()}
    assert len(rates) == 4 and min(rates.values()) >= 0.95, rates
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?")], "doc_id long, text string")
    assert [r.detected for r in languages.detected(odd, languages.profiles(docs.limit(50))).collect()] == [None] * 3
    assert [r.detected for r in languages.detected(odd, languages.profiles(docs.limit(0))).collect()] == [None] * 3


def test_summary(spark, tmp_path):
    (tmp_path / "x.lisp").write_text("\n".join(f'(NOM :ORTH "act{c}" :VERB "act{c}" :NOM-TYPE ((VERB-NOM)) :NOUN ((EXISTS)) :VERB-SUBC ((NOM-NP :SUBJECT ((DET-POSS)) :OBJECT ((DET-POSS) (PP-OF)))))' for c in "abcdefgh"))
    lexicon = build.compiled(lisp.entries(spark, str(tmp_path))).cache()
    assert summary.problems(lexicon).count() == 0
    hits = summary.collisions(lexicon.filter("kind = 'nom'"), 3).collect()
    assert [(r.one, r.other, r.n, r.examples) for r in hits] == [("OBJECT", "SUBJECT", 8, ["acta", "actb", "actc"])]
    wrong = lexicon.filter("kind = 'nom'").limit(1).withColumn("required", F.expr("array('OBJECT', 'OBJECT', 'PP')")).withColumn("args", F.expr("array_append(args, args[0])"))
    assert {r.problem for r in summary.problems(wrong).collect()} == {"required twice", "required and optional", "required without argument", "repeated complement"}
    rows = spark.createDataFrame([(k, v) for k in ("a", None) for v in range(40)] * 2, "k string, v int")
    assert {(r.k, r.n, tuple(r.examples)) for r in summary.first_examples(rows, ["k"], "v", 4).collect()} == {("a", 40, (0, 1, 2, 3)), (None, 40, (0, 1, 2, 3))}
    assert datasets.certain_nouns(lexicon).count() == 0 and datasets.certain_nouns(lexicon.withColumn("nouns", F.array(F.lit("PLUR-ONLY")))).count() == 8


def test_index_is_written_after_one_shuffle(spark, tmp_path):
    rows = [(d, s, w, "NOUN") for d in range(40) for s in range(3) for w in ("house", "house", f"w{d}")]
    got = postings.written(spark.createDataFrame(rows, "doc_id long, sent_id int, orth string, pos string"), str(tmp_path / "index"))
    assert sorted((r.lemma, r.doc_id, r.sent_id) for r in got.collect()) == sorted({(w, d, s) for d, s, w, _ in rows})
    assert len([f for f in (tmp_path / "index").glob("bucket=*/*.parquet")]) <= postings.BUCKETS * postings.PARTS


def test_profiles_count_letters_outside_the_first_plane(spark):
    docs = spark.createDataFrame([("a", "abc abc"), ("a", None), ("b", "\U00010400bc"), (None, "abc")], "lang string, text string")
    got = {(r.lang, r.gram): r.score for r in languages.profiles(docs).collect()}
    assert {k for k in got if k[0] == "b"} == {("b", " \U00010428b"), ("b", "\U00010428bc"), ("b", "bc ")}
    assert got["a", "abc"] == pytest.approx(math.log(2 / 7)) and got["a", "c a"] == pytest.approx(math.log(1 / 7))
