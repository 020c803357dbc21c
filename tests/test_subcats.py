"""Rewrites of subcategorizations and lookups on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from framewright.operators import lookups, subcats
from framewright.sources import lisp

SCHEMA = "entry_key string, subcat string, is_verb boolean, args map<string,array<string>>, required array<string>, optional array<string>, clauses array<map<string,array<string>>>, alternates boolean"


def row(spark, subcat="NOM-NP", is_verb=False, args=None, required=(), optional=(), clauses=None, alternates=False):
    return spark.createDataFrame([("x", subcat, is_verb, args, list(required), list(optional), clauses, alternates)], SCHEMA)


def test_objects_and_clauses(spark):
    got = subcats.objects(row(spark, args={"OBJECT": ["PP-OF", "DET-POSS"], "IND-OBJ": ["IND-OBJ-TO"], "PP": ["in"]})).first()
    assert got.args == {"OBJECT": ["of", "DET-POSS"], "IND-OBJ": ["to"], "PP": ["in"]}
    both = [{"SUBJECT": ["PP-BY"], "OBJECT": ["PP-OF"]}, {"PP": ["in"]}]
    assert subcats.clauses(row(spark, clauses=both)).first().clauses == [{"SUBJECT": ["by"], "OBJECT": ["of"]}]
    assert subcats.clauses(row(spark, is_verb=True, clauses=both)).first().clauses == []
    assert subcats.clauses(row(spark)).first().clauses == [] and subcats.objects(row(spark)).first().args == {}


def test_renamed(spark):
    rows = row(spark, args={"PP1": ["in"], "NP": ["x"], "SUBJECT": ["by"]}, required=["PP1", "SUBJECT"], optional=["NP"])
    got = subcats.renamed(rows, {"PP1": "PP", "NP": "IGNORE", "ADVP": "X", "SUBJECT": "SUBJECT"}).first()
    assert got.args == {"PP": ["in"], "SUBJECT": ["by"]} and got.required == ["PP", "SUBJECT"]
    assert got.optional == ["NP"]  # a dropped complement can come back by its defaults, so the lists keep it
    crossed = subcats.renamed(row(spark, args={"PP": ["in"], "PP1": ["on"]}, required=["P-POSSING", "PP"]), {"PP": "P-POSSING", "PP1": "PP"}).first()
    assert crossed.args == {"P-POSSING": ["in"], "PP": ["on"]} and crossed.required == ["P-POSSING", "PP"]
    kept = subcats.renamed(row(spark, args={"A": ["1"], "B": ["2"]}, required=["A"], optional=["C"]), {"A": "C", "B": "C"}).first()
    assert kept.args == {"C": ["2"]} and kept.required == [] and kept.optional == ["C"]


def test_special_values_and_defaults(spark):
    rows = row(spark, args={"SUBJECT": ["by"]}).withColumn("special", F.expr("map('SUBJECT', array('x'), 'PP', array('in'), 'NP', array())").cast("map<string,array<string>>"))
    assert subcats.with_special(rows, "special").first().args == {"SUBJECT": ["by"], "PP": ["in"]}
    got = subcats.with_defaults(row(spark, args={"SUBJECT": ["by"]}), {"SUBJECT": ["of"], "OBJECT": ["of", "OPTIONAL-POSITION"]}).first()
    assert got.args == {"SUBJECT": ["by"], "OBJECT": ["of"]} and got.optional == ["OBJECT"]
    with pytest.raises(Exception, match="required and optional"):
        subcats.with_defaults(row(spark, required=["OBJECT"]), {"OBJECT": ["OPTIONAL-POSITION"]}).collect()


def test_alternation(spark):
    got = subcats.alternated(row(spark, "NOM-INTRANS", args={"SUBJECT": ["by"]}, required=["SUBJECT"], alternates=True)).first()
    assert got.args == {"OBJECT": ["by"]} and got.required == ["OBJECT"] and got.optional == ["SUBJECT"]
    got = subcats.alternated(row(spark, "NOM-NP", args={"SUBJECT": ["by"], "OBJECT": ["of"]}, optional=["SUBJECT"], alternates=True)).first()
    assert got.args == {"IND-OBJ": ["by"], "OBJECT": ["of"]} and got.optional == ["IND-OBJ", "SUBJECT"]
    assert subcats.alternated(row(spark, "NOM-INTRANS", args={"SUBJECT": ["NOM"]}, alternates=True)).first().args == {"SUBJECT": ["NOM"]}
    assert subcats.alternated(row(spark, args={"SUBJECT": ["by"]})).first().args == {"SUBJECT": ["by"]}
    with pytest.raises(Exception, match="no alternation"):
        subcats.alternated(row(spark, "NOM-INTRANS", args={"SUBJECT": ["by"], "OBJECT": ["of"]}, alternates=True)).collect()


def test_table_value_and_particle(spark):
    table = spark.createDataFrame([("NOM-NP", "v", "n"), ("NOM-INTRANS", "w", "m")], "name string, verb_value string, nom_value string")
    rows = spark.createDataFrame([("NOM-NP", True), ("NOM-PART-NP", False), ("NOM-PART", True), ("NOM-XX", True)], "subcat string, is_verb boolean")
    assert {(r.subcat, r.value) for r in subcats.table_value(rows, table).collect()} == {("NOM-NP", "v"), ("NOM-PART-NP", "n"), ("NOM-PART", "w"), ("NOM-XX", None)}
    one = spark.createDataFrame([("break-out", "break", []), ("x", "y", ["off"])], "orth string, verb string, p array<string>")
    assert [r[0] for r in one.select(subcats.particle(F.col("orth"), F.col("verb"), F.col("p"))).collect()] == ["out", "off"]


def test_lookups(spark, tmp_path):
    rows = spark.createDataFrame([("a", "T1", True), ("a#2", "T2", False), ("a#3", "T1", False), ("b", "T1", True)], "entry_key string, type string, is_verb boolean")
    asked = spark.createDataFrame([("a#2",), ("b",)], "entry_key string")
    assert {tuple(r) for r in lookups.chain(rows, asked).collect()} == {("a#2", "a#2", 0), ("a#2", "a#3", 1), ("b", "b", 0)}
    assert {r.stem: r.types for r in lookups.types_of(rows).collect()} == {"a": ["T1", "T2"], "b": ["T1"]}
    assert lookups.entry(rows, "a").count() == 1 and lookups.entry(rows, None).count() == 0
    rows.write.parquet(f"{tmp_path}/lexicon")
    assert lookups.load_lexicon(spark, f"{tmp_path}/lexicon", True).count() == 2
    lookups.written_once(rows.limit(1), f"{tmp_path}/lexicon")
    assert spark.read.parquet(f"{tmp_path}/lexicon").count() == 4
    args = spark.createDataFrame([(1, 0, 2, "S"), (1, 0, 2, "O"), (1, 3, 4, "O")], "k long, start int, end int, type string")
    assert {(r.start, tuple(r.types)) for r in lookups.options_by_span(args, ["k"]).collect()} == {(0, ("O", "S")), (3, ("O",))}
    assert lookups.chosen(args, args.filter("type = 'S'"), ["k"]).count() == 1 and lookups.in_range(args, 0, 2).count() == 2
    items = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["b", "a"]), (1, 3, ["a"]), (2, 4, [])], "k long, id long, names array<string>")
    assert {r.id for r in lookups.largest_undominated(items, ["k"]).collect()} == {1, 2, 4}
    assert {r.id for r in lookups.largest_undominated(items, ["k"], greedy=True).collect()} == {1, 4}
    assert sorted(lookups.gathered(items, "k", "names").filter("k = 1").first().names) == ["a", "a", "a", "b", "b"]
    parts = lookups.ranked_parts(spark.range(100), "id", 4).groupBy("rank").agg(F.min("id").alias("low"), F.max("id").alias("high")).orderBy("rank").collect()
    assert all(a.high < b.low for a, b in zip(parts, parts[1:]))
    text = "_START_ARTICLE_ T _START_PARAGRAPH_ one_NEWLINE_two _START_SECTION_ h _START_PARAGRAPH_three"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert [r.text for r in lookups.paragraphs(docs).orderBy("place").collect()] == [" one\ntwo ", "three"]
    golden = spark.createDataFrame([("s", "p", [{"SUBJECT": "x"}])], "sentence string, predicate string, extractions array<map<string,string>>")
    lookups.save_golden(golden, f"{tmp_path}/golden")
    assert lookups.load_golden(spark, f"{tmp_path}/golden").collect() == golden.collect()
    verbs = spark.createDataFrame([("run#2", None, True), ("runner", "run#1", False)], "orth string, verb string, is_verb boolean")
    assert [r[0] for r in verbs.select(lookups.suitable_verb(F.col("orth"), F.col("verb"), F.col("is_verb"))).collect()] == ["run", "run"]
    assert verbs.select(lookups.specs(word=F.col("orth"), verb=F.col("verb"))).first()[0] == "word: run#2"


def test_unclosed_lisp_ends():
    assert lisp.parse('(NOM :ORTH "a"') == [("NOM", {"ORTH": "a"})]
    assert lisp.parse("(") in ([], [("", {})]) and lisp.parse(")") == []
