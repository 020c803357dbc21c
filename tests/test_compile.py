"""Compilation of raw entries, fixed candidates in the assignment, look-up of predicates and the split by task, on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from framewright.operators import compile, datasets, lexicons, lookups, roles

SCHEMA = "entry_key string, subcat string, is_verb boolean, args map<string,array<string>>, needs map<string,array<string>>"


def row(spark, subcat="NOM-PP", is_verb=False, args=None, needs=None, more=()):
    return spark.createDataFrame([("x", subcat, is_verb, args, needs), *more], SCHEMA)


def values(spark, text, *path):
    return spark.createDataFrame([(text,)], "raw string").select(compile.special_values(F.col("raw"), list(path)).alias("x")).first().x


def test_special_values(spark):
    raw = '{"NOM-SUBC": {"P-ING": {"PVAL": ["in", "on"]}, "P-POSSING": {"PVAL": ["at"]}, "PP": {"PVAL": {"of": {}, "to": {}}}, "X": "by"}}'
    assert values(spark, raw, "NOM-SUBC", "P-", "PVAL") == ["in", "on", "at"]
    assert values(spark, raw, "NOM-SUBC", "PP", "PVAL") == ["of", "to"] and values(spark, raw, "NOM-SUBC", "X") == ["by"]
    assert values(spark, raw, "NOM-SUBC", "Y", "PVAL") == [] and values(spark, '{"A": ["b"]}', "A", "C", "D") == ["b"]
    assert values(spark, None, "A") == [] and values(spark, "", "A") == []


def test_prepositions(spark):
    args = {"PVAL": ["in"], "PVAL-NOM": ["to"], "NOM-ROLE-FOR-PVAL": ["DET-POSS"], "SUBJECT": ["by"]}
    assert compile.prepositions(row(spark, args=args)).first().args == {"SUBJECT": ["by"], "PP": ["to", "DET-POSS"]}
    assert compile.prepositions(row(spark, args=args, is_verb=True)).first().args == {"SUBJECT": ["by"], "PP": ["in"]}
    assert compile.prepositions(row(spark, args={"PVAL": ["in"], "PVAL-NOM": ["to"]})).first().args == {"PP": ["in"]}
    assert compile.prepositions(row(spark, "NOM-PP-PP", args={"PVAL1": ["in"]})).first().args == {"PP1": ["in"], "PP2": ["in"]}
    assert compile.prepositions(row(spark)).first().args == {}
    with pytest.raises(Exception, match="no preposition"):
        compile.prepositions(row(spark, "NOM-PP-PP")).collect()


def lists(r):
    return r.required, r.optional


def test_requirements(spark):
    args = {"OBJECT": ["of"], "SUBJECT": ["by", "OPTIONAL-POSITION"], "PARTICLE": ["up"], "NP": ["OPTIONAL-POSITION"]}
    needs = {"SUBJECT": [], "PP": [], "OBJECT": ["DET-POSS-ONLY"]}
    alone = compile.requirements(row(spark, "NOM-NP", args=args, needs=needs), {"NOM-NP": ["NP", "IND-OBJ"]}).first()
    assert lists(alone) == (["IND-OBJ", "PP"], ["NP", "OBJECT", "SUBJECT"]) and alone.det_poss_only == ["OBJECT"] and alone.n_n_mod_only == []
    assert alone.args == {"OBJECT": ["of"], "SUBJECT": ["by"], "PARTICLE": ["up"]}
    both = row(spark, "NOM-NP", True, args, needs, [("x", "NOM-INTRANS", True, None, None), ("y", "NOM-NP-PP", False, None, None), ("y", "NOM-PP", False, None, None), ("z", "NOM-PART-NP", False, None, None)])
    got = {(r.entry_key, r.subcat): lists(r) for r in compile.requirements(both, {}).collect()}
    assert got["x", "NOM-NP"] == (["OBJECT", "PARTICLE", "PP"], ["NP", "SUBJECT"]) and got["x", "NOM-INTRANS"] == ([], ["SUBJECT"])
    assert got["y", "NOM-NP-PP"] == (["OBJECT"], ["SUBJECT"]) and got["z", "NOM-PART-NP"] == ([], ["OBJECT", "SUBJECT"])


def test_kinds_links_and_copies(spark):
    schema = "entry_key string, orth string, verb string, nom_type string, plural string, singular_false boolean, subcat string"
    rows = [("act", "act", "act", "VERB-NOM", "acts", None, "NOM-NP"), ("act", "act", "act", "VERB-NOM", "acts", None, "NOM-PART"), ("act#2", "act", "act", "SUBJECT", None, None, "NOM-NP"), ("goods", "good", None, "OBJECT", "goods", True, "NOM-NP")]
    found = compile.linked(compile.kinds(compile.versions(spark.createDataFrame(rows, schema))))
    got = {(r.source, r.kind, r.subcat): r for r in found.collect()}
    assert set(got) == {("act", "verb", "NOM-NP"), ("act", "verb", "NOM-PART"), ("act", "nom", "NOM-NP"), ("act", "plural", "NOM-NP"), ("act#2", "verb", "NOM-NP"), ("act#2", "nom", "NOM-NP"), ("goods", "plural", "NOM-NP")}
    one = got["act", "plural", "NOM-NP"]
    assert (one.entry_key, one.verb_key, one.nom_key, one.plural_key, one.plural) == ("acts", "act", "act", "acts", None)
    assert got["act#2", "verb", "NOM-NP"].entry_key == "act#2" and got["act#2", "nom", "NOM-NP"].plural_key is None
    assert got["act", "verb", "NOM-NP"].nom_type is None and got["goods", "plural", "NOM-NP"].verb_key is None

    entries = spark.createDataFrame([("act", "act", "acts"), ("act#2", "act", None)], "entry_key string, orth string, plural string")
    copies = spark.createDataFrame([("act", None), ("act", "activity"), ("act#2", "activity"), ("no", "x")], "entry_key string, new_orth string")
    assert {tuple(r) for r in compile.copied(entries, copies).collect()} == {("act", "act", "acts"), ("act#2", "act", None), ("act#3", "act", "acts"), ("activity", "activity", "activities"), ("activity#2", "activity", None)}
    assert compile.copied(entries, copies.limit(0)).count() == 2


def test_determined(spark):
    schema = "p int, pred_i int, cand string, start int, lemma string, types array<string>"
    options = [(1, 4, "Tim", 0, "Tim", ["SUBJECT", "OBJECT", "MODIFIER"]), (1, 4, "Apple", 2, "Apple", ["OBJECT", "SUBJECT"]), (1, 4, "x", 6, "x", ["PP1", "MODIFIER"]), (1, 4, "he", 8, "he", ["SUBJECT"]), (1, 4, "self", 4, "self", ["OBJECT"]), (1, 4, "m", 9, "m", ["MODIFIER"]), (2, 1, "y", 0, "y", ["OBJECT"]), (2, 1, "it", 3, "it", ["OBJECT"])]
    scores = [(1, c, k, v) for c, k, v in [("Tim", "OBJECT", -0.1), ("Tim", "SUBJECT", -3.0), ("Tim", "NONE", -4.0), ("Apple", "OBJECT", -1.0), ("Apple", "SUBJECT", -1.2), ("Apple", "NONE", -2.0), ("x", "PP", -3.0), ("x", "SUBJECT", 0.0), ("x", "NONE", -0.1), ("he", "OBJECT", 0.0)]]
    scores += [(2, "y", "OBJECT", -3.0), (2, "y", "NONE", -0.1)]
    labels = ["SUBJECT", "OBJECT", "PP", "NONE"]
    got = roles.determined(spark.createDataFrame(options, schema), spark.createDataFrame(scores, "p int, cand string, label string, logp double"), ["p"], labels)
    assert {(r.p, r.cand): r.types for r in got.collect()} == {(1, "Tim"): ["OBJECT"], (1, "Apple"): ["SUBJECT"], (1, "x"): ["MODIFIER"], (1, "he"): ["SUBJECT"], (1, "self"): ["OBJECT"], (1, "m"): ["MODIFIER"], (2, "it"): ["OBJECT"]}


def test_find(spark):
    tokens = spark.createDataFrame([("Acts", "act", "NOUN"), ("acted", "act", "VERB"), ("Move", "move", "NOUN"), ("run", "run", "ADJ"), ("Run", "run", "NOUN")], "orth string, lemma string, pos string")
    entries = spark.createDataFrame([("acts", False, "act#2", False), ("act", True, None, None), ("run", False, "run", True)], "entry_key string, is_verb boolean, verb string, certain boolean")
    matcher = spark.createDataFrame([(False, "move", "move"), (False, "acts", "enact")], "is_verb boolean, word string, verb string")
    found = lambda **o: {(r.orth, r.entry_key, r.suitable) for r in lookups.find(tokens, entries, **o).collect()}
    plain = {("Acts", "acts", "act"), ("acted", "act", "act"), ("Run", "run", "run")}
    assert found() == plain and found(matcher=matcher) == plain | {("Move", "DEFAULT", "move")}
    assert found(matcher=matcher, limited=["enact", "run"]) == {("Acts", "acts", "enact"), ("Run", "run", "run")}
    assert found(matcher=matcher, using_default=True) == {("Acts", "DEFAULT", "enact"), ("Move", "DEFAULT", "move")}
    assert found(matcher=matcher, be_certain=True) == {("acted", "act", "act"), ("Run", "run", "run")}


def test_tasks(spark):
    args, nouns = datasets.split_by_task(spark.createDataFrame([(1, "ARGS"), (2, "NOUNS"), (3, None)], "x int, tagset_type string"))
    assert [r.x for r in args.collect()] == [1] and [r.x for r in nouns.collect()] == [2]


def test_known_values(spark):
    """Functions that no query runs."""
    s = lambda *xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    one = spark.range(1).select(
        lexicons.subject_positions(s("DET-POSS"), s(), F.lit(False)).alias("a"), lexicons.subject_positions(s("of", "NOT-PP-BY"), s(), F.lit(True)).alias("b"),
        lexicons.subject_positions(F.lit(None).cast("array<string>"), s("of"), F.lit(False)).alias("c"), lexicons.root_tags(F.lit("PARTICLE")).alias("d"), lexicons.root_tags(F.lit("THAT-S")).alias("e"),
        lexicons.never_common(s(), F.lit("acts"), F.lit("act")).alias("f"), lexicons.never_common(s("PLUR-ONLY"), F.lit("acts"), F.lit("act")).alias("g"), lexicons.never_common(s("EXISTS"), F.lit("act"), F.lit("act")).alias("h"),
    ).first()
    assert (one.a, one.b, one.c) == (["DET-POSS", "by"], ["of"], ["of", "by"]) and one.d == ["PART", "ADP"] and one.e == [] and (one.f, one.g, one.h) == (True, False, False)
    rows = spark.createDataFrame([("NOM-INSTRANS",), ("NOM-PART-NP",), ("NO",)], "subcat string")
    spec = spark.createDataFrame([("NOM-INTRANS",), ("NOM-NP",)], "subcat string")
    assert {r.subcat for r in lexicons.known_subcats(rows, spec).collect()} == {"NOM-INTRANS", "NOM-PART-NP"}
    entries = spark.createDataFrame([("a", "x", ["VERB-NOM"]), ("b", "x", ["VERB-NOM"]), ("b#2", "y", ["SUBJECT"]), ("c", "x", [])], "orth string, verb string, nom_types array<string>")
    assert [r.orth for r in lexicons.usable(entries).collect()] == ["a"]
    report = spark.createDataFrame([("A", 1, 0, 1, 0.5), ("B", 0, 2, 2, None)], "label string, tp int, fp int, fn int, f1 double")
    assert roles.weighted_f1(report).first()[0] == 0.25 and roles.weighted_f1(report.limit(0)).first()[0] == 0.0
    values = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "b int, v double")
    assert roles.mean_of_means(values, "b", "v").first()[0] == 3.5
    args = spark.createDataFrame([(1, "PP", c, e, d) for d in (True, False) for c, e in (("x", 0.1), ("y", 0.2), ("z", 0.3))], "p int, type string, cand string, entropy double, is_default boolean")
    assert sorted(r.cand for r in roles.lowest_entropy(args.filter("is_default"), ["p"]).collect()) == ["x", "y"] and [r.cand for r in roles.lowest_entropy(args.filter("not is_default"), ["p"]).collect()] == ["x"]
