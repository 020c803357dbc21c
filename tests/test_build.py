"""Whole lexicons: reader, splits against a plain fixpoint, the rewriting program, and extraction with what it gives."""

import json
import re

import pytest
from pyspark.sql import functions as F

from framewright.operators import build, compile, entries, extract, rules, trees
from framewright.sources import lisp

LEXICON = """
(NOM :ORTH "come-back" :VERB "come" :PLURAL "come-backs" :NOM-TYPE ((VERB-PART)) :VERB-SUBC ((NOM-PART)))
(NOM :ORTH "giving" :VERB "give" :NOM-TYPE ((VERB-NOM) (SUBJECT :PVAL ("by"))) :FEATURES ((SUBJ-OBJ-ALT)) :VERB-SUBJ ((DET-POSS))
 :VERB-SUBC ((NOM-INTRANS :ALTERNATES-OPT T) (NOM-PP :PVAL ("to")) (NOM-PART-NP :ADVAL ("up") :ADVAL-NOM ("off" "up")) (NOM-PART :ADVAL-NOM ("up"))))
(NOM :ORTH "co-action" :VERB "act" :NOM-TYPE ((VERB-NOM)) :VERB-SUBC ((NOM-NP)))
(NOM :ORTH "coaction" :VERB "act" :PLURAL "x" :NOM-TYPE ((VERB-NOM)) :VERB-SUBC ((NOM-NP)))
(NOM :ORTH "two" :VERB "a" :NOM-TYPE ((VERB-NOM)) :VERB-SUBC ((NOM-NP)))
(NOM :ORTH "two" :VERB "b" :NOM-TYPE ((VERB-NOM)) :VERB-SUBC ((NOM-NP)))
(NOM :ORTH "none" :VERB "b" :VERB-SUBC ((NOM-NP)))
(NOM :ORTH "bad" :VERB "b" :NOM-TYPE ((VERB-NOM)) :VERB-SUBC ((NOM-NP :ALTERNATES T)))
(NOM :ORTH "output" :VERB "put" :NOM-TYPE ((VERB-PART)) :VERB-SUBC ((NOM-PART-NP)))
(NOM :ORTH "take" :VERB "take" :PLURAL "takes" :NOM-TYPE ((SUBJECT-PART :ADVAL ("off"))) :VERB-SUBC ((NOM-PART-NP)))
(NOM :ORTH "bare" :VERB "bare" :NOM-TYPE ((VERB-NOM)))
"""


def read(spark, folder, text):
    (folder / "x.lisp").write_text(text)
    return lisp.entries(spark, str(folder)).cache()


def plain_splits(es):
    """The splits one entry after the other, by recursion."""
    done, todo = [], list(es)

    def content(e):
        return json.dumps([e["verb"], e["features"], e["types"], e["subcats"]], sort_keys=True)

    def particles(e, t):
        return e["types"][t].get("ADVAL") or [e["orth"].replace(e["verb"], "").replace("-", "")]

    twins = []
    while todo:
        e = json.loads(json.dumps(todo.pop(0)))
        opt = [s for s, v in e["subcats"].items() if "ALTERNATES-OPT" in v]
        if opt:
            subcats = {s: {k: x for k, x in e["subcats"][s].items() if k != "ALTERNATES-OPT"} for s in opt}
            todo.append(e | {"features": [f for f in e["features"] if "ALT" not in f], "subcats": subcats})
            for s in opt:
                e["subcats"][s]["ALTERNATES"] = e["subcats"][s].pop("ALTERNATES-OPT")
        first, *others = e["types"]
        todo += [e | {"types": {t: e["types"][t]}} for t in others]
        e["types"] = {first: e["types"][first]}
        names = [s for s, v in e["subcats"].items() if "ADVAL-NOM" in v]
        for p in dict.fromkeys(p for s in names for p in e["subcats"][s]["ADVAL-NOM"]):
            subcats = {s: {k: x for k, x in v.items() if "ADVAL" not in k} | {"ADVAL": v["ADVAL-NOM"]} for s, v in e["subcats"].items() if p in v.get("ADVAL-NOM", [])}
            todo.append(e | {"orth": f"{e['orth']}-{p}", "types": {first.replace("-NOM", "") + "-PART": e["types"][first] | {"ADVAL": [p]}}, "subcats": subcats})
        e["subcats"] = {s: v for s, v in e["subcats"].items() if s not in names}
        p = None
        if "PART" in first:
            (p,) = particles(e, first)
            e["types"] = {first: e["types"][first] | {"ADVAL": [p]}}
            if "-" not in e["orth"] and not e["orth"].endswith(p) and not e["orth"].startswith(p):
                e["orth"] += f"-{p}"
        done.append(e)
        twin = e["orth"].replace("-", "") if "-" in e["orth"] else f"{p}-{e['orth'][len(p):]}" if p and e["orth"].startswith(p) and not e["orth"].endswith(p) else None
        if twin:
            twins.append(e | {"orth": twin})
        if not todo:
            there = {(x["orth"], content(x)) for x in done}
            for t in twins:
                if (t["orth"], content(t)) not in there:
                    there.add((t["orth"], content(t)))
                    todo.append(t)
            twins = []
    return sorted((e["orth"], content(e)) for e in done)


def test_splits_feed_each_other(spark, tmp_path):
    found = entries.plausible(entries.opened(read(spark, tmp_path, LEXICON)))
    assert {r.orth for r in found.select("orth").collect()} == {"come-back", "giving", "co-action", "coaction", "output", "take", "bare"}
    plain = []
    for kind, e in lisp.parse(LEXICON):
        if kind == "NOM" and e["ORTH"] not in ("two", "none", "bad"):
            plain.append({"orth": e["ORTH"], "verb": e["VERB"], "features": list(e.get("FEATURES", {})), "types": e["NOM-TYPE"], "subcats": e.get("VERB-SUBC", {})})

    def as_text(r):
        fields = lambda m: {k: {a: json.loads(b) if b.startswith("[") else b for a, b in v.items()} for k, v in m.items()}
        return r.orth, json.dumps([r.verb, r.features, fields(r.types), fields(r.subcats)], sort_keys=True)

    got = entries.split(found).collect()
    assert sorted(map(as_text, got)) == plain_splits(plain)
    assert len({r.id for r in got}) == len(got) and {r.orth: r.plural for r in got}["comeback"] == "comebacks"
    assert entries.split(found.limit(0)).count() == 0


def test_splits_that_fail(spark, tmp_path):
    two = '(NOM :ORTH "x" :VERB "y" :NOM-TYPE ((VERB-PART :ADVAL ("in" "on"))) :VERB-SUBC ((NOM-PART)))'
    with pytest.raises(Exception, match="USER_RAISED"):
        entries.split(entries.opened(read(spark, tmp_path, two))).collect()


def test_entries_without_subcategorizations_and_plurals(spark, tmp_path):
    got = {(r.entry_key, r.kind): r for r in build.compiled(read(spark, tmp_path, LEXICON)).collect() if r.orth.startswith("bare")}
    assert set(got) == {("bare", "verb"), ("bare", "nom"), ("bares", "plural")} and all(r.subcat is None and r.args == [] for r in got.values())
    words = ["child", "woman", "analysis", "housewife", "midlife", "person", "box", "city", "day", "act"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(compile.plural(F.col("w")).alias("p")).collect()
    assert [r.p for r in rows] == ["children", "women", "analyses", "housewives", "midlifes", "people", "boxes", "cities", "days", "acts"]


def test_rows_of_a_small_lexicon_are_dealt_to_all_tasks(spark, tmp_path, monkeypatch):
    """Few bytes with large expressions: every table between rewrites has its rows in as many files as there are cores."""
    text = "\n".join(f'(NOM :ORTH "noun{"abcdefgh"[i % 8] * (i // 8 + 1)}" :VERB "verb" :NOM-TYPE ((VERB-NOM)) :VERB-SUBC ((NOM-NP) (NOM-INTRANS)))' for i in range(64))
    shares, real = [], build.scratch.written

    def written(df, name):
        out = real(df, name)
        if name == "lexicon-rows":
            shares.append(sorted(r["count"] for r in out.groupBy(F.input_file_name()).count().collect()))
        return out

    raw = real(read(spark, tmp_path, text).coalesce(1), "raw")
    monkeypatch.setattr(build.scratch, "written", written)
    build.compiled(raw)
    assert shares and all(sum(x) == 256 and len(x) == 4 and x[-1] < 128 for x in shares)


def test_rule_table():
    table = rules.parsed()
    assert len(table) == 118 and len({r[0] for r in table}) == 59
    for name, _, usual, given, moves, paths, more, _ in table:
        known = {*rules.COMPLEMENTS, "IGNORE"}
        assert {*usual, *given, *moves, *moves.values(), *paths, *more} <= known and set(paths.values()) <= set(build.PATHS), name
        assert all(re.fullmatch(r"[a-z ]+|OPTIONAL-POSITION", p) or p in rules.POSITIONS for ps in given.values() for p in ps)


def test_written_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.lisp").write_text('(NOM :ORTH "act" :VERB "act" :NOM-TYPE ((VERB-NOM)) :VERB-SUBC ((NOM-NP)))')
    first = build.build(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert {r.kind for r in first.collect()} == {"verb", "nom", "plural"}
    (tmp_path / "in" / "x.lisp").write_text('(NOM :ORTH "fact" :VERB "act" :NOM-TYPE ((VERB-NOM)) :VERB-SUBC ((NOM-NP)))')
    assert "fact" not in {r.orth for r in build.build(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert "fact" in {r.orth for r in build.build(spark, str(tmp_path / "in"), str(tmp_path / "out"), force=True).collect()}


USED = """
(NOM :ORTH "request" :VERB "request" :NOM-TYPE ((VERB-NOM)) :VERB-SUBJ ((DET-POSS)) :VERB-SUBC ((NOM-NP-TO-INF-OC :OBJECT ((PP-OF)))))
(NOM :ORTH "avoidance" :VERB "avoid" :NOM-TYPE ((VERB-NOM)) :VERB-SUBC ((NOM-POSSING)))
(NOM :ORTH "meeting" :VERB "meet" :NOM-TYPE ((VERB-NOM)) :VERB-SUBC ((NOM-INTRANS-RECIP :SUBJECT ((PP-OF)) :REQUIRED ((SUBJECT)))))
(NOM :ORTH "talk" :VERB "talk" :NOM-TYPE ((VERB-NOM)) :VERB-SUBC ((NOM-PP :PVAL ("about")) (NOM-P-ING-SC :PVAL ("about"))))
(NOM :ORTH "gift" :VERB "give" :NOM-TYPE ((OBJECT)) :VERB-SUBJ ((DET-POSS)) :VERB-SUBC ((NOM-NP-TO-NP :OBJECT ((PP-OF)) :IND-OBJ ((PP-TO)) :NOT ((AND :SUBJECT ((DET-POSS)) :IND-OBJ ((PP-TO)))))))
"""
SENTENCES = {
    1: "Apple PROPN NNP nsubj 1|requests VERB VBZ root 1|Tim PROPN NNP dobj 1|to PART TO mark 4|leave VERB VB xcomp 1",
    2: "Apple PROPN NNP nmod:poss 2|'s PART POS case 0|request NOUN NN root 2|of ADP IN case 4|Tim PROPN NNP nmod 2|to PART TO mark 6|leave VERB VB acl 2",
    3: "avoidance NOUN NN root 0|of ADP IN case 3|his PRON PRP$ nmod:poss 3|leaving VERB VBG acl 0",
    4: "avoidance NOUN NN root 0|of ADP IN case 2|leaving VERB VBG acl 0",
    5: "meeting NOUN NN root 0|of ADP IN case 2|friends NOUN NNS nmod 0",
    6: "meeting NOUN NN root 0|of ADP IN case 2|Tim PROPN NNP nmod 0",
    7: "talk NOUN NN root 0|about ADP IN case 2|leaving VERB VBG acl 0",
    8: "their PRON PRP$ nmod:poss 1|gift NOUN NN root 1|by ADP IN case 3|Tim PROPN NNP nmod 1|to ADP TO case 5|Apple PROPN NNP nmod 1",
    9: "Gifts NOUN NNS root 0|to ADP TO case 2|Apple PROPN NNP nmod 0",
}


def test_extraction_with_a_compiled_lexicon(spark, tmp_path):
    """Infinitives, gerunds with and without a possessive, plurality, plurals, nouns that are arguments, and NOT clauses."""
    lexicon = build.for_extraction(build.compiled(read(spark, tmp_path, USED)))
    rows = [(d, 0, i, o, o.removesuffix("s") if pos == "VERB" else o, pos, tag, dep, int(head)) for d, line in SENTENCES.items() for i, (o, pos, tag, dep, head) in enumerate(t.split() for t in line.split("|"))]
    tokens = spark.createDataFrame(rows, "doc_id long, sent_id int, i int, orth string, lemma string, pos string, tag string, dep string, head int")
    got = {}
    for r in extract.extract(trees.trees(tokens), lexicon, null_choice=True).collect():
        got.setdefault(r.doc_id, set()).add(frozenset((a.name, a.text) for a in r.args))
    one = lambda **x: {frozenset((k.replace("_", "-"), v) for k, v in x.items())}
    assert got[1] == one(SUBJECT="Apple", OBJECT="Tim", TO_INF_OC="to leave")
    assert got[2] == one(SUBJECT="Apple", OBJECT="Tim", TO_INF_OC="to leave")
    assert got[3] == one(POSSING="his leaving") and got[4] == one(ING_ARBC="leaving")
    assert got[5] == one(SUBJECT="friends") and 6 not in got
    assert got[7] == one(P_ING_SC="about leaving")
    # `by` is no position of the clause's subject, so that it escapes the clause; an extraction that nothing lets escape is ruled out.
    assert got[8] == one(SUBJECT="Tim", IND_OBJ="Apple", OBJECT="gift") and 9 not in got
