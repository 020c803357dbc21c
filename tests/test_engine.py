"""The general extraction engine and what stands around it, on hand-made trees."""

import json
import re

import pytest
from pyspark.sql import functions as F

from framewright.functions import columns
from framewright.operators import datasets, extract, lexicons, present, roles, search, trees, verbnouns
from framewright.operators.extract import argument
from framewright.plans import registry
from framewright.sources import lisp

NP = ["PROPN", "NOUN", "PRON", "DET"]
TREES = {
    1: "The DET DT det 1|appointment NOUN NN root 1|of ADP IN case 3|Tim PROPN NNP nmod 1|by ADP IN case 5|Apple PROPN NNP nmod 1",
    2: "Apple PROPN NNP nmod:poss 2|'s PART POS case 0|appointment NOUN NN root 2|of ADP IN case 4|Tim PROPN NNP nmod 2",
    3: "Apple PROPN NNP compound 2|Tim PROPN NNP compound 2|appointment NOUN NN root 2",
    4: "Apple PROPN NNP nsubj 1|appoints VERB VBZ root 1|Tim PROPN NNP dobj 1",
    5: "a DET DT det 1|house NOUN NN root 1",
}


def lex(spark, required=(), not_clauses=(), constraints=()):
    of = [argument("OBJECT", ["DET-POSS", "N-N-MOD", "PREFIX"], ["of"], root_upostags=NP, constraints=constraints), argument("SUBJECT", ["DET-POSS", "N-N-MOD", "PREFIX"], ["by"], root_upostags=NP)]
    verb = [argument("OBJECT", ["DOBJ", "NSUBJPASS"], root_upostags=NP), argument("SUBJECT", ["NSUBJ", "PREFIX"], ["by"], root_upostags=NP)]
    return extract.lexicon(spark, [(False, "appointment", "appoint", "NOM-NP", list(required), [], list(not_clauses), of), (True, "appoint", "appoint", "NOM-NP", ["OBJECT"], [], [], verb)])


@pytest.fixture(scope="module")
def tokens(spark):
    rows = []
    for d, line in TREES.items():
        for i, t in enumerate(line.split("|")):
            orth, pos, tag, dep, head = t.split()
            rows.append((d, 0, i, orth, orth.removesuffix("s") if pos == "VERB" else orth, pos, tag, dep, int(head)))
    return spark.createDataFrame(rows, "doc_id long, sent_id int, i int, orth string, lemma string, pos string, tag string, dep string, head int")


@pytest.fixture(scope="module")
def parsed(tokens):
    return trees.trees(tokens).cache()


@pytest.fixture(scope="module")
def found(spark, parsed):
    return extract.extract(parsed, lex(spark)).cache()


def as_dicts(df):
    return {(r.doc_id, frozenset((a.name, a.text) for a in r.args)) for r in df.collect()}


def test_extraction(found):
    want = {("OBJECT", "Tim"), ("SUBJECT", "Apple")}
    assert as_dicts(found) == {(d, frozenset(want)) for d in (1, 2, 3, 4)}


def test_required_not_and_single_object(spark, tokens):
    lone = trees.trees(tokens.filter("doc_id = 2 and i < 3"))
    names = lambda lx: {next(iter(x))[0] for _, x in as_dicts(extract.extract(lone, lx))}
    assert names(lex(spark)) == {"OBJECT", "SUBJECT"}
    assert names(lex(spark, constraints=["DET-POSS-NO-OTHER-OBJ"])) == {"OBJECT"}
    assert names(lex(spark, required=["SUBJECT"])) == {"SUBJECT"}
    assert names(lex(spark, not_clauses=[{"OBJECT": ["DET-POSS"]}])) == set()


def test_null_choice_and_longest(spark, parsed):
    every = extract.structures(extract.matches(extract.predicates(parsed.filter("doc_id = 1"), lex(spark))), null_choice=True)
    assert sorted(len(r.xs) for r in every.collect()) == [1, 1, 2]
    assert extract.longest(every).count() == 1


def test_domination(spark):
    row = lambda t, p, n=None: F.struct(F.lit(t).alias("type"), F.lit(n or t).alias("name"), F.lit(p).alias("position"))
    pairs = [("PP", "in", "P-ING-SC", "in", True), ("SUBJECT", "about", "WH-S", "about what", True), ("TO-INF-SC", "TO-INF", "FOR-TO-INF", "TO-INF", True), ("ADVP", "ADMOD", "PP", "next to", True), ("OBJECT", "of", "SUBJECT", "of", False)]
    got = spark.range(1).select(*[extract.more_informative(row(a, p), row(b, q)).alias(str(i)) for i, (a, p, b, q, _) in enumerate(pairs)]).first()
    assert list(got) == [x[-1] for x in pairs]


def test_presentation(found):
    assert {r.line for r in present.iob(found).filter("doc_id = 2").collect()} == {"Apple/B-SUBJECT 's/O appointment/NOM of/O Tim/B-OBJECT"}
    assert {r.line for r in present.iobes(found).filter("doc_id = 4").collect()} == {"Apple/S-SUBJECT appoints/O-VERB Tim/S-OBJECT"}
    event = present.mentions(found).filter("doc_id = 1").first()
    assert (event.event_id, event.argument_id, event.n_args, event.start, event.end) == (0, 0, 2, 1, 5)
    assert json.loads(event.mention)["trigger"]["id"] == "T:0,0,2"
    assert present.informative_events(present.mentions(found)).count() == 4
    assert json.loads(present.as_strings(found).filter("doc_id = 1").first().extractions) == [{"OBJECT": "Tim", "SUBJECT": "Apple"}]


def test_search(spark, found):
    text, preds, args, error = search.parse_markup("[AGENT Apple] [# appointed] [APPOINTEE Tim Cook] [TITLE as CEO].")
    assert (text, preds, sorted(args), error) == ("Apple appointed Tim Cook as CEO.", [1], [(0, 0, "AGENT"), (2, 3, "APPOINTEE"), (4, 5, "TITLE")], None)
    assert search.parse_markup("a [] b")[3] == "empty brackets" and search.parse_markup(None)[0] is None
    marked = spark.createDataFrame([(4, 0, "[AGENT Apple] [# appoints] Tim")], "doc_id long, sent_id int, raw string").select("doc_id", "sent_id", search.markup("raw").alias("m")).select("doc_id", "sent_id", "m.*")
    wanted = search.searched_args(found, marked)
    assert [tuple(r) for r in wanted.collect()] == [("appoint", "SUBJECT", "AGENT")]
    hits = search.search(found, wanted)
    assert {(r.doc_id, tuple(r.found.items())) for r in hits.collect()} == {(d, (("AGENT", "Apple"),)) for d in (1, 2, 3, 4)}
    assert search.search(found, wanted, 2).count() == 2


def test_verb_nouns(spark, tokens):
    lines = spark.createDataFrame([("abandon_V%1#abandonment_N%2#abandoned_AJ%3",), ("appoint_V%1#appointment_N%1",)], "value string")
    pairs = verbnouns.family_pairs(lines)
    assert {tuple(r) for r in pairs.collect()} == {("abandon", "abandonment"), ("appoint", "appointment")}
    counts = spark.createDataFrame([("appoint", 3)], "verb string, n long")
    pairs = pairs.unionByName(spark.createDataFrame([("apply", "appointment")], "verb string, noun string"))
    known = verbnouns.mapping(pairs, counts)
    assert {r.verb for r in known.filter("noun = 'appointment' and is_primary").collect()} == {"appoint"}
    assert tuple(verbnouns.predicate_counts(tokens, known).first()) == (1, 3)
    assert {r.verb: r.forms for r in verbnouns.all_forms(known).collect()}["appoint"] == ["appoint", "appointment"]


def test_samples_and_markers(spark, found, tokens):
    rows = datasets.arg_samples(found).collect()
    assert {(r.sentence, r.arg, r.label) for r in rows if r.is_verb} == {("Apple appoints Tim", "Apple", "SUBJECT"), ("Apple appoints Tim", "Tim", "OBJECT")}
    nominals = spark.createDataFrame([("appointment", "VERB-NOM")], "noun string, type string")
    got = datasets.noun_samples(tokens, nominals, spark.createDataFrame([("appoint", "appointment")], "verb string, noun string"))
    assert {r.label: r.n for r in datasets.label_counts(got).collect()} == {"VERB-NOM": 3, "NOT-NOM": 1}
    words = F.array(*[F.lit(x) for x in "abcd"])
    got = spark.range(1).select(datasets.insert_markers(words, F.lit(2), F.lit(4), F.lit(0)).alias("x"), datasets.insert_markers(words, F.lit(0), F.lit(1), F.lit(3)).alias("y")).first()
    assert got.x == ["<pred>", "a", "<pred>", "b", "<arg>", "c", "d", "<arg>"] and got.y == ["<arg>", "a", "<arg>", "b", "c", "<pred>", "d", "<pred>"]
    tasks = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5)], "task string, k long")
    assert sorted((r.task, r.turn, r.k) for r in datasets.balanced(tasks, "task", "k").collect()) == [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("b", 0, 4), ("b", 1, 5), ("b", 2, 4)]


def test_samples_test_pp1_and_pp2_apart(spark, found):
    """One PP1 span and one PP2 span give a row each; an argument on the predicate gives none."""
    base = found.filter("is_verb").limit(1)
    kind = base.schema["args"].dataType.simpleString()
    one = lambda name, i: f"named_struct('name', '{name}', 'type', 'PP', 'head_i', {i}, 'position', null, 'start', {i}, 'end', {i} + 1, 'text', 't')"
    given = base.withColumn("args", F.expr(f"cast(array({one('PP1', 0)}, {one('PP2', 2)}, {one('SUBJECT', 1)}) as {kind})")).withColumn("pred_i", F.lit(1))
    assert sorted((r.arg_head_idx, r.label) for r in datasets.arg_samples(given).collect()) == [(0, "PP"), (2, "PP")]



def test_roles(spark):
    rows = [("Tim", "OBJECT", -0.1), ("Tim", "SUBJECT", -3.0), ("Tim", "NONE", -4.0), ("Apple", "OBJECT", -1.0), ("Apple", "SUBJECT", -1.2), ("Apple", "NONE", -2.0), ("x", "NONE", -0.1), ("x", "SUBJECT", -3.0)]
    scores = spark.createDataFrame([(1, *r) for r in rows], "p int, cand string, label string, logp double")
    assert {(r.cand, r.label) for r in roles.assigned(scores, ["p"]).collect()} == {("Tim", "OBJECT"), ("Apple", "SUBJECT")}
    got = spark.range(1).select(columns.log_softmax(F.array(F.lit(0.0), F.lit(0.0), F.lit(None).cast("double"))).alias("x")).first().x
    assert got[0] == pytest.approx(-0.6931, abs=1e-4) and got[2] is None


def test_lexicons(spark, tmp_path):
    (tmp_path / "x.lisp").write_text('(NOM :ORTH "abandonment" :VERB "abandon" :NOM-TYPE ((VERB-NOM)) :VERB-SUBC ((NOM-NP :OBJECT ((DET-POSS) (PP-OF)))))\n(NOM :ORTH "abandonment2" :VERB "abandon x")(VERB :ORTH "y")')
    got = {r.entry_key: r for r in lisp.entries(spark, str(tmp_path)).collect()}
    assert set(got) == {"abandonment", "abandonment#2"} and got["abandonment"].next_key == "abandonment#2" and got["abandonment#2"].verb == "abandon"
    assert json.loads(got["abandonment"].raw) == {"ORTH": "abandonment", "VERB": "abandon", "NOM-TYPE": {"VERB-NOM": {}}, "VERB-SUBC": {"NOM-NP": {"OBJECT": {"DET-POSS": {}, "PP-OF": {}}}}}
    one = spark.range(1).select(
        *[lexicons.without_part(F.lit(x)).alias(x) for x in ("VERB-PART", "NOM-PART-NP", "NOM-PART", "SUBJECT-PART")],
        *[lexicons.verb_type(F.lit(x)).alias(x) for x in ("NOM-NP-TO-NP", "NOM-NP-PP", "NOM-PP")],
        lexicons.position_list(columns.strings("PP-OF", "*NONE*", "p-loc")).alias("p"),
        lexicons.extended(F.lit("WH-S"), columns.strings("of", "what"), F.lit(False)).alias("w"),
    ).first()
    assert list(one)[:7] == ["VERB-NOM", "NOM-NP", "NOM-INTRANS", "SUBJECT", "DITRANSITIVE", "TRANSITIVE", "INTRANSITIVE"]
    assert one.p[:2] == ["of", "OPTIONAL-POSITION"] and len(one.p) == 23 and one.w == ["of whether", "of what", "what"]
    assert lexicons.audit(lex(spark)).count() == 0
    default = lexicons.with_default(lex(spark)).filter("subcat = 'DEFAULT' and not is_verb").first()
    assert [a.type for a in default.args] == ["OBJECT", "SUBJECT"] and default.required == []
    entries = spark.createDataFrame([("take-off", "take", ["VERB-NOM", "SUBJECT"], ["ALTERNATES-OPT"], ["in"])], "orth string, verb string, nom_types array<string>, features array<string>, particles array<string>")
    assert lexicons.split_entries(entries).count() == 16


def test_unused_span_has_all_words_between_its_bounds(spark):
    """A subtree with a gap: `by action , of it` where the comma hangs on the root."""
    line = "creation NOUN NN root 0|by ADP IN case 2|action NOUN NN nmod 0|, PUNCT PUNCT root 3|of ADP IN case 5|it NOUN NN nmod 2"
    rows = [(1, 0, i, t.split()[0], *t.split()[:1], *t.split()[1:4], int(t.split()[4])) for i, t in enumerate(line.split("|"))]
    tree = trees.trees(spark.createDataFrame(rows, "doc_id long, sent_id int, i int, orth string, lemma string, pos string, tag string, dep string, head int"))
    found = tree.select("*", F.lit(0).alias("pred_i"), F.lit(False).alias("is_verb"), F.array().cast(f"array<{extract.MATCH}>").alias("xs"))
    got = datasets.unused_spans(found, ["by"]).first().unused
    assert [(u.start, u.end, u.text, u.head_i) for u in got] == [(1, 6, "by action , of it", 2)]


def test_noun_samples_read_tokens_once(spark, tokens):
    nominals = spark.createDataFrame([("appointment", "VERB-NOM")], "noun string, type string")
    got = datasets.noun_samples(tokens, nominals, spark.createDataFrame([("appointment",), ("other",)], "noun string"))
    assert {(r.lemma, r.label) for r in got.collect()} == {("appointment", "VERB-NOM"), ("house", "NOT-NOM")}
    assert str(got._jdf.queryExecution().optimizedPlan()).count("Join") == 1


def test_combined_samples_by_sentence(spark, parsed):
    """Certain nouns give arguments and their types, uncertain ones with a verb nothing, all others NOT-NOM; verbs give arguments anyway."""
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    certain, nominals = table([("appointment",), ("appointment",)], "noun string"), table([("appointment", "VERB-NOM"), ("house", "VERB-NOM")], "noun string, type string")
    verbs = table([("appointment", "nominate"), ("appointment", "appoint")], "noun string, verb string")
    words = parsed.select("doc_id", "sent_id", F.explode("toks").alias("t")).select("doc_id", "sent_id", F.lower("t.orth").alias("noun"))

    def rows(certain, nominals, verbs):
        sents = parsed.join(datasets.known_nouns(words, certain, nominals, verbs), trees.SENTENCE, "left").withColumn("ts", F.col("toks"))
        preds = extract.predicates(sents, lex(spark), lambda t: (t["pos"] == "VERB") | datasets.is_certain(t))
        found = extract.chosen(datasets.unused_samples(extract.spans(extract.structures(extract.matches(preds), largest=True), trim=False), ["of", "by"]))
        return datasets.combined_samples(found, sents).collect()

    got = rows(certain, nominals, verbs)
    assert {(r.sentence, r.predicate_idx, r.verb, r.label) for r in got if r.tagset_type == "NOUNS"} == {
        *((s, i, "appoint", "VERB-NOM") for s, i in (("The appointment of Tim by Apple", 1), ("Apple 's appointment of Tim", 2), ("Apple Tim appointment", 2))), ("a house", 1, "NOT-NOM", "NOT-NOM"),
    }
    args = {(r.sentence, r.arg, r.label, r.is_verb) for r in got if r.tagset_type == "ARGS"}
    assert ("Apple appoints Tim", "Tim", "OBJECT", True) in args and ("The appointment of Tim by Apple", "of Tim", "OBJECT", False) in args and len(args) == 8
    got = rows(certain.limit(0), nominals, verbs.unionByName(table([("house", None)], "noun string, verb string")))
    assert {(r.tagset_type, r.is_verb) for r in got} == {("ARGS", True)}


def test_combined_samples_deal_no_trees(spark, capsys):
    """Sentences, words and keys are shuffled, neither tokens nor trees."""
    registry.queries()["combined_samples"](spark, "/root/testdata/sf0.001").explain("formatted")
    dealt = re.findall(r"\) (?:BroadcastExchange|Exchange)\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out)
    assert dealt and not re.search(r"\b(toks|ts|xs|orth|args)#", " ".join(dealt))


def test_combined_samples_parse_in_all_tasks(spark, capsys):
    """The join of sentences doesn't take the place of their deal to all tasks, which Spark would put in few by bytes."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        registry.queries()["combined_samples"](spark, "/root/testdata/sf0.001").explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert capsys.readouterr().out.count("REPARTITION_BY_NUM") == 2
