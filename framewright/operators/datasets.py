"""Training rows from extractions and nouns, and the samplers over two tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright import constants as C
from framewright.functions.columns import first, let, strings
from framewright.operators.extract import PREDICATE
from framewright.operators.trees import SENTENCE, children

SAMPLE = "sentence string, predicate_idx int, predicate_lemma string, is_verb boolean, verb string, arg_head_idx int, arg_start_idx int, arg_end_idx int, arg string, label string, tagset_type string"


def arg_samples(found: DataFrame) -> DataFrame:
    """A training row for each argument whose span has one type and whose type has one span among a predicate's extractions, without arguments on the predicate itself; PP1 and PP2 are tested apart and named PP."""
    renamed = F.when(F.col("label").isin("PP1", "PP2"), "PP").otherwise(F.col("label"))
    text = F.array_join(F.transform("toks", lambda t: t["orth"]), " ")
    rows = found.select(*PREDICATE, "is_verb", "verb", text.alias("sentence"), F.get("toks", F.col("pred_i"))["lemma"].alias("predicate_lemma"), F.explode("args").alias("a")).withColumn("label", F.col("a.name"))
    rows = rows.filter(renamed.isin(C.LABELS)).select("*", "a.head_i", "a.start", "a.end", "a.text").drop("a").distinct()
    by_span, by_label = W.partitionBy(*PREDICATE, "start", "end"), W.partitionBy(*PREDICATE, "label")
    one = lambda c, w: (F.min(c).over(w) == F.max(c).over(w))
    kept = rows.withColumn("_ok", one("label", by_span) & one("start", by_label) & one("end", by_label)).filter("_ok and head_i <> pred_i").withColumn("label", renamed)
    return kept.select("sentence", F.col("pred_i").alias("predicate_idx"), "predicate_lemma", "is_verb", "verb", F.col("head_i").alias("arg_head_idx"), F.col("start").alias("arg_start_idx"), F.col("end").alias("arg_end_idx"), F.col("text").alias("arg"), "label", F.lit("ARGS").alias("tagset_type"))


def plain_nouns(tokens: DataFrame) -> DataFrame:
    """Common nouns of ASCII letters with hyphens inside at most."""
    return tokens.filter(is_plain_noun(F.col))


def is_plain_noun(of: Callable[[str], Column]) -> Column:
    """Whether a token, whose fields `of` gives, is one of `plain_nouns`."""
    return (of("pos") == "NOUN") & ~of("tag").isin("NNPS", "NNS") & (of("lemma") != "-PRON-") & of("orth").rlike("^[A-Za-z]+(-+[A-Za-z]+)*$")


def noun_samples(tokens: DataFrame, nominals: DataFrame, verb_nouns: DataFrame) -> DataFrame:
    """doc_id, sent_id, i, lemma, label: the type of nouns in `nominals` (noun, type), NOT-NOM for nouns that no verb is known for."""
    # Both tables in one, so that the tokens are read once: the types of a noun, none for a noun that has a verb but no type.
    named = nominals.select("noun", F.col("type").alias("_type")).unionByName(verb_nouns.select("noun", F.lit(None).cast("string").alias("_type")))
    known = named.groupBy("noun").agg(F.collect_list("_type").alias("_types"))
    nouns = plain_nouns(tokens).withColumn("noun", F.lower("orth")).join(known, "noun", "left")
    label = F.explode(F.coalesce("_types", F.array(F.lit("NOT-NOM"))))
    return nouns.select("doc_id", "sent_id", "i", "lemma", label.alias("label")).filter(F.col("label").isin(C.LABELS))


def label_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def write_samples(samples: DataFrame, path: str) -> None:
    """Tab-separated files without a header; empty strings stay empty strings. An existing path is left as it is."""
    samples.write.mode("ignore").option("sep", "\t").option("emptyValue", "").csv(path)


def read_samples(spark, path: str) -> DataFrame:
    """Rows of write_samples, empty strings kept."""
    return spark.read.schema(SAMPLE).option("sep", "\t").csv(path).fillna("")


def balanced(rows: DataFrame, task: str, order: str) -> DataFrame:
    """Both tasks at the size of the larger one, `turn` by turn: rows of the smaller task repeat in order, all equally often or once more."""
    sizes = rows.groupBy(task).agg(F.count(F.lit(1)).alias("_n"))
    top = sizes.agg(F.max("_n").alias("_top"))
    numbered = rows.withColumn("_row", F.row_number().over(W.partitionBy(task).orderBy(order)) - 1).join(sizes, task).crossJoin(F.broadcast(top))  # one row
    times = F.floor((F.col("_top") - 1 - F.col("_row")) / F.col("_n"))
    return numbered.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), times))).withColumn("turn", F.col("_row") + F.col("_k") * F.col("_n")).drop("_row", "_n", "_top", "_k")


def certain_nouns(lexicon: DataFrame) -> DataFrame:
    """noun: words of compiled nouns and plurals none of whose entries can be a common noun; a plural of a noun that is common in the plural is none."""
    common = F.arrays_overlap("nouns", strings("EXISTS", "RARE-NOUN", "RARE-NOM")) | ((F.col("kind") == "plural") & F.array_contains("nouns", "PLUR-ONLY"))
    return lexicon.filter("kind <> 'verb'").groupBy(F.lower("orth").alias("noun")).agg(F.bool_and(~common).alias("ok")).filter("ok").select("noun")


def unused_spans(found: DataFrame, prepositions: list[str]) -> DataFrame:
    """Adds `unused`: (start, end, text, head_i) of nominal children of the predicate that the extraction does not use.

    Modifiers and clauses count only if they begin with one of the prepositions. The text has all words between the subtree's bounds,
    also those of other subtrees.
    """
    toks, pred = F.col("toks"), F.col("pred_i")
    links = lambda t: F.when(F.col("is_verb"), t["dep"].isin("nsubj", "iobj", "dobj", "nmod:poss", "nsubjpass", "nmod")).otherwise(t["dep"].isin("nmod", "compound", "acl"))
    begins = lambda t: F.exists(strings(*prepositions), lambda p: F.concat(t["text"], F.lit(" ")).startswith(F.concat(p, F.lit(" "))))
    free = lambda t: ~F.exists("xs", lambda x: x["head_i"] == t["i"])
    ok = lambda t: links(t) & (t["i"] != pred) & t["pos"].startswith("N") & free(t) & (~t["dep"].isin("nmod", "acl") | begins(t))
    words = lambda lo, hi: F.array_join(F.transform(F.slice(toks, lo + 1, hi - lo + 1), lambda t: t["orth"]), " ")
    bounded = lambda t, lo, hi: F.struct(lo.alias("start"), (hi + 1).alias("end"), words(lo, hi).alias("text"), t["i"].alias("head_i"))
    span = lambda t: bounded(t, F.array_min(t["subtree"]), F.array_max(t["subtree"]))
    return found.withColumn("unused", F.transform(F.filter(children(toks, pred), ok), span))


def known_nouns(words: DataFrame, certain: DataFrame, nominals: DataFrame, verb_nouns: DataFrame) -> DataFrame:
    """doc_id, sent_id and known: of a sentence's words (doc_id, sent_id, noun) those in a table, each once, with `sure` for certain ones.

    types are those of `nominals` (noun, type) for certain nouns, none for a noun that has a verb but no type, null for one without either;
    verb is the first by name in `verb_nouns` (noun, verb).
    """
    row = lambda kind, type, verb: ["noun", F.lit(kind).alias("_kind"), type.cast("string").alias("_type"), verb.cast("string").alias("_verb")]
    null = F.lit(None)
    named = certain.select(*row("sure", null, null)).unionByName(nominals.select(*row("type", F.col("type"), null))).unionByName(verb_nouns.select(*row("verb", null, F.col("verb"))))
    has = lambda kind: F.count_if(F.col("_kind") == kind) > 0
    found = named.groupBy("noun").agg(has("sure").alias("sure"), has("type").alias("_typed"), has("verb").alias("_verbal"), F.collect_list("_type").alias("_types"), F.min("_verb").alias("verb"))
    types = F.when(F.col("sure") & F.col("_typed"), F.col("_types")).when(F.col("_verbal"), strings())
    # Written words are so few bytes that Spark would broadcast millions of them.
    return words.join(found.withColumn("types", types).hint("merge"), "noun").groupBy(*SENTENCE).agg(F.collect_set(F.struct("noun", "sure", "types", "verb")).alias("known"))


def is_certain(t: Column) -> Column:
    """Whether the form of a token is certain by its sentence's `known`."""
    return F.exists(F.coalesce("known", F.array()), lambda x: (x["noun"] == F.lower(t["orth"])) & x["sure"])


def sentence_text(toks: Column) -> Column:
    return F.array_join(F.transform(toks, lambda t: t["orth"]), " ")


def unused_samples(found: DataFrame, prepositions: list[str]) -> DataFrame:
    """Extractions with what `combined_samples` asks of them instead of their trees: sentence, predicate_lemma and unused spans."""
    lemma = F.get("toks", F.col("pred_i"))["lemma"]
    return unused_spans(found, prepositions).withColumn("sentence", sentence_text(F.col("toks"))).withColumn("predicate_lemma", lemma).drop("toks")


def combined_samples(found: DataFrame, sents: DataFrame) -> DataFrame:
    """The whole dataset of arguments and nouns (SAMPLE): arguments of verbs and of certain nouns, unused candidates as NONE, and nouns.

    `found` are the extractions of these predicates, chosen among `unused_samples`; `sents` have a row each with their tokens `ts` and
    `known_nouns`, so that no token or tree is dealt anew. A span with a type besides NONE loses NONE; then it must have one type, and
    its type, if not NONE, one span. Arguments on the predicate are left out. Noun rows have no argument (-1) and the task NOUNS.
    """
    arg = F.transform(F.filter("args", lambda a: a["name"].isNotNull()), lambda a: F.struct(a["name"].alias("label"), a["start"].alias("start"), a["end"].alias("end"), a["text"].alias("text"), a["head_i"].alias("head_i")))
    none = F.transform("unused", lambda u: F.struct(F.lit("NONE").alias("label"), u["start"].alias("start"), u["end"].alias("end"), u["text"].alias("text"), u["head_i"].alias("head_i")))
    rows = found.select(*PREDICATE, "is_verb", "verb", "sentence", "predicate_lemma", F.explode(F.concat(arg, none)).alias("a")).select("*", "a.*").drop("a").distinct()
    renamed = F.when(F.col("label").isin("PP1", "PP2"), "PP").otherwise(F.col("label"))
    rows = rows.filter(renamed.isin(C.LABELS))
    by_span, by_label = W.partitionBy(*PREDICATE, "start", "end"), W.partitionBy(*PREDICATE, "label")
    rows = rows.withColumn("_one_span", (F.min("start").over(by_label) == F.max("start").over(by_label)) & (F.min("end").over(by_label) == F.max("end").over(by_label)))
    typed = F.count_if(F.col("label") != "NONE").over(by_span) > 0
    rows = rows.withColumn("_typed", typed).filter("not _typed or label <> 'NONE'").withColumn("_one_type", F.min("label").over(by_span) == F.max("label").over(by_span))
    kept = rows.filter("_one_type and (label = 'NONE' or _one_span) and head_i <> pred_i").withColumn("label", renamed)
    args = kept.select("sentence", F.col("pred_i").alias("predicate_idx"), "predicate_lemma", "is_verb", "verb", F.col("head_i").alias("arg_head_idx"), F.col("start").alias("arg_start_idx"), F.col("end").alias("arg_end_idx"), F.col("text").alias("arg"), "label", F.lit("ARGS").alias("tagset_type"))
    nouns = _noun_rows(sents)
    minus = F.lit(-1)
    return args.unionByName(nouns.select("sentence", F.col("i").alias("predicate_idx"), F.col("lemma").alias("predicate_lemma"), F.lit(False).alias("is_verb"), "verb", minus.alias("arg_head_idx"), minus.alias("arg_start_idx"), minus.alias("arg_end_idx"), F.lit("").alias("arg"), "label", F.lit("NOUNS").alias("tagset_type")))


def _noun_rows(sents: DataFrame) -> DataFrame:
    """sentence, i, lemma, verb and label of plain nouns, by their sentence's `known`: NOT-NOM, also as their verb, for those without types and verb."""
    entry = lambda word: first(F.filter(F.coalesce("known", F.array()), lambda x: x["noun"] == word))
    labels = lambda t: F.filter(F.coalesce(entry(F.lower(t["orth"]))["types"], strings("NOT-NOM")), lambda x: x.isin(C.LABELS))
    row = lambda t, label, verb: F.struct(t["i"].alias("i"), t["lemma"].alias("lemma"), F.when(label == "NOT-NOM", "NOT-NOM").otherwise(verb).alias("verb"), label.alias("label"))
    of = lambda t: let(entry(t["lemma"])["verb"], lambda verb: F.transform(labels(t), lambda label: row(t, label, verb)))
    nouns = F.flatten(F.transform(F.filter("ts", lambda t: is_plain_noun(lambda c: t[c])), of))
    # A generator computes text and nouns once a sentence.
    once = sents.select(F.explode(F.array(F.struct(sentence_text(F.col("ts")).alias("sentence"), nouns.alias("nouns")))).alias("s"))
    return once.select("s.sentence", F.explode("s.nouns").alias("n")).select("sentence", "n.*")


def split_by_task(rows: DataFrame, task: str = "tagset_type") -> tuple[DataFrame, DataFrame]:
    """The rows of the arguments' task (ARGS) and those of any other; rows without a task are in neither."""
    return rows.filter(F.col(task) == "ARGS"), rows.filter(F.col(task) != "ARGS")


def insert_markers(words, arg_start, arg_end, pred_i):
    """The words with <arg> around [arg_start, arg_end) and <pred> around the predicate, which must not lie inside the argument."""
    n = F.size(words)
    cut = lambda s, e: F.slice(words, s + 1, e - s)
    marked = lambda tag, s, e: F.concat(F.array(F.lit(tag)), cut(s, e), F.array(F.lit(tag)))
    arg, pred = marked("<arg>", arg_start, arg_end), marked("<pred>", pred_i, pred_i + 1)
    zero = F.lit(0)
    return F.when(pred_i < arg_start, F.concat(cut(zero, pred_i), pred, cut(pred_i + 1, arg_start), arg, cut(arg_end, n))).otherwise(F.concat(cut(zero, arg_start), arg, cut(arg_end, pred_i), pred, cut(pred_i + 1, n)))
