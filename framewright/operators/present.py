"""Extractions as tag lines, mentions, dictionaries and the most informative event of each sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions.columns import first, let, subset_of
from framewright.operators.extract import PREDICATE
from framewright.operators.trees import SENTENCE


def first_extraction(found: DataFrame) -> DataFrame:
    """Adds n_extractions and keeps the first extraction of each predicate (by subcategorization, then by arguments)."""
    w = W.partitionBy(*PREDICATE)
    order = w.orderBy("subcat", F.to_json("args"))
    return found.withColumn("n_extractions", F.count(F.lit(1)).over(w)).withColumn("_row", F.row_number().over(order)).filter("_row = 1").drop("_row")


def _line(tag) -> Column:
    own = lambda t: first(F.filter("args", lambda a: (a["start"] <= t["i"]) & (t["i"] < a["end"])))
    word = lambda t: F.concat(t["orth"], F.lit("/"), let(own(t), lambda a: tag(t["i"], a)))
    return F.array_join(F.transform("toks", word), " ")


def iob(found: DataFrame) -> DataFrame:
    """doc_id, sent_id, pred_i and a line of word/TAG: B- and I- of each argument, VERB or NOM on the predicate."""
    own = F.when(F.col("is_verb"), "VERB").otherwise("NOM")
    tag = lambda i, a: F.when(a.isNotNull(), F.concat(F.when(a["start"] == i, "B-").otherwise("I-"), a["name"])).when(i == F.col("pred_i"), own).otherwise("O")
    return first_extraction(found).select(*PREDICATE, _line(tag).alias("line"))


def iobes(found: DataFrame) -> DataFrame:
    """As `iob`, with S- for single words and E- for last ones; a predicate inside an argument keeps its own tag behind it."""
    own = F.when(F.col("is_verb"), "VERB").otherwise("NOM")

    def tag(i, a):
        place = F.when(a["end"] - a["start"] == 1, "S-").when(a["start"] == i, "B-").when(a["end"] - 1 == i, "E-").otherwise("I-")
        here = i == F.col("pred_i")
        return F.when(a.isNotNull(), F.concat(place, a["name"], F.when(here, F.concat(F.lit("-"), own)).otherwise(""))).when(here, F.concat(F.lit("O-"), own)).otherwise("O")

    return first_extraction(found).select(*PREDICATE, _line(tag).alias("line"))


def as_strings(found: DataFrame) -> DataFrame:
    """doc_id, sent_id, predicate (its text) and the JSON list of {name: text}; of predicates with one text the last one stays."""
    each = F.to_json(F.map_from_entries(F.transform(F.filter("args", lambda a: a["name"].isNotNull()), lambda a: F.struct(a["name"], a["text"]))))
    per = found.groupBy(*PREDICATE).agg(F.first(F.get("toks", F.col("pred_i"))["orth"]).alias("predicate"), F.sort_array(F.collect_list(each)).alias("all"))
    text = F.concat(F.lit("["), F.array_join("all", ","), F.lit("]"))
    return per.groupBy(*SENTENCE, "predicate").agg(F.max_by(text, "pred_i").alias("extractions"))


def mentions(found: DataFrame, left_shift: int = 0) -> DataFrame:
    """A row for each predicate: event_id in the sentence, argument_id of its first argument, the event's bounds and label, and JSON.

    Identifiers run through the sentence in order of the predicates; an event takes one for each argument and one for its trigger.
    """
    one = first_extraction(found)
    w = W.partitionBy(*SENTENCE).orderBy("pred_i")
    before = F.coalesce(F.sum(F.size("args") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    one = one.withColumn("event_id", F.row_number().over(w) - 1).withColumn("argument_id", before.cast("int"))
    label = F.when(F.col("n_extractions") > 1, F.concat("verb", F.lit(" ("), F.col("n_extractions"), F.lit(")"))).otherwise(F.col("verb"))
    at = F.concat(F.array("pred_i"), F.flatten(F.transform("args", lambda a: F.array(a["start"], a["end"] - 1))))
    text_id = lambda k: F.concat(F.lit("T:"), F.col("sent_id"), F.lit(","), F.col("event_id"), F.lit(","), F.col("argument_id") + k)
    inner = F.transform("args", lambda a, k: F.struct(F.lit("TextBoundMention").alias("type"), text_id(k).alias("id"), a["name"].alias("argument"), a["text"].alias("text"), F.struct((a["start"] + left_shift).alias("start"), (a["end"] + left_shift).alias("end")).alias("tokenInterval")))
    trigger = F.struct(F.lit("TextBoundMention").alias("type"), text_id(F.size("args")).alias("id"), F.get("toks", F.col("pred_i"))["orth"].alias("text"), F.struct((F.col("pred_i") + left_shift).alias("start"), (F.col("pred_i") + left_shift + 1).alias("end")).alias("tokenInterval"))
    event = F.struct(F.lit("EventMention").alias("type"), F.concat(F.lit("R:"), F.col("sent_id"), F.lit(","), F.col("event_id")).alias("id"), F.array(label).alias("labels"), F.col("sent_id").alias("sentence"), F.col("doc_id").alias("document"), trigger.alias("trigger"), inner.alias("arguments"), F.col("is_verb").alias("isVerbRelated"))
    return one.select(*PREDICATE, "is_verb", "event_id", "argument_id", F.size("args").alias("n_args"), label.alias("label"), (F.array_min(at) + left_shift).alias("start"), (F.array_max(at) + left_shift).alias("end"), F.to_json(event).alias("mention"))


def informative_events(events: DataFrame, verbs: bool = True, nouns: bool = True) -> DataFrame:
    """Of each sentence the event with most arguments among verbs and among nouns, the first one of equals; doc_id, sent_id, is_verb, event_id."""
    shown = events.filter((F.col("is_verb") & F.lit(verbs)) | (~F.col("is_verb") & F.lit(nouns)))
    return shown.groupBy(*SENTENCE, "is_verb").agg(F.max_by("event_id", F.struct("n_args", -F.col("event_id"))).alias("event_id"))


def word_offsets(sents: DataFrame, order: str = "sent_id", extra: int = 0) -> DataFrame:
    """Adds first_word: words of the document's sentences before this one, and `extra` marker words for each of them."""
    w = W.partitionBy("doc_id").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return sents.withColumn("first_word", F.coalesce(F.sum(F.size(F.split("sentence", " ")) + extra).over(w), F.lit(0)).cast("long"))


def without_subsets(found: DataFrame, key: list[str], column: str) -> DataFrame:
    """Of the distinct maps in `column` under a key only those that no other one contains."""
    canon = F.sort_array(F.map_entries(column))
    rows = found.withColumn("_canon", canon).dropDuplicates([*key, "_canon"])
    everything = F.collect_list(F.struct(F.col("_canon").alias("c"), F.map_from_entries("_canon").alias("m"))).over(W.partitionBy(*key))
    return rows.withColumn("_all", everything).filter(~F.exists("_all", lambda o: (o["c"] != F.col("_canon")) & subset_of(F.map_from_entries("_canon"), o["m"]))).drop("_all", "_canon")
