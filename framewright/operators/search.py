"""Query by example: marked sentences, the arguments they ask for, and the corpus rows that have them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.operators.extract import PREDICATE
from framewright.operators.present import without_subsets

_SPAN = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("label", T.StringType())
MARKED = T.StructType().add("text", T.StringType()).add("predicates", T.ArrayType(T.IntegerType())).add("args", T.ArrayType(_SPAN)).add("error", T.StringType())
INNERMOST = re.compile(r"\[([^\[\]]*)\]")


def parse_markup(text: str | None) -> tuple:
    """(clean text, predicate indexes, [(first word, last word, label)], error) of `[LABEL words]` and `[# word]`, inner brackets first.

    Indexes count blank-separated words of the text cleaned so far. An empty pair of brackets is an error, null has nothing.
    """
    if text is None:
        return None, [], [], None
    preds, args = [], {}
    while m := INNERMOST.search(text):
        words = m.group(1).split()
        if not words:
            return text, [], [], "empty brackets"
        if len(words) > 1:
            start = len(text[: m.start()].split())
            end = len(text[: m.end()].split()) - 2
            if words[0] == "#" and start == end:
                preds.append(start)
            else:
                args[start, end] = words[0]
        text = text[: m.start()] + " ".join(words[1:]) + text[m.end() :]
    return text, preds, [(s, e, label) for (s, e), label in args.items()], None


@F.pandas_udf(MARKED)
def markup(texts: pd.Series) -> pd.DataFrame:
    """Columns of parse_markup; nested brackets have no regular expression."""
    rows = [parse_markup(x) for x in texts]
    args = [[{"start": s, "end": e, "label": x} for s, e, x in r[2]] for r in rows]
    return pd.DataFrame({"text": [r[0] for r in rows], "predicates": [r[1] for r in rows], "args": args, "error": [r[3] for r in rows]})


def searched_args(found: DataFrame, marked: DataFrame) -> DataFrame:
    """verb, type, label: extracted spans of the examples' marked predicates that stand at a marked span.

    `marked` has doc_id, sent_id and the columns of `markup`.
    """
    wanted = marked.select("doc_id", "sent_id", F.get("predicates", F.lit(0)).alias("pred_i"), F.explode("args").alias("w"))
    spans = found.select(*PREDICATE, "verb", F.explode("args").alias("a")).select(*PREDICATE, "verb", F.col("a.name").alias("type"), F.col("a.start").alias("s"), F.col("a.end").alias("e"))
    joined = spans.join(wanted, PREDICATE).filter("s = w.start and e = w.end + 1")
    return joined.groupBy("verb", "type").agg(F.max("w.label").alias("label"))


def prefiltered(tokens: DataFrame, verb_nouns: DataFrame, searched: DataFrame) -> DataFrame:
    """Tokens of sentences that hold a searched verb or one of its nouns as a lemma, before any costlier step."""
    forms = searched.select("verb").distinct()
    forms = forms.select(F.col("verb").alias("lemma")).unionByName(verb_nouns.join(forms, "verb").select(F.col("noun").alias("lemma"))).distinct()
    hits = tokens.join(forms, "lemma", "left_semi").select("doc_id", "sent_id").distinct()
    return tokens.join(hits, ["doc_id", "sent_id"], "left_semi")


def translated(found: DataFrame, searched: DataFrame) -> DataFrame:
    """doc_id, sent_id, pred_i, verb and found (label to text): searched arguments of each extraction; contained ones go."""
    each = found.withColumn("_x", F.sha1(F.to_json("args"))).select(*PREDICATE, "verb", "subcat", "_x", F.explode("args").alias("a")).withColumn("type", F.col("a.name"))
    pairs = each.join(searched, ["verb", "type"]).groupBy(*PREDICATE, "verb", "subcat", "_x", "label").agg(F.max("a.text").alias("text"))
    maps = pairs.groupBy(*PREDICATE, "verb", "subcat", "_x").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "text")))).alias("found"))
    return without_subsets(maps.drop("subcat", "_x"), [*PREDICATE, "verb"], "found")


def search(found: DataFrame, searched: DataFrame, limited_results: int | None = None) -> DataFrame:
    """The translated extractions, of the first `limited_results` sentences by (doc_id, sent_id) where that is given."""
    hits = translated(found, searched)
    if limited_results is None:
        return hits
    first = hits.select("doc_id", "sent_id").distinct().orderBy("doc_id", "sent_id").limit(limited_results)
    return hits.join(first, ["doc_id", "sent_id"], "left_semi")
