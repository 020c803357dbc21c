"""A written index from lemmas to sentences, and search from bracketed examples through it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright import scratch
from framewright.operators import search
from framewright.operators.trees import SENTENCE

BUCKETS = 256
#: Parts of each bucket, and tasks that write the index.
PARTS, TASKS = 8, 512


def _bucket(lemma):
    return F.pmod(F.xxhash64(lemma), F.lit(BUCKETS)).cast("int")


def written(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """lemma, doc_id, sent_id, bucket of the nouns and verbs of `tokens` (doc_id, sent_id, orth or lemma, pos), a folder for each bucket of lemmas.

    Lemmas are in lower case. A common lemma's rows are dealt out by their sentences too, so that no task holds all of them.
    """
    spark = tokens.sparkSession
    path = path or scratch.new_path(spark, "postings")
    lemma = F.lower("lemma") if "lemma" in tokens.columns else F.lower("orth")
    rows = tokens.filter(F.col("pos").isin("NOUN", "VERB")).select(lemma.alias("lemma"), *SENTENCE).withColumn("bucket", _bucket(F.col("lemma")))
    # Equal rows meet in the one shuffle, as its keys are columns that they share.
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*SENTENCE), F.lit(PARTS))).repartition(TASKS, "bucket", "_part").distinct().drop("_part")
    dealt.write.partitionBy("bucket").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def sentences_with(postings: DataFrame, forms: DataFrame) -> DataFrame:
    """Distinct (doc_id, sent_id) with one of the lemmas of `forms` (lemma); only the folders of their buckets are read."""
    asked = forms.select("lemma").distinct()
    buckets = [r.b for r in asked.select(_bucket(F.col("lemma")).alias("b")).distinct().collect()]  # BUCKETS at most
    return postings.filter(F.col("bucket").isin(buckets) if buckets else F.lit(False)).join(asked, "lemma", "left_semi").select(*SENTENCE).distinct()


def search_from(examples: DataFrame, verb_nouns: DataFrame, postings: DataFrame, extracted: Callable[[DataFrame | None], DataFrame], limited_results: int | None = None) -> DataFrame:
    """Matches of bracketed examples in a corpus: doc_id, sent_id, pred_i, verb and found (label to text).

    `examples`: rows (doc_id, sent_id, raw) with extractions of their own, given by `extracted` of their cleaned texts; see
    `searched`. `extracted(sentences)` extracts from the corpus' sentences of that DataFrame only. Null and unmarked examples ask for nothing.
    """
    asked = scratch.written(examples, "searched")
    forms = asked.select("verb").distinct()
    lemmas = forms.select(F.col("verb").alias("lemma")).unionByName(verb_nouns.join(forms, "verb").select(F.col("noun").alias("lemma")))
    hits = scratch.written(sentences_with(postings, lemmas), "hits")
    return search.search(extracted(hits), asked, limited_results)


def searched(examples: DataFrame, extract_texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """verb, type, label that bracketed examples (doc_id, sent_id, raw) ask for; `extract_texts` extracts from (doc_id, sent_id, sentence)."""
    marked = scratch.written(examples.select(*SENTENCE, search.markup("raw").alias("m")).select(*SENTENCE, "m.*"), "marked")
    usable = marked.filter("error is null and size(predicates) > 0")
    return search.searched_args(extract_texts(usable.select(*SENTENCE, F.col("text").alias("sentence"))), usable)
