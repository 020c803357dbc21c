"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

Toxic documents go, one document of each near-duplicate group stays, repeated passages are cut, words of benchmark windows are
cut, and what is left is encoded. Each stage works on all that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framewright import scratch
from framewright.llm import bpe, decontaminate, jaccard, repeats, toxicity

#: Near duplicates in the pipeline: words in a shingle, least similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Words that an encoding worker remembers: fewer than alone, as the other stages run in the same workers.
REMEMBERED = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not find toxic; null and empty texts stay, rows go by their own text."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by likeness, that with the smallest doc_id; those without words all stay."""
    return jaccard.deduplicated(docs, SHINGLE, PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte strings of 400 or more that occur elsewhere too; nulls stay null."""
    return repeats.without_repeats(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that benchmark windows cover and the separators after them; nulls stay null."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), remove="spans")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the decoded bytes of every document left; null is the empty text."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, REMEMBERED)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", cut_benchmark),
    ("byte_bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written, and its predecessor's table deleted then; an empty table gives no rows."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.written(stage(spark, before, sf_dir), f"pipeline-{name}")
        if name != STAGES[0][0]:
            scratch.discard(before)
        before = docs
    return docs
