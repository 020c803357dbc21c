"""Sentences and tokens of raw texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"\w+(?:-\w+)*|'s|[^\w\s]"
MIN_WORDS, MAX_WORDS = 4, 34


def clean_sentence(s: Column) -> Column:
    """Underscores to blanks, tabs deleted, runs of white space to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.translate(s, "_\t", " "), r"[\s&&[^ ]]\s*| \s+", " "))  # single blanks are left alone


def is_ascii(s: Column) -> Column:
    return s.rlike(r"^[\x00-\x7F]*$")


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sent_id and the clean sentence, split at points and newlines; empty ones are left out.

    Parts are cleaned before they become rows: filters on the rows would else be pushed below the cleaning and repeat it.
    """
    return docs.select("doc_id", F.posexplode(F.transform(F.split("text", r"[.\n]+"), clean_sentence)).alias("sent_id", "sentence")).filter("sentence <> ''")


def gated(sents: DataFrame) -> DataFrame:
    """Sentences of 4 to 34 words of ASCII letters; their words stand between single blanks."""
    words = F.length("sentence") - F.length(F.replace("sentence", F.lit(" "))) + 1
    return sents.filter(words.between(MIN_WORDS, MAX_WORDS) & is_ascii(F.col("sentence")))


def tokens(sents: DataFrame) -> DataFrame:
    """doc_id, sent_id, i and orth; words keep their hyphens."""
    return sents.select("doc_id", "sent_id", F.posexplode(F.regexp_extract_all("sentence", F.lit(TOKEN), F.lit(0))).alias("i", "orth"))
