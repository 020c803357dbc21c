"""The map between verbs and the nouns derived from them, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def family_pairs(lines: DataFrame) -> DataFrame:
    """(verb, noun) of word families, one a line: `word_V%1#word_N%2`."""
    members = lines.select(F.split(F.regexp_replace("value", r"\d", ""), "#").alias("m"))
    of = lambda tag: F.transform(F.filter("m", lambda w: w.endswith(tag)), lambda w: F.replace(w, F.lit(tag), F.lit("")))
    return members.select(F.explode(of("_V%")).alias("verb"), "m").select("verb", F.explode(of("_N%")).alias("noun")).distinct()


def lexicon_pairs(entries: DataFrame) -> DataFrame:
    """(verb, noun) of entries (orth, verb, singular_key), without the default entry and plurals."""
    own = lambda c: F.get(F.split(c, "#"), F.lit(0))
    return entries.filter("orth <> 'DEFAULT' and singular_key is null").select(own("verb").alias("verb"), own("orth").alias("noun")).distinct()


def mapping(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """verb, noun, is_primary: primary is the noun's most frequent verb in `counts` (verb, n), the first by name of equals."""
    known = pairs.distinct().join(counts.select("verb", "n"), "verb", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = known.groupBy("noun").agg(F.min(F.struct((-F.col("n")).alias("n"), "verb"))["verb"].alias("primary"))
    return known.join(best, "noun").select("verb", "noun", (F.col("verb") == F.col("primary")).alias("is_primary"))


def suitable_verbs(tokens: DataFrame, verb_nouns: DataFrame) -> DataFrame:
    """Tokens with suitable_verb: a known verb's lemma, a noun's primary verb, or null."""
    verbs = verb_nouns.select(F.col("verb").alias("_lemma")).distinct().withColumn("_pos", F.lit("VERB")).withColumn("suitable_verb", F.col("_lemma"))
    nouns = verb_nouns.filter("is_primary").select(F.col("noun").alias("_lemma"), F.lit("NOUN").alias("_pos"), F.col("verb").alias("suitable_verb"))
    both = verbs.unionByName(nouns)
    return tokens.join(both, (F.lower(tokens.lemma) == both["_lemma"]) & (tokens.pos == both["_pos"]), "left").drop("_lemma", "_pos")


def all_forms(verb_nouns: DataFrame) -> DataFrame:
    """verb and forms: its nouns and itself, ascending."""
    return verb_nouns.groupBy("verb").agg(F.sort_array(F.array_union(F.collect_set("noun"), F.array(F.first("verb")))).alias("forms"))


def possible_types(verb_nouns: DataFrame, verb_types: DataFrame, nom_types: DataFrame) -> DataFrame:
    """verb, verb_types and nom_types (ascending, NONE where there are none) from (verb, type) and (noun, type) rows."""
    of_verbs = verb_types.groupBy("verb").agg(F.sort_array(F.collect_set("type")).alias("verb_types"))
    of_nouns = verb_nouns.join(nom_types, "noun").groupBy("verb").agg(F.sort_array(F.collect_set("type")).alias("nom_types"))
    none = F.array(F.lit("NONE"))
    every = verb_nouns.select("verb").distinct().join(of_verbs, "verb", "left").join(of_nouns, "verb", "left")
    return every.select("verb", F.coalesce("verb_types", none).alias("verb_types"), F.coalesce("nom_types", none).alias("nom_types"))


def predicate_counts(tokens: DataFrame, verb_nouns: DataFrame) -> DataFrame:
    """One row: n_verbs and n_nouns, tokens that are known verbs and nouns."""
    found = suitable_verbs(tokens, verb_nouns).filter("suitable_verb is not null")
    return found.agg(F.count_if(F.col("pos") == "VERB").alias("n_verbs"), F.count_if(F.col("pos") == "NOUN").alias("n_nouns"))
