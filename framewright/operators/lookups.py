"""Lookups in a compiled lexicon, selection among extractions, and small dataset jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def load_lexicon(spark: SparkSession, path: str, is_verb: bool) -> DataFrame:
    """The verbs' or the nouns' half of a lexicon written as Parquet (with a column is_verb)."""
    return spark.read.parquet(path).filter(F.col("is_verb") == is_verb)


def entry(rows: DataFrame, key: str | None) -> DataFrame:
    """The rows of one entry key; none for an empty or null key."""
    return rows.filter(F.col("entry_key") == key) if key else rows.limit(0)


def base(key: Column) -> Column:
    """A key without its number."""
    return F.regexp_replace(key, r"#\d+$", "")


def chain(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Each key of `keys` (entry_key) with the entries from it to the end of its chain (column `follows`: 0 for itself), by number."""
    number = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"#(\d+)$", 1), F.lit("")).cast("int"), F.lit(1))
    own = rows.select(base(F.col("entry_key")).alias("stem"), number(F.col("entry_key")).alias("at"), F.col("entry_key").alias("found"))
    asked = keys.select("entry_key", base(F.col("entry_key")).alias("stem"), number(F.col("entry_key")).alias("from"))
    return asked.join(own, "stem").filter("at >= from").select("entry_key", "found", (F.col("at") - F.col("from")).alias("follows"))


def suitable_verb(orth: Column, verb: Column, is_verb: Column) -> Column:
    """A verb's own orth or a noun's verb, without a number."""
    return base(F.when(is_verb, orth).otherwise(verb))


def find(tokens: DataFrame, entries: DataFrame, matcher: DataFrame | None = None, limited: list[str] | None = None, using_default: bool = False, be_certain: bool = False) -> DataFrame:
    """The verbs and nouns of `tokens` (orth, lemma, pos) that are predicates, with entry_key, is_verb and suitable (their verb).

    `entries` (entry_key, is_verb, verb, certain; one row an entry) are looked up by a verb's lemma and a noun's form, in lower case; a word
    that isn't there has the key DEFAULT. The matcher (is_verb, word, verb; one verb a word) gives the verb where the entry gives none that
    is among `limited` (any verb, if empty); using_default asks it alone. be_certain leaves out nouns that can be common, as those of DEFAULT.
    """
    is_verb = F.when(F.col("pos") == "VERB", True).when(F.col("pos") == "NOUN", False)
    words = tokens.withColumn("is_verb", is_verb).filter("is_verb is not null").withColumn("_form", F.lower(F.when(F.col("is_verb"), F.col("lemma")).otherwise(F.col("orth"))))
    own = entries.select(F.col("entry_key").alias("_form"), "is_verb", F.when(F.col("is_verb"), base(F.col("entry_key"))).otherwise(base(F.col("verb"))).alias("_verb"), F.col("certain").alias("_certain"), F.lit(True).alias("_known"))
    none = {"_verb": F.lit(None).cast("string"), "_certain": F.lit(None).cast("boolean"), "_known": F.lit(None).cast("boolean")}
    seen = words.withColumns(none) if using_default else words.join(own, ["_form", "is_verb"], "left")
    good = lambda v: F.coalesce((v != "") & (v.isin(limited) if limited else F.lit(True)), F.lit(False))
    verb = F.col("_verb")
    if matcher is not None:
        seen = seen.join(matcher.select("is_verb", F.col("word").alias("_form"), F.col("verb").alias("_matched")), ["_form", "is_verb"], "left")
        verb = F.when(good(F.col("_verb")), F.col("_verb")).otherwise(F.col("_matched"))
    sure = F.col("is_verb") | F.coalesce("_certain", F.lit(False)) if be_certain else F.lit(True)
    key = F.when(F.col("_known"), F.col("_form")).otherwise("DEFAULT")
    return seen.withColumn("suitable", verb).filter(good(F.col("suitable")) & sure).select(*tokens.columns, key.alias("entry_key"), "is_verb", "suitable")


def types_of(rows: DataFrame) -> DataFrame:
    """stem and its distinct types, sorted, over all entries of a chain (entry_key, type)."""
    return rows.groupBy(base(F.col("entry_key")).alias("stem")).agg(F.sort_array(F.collect_set("type")).alias("types"))


def options_by_span(args: DataFrame, keys: list[str]) -> DataFrame:
    """Each candidate's possible types: rows (keys, start, end, type) to keys, start, end, types (distinct, sorted)."""
    return args.groupBy(*keys, "start", "end").agg(F.sort_array(F.collect_set("type")).alias("types"))


def chosen(args: DataFrame, choice: DataFrame, keys: list[str]) -> DataFrame:
    """The arguments whose span has just the type that `choice` (keys, start, end, type) gives it."""
    return args.join(choice.select(*keys, "start", "end", "type").distinct(), [*keys, "start", "end", "type"], "left_semi")


def largest_undominated(items: DataFrame, keys: list[str], greedy: bool = False) -> DataFrame:
    """Of items (keys, id, names: array<string>) those with most names in their group, less those of equal names as one of a smaller id.

    greedy=False keeps items of equal names all, as neither is more general than the other.
    """
    size = F.size("names")
    best = items.withColumn("most", F.max(size).over(W.partitionBy(*keys))).filter(size == F.col("most")).drop("most")
    if not greedy:
        return best
    first = best.groupBy(*keys, F.array_sort(F.array_distinct("names")).alias("same")).agg(F.min("id").alias("id"))
    return best.join(first.drop("same"), [*keys, "id"], "left_semi")


def in_range(spans: DataFrame, low: int, high: int) -> DataFrame:
    """Spans (start, end) that lie in [low, high]."""
    return spans.filter((F.col("start") >= low) & (F.col("end") <= high))


def gathered(rows: DataFrame, key: str, values: str) -> DataFrame:
    """The arrays of each key in one, in no order."""
    return rows.groupBy(key).agg(F.flatten(F.collect_list(values)).alias(values))


def specs(**columns: Column) -> Column:
    """`name: value` of what is not null, joined by commas."""
    return F.concat_ws(", ", *[F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), c.cast("string"))) for k, c in columns.items()])


def ranked_parts(rows: DataFrame, order: str, ranks: int) -> DataFrame:
    """Adds `rank`, 0 to ranks - 1: ranges of the order, split where rows fall by sampled bounds, without a window over all rows."""
    return rows.repartitionByRange(ranks, order).withColumn("rank", F.spark_partition_id())


def paragraphs(articles: DataFrame) -> DataFrame:
    """doc_id, place and text of the paragraphs of marked articles: titles and section headings go, _NEWLINE_ is a line break."""
    each = articles.select("doc_id", F.posexplode(F.split("text", "_START_PARAGRAPH_")).alias("place", "text"))
    each = each.filter(~F.contains("text", F.lit("_START_ARTICLE_")))
    return each.select("doc_id", "place", F.replace(F.split("text", "_START_SECTION_")[0], F.lit("_NEWLINE_"), F.lit("\n")).alias("text"))


def written_once(rows: DataFrame, path: str) -> None:
    """Write unless something is there: a job that has been done stays done."""
    rows.write.mode("ignore").parquet(path)


def save_golden(extractions: DataFrame, path: str) -> None:
    """sentence, predicate and extractions as JSON lines, in the place of what is there."""
    extractions.select("sentence", "predicate", "extractions").write.mode("overwrite").json(path)


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("sentence string, predicate string, extractions array<map<string,string>>").json(path)
