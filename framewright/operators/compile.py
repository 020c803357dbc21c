"""From raw lexicon entries to rows of verbs, nouns and plurals: values in nested entries, prepositions, requirements, copies.

Rows are one for each subcategorization of an entry, as in `subcats.py`; nulls in maps and lists count as empty, other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions.columns import strings
from framewright.operators.lexicons import without_part
from framewright.operators.lookups import base
from framewright.operators.subcats import ARGS, OPTIONAL

#: The number behind a preposition's complement.
SUFFIXES = ("", "1", "2")
# Irregular plurals by ending; those that only whole words have.
IRREGULAR = {"child": "children", "foot": "feet", "goose": "geese", "life": "lives", "man": "men", "mouse": "mice", "person": "people", "tooth": "teeth", "sis": "ses", "thief": "thieves", "wife": "wives"}
WHOLE = {"child", "foot", "goose", "life", "mouse", "person", "tooth"}


def _below(step: str):
    """From JSON to the values under a name, or under all names that start with it if it ends with a hyphen."""
    named = lambda k, _: k.startswith(step) if step.endswith("-") else k == step
    found = lambda x: F.map_values(F.map_filter(F.from_json(x, "map<string,string>"), named))
    return lambda x: F.when(x.startswith("["), F.array(x)).when(x.startswith("{"), found(x)).otherwise(strings())


def special_values(raw: Column, path: list[str]) -> Column:
    """The values under `path` in an entry's JSON, in its order; a step that ends with a hyphen takes all names that start with it.

    A list met on the way is the values. At the end of the path a map gives its names and a text itself; what isn't there gives none.
    """
    level = F.array_compact(F.array(F.trim(raw)))
    for step in path:
        level = F.flatten(F.transform(level, _below(step)))
    names = lambda x: F.map_keys(F.from_json(x, "map<string,string>"))
    return F.flatten(F.transform(level, lambda x: F.when(x.startswith("["), F.from_json(x, "array<string>")).when(x.startswith("{"), names(x)).otherwise(F.array(x))))


def preposition_args(args: Column, is_verb: Column) -> Column:
    """PVAL, PVAL1 and PVAL2 as PP, PP1 and PP2; for nouns PVAL-NOM* replaces them where there is a NOM-ROLE-FOR-PVAL*, whose roles follow."""
    old = [name + s for s in SUFFIXES for name in ("PVAL", "PVAL-NOM", "NOM-ROLE-FOR-PVAL")]
    fresh = {}
    for s in SUFFIXES:
        plain, roles = F.coalesce(args["PVAL" + s], args["PP" + s]), args["NOM-ROLE-FOR-PVAL" + s]
        given = F.concat(F.coalesce(args["PVAL-NOM" + s], plain, strings()), roles)
        fresh["PP" + s] = F.when(~is_verb & roles.isNotNull(), given).otherwise(plain)
    found = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in fresh.items()]))
    return F.map_concat(F.map_filter(args, lambda k, _: ~k.isin(*old, "PP", "PP1", "PP2")), F.map_from_entries(found))


def prepositions(rows: DataFrame) -> DataFrame:
    """`preposition_args` of each row. A subcategorization with PP-PP and without PP2 takes that of PP1, else of PP; one that has neither fails the query."""
    args = preposition_args(F.coalesce("args", F.create_map().cast(ARGS)), F.col("is_verb"))
    missing = F.raise_error(F.concat(F.lit("no preposition for "), F.col("subcat"))).cast("array<string>")
    second = lambda a: F.map_concat(a, F.create_map(F.lit("PP2"), F.coalesce(a["PP1"], a["PP"], missing)))
    return rows.withColumn("args", args).withColumn("args", F.when(F.col("subcat").contains("PP-PP") & ~F.map_contains_key("args", F.lit("PP2")), second(F.col("args"))).otherwise(F.col("args")))


def requirements(rows: DataFrame, defaults: dict[str, list[str]] | str, siblings: str | None = None) -> DataFrame:
    """Required and optional complements from `needs` (map of complement to constraints) and `defaults` (subcat to complements required by it, or a column with these).

    An entry's subcategorizations are gathered from its rows, or given as the column `siblings`.

    Adds det_poss_only and n_n_mod_only, complements required under that constraint only. An optional position wins over `needs` and
    `defaults` and leaves args, as do complements without positions. OBJECT of NOM-NP* is required where the entry has the
    subcategorization without it too, else optional unless required; SUBJECT is optional unless required. Lists are sorted.
    """
    args, needs = F.coalesce("args", F.create_map().cast(ARGS)), F.coalesce("needs", F.create_map().cast(ARGS))
    under = lambda name: F.array_sort(F.map_keys(F.map_filter(needs, lambda _, v: F.array_contains(v, name))))
    part = F.when(F.col("is_verb") & F.map_contains_key(args, F.lit("PARTICLE")), strings("PARTICLE")).otherwise(strings())
    plain = F.map_keys(F.map_filter(needs, lambda _, v: F.size(v) == 0))
    free = F.map_keys(F.map_filter(args, lambda _, v: F.array_contains(v, OPTIONAL)))
    if isinstance(defaults, str):
        usual = F.coalesce(defaults, strings())
    else:
        usual = F.coalesce(F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), strings(*v))])[F.col("subcat")], strings()) if defaults else strings()
    asked = F.array_union(F.array_except(F.array_union(part, plain), free), F.array_except(usual, free))

    name = F.col("subcat")
    siblings = F.collect_set("subcat").over(W.partitionBy("entry_key")) if siblings is None else F.col(siblings)
    without = F.replace(F.replace(name, F.lit("NOM-PART-NP"), F.lit("NOM-PART")), F.lit("NOM-NP-"), F.lit("NOM-"))
    twin = F.when(name == "NOM-NP", strings("NOM-INTRANS", "NOM-INTRANS-RECIP")).when(name == "NOM-NP-AS-NP-SC", strings("NOM-AS-NP")).otherwise(F.array(without))
    object_ = F.when(~without_part(name).startswith("NOM-NP"), "none").when(F.arrays_overlap(twin, F.col("_siblings")), "needed").otherwise("free")

    marked = rows.withColumns({"_siblings": siblings, "_asked": asked, "_free": free, "det_poss_only": under("DET-POSS-ONLY"), "n_n_mod_only": under("N-N-MOD-ONLY")}).withColumn("_object", object_)
    required = F.when(F.col("_object") == "needed", F.array_union("_asked", strings("OBJECT"))).otherwise(F.col("_asked"))
    optional = F.when(F.col("_object") == "needed", F.array_remove("_free", "OBJECT")).when((F.col("_object") == "free") & ~F.array_contains("_asked", "OBJECT"), F.array_union("_free", strings("OBJECT"))).otherwise(F.col("_free"))
    with_subject = F.when(F.array_contains("_asked", "SUBJECT"), optional).otherwise(F.array_union(optional, strings("SUBJECT")))
    left = F.map_filter(F.transform_values(args, lambda _, v: F.array_remove(v, OPTIONAL)), lambda _, v: F.size(v) > 0)
    done = marked.withColumns({"required": F.array_sort(required), "optional": F.array_sort(with_subject), "args": left})
    return done.drop("_siblings", "_asked", "_free", "_object")


def versions(rows: DataFrame) -> DataFrame:
    """Each row once for the verb (is_verb) and once for the noun."""
    return rows.withColumn("is_verb", F.explode(F.array(F.lit(True), F.lit(False))))


def kinds(rows: DataFrame) -> DataFrame:
    """Rows of `versions` (orth, verb, nom_type, plural, singular_false) as verbs, nouns and plurals, by the new column `kind`.

    Nouns keep subcategorizations with PART only if their type has PART. An entry without a verb or a plural has none of that kind,
    and no noun where there is no singular. Verbs take their verb as orth and lose verb, nom_type and plural; plurals take their plural.
    """
    fits = F.coalesce(F.col("nom_type").contains("PART"), F.lit(False)) | F.coalesce(~F.col("subcat").contains("PART"), F.lit(True))
    singular = ~F.coalesce("singular_false", F.lit(False))
    of_noun = F.array_compact(F.array(F.when(singular, "nom"), F.when(F.col("plural").isNotNull(), "plural")))
    which = F.when(F.col("is_verb"), F.array_compact(F.array(F.when(F.col("verb").isNotNull(), "verb")))).when(fits, of_noun).otherwise(strings())
    each = rows.withColumn("kind", F.explode(which))
    orth = F.when(F.col("kind") == "verb", F.col("verb")).when(F.col("kind") == "plural", F.col("plural")).otherwise(F.col("orth"))
    each = each.withColumn("orth", orth)
    gone = lambda c, *ks: F.when(~F.col("kind").isin(*ks), F.col(c))
    return each.withColumns({"plural": gone("plural", "verb", "plural"), "verb": gone("verb", "verb"), "nom_type": gone("nom_type", "verb")})


def plural(word: Column) -> Column:
    """The English plural: of the last word's ending where it is irregular (IRREGULAR), else the regular one."""
    irregular = F.lit(None).cast("string")
    for end, many in IRREGULAR.items():
        irregular = F.coalesce(irregular, F.when(word.rlike(f"(^|[^a-z]){end}$") if end in WHOLE else word.endswith(end), F.concat(F.substr(word, F.lit(1), F.length(word) - len(end)), F.lit(many))))
    regular = F.when(word.rlike("(?i)[^aeiou]y$"), F.regexp_replace(word, "y$", "ies")).when(word.rlike("(?i)(s|x|z|ch|sh)$"), F.concat(word, F.lit("es"))).otherwise(F.concat(word, F.lit("s")))
    return F.coalesce(irregular, regular)


def copied(entries: DataFrame, copies: DataFrame) -> DataFrame:
    """`entries` (entry_key, orth, plural; one row an entry) and a copy for each row of `copies` (entry_key, new_orth; null: its own orth).

    A copy gets the first free number of its new orth (none if the orth is new), in order of the keys it comes from, and a plural of
    the new orth where the entry had one. Keys that aren't there give no copy.
    """
    taken = entries.groupBy(base(F.col("entry_key")).alias("_stem")).agg(F.count(F.lit(1)).alias("_n"))
    made = entries.join(copies, "entry_key").withColumn("orth", F.coalesce("new_orth", "orth")).join(taken, F.col("orth") == F.col("_stem"), "left")
    number = F.coalesce("_n", F.lit(0)) + F.row_number().over(W.partitionBy("orth").orderBy("entry_key"))
    made = made.withColumn("entry_key", F.when(number == 1, F.col("orth")).otherwise(F.concat("orth", F.lit("#"), number)))
    made = made.withColumn("plural", F.when(F.col("plural").isNotNull(), plural(F.col("orth"))))
    return entries.unionByName(made.select(entries.columns))


def linked(rows: DataFrame) -> DataFrame:
    """Rows of `kinds` under keys of their own (orth, orth#2, …; verbs apart from nouns and plurals) with the keys of the three entries of one source.

    The old entry_key becomes `source`; its order, with nouns before plurals, gives the numbers. A kind that a source lacks has a null key.
    """
    entries = rows.select("entry_key", "kind", "orth").distinct()
    k = F.row_number().over(W.partitionBy(F.col("kind") == "verb", "orth").orderBy("entry_key", "kind"))
    entries = entries.withColumn("_key", F.when(k == 1, F.col("orth")).otherwise(F.concat("orth", F.lit("#"), k)))
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("_key"))).alias(f"{kind}_key")
    links = entries.groupBy("entry_key").agg(of("verb"), of("nom"), of("plural"))
    found = rows.join(entries.select("entry_key", "kind", "_key"), ["entry_key", "kind"]).join(links, "entry_key")
    return found.withColumnsRenamed({"entry_key": "source", "_key": "entry_key"})
