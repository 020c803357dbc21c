"""Normalisation of lexicon entries and of their subcategorizations' positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright import constants as C
from framewright.functions.columns import first, is_lower, strings


def without_part(tag: Column) -> Column:
    """A type's name without PART: VERB-PART is VERB-NOM, NOM-PART is NOM-INTRANS, SUBJECT-PART is SUBJECT."""
    inner = F.replace(tag, F.lit("-PART-"), F.lit("-"))
    outer = F.when(inner.startswith("NOM"), F.replace(inner, F.lit("-PART"), F.lit("-INTRANS"))).otherwise(F.replace(inner, F.lit("-PART"), F.lit("")))
    return F.when(tag == "VERB-PART", "VERB-NOM").otherwise(outer)


def verb_type(subcat: Column) -> Column:
    """DITRANSITIVE, TRANSITIVE or INTRANSITIVE of a subcategorization's name."""
    name = without_part(subcat)
    return F.when(name.isin("NOM-NP-NP", "NOM-NP-TO-NP", "NOM-NP-FOR-NP"), "DITRANSITIVE").when(name.startswith("NOM-NP"), "TRANSITIVE").otherwise("INTRANSITIVE")


def position_list(raw: Column) -> Column:
    """Distinct positions: p-dir and p-loc as their prepositions, PP-X as x, the names for nothing as OPTIONAL-POSITION."""
    each = F.transform(raw, lambda x: F.when(x == "p-dir", strings(*C.P_DIR)).when(x == "p-loc", strings(*C.P_LOC)).when(x.startswith("PP-"), F.array(F.lower(F.replace(x, F.lit("PP-"), F.lit(""))))).when(x.isin(C.NONE_VALUES), strings("OPTIONAL-POSITION")).otherwise(F.array(x)))
    return F.array_distinct(F.flatten(each))


def extended(complement: Column, options: Column, is_verb: Column) -> Column:
    """Options with the question words of WH, WHERE-WHEN, HOW and HOW-TO complements after each preposition."""
    wh = F.when(is_verb, strings(*C.WH_VERB)).otherwise(strings(*C.WH_NOM))
    words = F.when(complement.isin("WH-S", "P-WH-S"), wh).when(complement == "WHERE-WHEN-S", strings(*C.WHERE_WHEN)).when(complement == "HOW-S", strings(*C.HOW)).when(complement == "HOW-TO-INF", strings(*C.HOW_TO)).otherwise(strings())
    each = lambda o: F.when((F.size(words) == 0) | F.array_contains(words, o), F.array(o)).otherwise(F.transform(words, lambda w: F.concat(o, F.lit(" "), w)))
    return F.flatten(F.transform(options, each))


def subject_positions(options: Column, defaults: Column, not_by: Column) -> Column:
    """The subject's positions, or the default ones, with `by` unless NOT-PP-BY is given."""
    own = F.coalesce(options, defaults)
    return F.when(not_by, F.array_remove(own, "NOT-PP-BY")).otherwise(F.array_union(own, strings("by")))


def split_positions(complement: Column, options: Column) -> Column:
    """(positions, prefixes): lower-case options are prefixes, which bring the position PREFIX except for FOR-TO-INF and PARTICLE."""
    prefixes = F.filter(options, is_lower)
    upper = F.filter(options, lambda x: ~is_lower(x))
    more = F.when((F.size(prefixes) > 0) & ~complement.isin("FOR-TO-INF", "PARTICLE"), strings("PREFIX")).otherwise(strings())
    return F.struct(F.concat(upper, more).alias("positions"), prefixes.alias("prefixes"))


def root_tags(complement: Column) -> Column:
    """The tags that a complement's root can have by default; empty for any."""
    nps = complement.isin("SUBJECT", "OBJECT", "IND-OBJ", "SECOND-SUBJECT", "NP", "AS-NP-OC", "AS-NP-SC", "PP", "PP1", "PP2")
    return F.when(complement == "PARTICLE", strings("PART", "ADP")).when(nps, strings(*C.NP_TAGS)).otherwise(strings())


def known_subcats(rows: DataFrame, spec: DataFrame) -> DataFrame:
    """Rows whose subcat, after the two known typos, is in `spec` (subcat) itself or without PART."""
    fixed = F.coalesce(*[F.when(F.col("subcat") == a, b) for a, b in C.SUBCAT_TYPOS.items()], F.col("subcat"))
    rows = rows.withColumn("subcat", fixed)
    names = spec.select(F.col("subcat").alias("_name")).distinct()
    return rows.withColumn("_bare", without_part(F.col("subcat"))).join(names, F.col("_bare") == F.col("_name"), "left_semi").drop("_bare")


def usable(entries: DataFrame) -> DataFrame:
    """Entries (orth, verb, nom_types) without nouns of several verbs and without entries of no type."""
    base = entries.withColumn("_base", F.get(F.split("orth", "#"), F.lit(0)))
    several = base.groupBy("_base").agg(F.count_distinct("verb").alias("_n")).filter("_n > 1")
    return base.join(several, "_base", "left_anti").filter("size(nom_types) > 0").drop("_base")


def split_types(entries: DataFrame) -> DataFrame:
    """One entry for each type of a nominalization."""
    return entries.withColumn("nom_type", F.explode("nom_types")).drop("nom_types")


def split_alternates(entries: DataFrame) -> DataFrame:
    """An entry with optional alternation (in `features`) as one that alternates and one that does not."""
    optional = F.array_contains("features", "ALTERNATES-OPT")
    rest = F.array_remove("features", "ALTERNATES-OPT")
    both = F.when(optional, F.array(F.array_append(rest, F.lit("ALTERNATES")), rest)).otherwise(F.array(F.col("features")))
    return entries.withColumn("features", F.explode(both))


def split_particles(entries: DataFrame) -> DataFrame:
    """Adds for each adverbial particle (`particles`) a noun `orth-particle` of the type with -PART."""
    parts = entries.select("*", F.explode("particles").alias("_p"))
    added = parts.withColumn("orth", F.concat("orth", F.lit("-"), "_p")).withColumn("nom_type", F.when(F.col("nom_type") == "VERB-NOM", "VERB-PART").otherwise(F.concat("nom_type", F.lit("-PART")))).withColumn("particles", F.array("_p")).drop("_p")
    return entries.withColumn("particles", strings()).unionByName(added)


def hyphen_twins(entries: DataFrame) -> DataFrame:
    """Adds to each hyphenated noun its form without hyphens, where no entry has it."""
    bare = F.replace(F.col("orth"), F.lit("-"), F.lit(""))
    twins = entries.filter(F.col("orth").contains("-")).withColumn("orth", bare)
    return entries.unionByName(twins.join(entries.select("orth"), "orth", "left_anti"))


def split_entries(entries: DataFrame) -> DataFrame:
    """All splits (alternation, types, particles, twins), in an order in which none gives another one anything to do again."""
    return entries.transform(split_types).transform(split_alternates).transform(split_particles).transform(hyphen_twins)


def with_default(lexicon: DataFrame) -> DataFrame:
    """Adds for verbs and for nouns the DEFAULT entry: of each complement the union of all its properties, none required; PP1 and PP2 count as PP, kinds of control as one."""
    lists = ["positions", "prefixes", "root_upostags", "root_urelations", "root_patterns", "constraints"]
    a = F.col("a")
    kind = F.when(a["type"].isin("PP1", "PP2"), "PP").otherwise(F.regexp_replace(a["type"], "-(OC|SC|POC|NPC|VC)$", ""))
    each = lexicon.select("is_verb", F.explode("args").alias("a")).select("is_verb", kind.alias("type"), *[a[c].alias(c) for c in lists])
    # Prefixes keep a fixed order: long ones first, then by name.
    order = lambda c: F.transform(F.array_sort(F.transform(c, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])
    merged = each.groupBy("is_verb", "type").agg(*[order(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in lists])
    kept = F.array_except("constraints", strings("PLURAL", "DET-POSS-NO-OTHER-OBJ", "N-N-MOD-NO-OTHER-OBJ"))
    arg = F.struct("type", "positions", "prefixes", strings().alias("illegal_prefixes"), "root_upostags", "root_urelations", "root_patterns", kept.alias("constraints"), strings().alias("including"))
    args = merged.groupBy("is_verb").agg(F.sort_array(F.collect_list(arg)).alias("args"))
    default = args.select("is_verb", F.lit("DEFAULT").alias("entry_key"), F.lit(None).cast("string").alias("verb"), F.lit("DEFAULT").alias("subcat"), strings().alias("required"), strings().alias("constraints"), F.array().cast("array<map<string,array<string>>>").alias("not_clauses"), "args")
    return lexicon.unionByName(default)


def verbs_by_argument(lexicon: DataFrame, complement: str) -> DataFrame:
    """Distinct verbs with a subcategorization that has a complement; the default entry is left out."""
    return lexicon.filter((F.col("entry_key") != "DEFAULT") & F.exists("args", lambda a: a["type"] == complement)).select("verb").distinct()


def audit(lexicon: DataFrame) -> DataFrame:
    """entry_key, subcat and problem of rows that break an invariant: repeated types, required without argument, no position."""
    types = F.transform("args", lambda a: a["type"])
    problems = F.array(
        F.when(F.size(F.array_distinct(types)) < F.size(types), "repeated complement"),
        F.when(F.size(F.array_except("required", types)) > 0, "required without argument"),
        F.when(F.exists("args", lambda a: F.size(a["positions"]) + F.size(a["prefixes"]) == 0), "no position"),
        F.when(F.exists("args", lambda a: F.array_contains(a["positions"], "PREFIX") & (F.size(a["prefixes"]) == 0)), "prefix position without prefix"),
    )
    return lexicon.select("entry_key", "subcat", F.explode(F.array_compact(problems)).alias("problem"))


def never_common(props: Column, orth: Column, lemma: Column) -> Column:
    """Whether a noun with these properties (array) can only be a nominalization; SING-ONLY does not count, as in the model."""
    return ~F.arrays_overlap(props, strings("EXISTS", "RARE-NOUN", "RARE-NOM")) & ~((orth != lemma) & F.array_contains(props, "PLUR-ONLY"))


def nom_position(args: Column, nom_type: Column) -> Column:
    """Arguments of a nominalization: the first complement that the noun itself stands for is renamed to its type, at NOM only."""
    table = F.create_map(*[x for k, v in C.NOM_TYPE_ARGS.items() for x in (F.lit(k), strings(*v))])
    types = F.transform(args, lambda a: a["type"])
    hit = first(F.filter(table[without_part(nom_type)], lambda t: F.array_contains(types, t)))
    empty = strings()
    change = lambda a: a.withField("type", without_part(nom_type)).withField("positions", strings("NOM")).withField("prefixes", empty)
    return F.transform(args, lambda a: F.when(a["type"] == hit, change(a)).otherwise(a))
