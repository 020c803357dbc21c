"""A whole lexicon from raw entries to the rows that extraction joins: an ordered program of rewrites over rows.

One row for each entry, subcategorization and side (verb or noun) goes through the rewrites of `compile.py`, `subcats.py` and
`lexicons.py`, each with the row's own rule (`rules.py`, a bounded table that is broadcast). Nothing is gathered by entry before the
links between verbs, nouns and plurals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import constants as C
from framewright import scratch
from framewright.functions.columns import first, is_lower, let, strings
from framewright.operators import compile, entries, lexicons, rules, subcats
from framewright.operators.extract import ARG
from framewright.operators.lookups import base
from framewright.operators.subcats import ARGS
from framewright.sources import lisp

# Fields of a subcategorization that are no complements.
NOT_COMPLEMENTS = ["REQUIRED", "NOT", "NOM-SUBC", "ALTERNATES", "ALTERNATES-OPT", "ADVAL", "ADVAL-NOM", "OPTIONAL"]
PATHS = {"P-": ["NOM-SUBC", "P-", "PVAL"], "P-WH": ["NOM-SUBC", "P-WH", "PVAL"]}


def positions(json: Column) -> Column:
    """A complement's positions from JSON: a list's texts or a map's names; PVAL under PP and IND-OBJ-OTHER stands for these names."""
    whole = lambda: F.from_json(json, "map<string,string>")
    under = lambda k: entries.listed(F.from_json(whole()[k], "map<string,string>")["PVAL"])
    names = F.array_except(F.map_keys(whole()), strings("PP", "IND-OBJ-OTHER"))
    every = F.when(json.startswith("{"), F.concat(under("PP"), under("IND-OBJ-OTHER"), names)).otherwise(entries.listed(json))
    return lexicons.position_list(every)


def subcategorized(splits: DataFrame, spec: DataFrame) -> DataFrame:
    """A row for each split entry, known subcategorization and side, with its rule; an entry without any keeps one row with null."""
    kind = first(F.map_keys("types"))
    rows = splits.withColumn("nom_type", kind).withColumn("_info", F.col("types")[F.col("nom_type")])
    rows = rows.withColumn("particles", entries.listed(F.col("_info")["ADVAL"])).withColumn("nom_positions", entries.listed(F.col("_info")["PVAL"]))
    rows = rows.withColumn("plural", F.when(~F.col("no_plural"), F.coalesce("plural", compile.plural(F.col("orth")))))
    typos = lambda k: F.coalesce(*[F.when(k == a, b) for a, b in C.SUBCAT_TYPOS.items()], k)
    # The rules' names are a few dozen, whatever the lexicon.
    names = [r.subcat for r in spec.select("subcat").distinct().collect()]
    listed = F.transform(F.map_entries("subcats"), lambda e: F.struct(typos(e["key"]).alias("subcat"), e["value"].alias("fields")))
    rows = rows.withColumn("_listed", F.filter(listed, lambda s: lexicons.without_part(s["subcat"]).isin(names)))
    rows = rows.withColumn("siblings", F.transform("_listed", lambda s: s["subcat"])).withColumn("_tagged", F.exists("_listed", lambda s: F.map_contains_key(s["fields"], F.lit("ALTERNATES"))))
    rows = rows.withColumn("_s", F.explode_outer("_listed")).withColumn("subcat", F.col("_s.subcat")).withColumn("fields", F.coalesce("_s.fields", F.create_map().cast("map<string,string>")))
    object_, indirect = (F.array_contains("features", x) for x in entries.ALTERNATIONS)
    tag = F.when(F.col("_tagged"), F.map_contains_key("fields", F.lit("ALTERNATES"))).otherwise(object_ | indirect)
    verb_type = lexicons.verb_type(F.col("subcat"))
    legal = F.when(object_, verb_type == "INTRANSITIVE").when(indirect, verb_type == "TRANSITIVE").otherwise(True)
    rows = rows.withColumn("alternates", F.coalesce(tag & legal, F.lit(False)))
    gets = F.col("nom_type").contains("PART") & F.coalesce(F.col("subcat").contains("PART"), F.lit(False))
    rows = rows.withColumn("_advals", F.array_union(entries.listed(F.col("fields")["ADVAL"]), F.when(gets, F.col("particles")).otherwise(strings())))
    rows = rows.withColumn("entry_key", F.col("id")).withColumn("bare", lexicons.without_part(F.col("subcat")))
    rule = spec.withColumnRenamed("subcat", "_rule").withColumnRenamed("is_verb", "_verb_side")
    both = compile.versions(rows)
    return both.join(F.broadcast(rule), (F.col("bare") == F.col("_rule")) & (F.col("is_verb") == F.col("_verb_side")), "left").drop("_rule", "_verb_side", "_s", "_listed", "_tagged", "_info")


def _first_args(rows: DataFrame) -> DataFrame:
    """args, needs, special and clauses of the row's side from its fields."""
    f, is_verb = F.col("fields"), F.col("is_verb")
    whole = F.transform_values(F.map_filter(f, lambda k, _: ~k.isin(NOT_COMPLEMENTS)), lambda _, v: positions(v))
    transitive = F.col("bare").startswith("NOM-NP")
    part = F.size("_advals") > 0
    own = F.coalesce(whole["SUBJECT"], F.when(F.col("verb_subj").isNotNull(), positions(F.col("verb_subj"))))
    subject = F.when(is_verb, strings("NSUBJ", "DET-POSS", "by")).when(own.isNotNull(), lexicons.subject_positions(own, strings(), F.array_contains(own, "NOT-PP-BY")))
    object_ = F.when(is_verb, F.when(transitive, strings("DOBJ", "NSUBJPASS"))).otherwise(whole["OBJECT"])
    particle = F.when(is_verb & part, F.array_append("_advals", F.lit("PART")))
    pair = lambda k, v: F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value")))
    fresh = F.map_from_entries(F.array_compact(F.array(pair("SUBJECT", subject), pair("OBJECT", object_), pair("PARTICLE", particle))))
    args = F.map_concat(F.map_filter(whole, lambda k, _: ~k.isin("SUBJECT", "OBJECT", "PARTICLE")), fresh)
    needs = F.transform_values(F.coalesce(entries.named(f["REQUIRED"]), F.create_map().cast(entries.FIELDS)), lambda _, v: F.map_keys(v))
    paths = {k: compile.special_values(F.concat(F.lit('{"NOM-SUBC":'), F.coalesce(f["NOM-SUBC"], F.lit("{}")), F.lit("}")), v) for k, v in PATHS.items()}
    found = F.coalesce(F.transform_values("special", lambda _, p: F.when(p == "P-", paths["P-"]).otherwise(paths["P-WH"])), F.create_map().cast(ARGS))
    clause = lambda c: compile.preposition_args(F.transform_values(F.from_json(c, "map<string,string>"), lambda _, v: positions(v)), is_verb)
    nots = F.coalesce(F.transform(F.map_values(F.from_json(f["NOT"], "map<string,string>")), clause), F.array().cast(f"array<{ARGS}>"))
    return rows.withColumns({"args": args, "needs": needs, "found": found, "clauses": nots})


def nom_typed(rows: DataFrame) -> DataFrame:
    """The first complement that the noun's type stands for. For nouns it becomes the type, at NOM and required.

    For verbs that don't alternate, and whose complement is required or optional, the noun's prepositions are added to it under the
    type's name. A complement of another name than the type leaves the lists; where it was PP1, PP2 becomes PP.
    """
    args, required, optional = F.coalesce("args", F.create_map().cast(ARGS)), F.coalesce("required", strings()), F.coalesce("optional", strings())
    is_verb, kind, empty = F.col("is_verb"), lexicons.without_part(F.col("nom_type")), strings()
    table = F.create_map(*[x for k, v in C.NOM_TYPE_ARGS.items() for x in (F.lit(k), strings(*v))])
    lists = F.concat(required, optional)
    there = F.when(is_verb, F.when(F.col("alternates"), empty).otherwise(lists)).otherwise(F.concat(F.map_keys(args), lists))
    rows = rows.withColumns({"_kind": kind, "_hit": first(F.filter(F.coalesce(table[kind], empty), lambda c: F.array_contains(there, c)))})
    hit, kind = F.col("_hit"), F.col("_kind")
    same, gives = hit == kind, F.size("nom_positions") > 0
    without = lambda m, *keys: F.map_filter(m, lambda k, _: ~F.array_contains(F.array(*keys), k))
    pair = lambda k, v: F.create_map(k, v)
    verb_args = F.when(gives, F.map_concat(without(args, hit, kind), pair(kind, F.array_union(F.coalesce(args[hit], empty), F.col("nom_positions"))))).otherwise(args)
    noun_args = F.map_concat(without(args, hit, kind), pair(kind, strings("NOM")))
    left = lambda xs, x: F.when(same, xs).otherwise(F.array_remove(xs, x))
    added = lambda xs, to: F.when(to, F.array_union(xs, F.array(kind))).otherwise(xs)
    was = F.array_contains(required, hit)
    verb_lists = (left(added(required, gives & was), hit), left(added(optional, gives & ~was & ~same), hit))
    noun_lists = (left(added(required, F.lit(True)), hit), left(F.array_remove(optional, kind), hit))
    # What PP2 says is PP's once PP1 is taken.
    second = lambda m: F.when((hit == "PP1") & F.map_contains_key(m, F.lit("PP2")), F.map_concat(without(m, F.lit("PP2"), F.lit("PP")), pair(F.lit("PP"), F.array_remove(m["PP2"], "NOM")))).otherwise(m)
    swapped = lambda xs: F.when(hit == "PP1", F.transform(xs, lambda x: F.when(x == "PP2", "PP").otherwise(x))).otherwise(xs)
    done = {
        "args": let(F.when(is_verb, verb_args).otherwise(noun_args), second),
        "required": F.array_sort(swapped(F.when(is_verb, verb_lists[0]).otherwise(noun_lists[0]))),
        "optional": F.array_sort(swapped(F.when(is_verb, verb_lists[1]).otherwise(noun_lists[1]))),
    }
    return rows.withColumns({k: F.when(hit.isNull(), F.col(k)).otherwise(v) for k, v in done.items()}).drop("_hit", "_kind")


def argument(kind: Column, options: Column, more: Column, is_verb: Column, det_poss: Column, n_n_mod: Column) -> Column:
    """A complement's record (`extract.ARG`): its positions, prefixes (long ones first, then by name) and all constraints."""
    none = strings()
    of = lambda name: F.coalesce(more[name], none)
    split = lexicons.split_positions(kind, options)
    order = lambda xs: F.transform(F.array_sort(F.transform(F.array_distinct(xs), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])
    tags = F.when(F.size(of("root_upostags")) > 0, of("root_upostags")).otherwise(lexicons.root_tags(kind))
    only = lambda names, mark: F.when(~is_verb & F.array_contains(names, kind), strings(mark)).otherwise(none)
    marks = F.concat(of("constraints"), only(det_poss, "DET-POSS-NO-OTHER-OBJ"), only(n_n_mod, "N-N-MOD-NO-OTHER-OBJ"))
    marks = F.when(kind == "PP", F.array_remove(marks, "REQUIRED-PREFIX")).when(kind == "PARTICLE", F.array_append(marks, F.lit("REQUIRED-PREFIX"))).otherwise(marks)
    words = "|".join([*C.WHERE_WHEN, *C.WH_VERB, *C.HOW_TO, *C.HOW])
    bad = lambda p: F.transform(strings("how to", "how much", "how many"), lambda x: F.trim(F.concat(F.trim(F.regexp_replace(p, words, "")), F.lit(" "), x)))

    def record(s: Column) -> Column:
        illegal = (
            F.when(kind.startswith("ING") | kind.startswith("POSSING"), strings(*C.WHERE_WHEN, *C.HOW, *C.WH_VERB, "that"))
            .when(kind.startswith("TO-INF"), strings("for"))
            .when(kind == "HOW-S", F.array_distinct(F.flatten(F.transform(s["prefixes"], bad))))
            .when(kind.startswith("AS-") & (kind != "AS-IF-S"), strings("as if"))
            .otherwise(of("illegal_prefixes"))
        )
        parts = [kind.alias("type"), F.array_sort(F.array_distinct(s["positions"])).alias("positions"), order(s["prefixes"]).alias("prefixes"), illegal.alias("illegal_prefixes"), tags.alias("root_upostags"), of("root_urelations").alias("root_urelations"), of("root_patterns").alias("root_patterns"), marks.alias("constraints"), none.alias("including")]
        return F.struct(*parts).cast(ARG)

    return let(split, record)


def represented(rows: DataFrame) -> DataFrame:
    """args as records sorted by type, without unknown complements and such without any position; what is required but not there is optional."""
    unknown = F.raise_error(F.concat(F.lit("unknown position in "), F.col("entry_key"))).cast("string")
    known = F.map_filter(F.coalesce("args", F.create_map().cast(ARGS)), lambda k, v: F.col("subcat").isNotNull() & k.isin(rules.COMPLEMENTS) & (F.size(v) > 0))
    checked = F.transform_values(known, lambda _, v: F.transform(v, lambda x: F.when(is_lower(x) | x.isin(rules.POSITIONS), x).otherwise(unknown)))
    nothing = F.create_map().cast("map<string,array<string>>")
    only = [F.array_union(a, b) for a, b in (("det_poss", "det_poss_only"), ("n_n_mod", "n_n_mod_only"))]
    record = lambda e: argument(e["key"], e["value"], F.coalesce(F.col("more")[e["key"]], nothing), F.col("is_verb"), *only)
    args = F.array_sort(F.transform(F.map_entries(checked), record))
    here = F.map_keys("args")
    marks = F.concat(F.when(F.col("alternates"), strings("ALTERNATES")).otherwise(strings()), F.coalesce("subcat_constraints", strings()))
    return rows.withColumns({
        "_required": F.array_sort(F.array_intersect("required", here)), "_optional": F.array_sort(F.array_union("optional", F.array_except("required", here))),
        "_args": args, "constraints": marks,
    }).drop("required", "optional", "args").withColumnsRenamed({"_required": "required", "_optional": "optional", "_args": "args"})


def rewritten(splits: DataFrame, spec: DataFrame) -> DataFrame:
    """The ordered program over all rows of split entries, written in between: each rewrite's expressions are large, so that all tasks get rows."""
    cut = lambda rows: scratch.written(rows, "lexicon-rows")
    rows = cut(_first_args(cut(subcategorized(scratch.dealt(splits, "id"), spec))))
    rows = rows.transform(subcats.objects).transform(compile.prepositions)
    rows = cut(compile.requirements(rows, "usual", "siblings"))
    rows = cut(subcats.with_special(subcats.renamed(rows, "names"), "found"))
    rows = subcats.with_defaults(rows, "defaults")
    rows = rows.withColumn("args", F.transform_values("args", lambda k, v: lexicons.extended(k, v, F.col("is_verb"))))
    rows = cut(rows.transform(subcats.clauses))
    rows = cut(subcats.alternated(cut(nom_typed(rows))))
    return cut(represented(rows))


COMPILED = ["kind", "orth", "verb", "nom_type", "plural", "subcat", "is_verb", "required", "optional", "constraints", "clauses", "args", "nouns", "source", "entry_key", "verb_key", "nom_key", "plural_key"]


def compiled(raw: DataFrame) -> DataFrame:
    """Verbs, nouns and plurals with their subcategorizations (COMPILED) from the reader's rows; an entry without any keeps one row.

    An empty lexicon gives no rows. Nulls: an entry without a verb has no row of kind verb; fields that are missing are empty.
    Mistaken entries are left out (`entries.plausible`), unknown subcategorizations and complements too.
    """
    spec = rules.table(raw.sparkSession)
    rows = rewritten(entries.split(entries.plausible(entries.opened(raw))), spec)
    return compile.linked(compile.kinds(rows)).select(COMPILED)


def for_extraction(lexicon: DataFrame, with_default: bool = False) -> DataFrame:
    """Compiled rows as `extract.LEXICON`, all senses under their word in lower case; on demand with the DEFAULT entries."""
    verb = F.when(F.col("is_verb"), F.col("orth")).otherwise(base(F.col("verb")))
    rows = lexicon.filter("subcat is not null").select(
        "is_verb", F.lower("orth").alias("entry_key"), verb.alias("verb"), "subcat", "required", "constraints", F.col("clauses").alias("not_clauses"), "args"
    )
    rows = rows.select(*[F.col(c.split()[0]) for c in ("is_verb", "entry_key", "verb", "subcat", "required", "constraints", "not_clauses", "args")])
    return lexicons.with_default(rows) if with_default else rows


def build(spark: SparkSession, source: str, target: str, force: bool = False) -> DataFrame:
    """Read the Lisp files at `source`, compile them and write `target`/raw and `target`/lexicon as Parquet; what is there is read instead, unless `force`."""
    mode = "overwrite" if force else "ignore"
    lisp.entries(spark, source).write.mode(mode).parquet(f"{target}/raw")
    try:
        there = not force and spark.read.parquet(f"{target}/lexicon").columns
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = False
    if not there:
        compiled(spark.read.parquet(f"{target}/raw")).write.mode(mode).parquet(f"{target}/lexicon")
    return spark.read.parquet(f"{target}/lexicon")

