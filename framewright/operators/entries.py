"""Raw lexicon entries as rows, removal of mistaken ones, and their splits, repeated until no entry is new.

An entry: id, orth, verb, plural, no_plural, singular_false, nouns, features, verb_subj (JSON), det_poss and n_n_mod (complements),
types and subcats (maps from a name to a map of fields as JSON, in the order of the source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright import constants as C
from framewright import scratch
from framewright.functions.columns import first, strings
from framewright.operators.compile import plural
from framewright.operators.subcats import particle

# The two features of alternation.
ALTERNATIONS = ["SUBJ-OBJ-ALT", "SUBJ-IND-OBJ-ALT"]
FIELDS = "map<string,map<string,string>>"
#: Rounds after which a lexicon whose splits do not end fails; each needs one or two.
ROUNDS = 20


def listed(json: Column) -> Column:
    """A field as a list: a list's texts, a map's names, a text alone; nothing for null."""
    names = F.map_keys(F.from_json(json, "map<string,string>"))
    return F.when(json.isNull(), strings()).when(json.startswith("["), F.from_json(json, "array<string>")).when(json.startswith("{"), names).otherwise(F.array(json))


def named(json: Column) -> Column:
    """A field as a map of maps; the names of a list, or a text, have empty ones."""
    bare = F.map_from_entries(F.transform(F.array_distinct(listed(json)), lambda k: F.struct(k, F.create_map().cast("map<string,string>"))))
    whole = F.from_json(json, "map<string,string>")
    inner = F.transform_values(whole, lambda _, v: F.when(v.startswith("{"), F.from_json(v, "map<string,string>")).otherwise(F.create_map().cast("map<string,string>")))
    return F.when(json.startswith("{"), inner).otherwise(bare)


def opened(raw: DataFrame) -> DataFrame:
    """Entries from rows (entry_key, orth, verb, raw) of the reader; fields that are not there are empty."""
    f = F.col("f")
    given = f["PLURAL"].isNotNull()
    none = f["PLURAL"].isin(C.NONE_VALUES)
    rows = raw.withColumn("f", F.from_json("raw", "map<string,string>"))
    return rows.select(
        F.col("entry_key").alias("id"), "orth", "verb",
        F.when(given & ~none, f["PLURAL"]).alias("plural"), (given & none).alias("no_plural"), F.coalesce(f["SINGULAR-FALSE"] == "T", F.lit(False)).alias("singular_false"),
        listed(f["NOUN"]).alias("nouns"), listed(f["FEATURES"]).alias("features"), f["VERB-SUBJ"].alias("verb_subj"),
        listed(f["DET-POSS-NO-OTHER-OBJ"]).alias("det_poss"), listed(f["N-N-MOD-NO-OTHER-OBJ"]).alias("n_n_mod"),
        named(f["NOM-TYPE"]).alias("types"), named(f["VERB-SUBC"]).alias("subcats"),
    )


def plausible(entries: DataFrame) -> DataFrame:
    """Without nouns that have several verbs (all their entries), without a type, or tagged as alternating without the feature."""
    several = entries.groupBy("orth").agg(F.count_distinct("verb").alias("n")).filter("n > 1")
    tagged = F.exists(F.map_values("subcats"), lambda v: F.map_contains_key(v, F.lit("ALTERNATES")) | F.map_contains_key(v, F.lit("ALTERNATES-OPT")))
    return entries.join(several, "orth", "left_anti").filter((F.size("types") > 0) & (F.arrays_overlap("features", strings(*ALTERNATIONS)) | ~tagged)).select(entries.columns)


def _content(entries: DataFrame) -> Column:
    """What makes two entries equal: all but id, orth and plural."""
    return F.sha2(F.to_json(F.struct(*[c for c in entries.columns if c not in ("id", "orth", "plural", "_source")])), 256)


def _made(rows: DataFrame, suffix: Column, orth: Column | None = None) -> DataFrame:
    """Rows as entries of their own; a new orth brings its plural, where one was given."""
    rows = rows.withColumn("id", F.concat_ws("/", "id", suffix))
    if orth is None:
        return rows
    return rows.withColumn("orth", orth).withColumn("plural", F.when(F.col("plural").isNotNull(), plural(F.col("orth"))))


def split_once(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays of each entry, with the orth of its twin with or without hyphen; entries split off) of one pass over `entries`.

    Split off are: the subcategorizations that alternate optionally, once without alternation (they stay as alternating); each further
    type; each particle of ADVAL-NOM, as `orth-particle` with its subcategorizations, which leave the entry.
    """
    columns = entries.columns
    optional = lambda v: F.map_contains_key(v, F.lit("ALTERNATES-OPT"))
    bare = lambda v, *names: F.map_filter(v, lambda k, _: ~k.isin(*names))
    swapped = lambda v: F.map_concat(bare(v, "ALTERNATES", "ALTERNATES-OPT"), F.create_map(F.lit("ALTERNATES"), v["ALTERNATES-OPT"]))
    fixed = _made(entries.filter(F.exists(F.map_values("subcats"), optional)), F.lit("fixed"))
    fixed = fixed.withColumn("subcats", F.transform_values(F.map_filter("subcats", lambda _, v: optional(v)), lambda _, v: bare(v, "ALTERNATES-OPT"))).withColumn("features", F.array_except("features", strings(*ALTERNATIONS)))
    kept = entries.withColumn("subcats", F.transform_values("subcats", lambda _, v: F.when(optional(v), swapped(v)).otherwise(v)))

    more = kept.withColumn("_type", F.explode(F.slice(F.map_keys("types"), 2, F.greatest(F.size("types"), F.lit(1)))))
    more = _made(more, F.col("_type")).withColumn("types", F.map_filter("types", lambda k, _: k == F.col("_type"))).select(columns)
    kept = kept.withColumn("_type", first(F.map_keys("types"))).withColumn("types", F.map_filter("types", lambda k, _: k == F.col("_type")))

    nominal = lambda v: F.map_contains_key(v, F.lit("ADVAL-NOM"))
    of = lambda v: listed(v["ADVAL-NOM"])
    particles = F.array_distinct(F.flatten(F.transform(F.map_values(F.map_filter("subcats", lambda _, v: nominal(v))), of)))
    wrong = F.raise_error(F.concat(F.lit("a type with PART can't have ADVAL-NOM: "), F.col("id"))).cast("array<string>")
    kept = kept.withColumn("_particles", F.when((F.size(particles) > 0) & F.col("_type").contains("-PART"), wrong).otherwise(particles))
    parts = kept.withColumn("_p", F.explode("_particles"))
    parts = _made(parts, F.col("_p"), F.concat_ws("-", "orth", "_p"))
    chosen = F.map_filter("subcats", lambda _, v: nominal(v) & F.array_contains(of(v), F.col("_p")))
    parts = parts.withColumn("subcats", F.transform_values(chosen, lambda _, v: F.map_concat(bare(v, "ADVAL", "ADVAL-NOM"), F.create_map(F.lit("ADVAL"), v["ADVAL-NOM"]))))
    info = F.map_concat(bare(F.col("types")[F.col("_type")], "ADVAL"), F.create_map(F.lit("ADVAL"), F.to_json(F.array("_p"))))
    parts = parts.withColumn("types", F.create_map(F.concat(F.replace("_type", F.lit("-NOM"), F.lit("")), F.lit("-PART")), info)).select(columns)
    kept = kept.withColumn("subcats", F.map_filter("subcats", lambda _, v: ~nominal(v)))

    given = listed(F.col("types")[F.col("_type")]["ADVAL"])
    kept = kept.withColumn("_p", F.when(F.col("_type").contains("PART"), particle(F.col("orth"), F.col("verb"), given)))
    info = F.map_concat(bare(F.col("types")[F.col("_type")], "ADVAL"), F.create_map(F.lit("ADVAL"), F.to_json(F.array("_p"))))
    kept = kept.withColumn("types", F.when(F.col("_p").isNotNull(), F.create_map(F.col("_type"), info)).otherwise(F.col("types")))
    # A noun without its particle gets it; its plural follows.
    lone = F.col("_p").isNotNull() & ~F.contains("orth", F.lit("-")) & ~F.endswith("orth", F.col("_p")) & ~F.startswith("orth", F.col("_p"))
    kept = kept.withColumn("_lone", lone)
    kept = kept.withColumn("orth", F.when(F.col("_lone"), F.concat_ws("-", "orth", "_p")).otherwise(F.col("orth"))).withColumn("plural", F.when(F.col("_lone") & F.col("plural").isNotNull(), plural(F.col("orth"))).otherwise(F.col("plural")))
    joined = F.replace("orth", F.lit("-"), F.lit(""))
    before = F.col("_p").isNotNull() & ~F.endswith("orth", F.col("_p")) & F.startswith("orth", F.col("_p"))
    twin = F.when(F.contains("orth", F.lit("-")), joined).when(before, F.concat(F.col("_p"), F.lit("-"), F.expr("substring(orth, length(_p) + 1)")))
    return kept.select(*columns, F.when(twin != F.col("orth"), twin).alias("twin")), fixed.select(columns).unionByName(more).unionByName(parts)


def split(entries: DataFrame) -> DataFrame:
    """All splits of all entries, until none is new: each round works on those that the round before made, and is written.

    A twin comes only where no entry of its orth equals it in all but the plural; of equal twins the one with the first id stays. Ids
    of split-off entries are their source's with a path. A lexicon whose splits do not end in ROUNDS rounds fails.
    """
    fresh, done = entries, None
    for _ in range(ROUNDS):
        kept, off = (scratch.written(x, "lexicon-split") for x in split_once(fresh))
        own = kept.drop("twin")
        done = own if done is None else done.unionByName(own)
        twins = _made(kept.filter("twin is not null"), F.lit("twin"), F.col("twin")).select(entries.columns)
        there = done.unionByName(off).select("orth", _content(off).alias("_c")).distinct()
        one = W.partitionBy("orth", "_c").orderBy("id")
        twins = twins.withColumn("_c", _content(twins)).join(there, ["orth", "_c"], "left_anti").withColumn("_k", F.row_number().over(one)).filter("_k = 1").select(entries.columns)
        fresh = scratch.written(off.unionByName(twins), "lexicon-fresh")
        if fresh.isEmpty():
            return done
    raise ValueError(f"the splits of the lexicon do not end in {ROUNDS} rounds")
