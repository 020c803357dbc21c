"""Queries of lexicon compilation. The source is a Lisp text with an entry for each nominalization of the corpus, in one of eight forms.

Which form a noun has follows from its letters; the SQL has the compiled rows of each form as worked out by hand from the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import scratch
from framewright.operators import build, entries, lexicons
from framewright.sources import lisp

FORMS = [
    ":NOM-TYPE ((VERB-NOM)) :VERB-SUBJ ((N-N-MOD) (DET-POSS)) :VERB-SUBC ((NOM-NP :OBJECT ((DET-POSS) (N-N-MOD) (PP-OF)) :REQUIRED ((OBJECT :DET-POSS-ONLY T))) (NOM-INTRANS))",
    ':NOM-TYPE ((SUBJECT)) :VERB-SUBC ((NOM-NP-PP :SUBJECT ((N-N-MOD)) :OBJECT ((PP-OF)) :PVAL ("to" "with")))',
    ':NOM-TYPE ((VERB-NOM) (OBJECT :PVAL ("as"))) :VERB-SUBC ((NOM-NP-TO-INF-OC :OBJECT ((DET-POSS) (PP-OF)) :SUBJECT ((DET-POSS))))',
    ":NOM-TYPE ((VERB-NOM)) :FEATURES ((SUBJ-OBJ-ALT)) :VERB-SUBC ((NOM-INTRANS :SUBJECT ((DET-POSS) (PP-OF)) :ALTERNATES-OPT T))",
    ':NOM-TYPE ((VERB-NOM)) :PLURAL *NONE* :VERB-SUBC ((NOM-P-POSSING :SUBJECT *NONE* :PVAL ("on") :NOM-SUBC ((P-POSSING :PVAL ("about")))) (NOM-WHERE-WHEN-S :SUBJECT ((DET-POSS) (NOT-PP-BY)) :NOM-SUBC ((P-WH :PVAL ("about")))))',
    ':NOM-TYPE ((IND-OBJ :PVAL ("to"))) :VERB-SUBC ((NOM-NP-TO-NP :OBJECT ((PP-OF)) :IND-OBJ ((IND-OBJ-TO) (N-N-MOD)) :SUBJECT ((DET-POSS)) :NOT ((AND :OBJECT ((PP-OF)) :SUBJECT ((DET-POSS)) :IND-OBJ ((N-N-MOD))))))',
    ':NOM-TYPE ((VERB-NOM)) :VERB-SUBC ((NOM-PP-PP :PVAL1 ("from") :PVAL2 ("to" "into") :NOM-ROLE-FOR-PVAL1 ((N-N-MOD))) (NOM-ADVP))',
    ":NOM-TYPE ((VERB-NOM)) :VERB-SUBC ((NOM-S :SUBJECT ((DET-POSS))) (NOM-ING-SC :SUBJECT ((DET-POSS))) (NOM-OF-NO-TABLE))",
]


def source(spark: SparkSession, nouns: DataFrame) -> str:
    """The path of a written Lisp text with an entry for each of `nouns` (verb, nom): plain letters only."""
    plain = nouns.filter(F.col("nom").rlike("^[a-z]+$")).select("verb", "nom").distinct()
    form = F.element_at(F.array(*[F.lit(x) for x in FORMS]), ((F.length("nom") + F.ascii("nom")) % len(FORMS) + 1).cast("int"))
    line = F.concat(F.lit('(NOM :ORTH "'), "nom", F.lit('" :VERB "'), "verb", F.lit('" '), form, F.lit(")"))
    path = scratch.new_path(spark, "lexicon-source")
    plain.select(line.alias("value")).write.text(path)
    return path


def raw(spark: SparkSession, nouns: DataFrame) -> DataFrame:
    return scratch.written(scratch.dealt(lisp.entries(spark, source(spark, nouns)), "entry_key"), "lexicon-raw")


def arguments(raw_entries: DataFrame) -> DataFrame:
    """Every complement of the compiled lexicon, lists as text."""
    rows = build.compiled(raw_entries).select("entry_key", "kind", "nom_type", "subcat", "required", "optional", "constraints", "clauses", F.explode("args").alias("a"))
    text = lambda c: F.array_join(c, ",")
    clause = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws(":", e["key"], F.array_join(e["value"], "+")))), " ")
    return rows.select("entry_key", "kind", "nom_type", "subcat", text("required").alias("required"), text("optional").alias("optional"), text("constraints").alias("constraints"), F.array_join(F.transform("clauses", clause), "; ").alias("clauses"), "a.type", *[text(F.col(f"a.{c}")).alias(c) for c in ("positions", "prefixes", "illegal_prefixes", "root_upostags", "root_urelations", "root_patterns")], text(F.col("a.constraints")).alias("marks"))


def links(raw_entries: DataFrame) -> DataFrame:
    """The keys of the verb, the noun and the plural of each entry of the compiled lexicon."""
    return build.compiled(raw_entries).select("entry_key", "kind", "orth", "verb_key", "nom_key", "plural_key").distinct()


def splits(raw_entries: DataFrame) -> DataFrame:
    """The entries that are left when all splits are done: id, orth, type and the subcategorizations by name."""
    done = entries.split(entries.plausible(entries.opened(raw_entries)))
    return done.select("id", "orth", "verb", F.element_at(F.map_keys("types"), 1).alias("nom_type"), F.array_join(F.array_sort(F.map_keys("subcats")), ",").alias("subcats"))


def defaults(raw_entries: DataFrame) -> DataFrame:
    """The complements of the DEFAULT entries: the union of all that the lexicon's entries say of them."""
    both = lexicons.with_default(build.for_extraction(build.compiled(raw_entries))).filter("entry_key = 'DEFAULT'")
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return both.select("is_verb", F.explode("args").alias("a")).select("is_verb", "a.type", text(F.col("a.positions")).alias("positions"), text(F.col("a.prefixes")).alias("prefixes"), text(F.col("a.root_upostags")).alias("root_upostags"), text(F.col("a.constraints")).alias("marks"))


_NP = "PROPN,NOUN,PRON,DET"
_WH = "where,when,how many,how much,how,if,whether,what"
_S = ("SUBJECT", "DET-POSS,N-N-MOD,PREFIX", "by", "", _NP, "", "", "")
_DS = ("SUBJECT", "DET-POSS,PREFIX", "by", "", _NP, "", "", "")
_VS = ("SUBJECT", "DET-POSS,NSUBJ,PREFIX", "by", "", _NP, "", "", "")
_VO = ("OBJECT", "DOBJ,NSUBJPASS", "", "", _NP, "", "", "")
_OF = ("OBJECT", "PREFIX", "of", "", _NP, "", "", "")
_TO = ("TO-INF-OC", "TO-INF", "", "for", "VERB,AUX", "mark_TO", "", "")
_PP = ("PP", "PREFIX", "with,to", "", _NP, "", "", "")
_PP2 = ("PP2", "PREFIX", "into,to", "", _NP, "", "", "")
_POSS = ("P-POSSING", "PREFIX", "on", "", "VERB", "", "ing$", "OPTIONAL-POSSESSIVE")
_NOM = lambda kind: (kind, "NOM", "", "", _NP, "", "", "")
# form, sense, side, type of the noun, subcat, required, optional, constraints, clauses, complements.
_COMPILED = [
    (0, 1, "nom", "VERB-NOM", "NOM-NP", "OBJECT", "SUBJECT", "", "", [("OBJECT", "DET-POSS,N-N-MOD,PREFIX", "of", "", _NP, "", "", "DET-POSS-NO-OTHER-OBJ"), _S]),
    (0, 1, "nom", "VERB-NOM", "NOM-INTRANS", "", "SUBJECT", "", "", [_S]),
    (0, 1, "verb", None, "NOM-NP", "OBJECT", "SUBJECT", "", "", [_VO, _VS]),
    (0, 1, "verb", None, "NOM-INTRANS", "", "SUBJECT", "", "", [_VS]),
    (1, 1, "nom", "SUBJECT", "NOM-NP-PP", "PP,SUBJECT", "OBJECT", "", "", [_OF, _PP, _NOM("SUBJECT")]),
    (1, 1, "verb", None, "NOM-NP-PP", "OBJECT,PP", "SUBJECT", "", "", [_VO, _PP, _VS]),
    (2, 1, "nom", "VERB-NOM", "NOM-NP-TO-INF-OC", "OBJECT,TO-INF-OC", "SUBJECT", "", "", [("OBJECT", "DET-POSS,PREFIX", "of", "", _NP, "", "", ""), _DS, _TO]),
    (2, 1, "verb", None, "NOM-NP-TO-INF-OC", "OBJECT,TO-INF-OC", "SUBJECT", "", "", [_VO, _VS, _TO]),
    (2, 2, "nom", "OBJECT", "NOM-NP-TO-INF-OC", "OBJECT,TO-INF-OC", "SUBJECT", "", "", [_NOM("OBJECT"), _DS, _TO]),
    (2, 2, "verb", None, "NOM-NP-TO-INF-OC", "OBJECT,TO-INF-OC", "SUBJECT", "", "", [("OBJECT", "DOBJ,NSUBJPASS,PREFIX", "as", "", _NP, "", "", ""), _VS, _TO]),
    (3, 1, "nom", "VERB-NOM", "NOM-INTRANS", "", "OBJECT,SUBJECT", "ALTERNATES", "", [("OBJECT", "DET-POSS,PREFIX", "by,of", "", _NP, "", "", "")]),
    (3, 1, "verb", None, "NOM-INTRANS", "", "OBJECT,SUBJECT", "ALTERNATES", "", [("OBJECT", "DET-POSS,NSUBJ,PREFIX", "by", "", _NP, "", "", "")]),
    (3, 2, "nom", "VERB-NOM", "NOM-INTRANS", "", "SUBJECT", "", "", [("SUBJECT", "DET-POSS,PREFIX", "by,of", "", _NP, "", "", "")]),
    (3, 2, "verb", None, "NOM-INTRANS", "", "SUBJECT", "", "", [_VS]),
    (4, 1, "nom", "VERB-NOM", "NOM-P-POSSING", "P-POSSING", "SUBJECT", "", "", [_POSS, ("SUBJECT", "PREFIX", "by", "", _NP, "", "", "")]),
    (4, 1, "verb", None, "NOM-P-POSSING", "P-POSSING", "SUBJECT", "", "", [_POSS, _VS]),
    (4, 1, "nom", "VERB-NOM", "NOM-WHERE-WHEN-S", "WHERE-WHEN-S", "SUBJECT", "", "", [("WHERE-WHEN-S", "PREFIX", "about how many,about how much,about where,about when", "", "", "", "", ""), ("SUBJECT", "DET-POSS", "", "", _NP, "", "", "")]),
    (4, 1, "verb", None, "NOM-WHERE-WHEN-S", "WHERE-WHEN-S", "SUBJECT", "", "", [("WHERE-WHEN-S", "PREFIX", "how many,how much,where,when", "", "", "", "", ""), _VS]),
    (5, 1, "nom", "IND-OBJ", "NOM-NP-TO-NP", "IND-OBJ,OBJECT", "SUBJECT", "", "IND-OBJ:N-N-MOD OBJECT:of SUBJECT:DET-POSS", [_NOM("IND-OBJ"), _OF, _DS]),
    (5, 1, "verb", None, "NOM-NP-TO-NP", "IND-OBJ,OBJECT", "SUBJECT", "", "", [("IND-OBJ", "IOBJ,PREFIX", "to", "", _NP, "", "", ""), _VO, _VS]),
    (6, 1, "nom", "VERB-NOM", "NOM-PP-PP", "PP1,PP2", "SUBJECT", "", "", [("PP1", "N-N-MOD,PREFIX", "from", "", _NP, "", "", ""), _PP2]),
    (6, 1, "verb", None, "NOM-PP-PP", "PP1,PP2", "SUBJECT", "", "", [("PP1", "PREFIX", "from", "", _NP, "", "", ""), _PP2, _VS]),
    (6, 1, "nom", "VERB-NOM", "NOM-ADVP", "", "ADJP,ADVP,SUBJECT", "ADVP-OR-ADJP", "", [("ADVP", "ADMOD", "", "", "ADV", "", "", ""), ("ADJP", "AJMOD", "", "", "ADJ", "", "", "")]),
    (6, 1, "verb", None, "NOM-ADVP", "ADVP", "SUBJECT", "", "", [("ADVP", "ADMOD", "", "", "ADV", "", "", ""), _VS]),
    (7, 1, "nom", "VERB-NOM", "NOM-S", "SBAR", "SUBJECT", "", "", [("SBAR", "THAT", "", "", "", "nsubj,mark_that", "", ""), _DS]),
    (7, 1, "verb", None, "NOM-S", "SBAR", "SUBJECT", "", "", [("SBAR", "SBAR,THAT", "", _WH, "", "nsubj", "", ""), _VS]),
    (7, 1, "nom", "VERB-NOM", "NOM-ING-SC", "ING-SC", "SUBJECT", "", "", [("ING-SC", "PREFIX", "of", f"{_WH},that", "VERB", "", "ing$", ""), _DS]),
    (7, 1, "verb", None, "NOM-ING-SC", "ING-SC", "SUBJECT", "", "", [("ING-SC", "ING", "", f"{_WH},that", "VERB", "", "ing$", "OPTIONAL-POSSESSIVE"), _VS]),
]


def _quoted(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def oracle_sql(pairs: str) -> dict[str, str]:
    """SQL over `pairs`, a WITH that ends in `prd` with the nominalizations (verb, nom)."""
    values = ",\n".join("(" + ", ".join(map(_quoted, (*row[:-1], *arg))) + ")" for row in _COMPILED for arg in row[-1])
    base = pairs.rstrip() + f""",
nouns AS (SELECT DISTINCT verb, nom, (length(nom) + ascii(nom)) % {len(FORMS)} AS form FROM pred WHERE regexp_full_match(nom, '[a-z]+')),
rule(form, sense, side, nom_type, subcat, required, optional, constraints, clauses, "type", positions, prefixes, illegal_prefixes, root_upostags, root_urelations, root_patterns, marks) AS (VALUES
{values}),
sided AS (SELECT *, side AS kind, CASE WHEN side = 'verb' THEN verb ELSE nom END AS orth FROM nouns JOIN rule USING (form) UNION ALL SELECT *, 'plural', nom || 's' FROM nouns JOIN rule USING (form) WHERE side = 'nom' AND form <> 4),
keyed AS (SELECT *, orth || CASE WHEN sense = 1 THEN '' ELSE '#' || sense END AS entry_key FROM sided)
"""
    number = "CASE WHEN sense = 1 THEN '' ELSE '#' || sense END"
    first5 = "array_to_string(list_sort(list(DISTINCT orth))[1:5], ',') AS examples"
    return {
        "lexicon_values": base
        + f""", kinds AS (SELECT orth, 'positions' AS property, unnest(string_split(positions, ',')) AS "value" FROM keyed UNION ALL SELECT orth, 'prefixes', unnest(string_split(prefixes, ',')) FROM keyed
            UNION ALL SELECT orth, 'illegal_prefixes', unnest(string_split(illegal_prefixes, ',')) FROM keyed UNION ALL SELECT orth, 'constraints', unnest(string_split(marks, ',')) FROM keyed UNION ALL SELECT orth, 'root_upostags', unnest(string_split(root_upostags, ',')) FROM keyed)
            SELECT property, "value", count(DISTINCT orth) AS n, {first5} FROM kinds WHERE "value" <> '' GROUP BY property, "value\"""",
        "lexicon_collisions": base
        + f""", core AS (SELECT *, list_filter(list_concat(string_split(positions, ','), string_split(prefixes, ',')), lambda x: x NOT IN ('', 'PREFIX')) AS ps FROM keyed WHERE "type" IN ('SUBJECT', 'OBJECT', 'IND-OBJ', 'PP', 'PP1', 'PP2'))
            SELECT a."type" AS one, b."type" AS other, count(DISTINCT a.orth) AS n, array_to_string(list_sort(list(DISTINCT a.orth))[1:5], ',') AS examples
            FROM core a JOIN core b ON a.entry_key = b.entry_key AND a.kind = b.kind AND a.subcat = b.subcat AND a."type" < b."type" AND list_has_any(a.ps, b.ps) GROUP BY a."type", b."type\"""",
        "lexicon_arguments": base + 'SELECT entry_key, kind, nom_type, subcat, required, optional, constraints, clauses, "type", positions, prefixes, illegal_prefixes, root_upostags, root_urelations, root_patterns, marks FROM keyed',
        "lexicon_links": base + f"SELECT DISTINCT entry_key, kind, orth, verb || {number} AS verb_key, nom || {number} AS nom_key, CASE WHEN form <> 4 THEN nom || 's' || {number} END AS plural_key FROM keyed",
        "lexicon_splits": base
        + """, names(form, path, nom_type, subcats) AS (VALUES (0, '', 'VERB-NOM', 'NOM-INTRANS,NOM-NP'), (1, '', 'SUBJECT', 'NOM-NP-PP'), (2, '', 'VERB-NOM', 'NOM-NP-TO-INF-OC'), (2, '/OBJECT', 'OBJECT', 'NOM-NP-TO-INF-OC'), (3, '', 'VERB-NOM', 'NOM-INTRANS'),
            (3, '/fixed', 'VERB-NOM', 'NOM-INTRANS'), (4, '', 'VERB-NOM', 'NOM-P-POSSING,NOM-WHERE-WHEN-S'), (5, '', 'IND-OBJ', 'NOM-NP-TO-NP'), (6, '', 'VERB-NOM', 'NOM-ADVP,NOM-PP-PP'), (7, '', 'VERB-NOM', 'NOM-ING-SC,NOM-OF-NO-TABLE,NOM-S'))
            SELECT nom || path AS id, nom AS orth, verb, nom_type, subcats FROM nouns JOIN names USING (form)""",
        "lexicon_defaults": base
        + """, each AS (SELECT side = 'verb' AS is_verb, CASE WHEN "type" IN ('PP1', 'PP2') THEN 'PP' ELSE regexp_replace("type", '-(OC|SC|POC|NPC|VC)$', '') END AS "type", positions, prefixes, root_upostags, marks FROM keyed)
            SELECT is_verb, "type", """
        + ", ".join(f"array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN {c} = '' THEN [] ELSE string_split({c}, ',') END)))), ',') AS {c}" for c in ("positions", "prefixes", "root_upostags"))
        + """, array_to_string(list_sort(list_filter(list_distinct(flatten(list(CASE WHEN marks = '' THEN [] ELSE string_split(marks, ',') END))), lambda m: m NOT IN ('PLURAL', 'DET-POSS-NO-OTHER-OBJ', 'N-N-MOD-NO-OTHER-OBJ'))), ',') AS marks
            FROM each GROUP BY is_verb, "type\"""",
    }
