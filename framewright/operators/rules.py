"""The known subcategorizations as data, and what follows from a complement's name.

Of each: the complements it requires, default positions, renamings, and where special positions of a complement stand in an entry.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from framewright import constants as C

# Name | required | default positions | renamed complements | special positions; V / N where verb and noun differ.
SUBCATS = """
NOM-INTRANS | - | - | - | -
NOM-INTRANS-RECIP | - | - | - | -
NOM-NP | OBJECT / - | - | - | -
NOM-NP-NP | IND-OBJ OBJECT | IND-OBJ=IOBJ / - | IND-OBJ>IGNORE / - | -
NOM-PP | PP | - | - | -
NOM-PP-PP | PP1 PP2 | - | PP>PP1 | -
NOM-NP-PP | OBJECT PP / PP | - | - | -
NOM-NP-TO-NP | OBJECT IND-OBJ | IND-OBJ=to,IOBJ / IND-OBJ=to | IND-OBJ>IGNORE / - | -
NOM-NP-FOR-NP | OBJECT IND-OBJ | IND-OBJ=for,IOBJ / IND-OBJ=for | IND-OBJ>IGNORE / - | -
NOM-NP-PP-PP | OBJECT PP1 PP2 / PP1 PP2 | - | PP>PP1 | -
NOM-ADVP | ADVP / - | ADVP=ADMOD / ADVP=ADMOD,OPTIONAL-POSITION; ADJP=AJMOD,OPTIONAL-POSITION | - | -
NOM-NP-ADVP | OBJECT ADVP / - | ADVP=ADMOD / ADVP=ADMOD,OPTIONAL-POSITION; ADJP=AJMOD,OPTIONAL-POSITION | - | -
NOM-ADVP-PP | ADVP PP / PP | ADVP=ADMOD / ADVP=ADMOD,OPTIONAL-POSITION; ADJP=AJMOD,OPTIONAL-POSITION | - | -
NOM-NP-AS-ING | OBJECT AS-ING-OC | AS-ING-OC=as | - | -
NOM-NP-AS-ADJP | OBJECT AS-ADJP | AS-ADJP=as | - | -
NOM-AS-NP | SUBJECT AS-NP-SC | AS-NP-SC=as | - | -
NOM-NP-AS-NP | OBJECT AS-NP-OC | AS-NP-OC=as | - | -
NOM-NP-AS-NP-SC | SUBJECT OBJECT AS-NP-SC / SUBJECT AS-NP-SC | AS-NP-SC=as | - | -
NOM-NP-PP-AS-NP | OBJECT PP AS-NP-OC | AS-NP-OC=as | PP1>PP | -
NOM-ING-SC | ING-SC | ING-SC=ING / ING-SC=of | - | - / ING-SC@P-
NOM-NP-ING | OBJECT ING-OC | ING-OC=ING | - | -
NOM-NP-ING-OC | OBJECT ING-OC | ING-OC=ING | - | -
NOM-NP-ING-SC | OBJECT ING-SC | ING-SC=ING | - | -
NOM-P-ING-SC | P-ING-SC | - | PP>P-ING-SC | P-ING-SC@P-
NOM-NP-P-ING | OBJECT P-ING-OC | - | PP>P-ING-OC | P-ING-OC@P-
NOM-NP-P-ING-OC | OBJECT P-ING-OC | - | PP>P-ING-OC | P-ING-OC@P-
NOM-NP-P-ING-SC | OBJECT P-ING-SC | - | PP>P-ING-SC | P-ING-SC@P-
NOM-P-NP-ING | PP ING-POC | ING-POC=ING | - | -
NOM-NP-P-NP-ING | OBJECT PP ING-POC | ING-POC=ING | - | -
NOM-POSSING | POSSING | POSSING=ING / POSSING=of | - | - / POSSING@P-
NOM-P-POSSING | P-POSSING | - | PP>P-POSSING | P-POSSING@P-
NOM-PP-P-POSSING | PP P-POSSING | P-POSSING=about,on; PP=between,among,with | PP>P-POSSING PP1>PP | -
NOM-POSSING-PP | POSSING PP | POSSING=ING / POSSING=of | - | - / POSSING@P-
NOM-NP-P-POSSING | OBJECT P-POSSING | - | PP>P-POSSING | P-POSSING@P-
NOM-FOR-TO-INF | FOR-TO-INF | FOR-TO-INF=for,TO-INF | - | -
NOM-NP-TO-INF-OC | OBJECT TO-INF-OC | TO-INF-OC=TO-INF | - | -
NOM-NP-TO-INF-SC | OBJECT TO-INF-SC | TO-INF-SC=TO-INF | - | -
NOM-NP-TO-INF-VC | OBJECT TO-INF-VC | TO-INF-VC=TO-INF | - | -
NOM-TO-INF-SC | TO-INF-SC | TO-INF-SC=TO-INF | - | -
NOM-P-NP-TO-INF-OC | PP TO-INF-POC | TO-INF-POC=TO-INF | - | -
NOM-P-NP-TO-INF | PP TO-INF-POC | TO-INF-POC=TO-INF | - | -
NOM-P-NP-TO-INF-VC | PP TO-INF-VC | TO-INF-VC=TO-INF | - | -
NOM-PP-FOR-TO-INF | PP FOR-TO-INF | FOR-TO-INF=for,TO-INF | PP1>PP | -
NOM-S | SBAR | SBAR=SBAR,THAT / SBAR=THAT | - | -
NOM-THAT-S | SBAR | SBAR=THAT | - | -
NOM-S-SUBJUNCT | SBAR | SBAR=SBAR,THAT / SBAR=THAT | - | -
NOM-NP-S | OBJECT SBAR | SBAR=SBAR,THAT / SBAR=THAT | - | -
NOM-PP-THAT-S | PP SBAR | SBAR=THAT | PP1>PP | -
NOM-PP-THAT-S-SUBJUNCT | PP SBAR | SBAR=THAT | PP1>PP | -
NOM-NP-AS-IF-S-SUBJUNCT | OBJECT AS-IF-S | AS-IF-S=as if | - | -
NOM-WH-S | WH-S | WH-S=if,whether,what / WH-S=of | - | - / WH-S@P-WH
NOM-WHERE-WHEN-S | WHERE-WHEN-S | WHERE-WHEN-S=where,when,how many,how much / WHERE-WHEN-S=of | - | - / WHERE-WHEN-S@P-WH
NOM-HOW-S | HOW-S | HOW-S=how / HOW-S=of | - | - / HOW-S@P-WH
NOM-PP-HOW-TO-INF | HOW-TO-INF | HOW-TO-INF=how to; PP=OPTIONAL-POSITION / HOW-TO-INF=of; PP=OPTIONAL-POSITION | PP1>PP | - / HOW-TO-INF@P-WH
NOM-NP-WH-S | OBJECT WH-S / WH-S | WH-S=if,whether,what / WH-S=of | - | - / WH-S@P-WH
NOM-P-WH-S | P-WH-S | - | PP>P-WH-S | P-WH-S@P-WH
NOM-PP-WH-S | PP WH-S | WH-S=if,whether,what / WH-S=of | PP1>PP | - / WH-S@P-WH
NOM-PP-P-WH-S | PP P-WH-S | - | PP>P-WH-S PP1>PP | P-WH-S@P-WH
NOM-NP-P-WH-S | OBJECT P-WH-S / P-WH-S | - | PP>P-WH-S | P-WH-S@P-WH
"""
# The complements, and the positions written in capitals, that a compiled lexicon knows.
COMPLEMENTS = [
    "SUBJECT", "SECOND-SUBJECT", "OBJECT", "IND-OBJ", "PP", "PP1", "PP2", "AS-NP-OC", "AS-NP-SC", "ADVP", "ADJP", "AS-ADJP", "ING-OC", "ING-SC", "ING-POC", "ING-ARBC", "POSSING",
    "AS-ING-OC", "P-ING-OC", "P-ING-SC", "P-ING-ARBC", "P-POSSING", "TO-INF", "TO-INF-OC", "TO-INF-SC", "TO-INF-VC", "TO-INF-POC", "FOR-TO-INF",
    "SBAR", "WH-S", "WHERE-WHEN-S", "HOW-S", "HOW-TO-INF", "P-WH-S", "AS-IF-S", "PARTICLE", "NONE",
]
POSITIONS = ["N-N-MOD", "DET-POSS", "NSUBJ", "NSUBJPASS", "DOBJ", "IOBJ", "AJMOD", "ADMOD", "TO-INF", "SBAR", "THAT", "ING", "ACL", "PART", "PREFIX", "NOM"]
RULE = "subcat string, is_verb boolean, usual array<string>, defaults map<string,array<string>>, names map<string,string>, special map<string,string>, more map<string,map<string,array<string>>>, subcat_constraints array<string>"


def constraints_of(subcat: str, complement: str, is_verb: bool) -> dict[str, list[str]]:
    """What an argument's root has to be, by the complement's kind; a few depend on the subcategorization or the side."""
    out: dict[str, list[str]] = {}
    gerund = "ING" in complement
    if gerund:
        out |= {"root_upostags": ["VERB"], "root_patterns": ["ing$"]}
    elif "TO-INF" in complement:
        out |= {"root_upostags": ["VERB", "AUX"], "root_urelations": ["mark_TO", *(["nsubj"] if complement == "FOR-TO-INF" else [])]}
    elif complement == "SBAR":
        by_that = not is_verb or "THAT" in subcat
        out["root_urelations"] = ["nsubj", *(["mark_that"] if by_that else [])]
        if is_verb and subcat in ("NOM-S", "NOM-NP-S"):
            out["illegal_prefixes"] = [*C.WHERE_WHEN, *C.HOW, *C.WH_VERB]
    elif complement == "AS-IF-S":
        out["root_urelations"] = ["nsubj"]
    elif complement in ("ADVP", "ADJP", "AS-ADJP"):
        out["root_upostags"] = ["ADV" if complement == "ADVP" else "ADJ"]
    marks = []
    if "POSSING" in complement or (is_verb and (subcat, complement) in (("NOM-ING-SC", "ING-SC"), ("NOM-P-ING-SC", "P-ING-SC"))):
        marks.append("OPTIONAL-POSSESSIVE")
    if complement == "FOR-TO-INF":
        marks.append("REQUIRED-PREFIX")
    if "SUBJUNCT" in subcat and complement in ("SBAR", "AS-IF-S"):
        marks.append("SUBJUNCT")
    if (subcat, complement) == ("NOM-INTRANS-RECIP", "SUBJECT"):
        marks.append("PLURAL")
    return out | ({"constraints": marks} if marks else {})


def parsed() -> list[tuple]:
    """The table's rows, one for each subcategorization and side."""
    out = []
    for line in SUBCATS.strip().splitlines():
        name, *cells = (c.strip() for c in line.split("|"))
        for side, is_verb in enumerate((True, False)):
            required, defaults, names, special = ("" if (own := (c.split(" / ") * 2)[side].strip()) == "-" else own for c in cells)
            usual = required.split()
            given = {k.strip(): v.split(",") for k, v in (x.split("=") for x in re.split(r";\s*", defaults) if x)}
            moves = dict(x.split(">") for x in names.split())
            paths = dict(x.split("@") for x in special.split())
            known = {*usual, *given, *moves.values(), *paths, "SUBJECT"} - {"IGNORE"}
            more = {k: c for k in sorted(known) if (c := constraints_of(name, k, is_verb))}
            out.append((name, is_verb, usual, given, moves, paths, more, ["ADVP-OR-ADJP"] if "ADVP" in name and not is_verb else []))
    return out


def table(spark: SparkSession) -> DataFrame:
    """The rules as a DataFrame, two rows for each of the known subcategorizations."""
    return spark.createDataFrame(parsed(), RULE)
