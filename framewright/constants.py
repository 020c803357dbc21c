"""Fixed values of the linguistic data model."""

from __future__ import annotations

# Positions, in order of preference, of a child under each dependency label; for verbs and for nouns.
VERB_POSITIONS = {
    "nmod": ["PREFIX", "TO-INF"], "nsubj": ["NSUBJ"], "nsubjpass": ["NSUBJPASS"], "dobj": ["DOBJ"], "iobj": ["IOBJ"], "advmod": ["ADMOD", "PREFIX"], "amod": [],
    "advcl": ["PREFIX", "ING", "TO-INF"], "xcomp": ["PREFIX", "ING", "TO-INF"], "ccomp": ["PREFIX", "ING", "THAT", "SBAR"], "acl": [], "acl:relcl": [],
    "nmod:poss": ["DET-POSS"], "compound": [], "prt": ["PART"], "compound:prt": ["PART"],
}
NOUN_POSITIONS = {
    "nmod": ["PREFIX", "TO-INF"], "nsubj": [], "nsubjpass": [], "dobj": [], "iobj": [], "advmod": ["ADMOD", "PREFIX"], "amod": ["AJMOD"],
    "advcl": [], "xcomp": [], "ccomp": ["THAT"], "acl": ["PREFIX", "ING", "TO-INF"], "acl:relcl": ["THAT"],
    "nmod:poss": ["DET-POSS"], "compound": ["N-N-MOD"], "prt": [], "compound:prt": [],
}

# Word lists.
P_DIR = ["down", "across", "from", "into", "off", "onto", "out", "out of", "outside", "over", "past", "through", "to", "toward", "towards", "up", "up to", "via"]
P_LOC = ["above", "about", "against", "along", "around", "behind", "below", "beneath", "beside", "between", "beyond", "by", "in", "inside", "near", "next to", "on", "throughout", "under", "upon", "within"]
POSSESSIVES = ["my", "your", "his", "our", "her", "their", "its"]
PRONOUNS = ["i", "he", "she", "it", "they", "we", "-PRON-"]
WH_VERB, WH_NOM = ["if", "whether", "what"], ["whether", "what"]
WHERE_WHEN, HOW, HOW_TO = ["where", "when", "how many", "how much"], ["how"], ["how to"]
NONE_VALUES = ["NONE", "*NONE*", "none"]

# Labels of training rows, and the types of a nominalization with the complements they stand for.
LABELS = ["SUBJECT", "OBJECT", "IND-OBJ", "PP", "NONE", "VERB-NOM", "NOT-NOM"]
NOM_TYPE_ARGS = {"VERB-NOM": [], "SUBJECT": ["SUBJECT"], "OBJECT": ["OBJECT"], "IND-OBJ": ["IND-OBJ", "PP1", "PP2", "PP"]}
SUBCAT_TYPOS = {"NOM-INSTRANS": "NOM-INTRANS", "INTRANS": "NOM-INTRANS"}
NP_TAGS = ["PROPN", "NOUN", "PRON", "DET"]
NP_TYPES = ["SUBJECT", "OBJECT", "IND-OBJ", "NP"]
