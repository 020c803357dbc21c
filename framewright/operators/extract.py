"""Extraction: predicates x lexicon, candidates x arguments, their products under constraints, and the choice among them.

Each function is DataFrame -> DataFrame over rows keyed by (doc_id, sent_id, pred_i), all of them partitioned by sentence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright import constants as C
from framewright.functions.columns import first, is_lower, let, strings
from framewright.operators.trees import SENTENCE, children, has_relations, in_relation, related

PREDICATE = [*SENTENCE, "pred_i"]
ARG = "struct<type:string,positions:array<string>,prefixes:array<string>,illegal_prefixes:array<string>,root_upostags:array<string>,root_urelations:array<string>,root_patterns:array<string>,constraints:array<string>,including:array<string>>"
LEXICON = f"is_verb boolean, entry_key string, verb string, subcat string, required array<string>, constraints array<string>, not_clauses array<map<string,array<string>>>, args array<{ARG}>"
MATCH = "struct<type:string,name:string,head_i:int,position:string,lo:int,hi:int,plural_ok:boolean,including:array<string>>"


def argument(type: str, positions=(), prefixes=(), illegal_prefixes=(), root_upostags=(), root_urelations=(), root_patterns=(), constraints=(), including=()) -> tuple:
    return (type, *(list(x) for x in (positions, prefixes, illegal_prefixes, root_upostags, root_urelations, root_patterns, constraints, including)))


def lexicon(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A lexicon from (is_verb, entry_key, verb, subcat, required, constraints, not_clauses, args) rows."""
    return spark.createDataFrame(rows, LEXICON)


def predicates(trees: DataFrame, lex: DataFrame | Callable[[DataFrame], DataFrame], condition=None) -> DataFrame:
    """A row for each predicate and each of its subcategorizations: verbs are looked up by lemma, nouns by form.

    `lex` is a table, or gives entries that follow from the word to rows with is_verb and entry_key. `condition` (token -> boolean column) limits the tokens that are looked at.
    """
    fits = lambda t: t["pos"].isin("NOUN", "VERB") & (condition(t) if condition else F.lit(True))
    found = trees.select(*SENTENCE, "toks", F.explode(F.filter("toks", fits)).alias("p"))
    verb = F.col("p.pos") == "VERB"
    found = found.withColumn("is_verb", verb).withColumn("entry_key", F.lower(F.when(verb, F.col("p.lemma")).otherwise(F.col("p.orth")))).withColumn("pred_i", F.col("p.i"))
    return lex(found) if callable(lex) else found.join(lex, ["is_verb", "entry_key"])


def non_predicates(trees: DataFrame, lex: DataFrame) -> DataFrame:
    """Nouns and verbs that are no entry of the lexicon."""
    found = trees.select(*SENTENCE, F.explode(F.filter("toks", lambda t: t["pos"].isin("NOUN", "VERB"))).alias("p"))
    verb = F.col("p.pos") == "VERB"
    found = found.select(*SENTENCE, F.col("p.i").alias("i"), F.col("p.orth").alias("orth"), verb.alias("is_verb"), F.lower(F.when(verb, F.col("p.lemma")).otherwise(F.col("p.orth"))).alias("entry_key"))
    return found.join(lex.select("is_verb", "entry_key").distinct(), ["is_verb", "entry_key"], "left_anti")


def _table(of: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for dep, ps in of.items() for x in (F.lit(dep), strings(*ps))])


def candidates_of(toks: Column, pred: Column, is_verb: Column) -> Column:
    """Candidates of a predicate: (tok, positions) of children with a known label, and a noun itself as NOM."""
    table = F.when(is_verb, _table(C.VERB_POSITIONS)).otherwise(_table(C.NOUN_POSITIONS))
    known = strings(*C.VERB_POSITIONS)
    kids = F.filter(children(toks, pred["i"]), lambda t: F.array_contains(known, t["dep"]))
    cands = F.transform(kids, lambda t: F.struct(t.alias("tok"), table[t["dep"]].alias("positions")))
    return F.when(is_verb, cands).otherwise(F.concat(cands, F.array(F.struct(pred.alias("tok"), strings("NOM").alias("positions")))))


def first_prefix(text: Column, prefixes: Column) -> Column:
    """The first of the prefixes, in their order, that starts the text at a word's end."""
    return first(F.filter(prefixes, lambda p: F.concat(text, F.lit(" ")).startswith(F.concat(p, F.lit(" ")))))


def is_possessive(t: Column) -> Column:
    return F.lower(t["text"]).rlike(r"('s|' s|s'|s ')$") | F.lower(t["orth"]).isin(C.POSSESSIVES)


def root_fits(toks: Column, tok: Column, arg: Column, position: Column) -> Column:
    """Whether the candidate's root obeys the argument. Inside a preposition of several words the root is the child after it."""
    words = F.size(F.split(position, " "))
    start = first(tok["subtree"])
    moved = is_lower(position) & (words > 1) & (tok["i"] - start < words)
    after = first(F.filter(children(toks, tok["i"]), lambda k: k["i"] >= start + words))

    def holds(r: Column, kids: Column) -> Column:
        inf, ing = arg["type"].contains("TO-INF"), arg["type"].contains("ING")
        copula = (inf | ing) & F.exists(kids, lambda k: related(k, F.when(inf, F.lit("cop_be")).otherwise(F.lit("cop_being"))))
        tags = (F.size(arg["root_upostags"]) == 0) | F.array_contains(arg["root_upostags"], r["pos"])
        bare = (r["pos"] == "DET") & arg["type"].isin(C.NP_TYPES) & ~F.lower(r["orth"]).isin(C.POSSESSIVES)
        gerund = ~F.array_contains(arg["root_patterns"], "ing$") | F.lower(r["orth"]).endswith("ing")
        return has_relations(kids, arg["root_urelations"]) & (copula | (tags & ~bare & gerund))

    return let(F.when(moved, after).otherwise(tok), lambda r: r.isNotNull() & let(children(toks, r["i"]), lambda kids: holds(r, kids)))


def matched_name(toks: Column, tok: Column, arg: Column) -> Column:
    """The argument's type, or its possessive or arbitrary variant where a possessive is optional."""
    optional = F.array_contains(arg["constraints"], "OPTIONAL-POSSESSIVE")
    kids = children(toks, tok["i"])
    poss = F.exists(F.filter(F.array(in_relation(kids, F.lit("nmod:poss")), in_relation(kids, F.lit("nsubj"))), lambda t: t.isNotNull()), is_possessive)
    has = arg["type"].contains("POSSING")
    named = F.when(poss & ~has, F.replace(arg["type"], F.lit("ING"), F.lit("POSSING"))).when(~poss & has, F.replace(arg["type"], F.lit("POSSING"), F.lit("ING-ARBC"))).otherwise(arg["type"])
    return F.when(optional, named).otherwise(arg["type"])


def match(toks: Column, pred: Column, cand: Column, arg: Column) -> Column:
    """The candidate as this argument, at the first of its positions that passes; null if none does."""
    tok = cand["tok"]
    n_words = lambda s: F.size(F.split(s, " "))

    def at(position: Column, prefix: Column) -> Column:
        placed = F.when(position == "PREFIX", prefix).otherwise(position)
        whole = n_words(prefix) == n_words(tok["text"])
        fits = F.when(position == "PREFIX", prefix.isNotNull() & ~whole).otherwise(~F.array_contains(arg["constraints"], "REQUIRED-PREFIX") | prefix.isNotNull())
        return F.when(F.array_contains(arg["positions"], position) & fits & first_prefix(tok["text"], arg["illegal_prefixes"]).isNull() & root_fits(toks, tok, arg, placed), placed)

    placed = lambda prefix: first(F.filter(F.transform(cand["positions"], lambda p: at(p, prefix)), lambda x: x.isNotNull()))
    encloses = (tok["i"] != pred["i"]) & (first(tok["subtree"]) <= pred["i"]) & (F.element_at(tok["subtree"], -1) >= pred["i"])
    plural = ~F.array_contains(arg["constraints"], "PLURAL") | tok["tag"].isin("NNS", "NNPS")
    found = lambda position: F.when(
        position.isNotNull() & ~encloses,
        F.struct(arg["type"].alias("type"), matched_name(toks, tok, arg).alias("name"), tok["i"].alias("head_i"), position.alias("position"), first(tok["subtree"]).alias("lo"), F.element_at(tok["subtree"], -1).alias("hi"), plural.alias("plural_ok"), arg["including"].alias("including")),
    )
    return let(let(first_prefix(tok["text"], arg["prefixes"]), placed), found)


def matches(preds: DataFrame, max_candidates: int | None = None) -> DataFrame:
    """Adds `options`: for each candidate with any, the arguments it can be. Rows that miss a required argument go.

    `max_candidates` is the feature of the older engine that passes over predicates with more candidates.
    """
    p, toks = F.col("p"), F.col("toks")
    cands = preds.withColumn("cands", candidates_of(toks, p, F.col("is_verb")))
    if max_candidates is not None:
        cands = cands.filter(F.size("cands") <= max_candidates)
    options = F.transform("cands", lambda c: F.array_distinct(F.filter(F.transform("args", lambda a: match(toks, p, c, a)), lambda m: m.isNotNull())))
    complete = lambda os: F.forall("required", lambda r: F.exists(os, lambda o: F.exists(o, lambda m: m["type"] == r)))
    # A filter on rows would be pushed below the matching and repeat it.
    return cands.withColumn("options", F.explode(F.filter(F.array(F.filter(options, lambda o: F.size(o) > 0)), complete))).drop("cands")


def combinations(options: Column, null_choice: bool, is_default: Column | None = None) -> Column:
    """Every choice of one argument for each candidate (with `null_choice`, or of none).

    With `null_choice` and outside the default entry a type comes once: of two the last would win, which is the choice of none for the other.
    """
    empty = F.array(F.array().cast(f"array<{MATCH}>"))
    if not null_choice:
        product = F.aggregate(options, empty, lambda acc, o: F.flatten(F.transform(acc, lambda a: F.transform(o, lambda m: F.concat(a, F.array(m))))))
        return product
    free = lambda a, m: F.coalesce(is_default, F.lit(False)) | ~F.exists(a, lambda y: y["type"] == m["type"])
    more = lambda a, o: F.transform(F.filter(o, lambda m: free(a, m)) if is_default is not None else o, lambda m: F.concat(a, F.array(m)))
    return F.aggregate(options, empty, lambda acc, o: F.concat(acc, F.flatten(F.transform(acc, lambda a: more(a, o)))))


def as_map(args: Column, is_default: Column) -> Column:
    """One argument a type, the last one wins; pairs of PP under the default entry become PP1 and PP2."""

    def renamed(xs: Column) -> Column:
        n = F.size(F.filter(xs, lambda x: x["type"] == "PP"))

        def one(x: Column, i: Column) -> Column:
            k = F.size(F.filter(F.slice(xs, 1, i + 1), lambda y: y["type"] == "PP"))
            kind = F.when(k % 2 == 0, "PP2").when(k < n, "PP1").otherwise("PP")
            return F.when(x["type"] == "PP", x.withField("type", kind).withField("name", kind)).otherwise(x)

        return F.when(is_default & (n > 1), F.transform(xs, one)).otherwise(xs)

    return let(renamed(args), lambda xs: F.filter(xs, lambda x, i: ~F.exists(F.slice(xs, i + 2, F.size(xs)), lambda y: y["type"] == x["type"])))


def obeys(xs: Column, pred_i: Column, is_verb: Column, required: Column, constraints: Column, not_clauses: Column, args: Column) -> Column:
    """All constraints of a subcategorization on an extraction."""
    types = F.transform(xs, lambda x: x["type"])
    of = lambda t: first(F.filter(xs, lambda x: x["type"] == t))
    at = lambda t: F.coalesce(of(t)["head_i"], pred_i)
    rest = F.concat(F.array(pred_i), F.transform(F.filter(xs, lambda x: ~x["type"].isin("SUBJECT", "OBJECT", "IND-OBJ")), lambda x: x["head_i"]))
    before = lambda least, a, *others: (a >= pred_i) | (a <= F.least(least, *others) if others else a <= least)
    ordered = lambda least: before(least, at("SUBJECT"), at("IND-OBJ"), at("OBJECT")) & before(least, at("IND-OBJ"), at("OBJECT")) & before(least, at("OBJECT"))
    ordering = is_verb | let(F.array_min(rest), ordered)
    modifier = ~F.array_contains(constraints, "ADVP-OR-ADJP") | F.arrays_overlap(types, strings("ADVP", "ADJP"))
    passive = ~is_verb | ~F.coalesce(of("SUBJECT")["position"] == "by", F.lit(False)) | F.coalesce(of("OBJECT")["position"] == "NSUBJPASS", F.lit(True))
    # A clause is escaped by an argument at a position outside its list; untouched clauses do not count as escaped.
    escaped = F.exists(not_clauses, lambda c: F.exists(xs, lambda x: F.map_contains_key(c, x["type"]) & ~F.array_contains(c[x["type"]], x["position"])))
    allowed = (F.size(not_clauses) == 0) | escaped
    once = lambda p: F.size(F.filter(xs, lambda x: x["position"] == p)) <= 1
    unique = (F.size(F.array_distinct(types)) == F.size(types)) & (is_verb | (once("DET-POSS") & once("of")))
    objects = F.filter(xs, lambda x: x["type"].isin("OBJECT", "IND-OBJ", "SUBJECT"))
    claimed = lambda o: F.exists(args, lambda a: (a["type"] != o["type"]) & o["position"].isin("DET-POSS", "N-N-MOD") & F.array_contains(a["constraints"], F.concat(o["position"], F.lit("-NO-OTHER-OBJ"))))
    single = is_verb | (F.size(objects) != 1) | ~F.exists(objects, claimed)
    plural = F.forall(xs, lambda x: x["plural_ok"] | F.arrays_overlap(x["including"], types))
    return (F.size(xs) > 0) & (F.size(F.array_except(required, types)) == 0) & ordering & modifier & passive & allowed & unique & single & plural


def structures(matched: DataFrame, null_choice: bool = False, largest: bool = False) -> DataFrame:
    """A row for each extraction that obeys its subcategorization: doc_id, sent_id, pred_i, is_verb, verb, subcat, toks, xs.

    largest: only those with most arguments of each subcategorization, where a choice of the largest follows anyway.
    """
    default = F.col("subcat") == "DEFAULT"
    fits = lambda xs: obeys(xs, F.col("pred_i"), F.col("is_verb"), F.col("required"), F.col("constraints"), F.col("not_clauses"), F.col("args"))
    every = combinations(F.col("options"), null_choice, default)
    mapped = F.array_distinct(F.transform(every, lambda c: as_map(c, default)))
    # With a choice of none and outside the default entry all are different, and have a type once.
    each = F.when(default, mapped).otherwise(every) if null_choice else mapped
    if largest:
        sized = lambda cs, n: F.filter(cs, lambda xs: (F.size(xs) == n) & fits(xs))
        down = lambda cs, top: F.aggregate(F.sequence(F.lit(0), top), F.filter(cs, lambda _: F.lit(False)), lambda got, k: F.when(F.size(got) > 0, got).otherwise(sized(cs, top - k)))
        most = lambda cs: F.coalesce(F.array_max(F.transform(cs, F.size)), F.lit(0))
        each = let(each, lambda cs: let(most(cs), lambda top: down(cs, top)))
    else:
        each = F.filter(each, fits)
    return matched.select(*PREDICATE, "is_verb", "verb", "subcat", "toks", F.explode(each).alias("xs"))


def more_informative(a: Column, b: Column) -> Column:
    """Whether `b` is to be preferred over `a`, both at one head: the ordered rules on types, names and positions."""
    p, q, s, t, n, m = a["position"], b["position"], a["type"], b["type"], a["name"], b["name"]
    both = is_lower(p) & is_lower(q)
    return (
        (both & ((F.length(p) < F.length(q)) | (s.isin("PP", "PP1", "PP2") & t.startswith("P-")) | (~s.startswith("AS-") & t.startswith("AS-"))))
        | (s.startswith("TO-INF") & t.startswith("FOR-"))
        | (n.contains("-ARBC") & (F.replace(n, F.lit("-ARBC"), F.lit("")) == m))
        | (m.contains("POSS") & (F.replace(m, F.lit("POSS"), F.lit("")) == n))
        | (is_lower(p) & (t == "FOR-TO-INF"))
        | (p.isin("ING", "TO-INF") & is_lower(q))
        | ((s == "ADVP") & is_lower(q))
        | (F.concat(F.lit("P-"), s) == t)
        | ((s == "AS-ADJP") & t.contains("AS-ING"))
    )


def longest(found: DataFrame) -> DataFrame:
    w = W.partitionBy(*PREDICATE).orderBy(F.desc(F.size("xs")))
    return found.withColumn("_rank", F.rank().over(w)).filter("_rank = 1").drop("_rank")


def informative(found: DataFrame) -> DataFrame:
    """Without extractions that another one over the same tokens dominates at any argument; two can drop each other."""
    heads = F.sort_array(F.transform("xs", lambda x: x["head_i"]))
    rivals = found.withColumn("_heads", heads).withColumn("_all", F.collect_set("xs").over(W.partitionBy(*PREDICATE, "_heads")))
    beaten = lambda other: F.exists("xs", lambda a: F.exists(other, lambda b: (a["head_i"] == b["head_i"]) & more_informative(a, b)))
    return rivals.filter(~F.exists("_all", beaten)).drop("_heads", "_all")


def unique(found: DataFrame) -> DataFrame:
    """One row for extractions with equal names, heads and positions; the first subcategorization by name stays."""
    canon = F.sort_array(F.transform("xs", lambda x: F.struct(x["name"].alias("name"), x["head_i"].alias("head_i"), x["position"].alias("position"))))
    w = W.partitionBy(*PREDICATE, "_canon").orderBy("subcat")
    return found.withColumn("_canon", canon).withColumn("_row", F.row_number().over(w)).filter("_row = 1").drop("_row", "_canon")


def chosen(found: DataFrame) -> DataFrame:
    return found.transform(longest).transform(informative).transform(unique)


_WH = "|".join(C.WHERE_WHEN + C.WH_VERB + C.HOW_TO + C.HOW)


def span(toks: Column, x: Column, trim: bool = True, trim_all: bool = False) -> Column:
    """(start, end, text) of an argument: its subtree without possessive ending, final punctuation and leading preposition; null if nothing is left."""
    lo = F.when(x["position"] == "NOM", x["head_i"]).otherwise(x["lo"])
    hi = F.when(x["position"] == "NOM", x["head_i"]).otherwise(x["hi"])
    last = F.get(toks, hi)
    ending = (F.lower(last["orth"]).isin("'s", "s'", "’s", "s’") & x["position"].isin("DET-POSS", "NSUBJ", "N-N-MOD")) | (last["pos"] == "PUNCT")
    end = hi + 1 - ending.cast("int")
    words = lambda s, e: F.array_join(F.transform(F.slice(toks, s + 1, F.greatest(F.lit(0), e - s)), lambda t: t["orth"]), " ")
    prep = F.trim(F.regexp_replace(x["position"], _WH, ""))
    kept = x["name"].rlike("^(PP|P-|FOR-|AS-|PARTICLE)")
    wanted = F.lit(trim_all) | (F.lit(trim) & is_lower(x["position"]) & ~kept)
    cut = wanted & (prep != "") & words(lo, end).startswith(prep)
    start = lo + F.when(cut, F.size(F.split(prep, " "))).otherwise(0)
    return let(F.struct(start.alias("s"), end.alias("e")), lambda r: F.when(r["e"] > r["s"], F.struct(r["s"].alias("start"), r["e"].alias("end"), words(r["s"], r["e"]).alias("text"))))


def spans(found: DataFrame, trim: bool = True, trim_all: bool = False) -> DataFrame:
    """Adds `args`: (name, type, head_i, position, start, end, text) of each argument with a span; names of NONE and VERB-NOM are null."""
    toks = F.col("toks")
    name = lambda x: F.when(~x["name"].isin("NONE", "VERB-NOM"), x["name"])
    both = F.transform("xs", lambda x: F.struct(name(x).alias("name"), x["type"].alias("type"), x["head_i"].alias("head_i"), x["position"].alias("position"), span(toks, x, trim, trim_all).alias("sp")))
    flat = F.transform(F.filter(both, lambda x: x["sp"].isNotNull()), lambda x: F.struct(*[x[c].alias(c) for c in ("name", "type", "head_i", "position")], *[x["sp"][c].alias(c) for c in ("start", "end", "text")]))
    return found.withColumn("args", flat)


def extract(tokens_as_trees: DataFrame, lex: DataFrame | Callable[[DataFrame], DataFrame], null_choice: bool = False, max_candidates: int | None = None, min_arguments: int = 0, limited_verbs: list[str] | None = None, condition=None, trim: bool = True, fields: list[str] | None = None) -> DataFrame:
    """The whole extraction: doc_id, sent_id, pred_i, is_verb, verb, subcat, toks, xs and args with spans (without `trim` with their prepositions).

    `fields` are those of each token that the result keeps in `toks` (all, if None). Spans come before the choice, which then sorts
    no trees but where they are asked for.
    """
    lex = lex if limited_verbs is None else lex.filter(F.col("verb").isin(limited_verbs))
    found = spans(structures(matches(predicates(tokens_as_trees, lex, condition), max_candidates), null_choice, largest=True), trim)
    if fields is not None:
        found = found.withColumn("toks", F.transform("toks", lambda t: F.struct(*[t[x].alias(x) for x in fields])))
    return chosen(found).filter(F.size("xs") >= min_arguments)
