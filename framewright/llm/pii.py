"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the valid matches of four base kinds. What stands around them makes lexical patterns (two words before; one before
and one after). Other identifier-like runs of a text (words with a digit or an @, or words joined by a written-out "(at)") are the
instances to be discovered: each kind takes those of its form. A graph of distinct (pattern, instance) edges is scored in rounds: a
pattern by the share of its instances that are known to be of the kind (an unknown one counts half, one of another kind or form
whole), an instance by the patterns it stands in. Instances that end above THRESHOLD are personal data wherever they occur.

Ordinary words are never instances, so a pattern's score is that of what looks like an identifier behind it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright import scratch
from framewright.llm.native import let

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns; possessive loops and look-behinds change no match and keep long texts linear.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ \-]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9\-]+[0-9]",
}
_WORD = r"[^\s0-9@]*+[0-9@]\S*+"
#: Runs of words with a digit or an @; a name, "(at)" and a host, with or without "(dot)".
RUN = rf"(?i)(?<!\S)(?:\S++ [(\[{{]at[)\]}}] \S++(?: [(\[{{]dot[)\]}}] \S++)*+|{_WORD}(?: {_WORD})*+)"
#: What a run has to look like to be an instance of a kind; longer runs than LONGEST are of no kind.
FORMS = {
    "email": r"(?i)^[^\s@]+(?:@| [(\[{]at[)\]}] )\S+(?: [(\[{]dot[)\]}] \S+)*$",
    "ip": r"(?i)^(?:[0-9x*]+(?:\.[0-9x*]+){3}|[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){3,7})$",
    "card": r"(?i)^[0-9x*](?:[ -]?[0-9x*]){11,18}$",
    "phone": r"^\+?[0-9(][ ()./0-9-]{5,24}[0-9]$",
}
LONGEST = 64
#: Code points on either side that are looked at for words.
NEAR = 80
#: Distinct known instances that a pattern needs; rounds; the score from which patterns and instances count.
SUPPORT, ROUNDS, THRESHOLD = 3, 3, 0.75
_EDGE = "pattern", "kind", "instance"


def valid(kind: str, text: Column) -> Column:
    """Whether a match of a base pattern is one of the kind."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "ip":
        return text.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(False)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def _found(text: Column, regex: str) -> Column:
    """(start, text, before, after) of each match, in order; before and after are what stands near it, up to the matches next to it and one beyond."""
    parts = F.struct(F.split(text, regex, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("hits"))

    def starts(p: Column) -> Column:
        sizes = F.transform(p["hits"], lambda h, i: F.length(F.get(p["gaps"], i)) + F.when(i > 0, F.length(F.get(p["hits"], i - 1))).otherwise(0))
        return F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def near(p: Column, h: Column, i: Column, at: Column) -> Column:
        left = F.concat(F.when(i > 0, F.get(p["hits"], i - 1)).otherwise(""), F.get(p["gaps"], i))
        right = F.concat(F.get(p["gaps"], i + 1), F.coalesce(F.get(p["hits"], i + 1), F.lit("")))
        return F.struct(F.get(at, i + 1).alias("start"), h.alias("text"), F.substring(left, -NEAR, NEAR).alias("before"), F.substring(right, 1, NEAR).alias("after"))

    return F.when(text.rlike(regex), let(parts, lambda p: let(starts(p), lambda at: F.transform(p["hits"], lambda h, i: near(p, h, i, at))))).otherwise(F.array().cast("array<struct<start:int,text:string,before:string,after:string>>"))


def _words(text: Column) -> Column:
    """Words of a context, letters in lower case, numbers as one 0."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"\s+"), lambda w: w != "")


def _patterns(before: Column, after: Column) -> Column:
    """The lexical patterns around a place: two words before it; one before and one after; edges of the text as ^ and $."""
    one = lambda ws, i: F.coalesce(F.element_at(ws, i), F.lit("^" if i < 0 else "$"))
    last = lambda ws, k: F.when(F.size(ws) >= k, F.element_at(ws, -k)).otherwise("^")
    return let(_words(before), lambda b: let(_words(after), lambda a: F.array(F.concat_ws(" ", last(b, 2), last(b, 1), F.lit("_")), F.concat_ws(" ", last(b, 1), F.lit("_"), F.when(F.size(a) > 0, one(a, 1)).otherwise("$")))))


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document, written once: row, doc_id, one array a base kind (its valid matches) and runs. Holds no texts."""
    whole = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    of = lambda k: F.filter(_found(F.col("text"), BASE[k]), lambda h: valid(k, h["text"])).alias(k)
    hits = whole.select("row", "doc_id", *map(of, KINDS), _found(F.col("text"), RUN).alias("runs"))
    return scratch.written(hits, "pii-scan")


def instances(scan: DataFrame) -> DataFrame:
    """Runs that hold no valid base match: row, kind (null for no form), instance, start, end, patterns; a row for each kind they could be."""
    each = scan.filter(F.size("runs") > 0).select("row", F.explode("runs").alias("r")).select("row", "r.*")
    opened = each.withColumn("lead", F.length(F.regexp_extract("text", "^[\"'<«\\[{]+", 0)))
    cut = opened.withColumn("text", F.regexp_replace(F.expr("substring(text, lead + 1)"), "[\"'>»\\]}.,;:!?]+$", "")).withColumn("start", F.col("start") + F.col("lead"))
    holds = lambda k: F.exists(F.regexp_extract_all("text", F.lit(BASE[k]), F.lit(0)), lambda h: valid(k, h))
    base = reduce(or_, map(holds, KINDS))
    short = F.length("text") <= LONGEST
    kinds = F.array_compact(F.array(*[F.when(short & F.col("text").rlike(FORMS[k]) & _plausible(k, F.col("text")), F.lit(i)) for i, k in enumerate(KINDS)]))
    fresh = cut.filter((F.length("text") > 0) & ~base).withColumn("kinds", kinds)
    return fresh.select("row", F.explode_outer("kinds").alias("kind"), F.when(short, F.lower("text")).otherwise(F.sha2("text", 256)).alias("instance"), "start", (F.col("start") + F.length("text")).alias("end"), _patterns(F.col("before"), F.col("after")).alias("patterns"))


def _plausible(kind: str, text: Column) -> Column:
    """Digits enough for the kind."""
    n = F.length(F.regexp_replace(text, "[^0-9]", ""))
    return n.between(7, 15) if kind == "phone" else n >= 4 if kind == "card" else F.lit(True)


def seeds(scan: DataFrame) -> DataFrame:
    """Distinct (pattern, kind, instance) of the base matches."""
    out = None
    for i, k in enumerate(KINDS):
        each = scan.filter(F.size(k) > 0).select(F.explode(k).alias("h")).select(F.explode(_patterns(F.col("h.before"), F.col("h.after"))).alias("pattern"), F.lit(i).alias("kind"), F.lower("h.text").alias("instance"))
        out = each if out is None else out.unionByName(each)
    return out.distinct()


def scored(scan: DataFrame) -> DataFrame:
    """Instances with their score: kind, instance, score (above THRESHOLD), found in ROUNDS rounds of scoring patterns by instances and back."""
    edges = scratch.written(instances(scan).select("kind", "instance", F.explode("patterns").alias("pattern")).distinct(), "pii-edges")
    # Patterns matter only where something can be discovered.
    open_ = edges.filter("kind is not null").select("pattern").distinct()
    known = seeds(scan).join(open_, "pattern", "left_semi").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"))
    every = known.groupBy("pattern").agg(F.sum("n").alias("seeds"))
    other = edges.filter("kind is null").groupBy("pattern").agg(F.count(F.lit(1)).alias("others"))
    base = scratch.written(known.join(every, "pattern").join(other, "pattern", "left").select("pattern", "kind", "n", (F.col("seeds") - F.col("n") + F.coalesce("others", F.lit(0))).alias("against")), "pii-patterns")
    typed, score = edges.filter("kind is not null"), None
    for _ in range(ROUNDS):
        with_score = typed.withColumn("score", F.lit(0.0)) if score is None else typed.join(score, ["kind", "instance"], "left").fillna(0.0, ["score"])
        sums = with_score.groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count_if(F.col("score") >= THRESHOLD).alias("sure"), F.sum(1 - F.col("score")).alias("unknown"))
        total = lambda c: F.coalesce(c, F.lit(0))
        n, against = total(F.col("n")) + F.col("s"), total(F.col("against"))
        trusted = sums.join(base, ["pattern", "kind"], "left").filter(total(F.col("n")) + F.col("sure") >= SUPPORT).select("pattern", "kind", (n / (n + against + F.col("unknown") / 2)).alias("trust")).filter(F.col("trust") >= THRESHOLD)
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("trust")))))
        fresh = scratch.written(typed.join(trusted, ["pattern", "kind"]).groupBy("kind", "instance").agg(F.round(1 - doubt, 9).alias("score")), "pii-scores")
        if score is not None:
            scratch.discard(score)
        score = fresh
    return score.filter(F.col("score") >= THRESHOLD)


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, base and added: arrays of (kind number, start, end), sorted, of every document.

    An added span overlaps no base span; an instance of several kinds is of that with the highest score, the first of equals.
    """
    scan = scanned(docs, doc_id, text)
    best = scored(scan).groupBy("instance").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    place = lambda k, s, e: F.struct(k.cast("int").alias("kind"), s.alias("start"), e.alias("end"))
    hits = instances(scan).select("row", "kind", "instance", "start", "end").join(best, ["kind", "instance"])
    added = hits.groupBy("row").agg(F.array_sort(F.collect_set(place(F.col("kind"), F.col("start"), F.col("end")))).alias("added"))
    of = lambda i, k: F.transform(k, lambda h: place(F.lit(i), h["start"], h["start"] + F.length(h["text"])))
    base = F.concat(*[of(i, k) for i, k in enumerate(KINDS)])
    both = scan.select("row", "doc_id", base.alias("base")).join(added, "row", "left")
    free = F.filter("added", lambda a: ~F.exists("base", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
    return both.select("row", "doc_id", "base", F.coalesce(free, F.array().cast("array<struct<kind:int,start:int,end:int>>")).alias("added"))


def report(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans (base and added), n_added.

    Null and empty texts have none. Repeated rows get a result each, ids may be null. An empty table gives no rows. Other columns
    are ignored, whatever their names. A run that holds a valid base match is no instance, so what else it holds is not discovered.
    """
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda i, k: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{k}")
    return spans(docs).select("doc_id", *[count(i, k) for i, k in enumerate(KINDS)], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
