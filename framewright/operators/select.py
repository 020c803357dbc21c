"""Selection among the extractions of a predicate by domination: the largest ones that no other one of them makes superfluous."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.columns import first
from framewright.operators.extract import PREDICATE, informative


def undominated(items: Column, size: Callable[[Column], Column], beats: Callable[[Column, Column], Column], largest: bool = True, greedy: bool = False) -> Column:
    """Of an array those that no other one beats (`beats(item, other)`), in one pass; with `largest` only those as large as the first.

    greedy: the largest come first, and an item has to be beaten by one that is kept; otherwise by any one, so that two can beat each other.
    """
    ranked = F.transform(F.array_sort(F.transform(items, lambda x, i: F.struct((-size(x)).alias("n"), i.alias("i"), x.alias("x")))), lambda s: s["x"]) if greedy else items
    candidates = F.filter(ranked, lambda x: size(x) == size(first(ranked))) if largest else ranked
    if not greedy:
        return F.filter(candidates, lambda x: ~F.exists(ranked, lambda y: beats(x, y)))
    return F.aggregate(candidates, F.filter(candidates, lambda _: F.lit(False)), lambda kept, x: F.when(F.exists(kept, lambda y: beats(x, y)), kept).otherwise(F.concat(kept, F.array(x))))


def sub_extraction(a: Column, b: Column) -> Column:
    """Whether all of `a` is in `b`, both arrays of (name, start, end); PP1 and PP2 that stand the other way round match."""
    of = lambda xs, name: first(F.filter(xs, lambda x: x["name"] == name))
    place = lambda xs, name: F.struct(of(xs, name)["start"], of(xs, name)["end"])
    there = lambda xs: of(xs, "PP1").isNotNull() & of(xs, "PP2").isNotNull()
    crossed = there(a) & there(b) & (place(a, "PP1") == place(b, "PP2")) & (place(a, "PP2") == place(b, "PP1"))
    inside = lambda x: F.array_contains(b, x) | (F.coalesce(crossed, F.lit(False)) & x["name"].isin("PP1", "PP2"))
    return F.forall(a, inside)


def _named(args: Column) -> Column:
    """The named spans of an extraction, by name."""
    kept = F.filter(args, lambda a: a["name"].isNotNull())
    return F.array_sort(F.transform(kept, lambda a: F.struct(a["name"].alias("name"), a["start"].alias("start"), a["end"].alias("end"))))


def without_parts(found: DataFrame) -> DataFrame:
    """Of each predicate the extractions with most arguments, without those that hold all that a kept one has; the first of equals stays.

    The order among equals is by subcategorization, then by arguments. A predicate's extractions are few: they are looked at in one row.
    """
    columns = [c for c in found.columns if c not in PREDICATE]
    entry = F.struct(F.col("subcat").alias("_s"), F.to_json("args").alias("_j"), _named(F.col("args")).alias("_named"), F.struct(*columns).alias("_row"))
    per = found.groupBy(*PREDICATE).agg(F.array_sort(F.collect_list(entry), _by_text).alias("_all"))
    kept = undominated(F.col("_all"), lambda x: F.size(x["_row"]["xs"]), lambda x, y: sub_extraction(y["_named"], x["_named"]), greedy=True)
    return per.select(*PREDICATE, F.explode(kept).alias("_x")).select(*PREDICATE, "_x._row.*").select(found.columns)


def _by_text(a: Column, b: Column) -> Column:
    one = lambda x: F.struct(x["_s"], x["_j"])
    return F.when(one(a) < one(b), -1).when(one(a) > one(b), 1).otherwise(0)


def chosen_types(found: DataFrame, choice: DataFrame, every: DataFrame) -> DataFrame:
    """Extractions cut down to the arguments whose span `choice` (predicate, start, end, types) gives their type, where that is one of `every` too."""
    key = F.sha2(F.to_json(F.array_sort(F.transform("xs", lambda x: F.struct(x["name"], x["head_i"], x["position"])))), 256)
    there = every.select(*PREDICATE, key.alias("_key")).distinct()
    given = choice.groupBy(*PREDICATE).agg(F.collect_list(F.struct("start", "end", "types")).alias("_given"))
    ok = lambda a: F.exists("_given", lambda g: (g["start"] == a["start"]) & (g["end"] == a["end"]) & F.array_contains(g["types"], a["type"]))
    cut = found.join(given, PREDICATE).withColumn("args", F.filter("args", ok))
    cut = cut.withColumn("xs", F.filter("xs", lambda x: F.exists("args", lambda a: (a["head_i"] == x["head_i"]) & (a["type"] == x["type"])))).withColumn("_key", key)
    return cut.join(there, [*PREDICATE, "_key"], "left_semi").select(found.columns).distinct()


def choose_informative(found: DataFrame, choice: DataFrame | None = None) -> DataFrame:
    """The older engine's choice, over rows with spans: largest without parts, then not dominated at any argument, then by a model's choice of types.

    With `choice` extractions are cut down to the chosen types and selected once more; predicates that it says nothing of go.
    """
    left = informative(without_parts(found))
    return left if choice is None else without_parts(chosen_types(left, choice, found))


def is_in(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Adds `known`: whether `others` has an extraction of the same predicate with the same names, heads and positions."""
    canon = F.to_json(F.array_sort(F.transform("xs", lambda x: F.struct(x["name"], x["head_i"], x["position"]))))
    there = others.select(*PREDICATE, canon.alias("_canon"), F.lit(True).alias("_there")).distinct()
    return rows.withColumn("_canon", canon).join(there, [*PREDICATE, "_canon"], "left").withColumn("known", F.coalesce("_there", F.lit(False))).select(*rows.columns, "known")
