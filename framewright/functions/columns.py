"""Column builders shared by the operators: single evaluation, lower-case tests, first elements, text helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once a row however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_lower(s: Column) -> Column:
    """At least one cased letter and none in upper case."""
    return (s == F.lower(s)) & s.rlike("[a-z]")


def first(xs: Column) -> Column:
    """The first element, null for an empty array."""
    return F.get(xs, F.lit(0))


def strings(*xs: str) -> Column:
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


def unquoted(s: Column) -> Column:
    """Without one quotation mark at either end."""
    return F.regexp_replace(s, '^"|"$', "")


def joined_options(options: Column, delimiter: str, start: str = "", end: str = "") -> Column:
    """Options with a text before and after each, joined by a delimiter."""
    return F.array_join(F.transform(options, lambda x: F.concat(F.lit(start), x, F.lit(end))), delimiter)


def reversed_map(m: Column) -> Column:
    """Values to keys; keys must not be lost, so values have to be unique."""
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"])))


def subset_of(a: Column, b: Column) -> Column:
    """Whether every entry of map `a` is in map `b`."""
    return F.forall(F.map_entries(a), lambda e: F.map_contains_key(b, e["key"]) & b[e["key"]].eqNullSafe(e["value"]))


def log_softmax(scores: Column) -> Column:
    """Log-probabilities of an array of scores; null scores are impossible and stay null."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.coalesce(F.exp(x - top), F.lit(0.0)))
    return F.transform(scores, lambda x: x - top - F.log(total))
