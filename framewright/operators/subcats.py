"""Rewrites of one subcategorization, as functions of a DataFrame with a row for each.

Columns: entry_key, subcat, is_verb, args (map of complement to positions), required and optional (arrays of complements), clauses
(array of maps of complement to positions that must not hold together), alternates. Nulls in args, required, optional or clauses
count as empty. Each function keeps the number of rows and all other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.columns import let, strings
from framewright.operators.lexicons import position_list, verb_type, without_part

#: The complements that a verb's NOT clauses leave out, the name for a complement to drop, and for an optional position.
CORE, IGNORE, OPTIONAL = ("SUBJECT", "OBJECT"), "IGNORE", "OPTIONAL-POSITION"
ARGS = "map<string,array<string>>"


def _args() -> Column:
    return F.coalesce("args", F.create_map().cast(ARGS))


def _names(column: str) -> Column:
    return F.coalesce(column, strings())


def objects(rows: DataFrame) -> DataFrame:
    """Positions of OBJECT and IND-OBJ as lists; IND-OBJ-X is the preposition x."""

    def each(k, v):
        plain = position_list(v)
        lowered = F.transform(plain, lambda x: F.when(x.startswith("IND-OBJ-"), F.lower(F.replace(x, F.lit("IND-OBJ-"), F.lit("")))).otherwise(x))
        return F.when(k == "OBJECT", plain).when(k == "IND-OBJ", lowered).otherwise(v)

    return rows.withColumn("args", F.transform_values(_args(), each))


def clauses(rows: DataFrame) -> DataFrame:
    """NOT clauses of two conditions or more, with positions as lists; verbs keep no condition on SUBJECT or OBJECT."""
    kept = F.transform(F.coalesce("clauses", F.array().cast(f"array<{ARGS}>")), lambda c: F.transform_values(F.map_filter(c, lambda k, _: ~F.col("is_verb") | ~k.isin(*CORE)), lambda _, v: position_list(v)))
    return rows.withColumn("clauses", F.filter(kept, lambda c: F.size(F.map_keys(c)) > 1))


def renamed(rows: DataFrame, table: dict[str, str] | str) -> DataFrame:
    """Complements under the names that `table` (a dict, or a column with a map) gives; IGNORE drops one. Of several with one new name the last of the table stays.

    A name moves in required and optional with its complement, unless the other list has the new name already, the name is dropped,
    or it is itself one of the table's new names: what the lists say then is said in new names.
    """
    if isinstance(table, dict):
        moves = {k: v for k, v in table.items() if k != v}
        if not moves:
            return rows
        to, every = F.create_map(*[F.lit(x) for pair in moves.items() for x in pair]), strings(*table.values())
    else:
        given = F.coalesce(table, F.create_map().cast("map<string,string>"))
        to, every = F.map_filter(given, lambda k, v: k != v), F.map_values(given)
    args, places = _args(), F.map_keys(to)
    old = F.map_filter(args, lambda k, _: ~F.map_contains_key(to, k))
    came = F.filter(places, lambda k: F.map_contains_key(args, k) & (to[k] != IGNORE))
    last = F.filter(came, lambda k: F.array_position(came, k) == F.array_max(F.transform(F.filter(came, lambda j: to[j] == to[k]), lambda j: F.array_position(came, j))))
    fresh = F.map_from_entries(F.transform(last, lambda k: F.struct(to[k], args[k])))
    untouched = F.map_filter(old, lambda k, _: ~F.map_contains_key(fresh, k))
    here = lambda x: F.map_contains_key(args, x) & F.map_contains_key(to, x) & (to[x] != IGNORE) & ~F.array_contains(every, x)

    def moved(own: str, other: str) -> Column:
        keep = F.filter(_names(own), lambda x: ~here(x))
        gone = F.filter(_names(own), lambda x: here(x) & ~F.array_contains(_names(other), to[x]))
        return F.array_sort(F.array_distinct(F.concat(keep, F.transform(gone, lambda x: to[x]))))

    lists = rows.withColumns({"_required": moved("required", "optional"), "_optional": moved("optional", "required")})
    done = lists.withColumn("args", F.map_concat(untouched, fresh)).drop("required", "optional")
    return done.withColumnsRenamed({"_required": "required", "_optional": "optional"}).select(rows.columns)


def with_special(rows: DataFrame, special: str) -> DataFrame:
    """Missing complements from the map in column `special`, where it has positions for them."""
    more = F.map_filter(F.coalesce(special, F.create_map().cast(ARGS)), lambda k, v: (F.size(v) > 0) & ~F.map_contains_key(_args(), k))
    return rows.withColumn("args", F.map_concat(_args(), more))


def with_defaults(rows: DataFrame, defaults: dict[str, list[str]] | str) -> DataFrame:
    """Missing complements with default positions (a dict, or a column with a map); one that has OPTIONAL-POSITION makes its complement optional.

    A complement that is required and optional by default fails the query.
    """
    if isinstance(defaults, dict):
        given = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), strings(*v))]).cast(ARGS) if defaults else F.create_map().cast(ARGS)
    else:
        given = F.coalesce(defaults, F.create_map().cast(ARGS))
    optional = F.map_keys(F.map_filter(given, lambda _, v: F.array_contains(v, OPTIONAL)))
    more = F.map_filter(F.transform_values(given, lambda _, v: F.array_remove(v, OPTIONAL)), lambda _, v: F.size(v) > 0)
    both = F.array_intersect(optional, _names("required"))
    checked = F.when(F.size(both) > 0, F.raise_error(F.concat(F.lit("required and optional by default: "), F.array_join(both, ", ")))).otherwise(F.array_sort(F.array_union(_names("optional"), optional)))
    return rows.withColumns({"optional": checked, "args": F.map_concat(_args(), F.map_filter(more, lambda k, _: ~F.map_contains_key(_args(), k)))})


def alternated(rows: DataFrame) -> DataFrame:
    """Where `alternates` holds and the noun can't be the subject itself: SUBJECT becomes OBJECT (intransitive) or IND-OBJ (transitive).

    The new complement takes the subject's place among the required or optional, and SUBJECT is optional from then on. A row that has the
    new complement already, or no SUBJECT, or is ditransitive fails the query.
    """
    kind = verb_type(F.col("subcat"))
    new = F.when(kind == "TRANSITIVE", "IND-OBJ").when(kind == "INTRANSITIVE", "OBJECT")
    legal = new.isNotNull() & F.map_contains_key(_args(), F.lit("SUBJECT")) & ~F.map_contains_key(_args(), new)
    asked = F.coalesce("alternates", F.lit(False))
    here = F.when(~asked, False).when(~F.coalesce(legal, F.lit(False)), F.raise_error(F.concat(F.lit("no alternation for "), F.col("entry_key")))).otherwise(~F.array_contains(_args()["SUBJECT"], "NOM"))
    needed = F.array_contains(_names("required"), "SUBJECT")
    swap = lambda xs: F.transform(xs, lambda x: F.when(x == "SUBJECT", F.col("_new")).otherwise(x))
    marked = rows.withColumns({"_here": here, "_new": new, "_needed": needed})
    optional = F.array_remove(_names("optional"), "SUBJECT")
    late = F.concat(F.when(F.col("_needed"), optional).otherwise(F.concat(optional, F.array("_new"))), strings("SUBJECT"))
    changes = {
        "args": F.map_from_entries(F.transform(F.map_entries(_args()), lambda e: F.struct(F.when(e["key"] == "SUBJECT", F.col("_new")).otherwise(e["key"]), e["value"]))),
        "required": swap(_names("required")),
        "optional": late,
    }
    return marked.withColumns({k: F.when(F.col("_here"), v).otherwise(F.col(k)) for k, v in changes.items()}).drop("_here", "_new", "_needed")


def table_value(rows: DataFrame, table: DataFrame, column: str = "subcat") -> DataFrame:
    """Adds `value` of the broadcast `table` (name, verb_value, nom_value; one row a known subcategorization): of the name, else of it without PART."""
    own = table.select(F.col("name").alias("n1"), F.struct("verb_value", "nom_value").alias("v1"))
    plain = table.select(F.col("name").alias("n2"), F.struct("verb_value", "nom_value").alias("v2"))
    found = rows.join(F.broadcast(own), F.col(column) == F.col("n1"), "left").join(F.broadcast(plain), without_part(F.col(column)) == F.col("n2"), "left")
    value = F.coalesce("v1", "v2")
    return found.withColumn("value", F.when(F.col("is_verb"), value["verb_value"]).otherwise(value["nom_value"])).drop("n1", "n2", "v1", "v2")


def particle(orth: Column, verb: Column, particles: Column) -> Column:
    """The one particle of a noun with PART: the given one, else what the noun has besides the verb; more than one fails the query."""
    rest = F.replace(F.replace(orth, verb, F.lit("")), F.lit("-"), F.lit(""))
    own = F.when(F.size(particles) > 0, particles).otherwise(F.array(rest))
    return let(own, lambda xs: F.when(F.size(xs) == 1, F.get(xs, F.lit(0))).otherwise(F.raise_error(F.lit("not one particle"))))
