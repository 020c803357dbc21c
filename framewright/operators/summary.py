"""Reports on a compiled lexicon: invariants that it has to keep, complements that share positions, counts of values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions.columns import strings
from framewright.operators import rules


def first_examples(rows: DataFrame, keys: list[str], value: str, k: int = 5) -> DataFrame:
    """Of each group the number of its distinct values and the first `k` of them: only k of a group leave a task or meet in one."""
    each = rows.select(*keys, value).distinct()
    n = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(value))
    top = each.withColumn("_k", place).filter(F.col("_k") <= k).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("examples"))
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"t.{c}")) for c in keys]
    return n.alias("n").join(top.alias("t"), same).select(*[F.col(f"n.{c}").alias(c) for c in keys], F.col("n.n").alias("n"), F.col("t.examples").alias("examples"))


def collisions(lexicon: DataFrame, k: int = 5) -> DataFrame:
    """Pairs of a subcategorization's core complements that share a position or prefix (PREFIX alone does not count): n words, the first `k`."""
    places = lambda a: F.array_remove(F.array_union(a["positions"], a["prefixes"]), "PREFIX")
    core = F.filter("args", lambda a: a["type"].isin("SUBJECT", "OBJECT", "IND-OBJ", "PP", "PP1", "PP2"))
    each = lexicon.filter("subcat is not null").select("orth", core.alias("args")).select("orth", F.explode("args").alias("a"), "args")
    pairs = each.select("orth", "a", F.explode("args").alias("b")).filter((F.col("a.type") < F.col("b.type")) & F.arrays_overlap(places(F.col("a")), places(F.col("b"))))
    return first_examples(pairs.select(F.col("a.type").alias("one"), F.col("b.type").alias("other"), "orth"), ["one", "other"], "orth", k)


def values(lexicon: DataFrame, k: int = 5) -> DataFrame:
    """property, value, n, examples: how many words have each position, prefix, illegal prefix and constraint of an argument."""
    names = ["positions", "prefixes", "illegal_prefixes", "constraints", "root_upostags"]
    one = lexicon.filter("subcat is not null").select("orth", F.explode("args").alias("a"))
    pairs = one.select("orth", F.explode(F.flatten(F.array(*[F.transform(F.col(f"a.{c}"), _pair(c)) for c in names]))).alias("p"))
    return first_examples(pairs.select(F.col("p.property").alias("property"), F.col("p.value").alias("value"), "orth"), ["property", "value"], "orth", k)


def _pair(name: str):
    return lambda v: F.struct(F.lit(name).alias("property"), v.alias("value"))


def problems(lexicon: DataFrame) -> DataFrame:
    """entry_key, kind, subcat and problem of compiled rows that break an invariant; none for a lexicon that `build.compiled` made."""
    types = F.transform("args", lambda a: a["type"])
    lists = F.array_union("required", "optional")
    has = lambda mark, position: F.exists("args", lambda a: F.array_contains(a["constraints"], mark) & ~F.array_contains(a["positions"], position))
    unknown = F.exists("args", lambda a: ~a["type"].isin(rules.COMPLEMENTS))
    checks = {
        "required twice": F.size(F.array_distinct("required")) < F.size("required"),
        "optional twice": F.size(F.array_distinct("optional")) < F.size("optional"),
        "required and optional": F.arrays_overlap("required", "optional"),
        "neither required nor optional": F.size(F.array_except(types, lists)) > 0,
        "required without argument": F.size(F.array_except("required", types)) > 0,
        "repeated complement": F.size(F.array_distinct(types)) < F.size(types),
        "unknown complement": unknown,
        "unknown constraint": F.size(F.array_except("constraints", strings("ALTERNATES", "ADVP-OR-ADJP"))) > 0,
        "no position": F.exists("args", lambda a: F.size(a["positions"]) == 0),
        "no DET-POSS for its constraint": has("DET-POSS-NO-OTHER-OBJ", "DET-POSS"),
        "no N-N-MOD for its constraint": has("N-N-MOD-NO-OTHER-OBJ", "N-N-MOD"),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in checks.items()]))
    return lexicon.filter("subcat is not null").select("entry_key", "kind", "subcat", F.explode(found).alias("problem"))
