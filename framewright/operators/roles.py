"""Roles by scores: the best injective assignment, the top candidates of a type, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright import constants as C
from framewright.functions.columns import let, strings


def assigned(scores: DataFrame, key: list[str]) -> DataFrame:
    """Columns of `key`, cand and label from (key, cand, label, logp): each label goes to one candidate at most, by the greatest sum.

    A candidate without a label pays its NONE score; candidates whose best label is NONE are set aside first. Equal sums go
    to the first assignment by labels in order of candidates. The work grows with the number of labels to the power of
    the candidates of one key, which is a predicate.
    """
    per = scores.groupBy(*key, "cand").agg(F.sort_array(F.collect_list(F.struct("label", "logp"))).alias("os"), F.max_by("label", F.struct("logp", "label")).alias("best"))
    cands = per.filter("best <> 'NONE'").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("cand", "os"))).alias("cs"))
    empty = F.array(F.struct(F.lit(0.0).alias("total"), F.array().cast("array<string>").alias("labels")))

    def step(acc, c):
        add = lambda a, o: F.struct((a["total"] + o["logp"]).alias("total"), F.concat(a["labels"], F.array(o["label"])).alias("labels"))
        free = lambda a: F.filter(c["os"], lambda o: (o["label"] == "NONE") | ~F.array_contains(a["labels"], o["label"]))
        return F.flatten(F.transform(acc, lambda a: F.transform(free(a), lambda o: add(a, o))))

    every = F.aggregate("cs", empty, step)
    best = F.array_min(F.transform(every, lambda x: F.struct((-x["total"]).alias("t"), x["labels"].alias("labels"))))["labels"]
    pairs = cands.select(*key, let(best, lambda ls: F.transform("cs", lambda c, i: F.struct(c["cand"].alias("cand"), F.get(ls, i).alias("label")))).alias("_pairs"))
    return pairs.select(*key, F.explode("_pairs").alias("_pair")).select(*key, "_pair.cand", "_pair.label").filter("label <> 'NONE'")


def determined(options: DataFrame, scores: DataFrame, key: list[str], labels: list[str]) -> DataFrame:
    """Columns of `key`, cand and types from options (key, pred_i, cand, start, lemma, types) and scores (key, cand, label, logp).

    Pronouns, candidates that start at the predicate and those without a type among `labels` (with PP1 and PP2, if PP is one) keep
    their types. The others are `assigned` by the scores of their types and of NONE; PP1 and PP2 have the score of PP. Who gets no label keeps
    the types outside `labels`; but where NONE is the best of all of them, only the fixed candidates stay. Missing scores are impossible labels.
    """
    own = strings(*labels, *(["PP1", "PP2"] if "PP" in labels else []))
    fixed = (F.col("start") == F.col("pred_i")) | ~F.arrays_overlap("types", own) | F.col("lemma").isin(C.PRONOUNS)
    marked = options.withColumn("_fixed", F.coalesce(fixed, F.lit(True)))
    free = marked.filter("not _fixed")
    allowed = F.array_intersect(F.array_union("types", strings("NONE")), F.array_union(own, strings("NONE")))
    asked = free.select(*key, "cand", F.explode(allowed).alias("_asked"))
    asked = asked.withColumn("label", F.when(F.col("_asked").isin("PP1", "PP2"), "PP").otherwise(F.col("_asked")))
    given = asked.join(scores, [*key, "cand", "label"]).select(*key, "cand", F.col("_asked").alias("label"), "logp")
    best = given.groupBy(*key, "cand").agg(F.max_by("label", F.struct("logp", "label")).alias("best"))
    live = best.filter("best <> 'NONE'").select(key).distinct()
    got = assigned(given, key).withColumnRenamed("label", "_label")
    rest = free.join(live, key, "left_semi").join(got, [*key, "cand"], "left")
    types = F.when(F.col("_label").isNotNull(), F.array("_label")).otherwise(F.array_except("types", own))
    return marked.filter("_fixed").select(*key, "cand", "types").unionByName(rest.select(*key, "cand", types.alias("types")))


def lowest_entropy(args: DataFrame, key: list[str]) -> DataFrame:
    """Of (key, type, cand, entropy, is_default) the candidate of least entropy of each type; two for PP under the default entry."""
    w = W.partitionBy(*key, "type").orderBy("entropy", "cand")
    limit = F.when((F.col("type") == "PP") & F.col("is_default"), 2).otherwise(1)
    return args.withColumn("_row", F.row_number().over(w)).filter(F.col("_row") <= limit).drop("_row")


def weighted_f1(report: DataFrame) -> DataFrame:
    """One row: weighted_f1 over the labels of a report (label, tp, fp, fn, f1) by their true rows; 0 for none."""
    support = F.col("tp") + F.col("fn")
    return report.agg(F.round(F.coalesce(F.try_divide(F.sum(support * F.coalesce("f1", F.lit(0.0))), F.sum(support)), F.lit(0.0)), 6).alias("weighted_f1"))


def mean_of_means(values: DataFrame, batch: str, value: str) -> DataFrame:
    """One row: the mean of the batches' means, six digits."""
    return values.groupBy(batch).agg(F.avg(value).alias("m")).agg(F.round(F.avg("m"), 6).alias("mean"))
