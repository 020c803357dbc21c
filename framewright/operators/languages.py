"""The language of a text by its letters: profiles of character trigrams learnt from rows with a given language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trigrams that a language's profile keeps, the most frequent; languages at most, the most frequent (both bound what is broadcast).
PROFILE, LANGUAGES = 3000, 200


def _clean(text):
    """Letters in lower case between single blanks."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def profiles(rows: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, gram, score of (text, lang) rows: log-frequency of each language's PROFILE most frequent trigrams; null texts and languages teach nothing.

    Trigrams are counted by batches in the tasks that read the texts and summed by a shuffle of counts.
    """

    def count(batches):
        for b in batches:
            names = np.array(b.column("lang").to_pylist())
            texts = b.column("text").to_pylist()
            for name in sorted(set(names.tolist())):
                grams, n = _distinct([texts[i] for i in np.flatnonzero(names == name)])
                yield _counts(name, grams, n)

    known = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    common = known.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "lang").limit(LANGUAGES)
    each = known.select(F.col(lang).alias("lang"), _clean(F.col(text)).alias("text")).mapInArrow(count, "lang string, gram string, n long")
    counts = each.groupBy("lang", "gram").agg(F.sum("n").alias("n")).join(F.broadcast(common.select("lang")), "lang")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    order = F.row_number().over(_window())
    return counts.withColumn("place", order).filter(F.col("place") <= PROFILE).join(F.broadcast(totals), "lang").select("lang", "gram", F.log(F.col("n") / F.col("total")).alias("score"))


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("lang").orderBy(F.desc("n"), "gram")


def _keys(text: str) -> np.ndarray:
    """The trigrams of a text in order, each as one number of three code points."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


def _distinct(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of the texts and how often each occurs."""
    keys = [_keys(t) for t in texts]
    return np.unique(np.concatenate(keys) if keys else np.empty(0, np.int64), return_counts=True)


def _counts(name: str, grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    text = ["".join(map(chr, (k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF))) for k in grams.tolist()]
    return pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(text), pa.string()), "gram": pa.array(text, pa.string()), "n": pa.array(n, pa.int64())})


def detected(rows: DataFrame, learnt: DataFrame, text: str = "text", out: str = "detected") -> DataFrame:
    """`rows` with the language whose profile gives the text's trigrams most; null for texts without letters, nulls, or without profiles.

    A trigram that a profile lacks counts as its rarest one, less one. Of equal languages the first by name wins. Other columns stay.
    """
    found = learnt.collect()  # LANGUAGES * PROFILE rows at most
    names = sorted({r.lang for r in found})
    low = np.array([min(r.score for r in found if r.lang == n) - 1 for n in names])
    grams = np.unique(np.array([_keys(r.gram)[0] for r in found], np.int64))
    place = {n: i for i, n in enumerate(names)}
    scores = np.vstack([np.tile(low, (len(grams), 1)), low[None, :]])  # the last row is that of all other trigrams
    for r in found:
        scores[np.searchsorted(grams, _keys(r.gram)[0]), place[r.lang]] = r.score
    shared = rows.sparkSession.sparkContext.broadcast((names, grams, scores))

    def score(batches):
        names, grams, scores = shared.value
        for b in batches:
            best = []
            for t in b.column("_clean").to_pylist():
                if not names or t is None or not t.strip():
                    best.append(None)
                    continue
                keys = _keys(t)
                at = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
                n = np.bincount(np.where(grams[at] == keys, at, len(grams)), minlength=len(grams) + 1)
                best.append(names[int((n @ scores).argmax())])
            keep = [k for k in b.schema.names if k != "_clean"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(best, pa.string())], [*keep, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.withColumn("_clean", _clean(F.col(text))).mapInArrow(score, f"{fields}, `{out}` string")
