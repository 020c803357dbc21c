"""Lexicons in parenthesised text: `(NOM :ORTH "word" :TAG value …)` to one JSON row an entry.

The grammar is recursive, so a Python parser reads each file; a lexicon is a few megabytes.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOKEN = re.compile(r'"[^"]*"|[()]|[^\s()"]+')


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at = TOKEN.findall(text), 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ")"

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def items(self) -> list:
        """What stands between parentheses, the first of which is taken: atoms, lists, and tags with their values as one map."""
        out = []
        while self.peek() != ")":
            if self.peek().startswith(":"):
                out.append(self.fields())
            elif self.peek() == "(":
                self.take()
                out.append(self.items())
            else:
                out.append(self.take().strip('"'))
        self.at += 1
        return out

    def fields(self) -> dict:
        """Tags and values up to the closing parenthesis; what stands without a tag is passed over."""
        found = {}
        while self.peek() != ")":
            if self.peek().startswith(":"):
                tag = self.take()[1:].upper()
                found[tag] = self.value()
            elif self.take() == "(":
                self.items()
        return found

    def value(self):
        """A text (several atoms are joined), a list of atoms, or a map where the list begins with a list."""
        if self.peek() == "(":
            self.take()
            found = self.items()
            if found and isinstance(found[0], list):
                pairs = [x if isinstance(x, list) else [x] for x in found if x]
                return {str(x[0]): x[1] if len(x) > 1 else {} for x in pairs}
            return found
        words = []
        while self.peek() not in ("(", ")") and not self.peek().startswith(":"):
            words.append(self.take().strip('"'))
        return " ".join(words)


def parse(text: str) -> list[tuple[str, dict]]:
    """(kind, fields) of every entry of a file; an unclosed entry ends with the text."""
    reader, out = _Reader(text), []
    while reader.at < len(reader.tokens):
        if reader.peek() != "(":
            reader.take()
            continue
        reader.take()
        got = reader.items()
        if got and isinstance(got[0], str):
            out.append((got[0], got[1] if len(got) > 1 else {}))
    return out


def entries(spark: SparkSession, path: str) -> DataFrame:
    """entry_key, orth, verb, next_key and raw (JSON) of the NOM entries of the files at `path`.

    Digits leave ORTH; entries of one ORTH are numbered orth, orth#2, … in order of file and place, each with the key of its
    next; of a VERB of several words the first stays.
    """

    def each(batches):
        for b in batches:
            rows = [(f, i, kind, x) for f, text in zip(b.column("file").to_pylist(), b.column("value").to_pylist(), strict=True) for i, (kind, x) in enumerate(parse(text)) if isinstance(x, dict)]
            rows = [r for r in rows if r[2] == "NOM" and isinstance(r[3].get("ORTH"), str)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[3]["ORTH"] for r in rows], pa.string()), pa.array([v if isinstance(v := r[3].get("VERB"), str) else None for r in rows], pa.string()), pa.array([json.dumps(r[3]) for r in rows], pa.string())],
                ["file", "place", "orth", "verb", "raw"],
            )

    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    found = texts.mapInArrow(each, "file string, place int, orth string, verb string, raw string")
    found = found.select("file", "place", F.regexp_replace("orth", r"\d", "").alias("orth"), F.split("verb", " ")[0].alias("verb"), "raw")
    return numbered(found, ["file", "place"])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds entry_key (orth, orth#2, …) and next_key, and drops the columns of the order."""
    w = W.partitionBy("orth").orderBy(*order)
    k = F.row_number().over(w)
    keyed = rows.withColumn("entry_key", F.when(k == 1, F.col("orth")).otherwise(F.concat("orth", F.lit("#"), k)))
    return keyed.withColumn("next_key", F.lead("entry_key").over(w)).drop(*order)
