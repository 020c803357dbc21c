"""Model inputs: sentences with marked argument and predicate as sub-word ids, by the longest match in a given vocabulary."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Markers, special pieces, the tasks' numbers and the length from which an example is left out.
START_ARG, END_ARG, START_PRED, END_PRED = "<arg>", "</arg>", "<pred>", "</pred>"
CLS, SEP, UNKNOWN, MORE = "[CLS]", "[SEP]", "[UNK]", "##"
TASKS = {"ARGS": 0, "NOUNS": 1}
MAX_LENGTH = 100
#: Letters of a word above which it is unknown as a whole; entries of a vocabulary, which every worker holds.
LONGEST_WORD, MOST_ENTRIES = 100, 1_000_000
ENCODED = "ids array<int>, mask array<int>, start_arg int, end_arg int, start_pred int, end_pred int, verb_at int, task int"


class Vocabulary:
    """Pieces with their numbers, as a trie of letters for words and one for continuations."""

    def __init__(self, pieces: dict[str, int]):
        self.ids, self.starts, self.more = pieces, {}, {}
        for piece in pieces:
            node, letters = (self.more, piece[len(MORE) :]) if piece.startswith(MORE) and piece != MORE else (self.starts, piece)
            for c in letters:
                node = node.setdefault(c, {})
            node[""] = piece

    def pieces(self, word: str) -> list[str]:
        """The longest pieces from left to right; the unknown piece if any place has none."""
        if word in (START_ARG, END_ARG, START_PRED, END_PRED):
            return [word]
        out, at = [], 0
        while at < len(word):
            node, best, end = (self.more if at else self.starts), None, at
            for k in range(at, len(word)):
                node = node.get(word[k])
                if node is None:
                    break
                if "" in node:
                    best, end = node[""], k + 1
            if best is None or len(word) > LONGEST_WORD:
                return [UNKNOWN]
            out.append(best)
            at = end
        return out


def marked(words: list[str], arg_start: int, arg_end: int, pred: int) -> list[str]:
    """The words with markers around [arg_start, arg_end) and the predicate; without an argument (-1) the predicate has both."""
    if arg_start == -1:
        return [*words[:pred], START_PRED, START_ARG, words[pred], END_ARG, END_PRED, *words[pred + 1 :]]
    if arg_start <= pred < arg_end:
        raise ValueError("the predicate is inside the argument")
    opens = {arg_start: START_ARG, pred: START_PRED}
    closes = {arg_end - 1: END_ARG, pred: END_PRED}
    return [x for i, w in enumerate(words) for x in ([opens[i]] if i in opens else []) + [w] + ([closes[i]] if i in closes else [])]


def plain_words(text: str) -> list[str]:
    """Words in lower case without accents; each sign is a word."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return re.findall(r"</?(?:arg|pred)>|\w+|[^\w\s]", bare.replace("_", " _ "))


def encode(vocabulary: Vocabulary, words: list[str], arg_start: int, arg_end: int, pred: int, verb: str | None, task: str, max_length: int, context: bool = True) -> tuple | None:
    """One example's ENCODED values; None from `max_length` pieces on. The verb is a second text, in the arguments' task or without context."""
    text = marked(words, arg_start, arg_end, pred) if context else words[arg_start:arg_end]
    pair = verb if task == "ARGS" or not context else None
    pieces = [CLS, *(p for w in plain_words(" ".join(text)) for p in vocabulary.pieces(w)), SEP]
    verb_at = len(pieces)
    if pair:
        pieces += [*(p for w in plain_words(pair) for p in vocabulary.pieces(w)), SEP]
    if len(pieces) >= max_length:
        return None
    ids = [vocabulary.ids[p] for p in pieces]
    places = (pieces.index(m) if m in pieces else -1 for m in (START_ARG, END_ARG, START_PRED, END_PRED))
    pad = [0] * (max_length - len(ids))
    return ids + pad, [1] * len(ids) + pad, *places, verb_at, TASKS[task]


def with_markers(pieces: list[str]) -> dict[str, int]:
    """Numbers of a vocabulary's pieces in order; markers come behind. It must have the special pieces."""
    if len(pieces) > MOST_ENTRIES:
        raise ValueError(f"a vocabulary of more than {MOST_ENTRIES} pieces")
    if missing := {CLS, SEP, UNKNOWN} - set(pieces):
        raise ValueError(f"the vocabulary lacks {sorted(missing)}")
    return {p: i for i, p in enumerate([*pieces, START_ARG, END_ARG, START_PRED, END_PRED])}


def encoded(samples: DataFrame, pieces: list[str], max_length: int = MAX_LENGTH, context: bool = True) -> DataFrame:
    """`samples` (words, arg_start_idx, arg_end_idx, predicate_idx, verb, tagset_type; other columns stay) with `x`, the struct of ENCODED.

    x is null where an example is too long, its words or numbers are null, or its task is unknown; an argument that holds the predicate fails the query.
    """
    known = samples.sparkSession.sparkContext.broadcast(with_markers(pieces))  # MOST_ENTRIES at most
    names = [c.split()[0] for c in ENCODED.split(", ")]
    kinds = {"array<int>": pa.list_(pa.int32()), "int": pa.int32()}
    kind = pa.struct([(n, kinds[c.split()[1]]) for n, c in zip(names, ENCODED.split(", "), strict=True)])

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(known.value)
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("words", "arg_start_idx", "arg_end_idx", "predicate_idx", "verb", "tagset_type")), strict=True)
            out = []
            for words, s, e, p, verb, task in rows:
                x = None if words is None or None in (s, e, p) or None in words or task not in TASKS else encode(vocabulary, words, s, e, p, verb, task, max_length, context)
                out.append(None if x is None else dict(zip(names, x, strict=True)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], [*b.schema.names, "x"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema.fields)
    return samples.mapInArrow(batch, f"{fields}, x struct<{', '.join(c.replace(' ', ':', 1) for c in ENCODED.split(', '))}>")


def usable(rows: DataFrame) -> DataFrame:
    """Rows with features."""
    return rows.filter(F.col("x").isNotNull())
