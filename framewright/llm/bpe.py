"""Byte-level BPE by replaying merges over all words at once.

The words (pattern matches) of a batch of documents form one corpus: an inverted index leads from each mergeable pair,
under its rank, to the places where it stands. Ranks are taken in ascending order from a heap; each merge touches only the
two neighbours, whose new pairs join the index. A merge may give a pair of a lower rank than the present one: the later
places of that word then wait until that pair is done, so that every word sees its merges in the order a single-word
encoder would choose (lowest rank, then leftmost).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright import scratch
from framewright.llm.pretokens import splitter

#: Words whose ids a worker remembers between batches; it forgets all beyond. Long words are never remembered.
REMEMBERED, LONG = 600_000, 64
TEXTS_AT_ONCE = 1000


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def replay(words: list[bytes], rank_of: dict[bytes, int], by_id: dict[int, bytes]) -> list[list[int]]:
    """The ids of each word, all words merged together in rank order."""
    home, token, left, right = [], [], [], []
    firsts = []
    for w, word in enumerate(words):
        at = len(token)
        firsts.append(at)
        n = len(word)
        home += [w] * n
        token += [word[i : i + 1] for i in range(n)]
        left += [-1, *range(at, at + n - 1)] if n else []
        right += [*range(at + 1, at + n), -1] if n else []
    index: dict[int, list[int]] = {}
    rank = rank_of.get
    for i, j in enumerate(right):
        if j >= 0 and (r := rank(token[i] + token[j])) is not None:
            if r in index:
                index[r].append(i)
            else:
                index[r] = [i]
    heap = list(index)
    heapq.heapify(heap)
    push, pop = heapq.heappush, heapq.heappop
    while heap:
        now = pop(heap)
        places = index.pop(now, None)
        if places is None:
            continue
        wait: set[int] = set()
        places.sort()
        size = len(by_id[now])
        for i in places:
            t = token[i]
            j = right[i]
            if j < 0 or not t or len(t) + len(token[j]) != size or rank(t + token[j]) != now:
                continue
            if wait and home[i] in wait:
                if now not in index:
                    index[now] = []
                    push(heap, now)
                index[now].append(i)
                continue
            token[i] = t = by_id[now]
            token[j] = b""
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (r := rank(t + token[k])) is not None:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
                        push(heap, r)
                    if r < now:
                        wait.add(home[i])
            h = left[i]
            if h >= 0 and (r := rank(token[h] + t)) is not None:
                if r in index:
                    index[r].append(h)
                else:
                    index[r] = [h]
                    push(heap, r)
                if r < now:
                    wait.add(home[i])
    ids = []
    for at, word in zip(firsts, words, strict=True):
        out, i = [], at if word else -1
        while i >= 0:
            out.append(rank_of[token[i]])
            i = right[i]
        ids.append(out)
    return ids


class Coder:
    """Encodes and decodes texts; ids are little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.ranks = ranks(path)
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.split = splitter(pattern)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(x) for x in texts]
        if len(self.known) > self.remembered:
            self.known.clear()
        new = list(set().union(*split).difference(self.known))
        raw = [w.encode() for w in new]
        # A word that is an entry of the vocabulary is that one id, as the library has it.
        merged = iter(replay([x for x in raw if x not in self.ranks], self.ranks, self.bytes_of))
        found = [[self.ranks[x]] if x in self.ranks else next(merged) for x in raw]
        self.known.update((w, np.array(x, "<u4").tobytes()) for w, x in zip(new, found, strict=True))
        get = self.known.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        for w in new:
            if len(w) > LONG:
                del self.known[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def coder(path: str, pattern: str, remembered: int) -> Coder:
    return Coder(path, pattern, remembered)


def _mapped(docs: DataFrame, path: str, pattern: str, give, columns: str, remembered: int = REMEMBERED) -> DataFrame:
    """A worker that is to remember fewer words than usual shares its executor with other stages: it forgets them at its task's end."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern, remembered)
        for b in batches:
            for at in range(0, b.num_rows, TEXTS_AT_ONCE):
                part = b.slice(at, TEXTS_AT_ONCE)
                ids = c.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *give(c, ids)], names)
        if remembered < REMEMBERED:
            c.known.clear()
            b = part = ids = None
            scratch.give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(x.split()[0] for x in columns.split(", "))]
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(each, f"doc_id {kind}, {columns}")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of each row of `docs`; null is the empty text, with no ids."""
    def give(c, ids):
        return [pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))]

    return _mapped(docs, path, pattern, give, "ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of `docs` (doc_id, text); a worker remembers the ids of `remembered` words, those fewer than REMEMBERED until its task ends.

    Null is the empty text: no ids, digests of nothing. Repeated rows get a row each, an empty table an empty result;
    other columns are ignored. Nothing is shuffled; a task holds one batch of documents and its words.
    """
    def give(c, ids):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids]), pa.array([sha(c.decode(x)) for x in ids])]

    return _mapped(docs, path, pattern, give, "n_tokens long, ids_sha256 string, decoded_sha256 string", remembered)
