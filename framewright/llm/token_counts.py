"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where both encodings provably agree.

Proof of a splice: the pre-tokenizer matches from left to right without looking back, so tokens after a word's start
depend on the text from there on only. If a word starts at p in the chunk before (whose tokens are right up to there, as p
is well before its cut) and in the chunk after, both give the tokens of the whole text beyond p. p keeps a margin from either
cut, longer than any special token, and the characters around p must not compose under NFC.

Texts of one chunk are spliced at whitespace, if the tokenizer is one whose matches and special tokens hold none (`parted`): nothing
composes with it, lower case is taken character by character, so a text's tokens are those of its words, one after the other.
Each word is then encoded once, by the library, and its count remembered.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP, MARGIN = 1 << 16, 1 << 10, 64
LIMIT = 2048
TEXTS_AT_ONCE = 512
#: Words whose counts a worker remembers between batches; it forgets all beyond. Long words are never remembered.
REMEMBERED, LONG = 600_000, 64
#: Controls that part words for Python but not for the tokenizer.
UNPARTED = re.compile("[\x1c-\x1f]")
#: Normalizers that leave whitespace where it is, and a pattern without whitespace.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(4)
def parted(path: str) -> bool:
    """Whether a text's tokens are known to be those of its words between whitespace, one after the other."""
    spec = json.loads(tokenizer(path).to_str())
    normalizer, split = spec["normalizer"] or {}, ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    plain = all(not (x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"])) for x in spec["added_tokens"])
    return plain and normalizer.get("normalizers") == NORMALIZERS and split == {"type": "Split", "pattern": {"Regex": WORD}, "behavior": "Removed", "invert": True}


@lru_cache(4)
def remembered(path: str) -> dict[str, int] | None:
    """The counts of words that this worker has met; None where words can't be counted one by one."""
    return {} if parted(path) else None


def _starts(encoding, at: int) -> tuple[list[int], list[int]]:
    """Absolute start of each token, and of those that begin a word."""
    starts = [at + a for a, _ in encoding.offsets]
    words = encoding.word_ids
    return starts, [s for i, s in enumerate(starts) if i == 0 or words[i] is None or words[i] != words[i - 1]]


def _stable(text: str, p: int) -> bool:
    if unicodedata.combining(text[p]):
        return False
    pair = text[p - 1 : p + 1]
    return unicodedata.normalize("NFC", pair) == unicodedata.normalize("NFC", pair[0]) + unicodedata.normalize("NFC", pair[1])


def encode_spliced(t, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """(id, start) of each token of `text`, as the tokenizer gives them for the whole; overlaps widen until a splice is proven."""
    begin, known = 0, 0  # the chunk's start; tokens before `known` are given
    end = min(len(text), chunk)
    now = t.encode(text[begin:end], add_special_tokens=False)
    while True:
        starts, words = _starts(now, begin)
        if end == len(text):
            yield from ((i, s) for i, s in zip(now.ids, starts, strict=True) if s >= known)
            return
        width, joint = overlap, None
        while joint is None and width < end - known:
            after = end - width
            after_end = min(len(text), after + max(chunk, 2 * width))
            then = t.encode(text[after:after_end], add_special_tokens=False)
            both = set(words) & set(_starts(then, after)[1])
            joint = max((p for p in both if after + MARGIN <= p <= end - MARGIN and _stable(text, p)), default=None)
            width *= 2
        if joint is None:  # no splice in the whole chunk: take a longer one
            end = min(len(text), end + max(chunk, end - begin))
            now = t.encode(text[begin:end], add_special_tokens=False)
            continue
        yield from ((i, s) for i, s in zip(now.ids, starts, strict=True) if known <= s < joint)
        begin, end, known, now = after, after_end, joint, then


def count_words(t, texts: list[str], known: dict[str, int]) -> list[int]:
    """Counts of texts as the sums of their words' counts; `known` has those of words met before, and gets the new ones."""
    split = [x.split() for x in texts]
    if len(known) > REMEMBERED:
        known.clear()
    new = list(set().union(*split).difference(known))
    for at in range(0, len(new), TEXTS_AT_ONCE):
        some = new[at : at + TEXTS_AT_ONCE]
        known.update(zip(some, map(len, t.encode_batch_fast(some, add_special_tokens=False)), strict=True))
    get = known.__getitem__
    counts = [sum(map(get, words)) for words in split]
    for w in new:
        if len(w) > LONG:
            del known[w]
    return counts


def count_texts(t, texts: list[str], known: dict[str, int] | None = None) -> list[int]:
    """The number of tokens of each text; with `known` (a tokenizer that is `parted`) each word is encoded once."""
    counts = [0] * len(texts)
    short = [i for i, x in enumerate(texts) if len(x) <= CHUNK]
    words = [] if known is None else [i for i in short if not UNPARTED.search(texts[i])]
    whole = short if known is None else [i for i in short if UNPARTED.search(texts[i])]
    for at in range(0, len(words), TEXTS_AT_ONCE):
        some = words[at : at + TEXTS_AT_ONCE]
        for i, n in zip(some, count_words(t, [texts[i] for i in some], known), strict=True):
            counts[i] = n
    for at in range(0, len(whole), TEXTS_AT_ONCE):
        some = whole[at : at + TEXTS_AT_ONCE]
        for i, e in zip(some, t.encode_batch_fast([texts[i] for i in some], add_special_tokens=False), strict=True):
            counts[i] = len(e.ids)
    for i, x in enumerate(texts):
        if len(x) > CHUNK:
            counts[i] = sum(1 for _ in encode_spliced(t, x))
    return counts


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) for each row of `docs` (doc_id, text).

    Null counts as the empty text: no bytes, no tokens. Repeated rows get a row each, an empty table an empty result;
    other columns are ignored. Nothing is shuffled; a task holds one Arrow batch, one chunk's encoding and the counts of words.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, known = tokenizer(path), remembered(path)
        for b in batches:
            n = pa.array(count_texts(t, b.column("text").to_pylist(), known), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce("text", F.lit("")).alias("text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), text).mapInArrow(each, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
