"""Removal of byte strings of a minimum length that occur more than once, within and across documents.

In every window of the minimum length the anchor (a short run of bytes) of the least hash is marked, so any two equal windows
have an equal anchor at an equal place. The windows of one anchor are a fragment. Equal fragments are counted by hash; what is
in two places is a repeat as it stands. Of the others, windows by their distance from the anchor form pieces: all windows of a
piece hold a common core of bytes, so equal windows lie in pieces of equal cores, and only pieces whose core occurs again are
searched. A group of pieces (one core) goes whole to one block. There the block's suffixes are sorted, and breadth-first
backward extension on its Burrows-Wheeler transform derives common prefixes in increasing order and stops at the minimum
length; what has no value by then is a repeat. A group too large for a block is dealt anew by longer cores: each piece is
halved, equal halves are counted, and so on; a core that is as long as a window holds one window, and its group needs no search.
Nothing is left out: equality is by 64-bit hashes within groups of equal 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright import scratch
from framewright.llm.shingles import _BYTE, _INVERSE, BASE, mix, powers

LENGTH, ANCHOR = 400, 64
#: Bytes of a group that goes to one block, and of all a block has besides its last group.
GROUP, BLOCK = 1_000_000, 1_000_000
#: Bytes that are hashed in one go, and the bits of a place among them.
AT_ONCE, PLACE = 1 << 19, np.uint64(20)
#: Bits of a place in a block (two groups at most); intervals of more rows are extended symbol by symbol.
ROW, WIDE = 21, 32
_UP, _DOWN = powers(BASE, AT_ONCE + 1), powers(_INVERSE, AT_ONCE + 1)
_MOST = np.iinfo(np.uint64).max
FRAGMENT = "k1 long, k2 long, s long, n int, x int, h long, f long, w0 long, w1 long"
PIECE = "w long, k1 long, k2 long, s long, x int, d int, own boolean, raw binary"


def stretches(ends: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first text, start, ends) of stretches of at most AT_ONCE bytes of texts that end at `ends`; a longer text is cut, with overlaps."""
    first, start = 0, 0
    while first < len(ends):
        last = int(np.searchsorted(ends, start + AT_ONCE, "right"))
        if last > first:
            yield first, start, ends[first:last]
        else:
            last, end = first + 1, int(ends[first])
            for at in range(start, max(start + 1, end - length + 1), AT_ONCE - length):
                yield first, at, np.array([min(end, at + AT_ONCE - 1)])
        first, start = last, int(ends[last - 1])


def fragments(b: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, s, n, x, h, f, w0, w1): each fragment of the texts in `b` that end at `ends`.

    s is its start in b, n its bytes, x the place of its anchor from s, h and f the anchor's and its own hash, w0 and w1 the
    cores of its windows less than half the greatest distance before the anchor, and of those from there (0 where it has none).
    """
    half = half_way(length, anchor)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _UP[: len(b)], out=sums[1:])
    h = mix((sums[anchor:] - sums[: len(b) - anchor + 1]) * _DOWN[: len(b) - anchor + 1])
    w = length - anchor + 1
    # Hash and place in one number: the least is the leftmost of the least hash. Minima over w by blocks of w.
    marked = np.full(-(-len(h) // w) * w, _MOST, np.uint64)
    marked[: len(h)] = h >> PLACE << PLACE | np.arange(len(h), dtype=np.uint64)
    ahead = np.minimum.accumulate(marked.reshape(-1, w), 1).ravel()
    behind = np.minimum.accumulate(marked.reshape(-1, w)[:, ::-1], 1)[:, ::-1].ravel()
    k = len(b) - length + 1
    at = (np.minimum(behind[:k], ahead[w - 1 : w - 1 + k]) & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    sizes = np.diff(ends, prepend=0)
    start = np.flatnonzero(np.repeat(ends, sizes)[:k] >= np.arange(length, length + k))
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(8))
    at = at[start]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
    s, e = start[first], start[np.concatenate([first[1:], [len(start)]]) - 1] + length
    p = at[first]
    whole = lambda i, j: mix((sums[j] - sums[i]) * _DOWN[i] + (j - i).astype(np.uint64))
    core = length - half + 1
    w0 = np.where(p - (e - length) < half, whole(p, np.minimum(p + core, len(b))), 0)
    far = np.maximum(p - half, 0)
    w1 = np.where(p - s >= half, whole(far, np.minimum(far + core, len(b))) ^ np.uint64(1), 0)
    return np.searchsorted(ends, s, "right"), s, e - s, p - s, h[p], whole(s, e), w0, w1


def half_way(length: int, anchor: int) -> int:
    return (length - anchor + 2) // 2


def _dense(t: np.ndarray) -> tuple[np.ndarray, int]:
    """Symbols numbered without gaps, and how many there are."""
    there = np.zeros(258, np.int64)
    there[t] = 1
    return (np.cumsum(there) - 1)[t], int(there.sum())


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of t (fewer than 1 << ROW) in the order of their first `depth` symbols or more, by prefix doubling: ranks and place in one sorted number."""
    n, bits = len(t), max(1, int(len(t) - 1).bit_length())
    symbols, kinds = _dense(t)
    width = max(1, int((63 - bits) / np.log2(max(2, kinds))))
    places = np.arange(n, dtype=np.int64)
    key, rank = np.zeros(n, np.int64), np.empty(n, np.int64)
    for i in range(width):
        key = key * kinds + np.roll(symbols, -i)
    while True:
        key = np.sort(key << bits | places)
        order = key & (1 << bits) - 1
        key >>= bits
        rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        if width >= depth:
            return order
        key = rank << bits | np.roll(rank, -width)
        width *= 2


def repeat_bounds(t: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each row of the sorted rotations, whether it has a common prefix of `length` with the row before."""
    n = len(t)
    bwt, kinds = _dense(t[order - 1])
    counts = np.bincount(bwt, minlength=kinds)
    base = np.cumsum(counts) - counts
    by_symbol = np.argsort(bwt.astype(np.uint16), kind="stable")
    to = np.empty(n, np.int64)
    to[by_symbol] = np.arange(n)
    places = np.split(by_symbol, base[1:])
    opens = np.zeros(n + 1, bool)  # rows at which another first symbol begins
    opens[base] = True
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(low):
            break
        size = high - low
        one = to[low[size == 1]]
        lows, highs = [one], [one + 1]
        some = (size > 1) & (size <= WIDE)
        if some.any():
            # The rows of each interval by where they go: runs of neighbours with one first symbol are the intervals one symbol longer.
            x, m = low[some], size[some]
            ends = np.cumsum(m)
            rows = np.arange(ends[-1]) + np.repeat(x - (ends - m), m)
            gone = np.sort(np.repeat(np.arange(len(x)), m) << ROW | to[rows])
            cut = np.flatnonzero(np.concatenate([[True], (gone[1:] != gone[:-1] + 1) | opens[gone[1:] & (1 << ROW) - 1]]))
            gone &= (1 << ROW) - 1
            lows.append(gone[cut])
            highs.append(gone[np.concatenate([cut[1:], [len(gone)]]) - 1] + 1)
        if (wide := size > WIDE).any():
            for place, start in zip(places, base, strict=True):
                x, y = np.searchsorted(place, low[wide]), np.searchsorted(place, high[wide])
                there = x < y
                lows.append(start + x[there])
                highs.append(start + y[there])
        low, high = np.concatenate(lows), np.concatenate(highs)
        new = ~known[high]
        low, high = low[new], high[new]
        known[high] = True
    return ~known[:n]


def block_repeats(pieces: list[bytes], who: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(piece, first, last): the first and last window in each piece that stands in two places or more; `who` names a piece's place."""
    sizes = np.array([len(x) + 1 for x in pieces])
    ends = np.cumsum(sizes)
    t = np.frombuffer(b"\0".join([*pieces, b"\0"]), np.uint8).astype(np.int64) + 2
    t[ends - 1] = 1
    t[-1] = 0
    order = suffix_order(t, length)
    same = repeat_bounds(t, order, length)
    # Only rows in runs of equal prefixes count, and of those the ones that start a window.
    rows = np.flatnonzero(same | np.concatenate([same[1:], [False]]))
    if not len(rows):
        return []
    at = order[rows]
    piece = np.searchsorted(ends, at, "right")
    full = np.minimum(piece, len(pieces) - 1)
    window = (piece < len(pieces)) & (ends[full] - 1 - at >= length)
    run = np.cumsum(~same[rows])[window]
    at, piece = at[window], piece[window]
    if not len(at):
        return []
    offset = at - (ends - sizes)[piece]
    spot = who[piece] * (int(sizes.max()) + 1) + offset
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    several = np.minimum.reduceat(spot, first) != np.maximum.reduceat(spot, first)
    hit = np.repeat(several, np.diff(np.append(first, len(at))))
    low, high = np.full(len(pieces), 1 << 60), np.full(len(pieces), -1)
    np.minimum.at(low, piece[hit], offset[hit])
    np.maximum.at(high, piece[hit], offset[hit])
    return [(int(i), int(low[i]), int(high[i])) for i in np.flatnonzero(high >= 0)]


def _sums(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text ends."""
    big = array.cast(pa.large_string())
    offsets = np.frombuffer(big.buffers()[1], np.int64)[big.offset : big.offset + len(big) + 1]
    raw = np.frombuffer(big.buffers()[2] or b"", np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _marks(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """The fragments of (k1, k2, text)."""

    def each(batches):
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            raw, ends = _sums(batch.column("text"))
            before = ends - np.diff(ends, prepend=0)
            for first, start, stops in stretches(ends, length):
                if stops[-1] - start < length:
                    continue
                text, s, n, x, h, f, w0, w1 = fragments(raw[start : stops[-1]], stops - start, length, anchor)
                text += first
                cols = [k1[text], k2[text], s + start - before[text], n.astype(np.int32), x.astype(np.int32), *(v.astype(np.uint64).view(np.int64) for v in (h, f, w0, w1))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [c.split()[0] for c in FRAGMENT.split(", ")])

    return texts.mapInArrow(each, FRAGMENT)


def _search(pieces: DataFrame, length: int) -> DataFrame:
    """(k1, k2, s, e) of the repeats in groups of pieces of one core w, each small enough for a block."""

    def found(held):
        names = {}
        who = np.array([names.setdefault((x[1], x[2], x[3]), len(names)) for x in held])
        out = [(held[i][1], held[i][2], held[i][3] + a, held[i][3] + b + length) for i, a, b in block_repeats([x[4] for x in held], who, length)]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], ["k1", "k2", "s", "e"])

    def each(batches):
        held, size = [], 0
        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in ("w", "k1", "k2", "s", "raw")), strict=True):
                if size > BLOCK and x[0] != held[-1][0]:
                    yield found(held)
                    held, size = [], 0
                held.append(x)
                size += len(x[4]) + 1
        if held:
            yield found(held)

    dealt = pieces.select("w", "k1", "k2", "s", "raw").repartition("w").sortWithinPartitions("w")
    return dealt.mapInArrow(each, "k1 long, k2 long, s long, e long")


def _hash(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _halved(pieces: DataFrame, g: int, length: int) -> DataFrame:
    """Pieces of at most g distances each, with the hash f of their bytes, from pieces of more."""

    def each(batches):
        for b in batches:
            out = []
            for k1, k2, s, x, d, own, raw in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "s", "x", "d", "own", "raw")), strict=True):
                last = len(raw) - length
                for near in (d, d + g):
                    # Windows whose distance to the anchor, x - i, is in [near, near + g).
                    i, j = max(0, x - near - g + 1), min(last, x - near)
                    if i <= j:
                        part, core = raw[i : j + length], raw[x - near : x - near + length - g + 1]
                        out.append((_hash(core + near.to_bytes(4, "little")), k1, k2, s + i, x - i, near, own, part, _hash(part)))
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.bool_(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

    names = ["w", "k1", "k2", "s", "x", "d", "own", "raw", "f"]
    return pieces.mapInArrow(each, PIECE + ", f long")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and the text's 128-bit key k1, k2."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", *_key(F.col("text")))


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def removed_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """k1, k2 of each text with repeats, and its spans: array<struct<s, e>>, in no order, overlapping."""
    texts = keyed(docs).filter(F.octet_length("text") >= length).drop("doc_id")
    # One row a text from here on: each task keeps one of its copies, so that no task gets more rows of a text than there are tasks.
    once = scratch.written(texts.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("c"), F.first("text").alias("text")), "repeat-texts")
    copies = once.filter("c > 1").select("k1", "k2", F.lit(0).cast("long").alias("s"), F.octet_length("text").cast("long").alias("e"))
    copies, texts = scratch.written(copies, "repeat-copies"), once.drop("c")
    marks = scratch.written(_marks(texts, length, anchor), "repeat-marks")
    half = half_way(length, anchor)
    firsts = [F.first(c).alias(c) for c in ("k1", "k2", "s", "n", "x", "w0", "w1")]
    per = scratch.written(marks.groupBy("h", "f").agg(F.count(F.lit(1)).alias("c"), *firsts), "repeat-fragments")
    again = per.filter("c > 1").select("h", "f")
    twice = marks.join(again, ["h", "f"]).select("k1", "k2", "s", (F.col("s") + F.col("n")).alias("e")).distinct()
    twice = scratch.written(twice, "repeat-twice")
    scratch.discard(marks)

    # Pieces whose core is in another fragment too, in a group with one at least that isn't a repeat as it stands.
    spot, single = [F.col(c) for c in ("k1", "k2", "s", "n", "x")], F.col("c") == 1
    cores = per.select(*spot, single.alias("own"), F.explode(F.array(F.struct(F.col("w0").alias("w"), F.lit(0).alias("d")), F.struct(F.col("w1").alias("w"), F.lit(half).alias("d")))).alias("core"))
    cores = cores.select(*spot, "own", "core.w", "core.d").filter("w <> 0")
    shared = cores.groupBy("w").agg(F.count(F.lit(1)).alias("kinds"), F.max("own").alias("open")).filter("kinds > 1 and open").select("w")
    wanted = scratch.written(cores.join(shared, "w"), "repeat-wanted")
    scratch.discard(per)
    asked = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("w", "s", "n", "x", "d", "own")).alias("ps"))

    def cut(batches):
        for b in batches:
            out = []
            for k1, k2, text, ps in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "text", "ps")), strict=True):
                raw = text.encode()
                for p in ps:
                    s, a, d = p["s"], p["s"] + p["x"], p["d"]
                    i = max(s, a - d - half + 1)
                    j = min(s + p["n"] - length, a - d)
                    out.append((p["w"], k1, k2, i, a - i, d, p["own"], raw[i : j + length]))
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["w", "k1", "k2", "s", "x", "d", "own", "raw"])

    pieces = scratch.written(texts.join(asked, ["k1", "k2"]).mapInArrow(cut, PIECE), "repeat-pieces")
    scratch.discard(wanted, once)
    found, g = [copies, twice], half
    while True:
        large = pieces.groupBy("w").agg(F.sum(F.octet_length("raw")).alias("size")).filter(F.col("size") > GROUP).select("w")
        large = scratch.written(large, "repeat-large")
        more = not large.isEmpty()
        small = pieces.join(large, "w", "left_anti") if more else pieces
        found.append(scratch.written(_search(small, length), "repeat-found"))
        if not more:
            break
        g = -(-g // 2)
        halves = scratch.written(_halved(pieces.join(large, "w", "left_semi"), g, length), "repeat-halves")
        scratch.discard(pieces, large)
        place = F.xxhash64("k1", "k2", "s")
        kinds = halves.groupBy("w", "f").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        kinds = scratch.written(kinds, "repeat-kinds")
        several = kinds.filter("first <> last").select("w", "f")
        found.append(scratch.written(halves.join(several, ["w", "f"]).select("k1", "k2", "s", (F.col("s") + F.octet_length("raw")).alias("e")), "repeat-found"))
        # One piece of each kind goes on, if its core has other kinds and one of them is in one place only.
        open_ = kinds.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("first") == F.col("last")).alias("open")).filter("n > 1 and open").select("w")
        going = kinds.join(open_, "w").select("w", "f", "first", (F.col("first") == F.col("last")).alias("one"))
        pieces = halves.withColumn("first", place).join(going, ["w", "f", "first"]).withColumn("own", F.col("own") & F.col("one"))
        pieces = scratch.written(pieces.select([c.split()[0] for c in PIECE.split(", ")]), "repeat-pieces")
        scratch.discard(halves, kinds)
    scratch.discard(pieces, large)
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    spans = scratch.written(every.groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "repeat-spans")
    scratch.discard(*found)
    return spans


def merged(found) -> list[tuple[int, int]]:
    """Maximal runs of the spans, ascending; spans that touch are one."""
    out = []
    for s, e in sorted((x["s"], x["e"]) for x in found or ()):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for s, e in spans:
        kept.append(raw[at:s])
        at = e
    return b"".join([*kept, raw[at:]])


def report(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of `docs` (doc_id, text).

    Null and empty texts, and texts below `length` bytes, keep all. Repeated rows are copies of one another, and are removed whole
    if they are long enough. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    found = removed_spans(docs, length, anchor)

    def each(batches):
        for b in batches:
            out = []
            for text, x in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw, runs = text.encode(), merged(x)
                kept = without(raw, runs)
                out.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in out], pa.int64()) for i in range(3)), pa.array([r[3] for r in out], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = keyed(docs).join(found, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(each, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """`docs` with the repeated parts cut from `text` (bytes that no longer form a character go too); same columns and rows.

    Nulls, empty texts and texts below `length` bytes stay as they are; a repeated row keeps nothing if it is long enough.
    """
    found = removed_spans(docs, length, anchor)

    def each(batches):
        for b in batches:
            texts = [t if not x else without(t.encode(), merged(x)).decode("utf-8", "ignore") for t, x in zip(b.column(0).field("text").to_pylist(), b.column(1).to_pylist(), strict=True)]
            row = b.column(0)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else row.field(c) for c in columns], columns)

    columns = docs.columns
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), *_key(text)).join(found, ["k1", "k2"], "left").select("row", "spans")
    return rows.mapInArrow(each, docs.schema)
