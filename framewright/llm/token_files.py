"""Token-id files: frequency-ranked ids in one to four bytes each, lengths in separate control bytes.

A file holds documents in ascending doc_id: a header (magic, documents, blocks), the doc_ids and token counts as
little-endian 64-bit integers, then blocks of up to BLOCK ids: two 64-bit lengths, control bytes (four 2-bit lengths each) and
data bytes. Documents without a doc_id have files of their own, marked in the magic, with zeros for doc_ids; they come before
all others. The ids are ranks by corpus frequency; the folder's `ranks` file has the id of each rank. Decoding looks the
control bytes up in numpy tables. Files cover consecutive ranges of doc_id, and so do their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright import scratch
from framewright.llm import files
from framewright.llm.native import ordered_buckets
from framewright.llm.pretokens import matches, plain
from framewright.llm.token_counts import tokenizer

MAGIC, NO_IDS = b"FWTI\x01\0\0\0", b"FWTI\x01\x01\0\0"
BLOCK = 1 << 19
ROWS_A_FILE = 2000
#: How byte-level vocabularies write a blank.
SPACE = "Ġ"
#: Bytes of ids that a task holds before it passes them on; words whose ids it remembers.
HELD, REMEMBERED = 32 << 20, 900_000
#: Stands before each pre-token that does not begin with whitespace other than a blank, when Arrow has split a batch of texts.
CUT = "\x01"
SPLIT = r" ?\p{L}+|'(?:[stmd]|re|ve|ll)| ?\p{N}+| ?[^\s\v\x{85}\p{Z}\p{L}\p{N}]+"
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)
TOTALS = LENGTHS.sum(1).astype(np.int64)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    n = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    four[: len(v)] = n - 1
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < n[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values, by lookup of each control byte's four lengths."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data, np.uint8)
    values = raw[starts].astype("<u4")
    for j in (1, 2, 3):
        if len(at := np.flatnonzero(lengths > j)):
            values[at] |= raw[starts[at] + j].astype(np.uint32) << np.uint32(8 * j)
    return values


class WordIds(dict):
    """Words seen, numbered: pre-tokens, with one whitespace character after them at most, or, after CUT, pre-tokens of any kind; `ids` holds each one's ids from its place in `starts` on, `sizes` of them, as the library gives them. Forgets all when it is full."""

    def __init__(self, t, kind: str):
        super().__init__()
        self.t, self.kind = t, kind
        self.ids, self.starts, self.sizes = np.empty(1 << 16, kind), np.zeros(1 << 15, np.int32), np.zeros(1 << 15, np.int32)
        self.used = 0
        self.fresh: list[str] = []
        self.specials = [x.content for x in t.get_added_tokens_decoder().values()]
        vocabulary = t.get_vocab()
        self.opens = np.zeros(1 + max(vocabulary.values(), default=0), bool)  # ids that begin with a blank
        self.opens[[i for x, i in vocabulary.items() if x[:1] == SPACE]] = True

    def __missing__(self, word: str) -> int:
        apart = word[:1] == CUT
        if not apart and len(word) - len(word.rstrip()) > 1:
            return -1  # how more whitespace is split depends on what follows
        number = self[word] = len(self)
        self.fresh.append(word[1:] if apart else word)
        return number

    def _numbered(self, texts: list[str]) -> list[np.ndarray | None]:
        """The numbers of each text's words; None where Python's and Arrow's engines might give others than the tokenizer's pattern."""
        split = pc.split_pattern(pc.replace_substring_regex(pa.array(texts, pa.large_string()), SPLIT, f"{CUT}\\0"), CUT)
        words = split.flatten().dictionary_encode()
        numbers = np.array(list(map(self.__getitem__, words.dictionary.to_pylist())), np.int32)[words.indices.to_numpy()]
        cuts = split.offsets.to_numpy()
        out = [numbers[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for i in {int(np.searchsorted(cuts, at, "right")) - 1 for at in np.flatnonzero(numbers < 0)} | {i for i, x in enumerate(texts) if CUT in x}:
            found = matches(texts[i])
            out[i] = None if found is None else np.array([self[CUT + w] for w in found], np.int32)
        return out

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids, one after the other, and how many each has."""
        each = [e.ids for e in self.t.encode_batch_fast(words, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(each)), self.kind), np.array(list(map(len, each)), np.int64)

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of a blank and letters make one text, which falls into them again; each begins with an id that begins with a blank."""
        ids = np.array(self.t.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, self.kind)
        first = np.flatnonzero(self.opens[ids])
        if len(first) != len(words):  # a tokenizer of another kind
            return self._each(words)
        return ids, np.diff(first, append=len(ids))

    def _keep(self, numbers: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        end = self.used + len(ids)
        self.ids, self.starts, self.sizes = _room(self.ids, end), _room(self.starts, len(self)), _room(self.sizes, len(self))
        self.ids[self.used : end] = ids
        self.starts[numbers] = self.used + np.cumsum(sizes) - sizes
        self.sizes[numbers] = sizes
        self.used = end

    def _texts(self, rows: list[np.ndarray]) -> Iterator[bytes]:
        """The ids of each row of words, as bytes; gathered for a few rows at once, which the processor's cache holds."""
        for at in range(0, len(rows), 64):
            part = rows[at : at + 64]
            lengths = np.array(list(map(len, part)), np.int64)
            numbers = np.concatenate(part)
            sizes = self.sizes[numbers]
            ends = np.cumsum(sizes)
            raw = self.ids[np.repeat(self.starts[numbers] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))].tobytes()
            cuts = (np.append(0, ends)[np.append(0, np.cumsum(lengths))] * self.ids.itemsize).tolist()
            yield from (raw[i:j] for i, j in zip(cuts, cuts[1:]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Words are pre-tokens, which the byte-level tokenizer encodes one by one; texts it might split otherwise go to it whole."""
        if len(self) > REMEMBERED:
            self.clear()
            self.used = 0
        known = len(self)
        sure = [i for i, x in enumerate(texts) if plain(x) and not any(s in x for s in self.specials)]
        rows: list[np.ndarray | None] = [None] * len(texts)
        for i, row in zip(sure, self._numbered([texts[i] for i in sure]), strict=True):
            rows[i] = row
        fresh, self.fresh = self.fresh, []
        spaced = [w[:1] == " " and w[1:].isalpha() for w in fresh]
        for want, give, at_once in ((True, self._spaced, 4096), (False, self._each, 8192)):
            own = [i for i, x in enumerate(spaced) if x == want]
            for at in range(0, len(own), at_once):
                part = own[at : at + at_once]
                self._keep([known + i for i in part], *give([fresh[i] for i in part]))
        of = self._texts([row for row in rows if row is not None])
        whole = lambda x: np.array(self.t.encode(x, add_special_tokens=False).ids, self.kind).tobytes()
        return [whole(x) if row is None else next(of) for x, row in zip(texts, rows, strict=True)]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """`a` with room for n values at least: if it is too short, twice as long."""
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    t = tokenizer(path)
    top = max(t.get_vocab_size(), 1 + max(t.get_added_tokens_decoder(), default=0))
    return WordIds(t, "<u2" if top <= 1 << 16 else "<u4")


CHUNKS = "bucket long, doc_ids binary, counts binary, ids binary"


def tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Chunks of (bucket, doc_ids, counts, ids): each task's documents by bucket, compressed, zero for a null doc_id. In bucket -2: ids (as doc_ids) and how often they occur."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        kind, tail = words.kind, np.array([end_id], words.kind).tobytes()
        held: dict[int, tuple[list, list, list]] = {}
        seen, size = np.zeros(1, np.int64), 0
        press = zstandard.ZstdCompressor(1).compress

        def chunk(bucket, doc_ids, counts, ids):
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), *(pa.array([x], pa.binary()) for x in (np.array(doc_ids, "<i8").tobytes(), np.array(counts, "<i8").tobytes(), press(ids)))], ["bucket", "doc_ids", "counts", "ids"])

        for b in batches:
            buckets, doc_ids = b.column("bucket").to_pylist(), b.column("doc_id").to_pylist()
            texts = b.column("text").to_pylist()
            for at in range(0, len(texts), 1000):
                for k, d, ids in zip(buckets[at : at + 1000], doc_ids[at : at + 1000], words.encode(texts[at : at + 1000]), strict=True):
                    ids += tail
                    x, y, z = held.setdefault(k, ([], [], []))
                    x.append(0 if d is None else d)
                    y.append(len(ids) // len(tail))
                    z.append(ids)
                    size += len(ids)
                if size > HELD:
                    for k, (x, y, z) in held.items():
                        joined = b"".join(z)
                        found = np.bincount(np.frombuffer(joined, kind))
                        seen = found + np.pad(seen, (0, len(found) - len(seen))) if len(found) > len(seen) else seen + np.pad(found, (0, len(seen) - len(found)))
                        yield chunk(k, x, y, joined)
                    held, size = {}, 0
        for k, (x, y, z) in held.items():
            joined = b"".join(z)
            found = np.bincount(np.frombuffer(joined, kind))
            seen = found + np.pad(seen, (0, len(found) - len(seen))) if len(found) > len(seen) else seen + np.pad(found, (0, len(seen) - len(found)))
            yield chunk(k, x, y, joined)
        if len(ids := np.flatnonzero(seen)):
            yield chunk(-2, ids, seen[ids], b"")

    return docs.mapInArrow(each, CHUNKS)


def ranking(chunks: DataFrame) -> np.ndarray:
    """All ids that occur, the most frequent first, ties by id: as many as the vocabulary has at most."""

    def each(batches):
        for b in batches:
            for x, y in zip(b.column("doc_ids").to_pylist(), b.column("counts").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, "<i8")), pa.array(np.frombuffer(y, "<i8"))], ["id", "n"])

    counted = chunks.filter("bucket = -2").select("doc_ids", "counts").mapInArrow(each, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return counted.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy("<u4")


def write_files(docs: DataFrame, path: str, end_id: int = 0, rows_a_file: int = ROWS_A_FILE) -> tuple[str, DataFrame]:
    """Encode `docs` (doc_id, text) with the tokenizer at `path`, append `end_id` to each, write the files; (folder, manifest).

    Each text is encoded once; compressed chunks of ids are kept in the shared folder until ranks are known, and are
    shuffled to their files by doc_id range, those of null doc_ids by hash of the text. The manifest has bucket, name, n_docs, n_ids of the files of completed tasks.
    """
    spark = docs.sparkSession
    text, unnamed = F.coalesce("text", F.lit("")), docs.filter("doc_id is null").count()
    bucket = F.when(F.col("doc_id").isNull(), -3 - F.pmod(F.xxhash64(text), F.lit(-(-unnamed // rows_a_file) or 1))).otherwise(ordered_buckets(docs, rows_a_file, by_bytes=False))
    rows = docs.select("doc_id", text.alias("text"), bucket.alias("bucket"))
    kind = word_ids(path).kind
    chunks = scratch.written(tokenised(rows, path, end_id), "token-chunks")
    ranks = ranking(chunks)
    home = files.folder(scratch.new_path(spark, "token-files"))
    files.publish(f"{home}/ranks", lambda out: out.write(ranks.tobytes()))
    shared = spark.sparkContext.broadcast(ranks)  # at most the vocabulary

    def save(bucket: int, rows: list[tuple[bytes, bytes, bytes]]):
        rank_of = np.zeros(int(shared.value.max(initial=0)) + 1, "<u4")
        rank_of[shared.value] = np.arange(len(shared.value), dtype="<u4")
        doc_ids = np.concatenate([np.frombuffer(x, "<i8") for x, _, _ in rows])
        counts = np.concatenate([np.frombuffer(y, "<i8") for _, y, _ in rows])
        ids = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(z) for _, _, z in rows), kind)
        order = np.argsort(doc_ids, kind="stable")
        magic, name = (NO_IDS, f"ids-none-{-3 - bucket:012d}") if bucket < -2 else (MAGIC, f"ids-{bucket + 1:012d}")
        first = np.cumsum(counts) - counts
        n = int(counts.sum())
        until = np.cumsum(counts[order])  # where each document ends in the file

        def between(at: int, end: int) -> np.ndarray:
            """Ids at..end of the file, in its order; only documents of this part are looked at."""
            i, j = np.searchsorted(until, at, "right"), np.searchsorted(until, end, "left")
            o = order[i : j + 1]
            part = ids[np.repeat(first[o] - (np.cumsum(counts[o]) - counts[o]), counts[o]) + np.arange(int(counts[o].sum()))]
            skip = at - (int(until[i]) - int(counts[o[0]]))
            return part[skip : skip + end - at]


        def write(out):
            out.write(magic + struct.pack("<QQ", len(order), -(-n // BLOCK)) + doc_ids[order].tobytes() + counts[order].tobytes())
            for at in range(0, n, BLOCK):
                end = min(n, at + BLOCK)
                control, data = pack(rank_of[between(at, end)])
                out.write(struct.pack("<QQ", end - at, len(data)) + control + data)

        files.publish(f"{home}/{name}", write)
        return bucket, name, len(order), n

    def each(batches):
        now, rows = None, []
        done = lambda x: pa.RecordBatch.from_arrays([pa.array([v]) for v in x], ["bucket", "name", "n_docs", "n_ids"])
        for b in batches:
            for k, *row in zip(*(b.column(c).to_pylist() for c in ("bucket", "doc_ids", "counts", "ids")), strict=True):
                if k != now and rows:
                    yield done(save(now, rows))
                    rows = []
                now = k
                rows.append(row)
        if rows:
            yield done(save(now, rows))

    placed = chunks.filter("bucket <> -2").repartition("bucket").sortWithinPartitions("bucket")
    return home, scratch.written(placed.mapInArrow(each, "bucket long, name string, n_docs long, n_ids long"), "token-manifest")


def read_blocks(uri: str, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """(doc_ids, counts, blocks of ids) of a file; the doc_ids are masked where there are none."""
    raw = files.read_range(uri, 0)
    if raw[:8] not in (MAGIC, NO_IDS):
        raise ValueError(f"not a token file: {uri}")
    n, blocks = struct.unpack_from("<QQ", raw, 8)
    doc_ids, counts = np.ma.array(np.frombuffer(raw, "<i8", n, 24), mask=raw[:8] == NO_IDS), np.frombuffer(raw, "<i8", n, 24 + 8 * n)

    def each():
        at = 24 + 16 * n
        for _ in range(blocks):
            size, length = struct.unpack_from("<QQ", raw, at)
            middle = at + 16 + -(-size // 4)
            yield ranks[unpack(raw[at + 16 : middle], raw[middle : middle + length], size)]
            at = middle + length

    return doc_ids, counts, each()


def read_files(home: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian unsigned 32-bit) of every document in the files."""
    return _read(home, manifest, "ids", "binary", lambda ids: ids)


def read_digests(home: str, manifest: DataFrame) -> DataFrame:
    """As read_files, with ids_crc32 (unsigned) in the place of the ids."""
    return _read(home, manifest, "ids_crc32", "long", zlib.crc32)


def _read(home: str, manifest: DataFrame, name: str, kind: str, of) -> DataFrame:
    before = F.sum("n_ids").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    placed = manifest.select("name", F.coalesce(before, F.lit(0)).alias("base"))

    def each(batches):
        ranks = np.frombuffer(files.read_range(f"{home}/ranks", 0), "<u4")
        for b in batches:
            for file, base in zip(b.column("name").to_pylist(), b.column("base").to_pylist(), strict=True):
                doc_ids, counts, blocks = read_blocks(f"{home}/{file}", ranks)
                left, out = b"", []
                wanted = iter((4 * counts).tolist())
                need = next(wanted, None)
                for block in blocks:
                    left += block.tobytes()
                    at = 0
                    while need is not None and len(left) - at >= need:
                        out.append(of(left[at : at + need]))
                        at += need
                        need = next(wanted, None)
                    left = left[at:]
                starts = base + np.cumsum(counts) - counts
                for at in range(0, len(out), 500):
                    cut = slice(at, at + 500)
                    values = pa.array(out[cut], pa.binary() if kind == "binary" else pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[cut]), pa.array(starts[cut]), pa.array(counts[cut]), values], ["doc_id", "start", "n_tokens", name])

    spread = max(1, min(10_000, manifest.count()))
    return placed.repartition(spread, "name").mapInArrow(each, f"doc_id long, start long, n_tokens long, {name} {kind}")


def round_trip(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """doc_id, start, n_tokens (with the end id) and ids_crc32 of each document, from files written for `docs` and read back.

    Null is the empty text, whose only id is the end id. Repeated rows keep a place each, rows of one doc_id stand side by
    side; those with a null doc_id stand before all others and come back with it. An empty table gives no file and no row. Other columns are ignored.
    Ids are whole numbers.
    """
    return read_digests(*write_files(docs, path, end_id))
