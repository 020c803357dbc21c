"""WARC archives: writing with revisit records, and reading by boundary chains.

Each record is one gzip member, as archives are commonly kept. A reader splits files into byte ranges; the task of a range
decompresses from every place that looks like a member's start and emits (offset, offset of what follows, record). Payloads can
hold such bytes too, so a candidate is a record only if it is reached from the file's start: pointer jumping over the offsets
(every round doubles the steps taken) keeps the reachable ones and rejects the rest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import scratch
from framewright.llm import files

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1.1\r\n"
REVISIT_BYTES = 1000
FILE_BYTES, RANGE = 16 << 20, 4 << 20
READ = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | str, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A record's bytes: HTTP response with the payload, or a revisit without it. A page without an id has a name of its own, `none:...`."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    uri = "".join(c if c.isprintable() and c != " " else "%%%02X" % ord(c) for c in url or "about:blank")
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>", f"X-Payload-Length: {len(payload)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """(headers by lower-case name, block) of a record's bytes, or None if they are none."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    if not size.isdigit() or rest[int(size) :] != b"\r\n\r\n":
        return None
    return fields, rest[: int(size)]


def member(uri: str, at: int, held: bytes, start: int) -> tuple[bytes, int] | None:
    """(content, offset of what follows) of the gzip member at `at`, from `held` (bytes from `start`) and further reads."""
    unpack, out, end = zlib.decompressobj(31), [], at
    part = held[at - start : at - start + READ]
    while part:
        try:
            out.append(unpack.decompress(part))
        except zlib.error:
            return None
        end += len(part) - len(unpack.unused_data)
        if unpack.eof:
            return b"".join(out), end
        if end - start < len(held):
            part = held[end - start : end - start + READ]
        else:
            part = files.read_range(uri, end, min(files.size(uri), end + READ))
    return None


def write(pages: DataFrame) -> tuple[str, DataFrame]:
    """Archive `pages` (page_id, url, html); (folder, manifest of name and bytes).

    Of equal payloads of at least REVISIT_BYTES bytes that with the largest page_id is written whole.
    """
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    digests = pages.select("page_id", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n")).filter(F.col("n") >= REVISIT_BYTES)
    first = digests.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("least"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("least", "c")
    revisits = digests.join(first, "digest").filter("page_id < keeper").select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "keeper").distinct()
    revisits = scratch.written(revisits, "warc-revisits")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    rows = rows.join(revisits, (F.col("page_id") == F.col("_p")) & (F.col("digest") == F.col("_d")), "left").select("page_id", "url", "html", "digest", "keeper")
    home = files.folder(scratch.new_path(spark, "warc"))

    def save(parts: list[bytes]) -> pa.RecordBatch:
        body = b"".join(parts)
        name = f"{hashlib.sha256(body).hexdigest()}.warc.gz"
        files.publish(f"{home}/{name}", lambda out: out.write(body))
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(body)], pa.int64())], ["name", "bytes"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, unnamed = [], 0, 0
        for b in batches:
            for p, url, text, digest, keeper in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "keeper")), strict=True):
                if p is None:
                    p = f"none:{TaskContext.get().partitionId()}:{unnamed}"
                    unnamed += 1
                parts.append(record(p, url, text.encode(), digest, keeper))
                size += len(parts[-1])
                if size >= FILE_BYTES:
                    yield save(parts)
                    parts, size = [], 0
        if parts:
            yield save(parts)

    return home, scratch.written(rows.mapInArrow(each, "name string, bytes long"), "warc-manifest")


def reachable(offsets: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Which of the ascending offsets are reached from offset 0, by pointer jumping."""
    n = len(offsets)
    jump = np.searchsorted(offsets, follows)
    jump = np.where((jump < n) & (offsets[np.minimum(jump, n - 1)] == follows), jump, n)
    jump = np.append(jump, n)
    found = np.zeros(n + 1, bool)
    found[:1] = n > 0 and offsets[0] == 0
    while True:
        more = found.copy()
        more[jump[found]] = True
        if (more[:n] == found[:n]).all() and (jump[:n][found[:n]] == n).all():
            return found[:n]
        found, jump = more, jump[jump]


def read(spark: SparkSession, home: str, manifest: DataFrame) -> DataFrame:
    """name, at, headers (map) and block of every record in the archives."""
    ranges = manifest.select("name", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("bytes") - 1), F.lit(RANGE).cast("long"))).alias("start"))
    spread = max(1, min(10_000, ranges.count()))

    def candidates(batches):
        for b in batches:
            for name, size, start in zip(*(b.column(c).to_pylist() for c in ("name", "bytes", "start")), strict=True):
                uri, stop = f"{home}/{name}", min(size, start + RANGE)
                held = files.read_range(uri, start, min(size, stop + 2))
                at = held.find(MAGIC)
                got, n = [], 0
                while 0 <= at < stop - start:
                    if (m := member(uri, start + at, held, start)) is not None and (r := parse(m[0])) is not None:
                        got.append((start + at, m[1], list(r[0].items()), r[1]))
                        n += len(m[0])
                    if n > 8 << 20:
                        yield batch(name, got)
                        got, n = [], 0
                    at = held.find(MAGIC, at + 1)
                if got:
                    yield batch(name, got)

    def batch(name, got):
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(got)), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.map_(pa.string(), pa.string())), pa.array([x[3] for x in got], pa.binary())],
            ["name", "at", "follows", "headers", "block"],
        )

    found = ranges.repartition(spread, "name", "start").mapInArrow(candidates, "name string, at long, follows long, headers map<string,string>, block binary")
    found = scratch.written(found, "warc-candidates")

    def chain(batches):
        now, held = None, []
        for b in batches:
            for name, at, follows in zip(*(b.column(c).to_pylist() for c in ("name", "at", "follows")), strict=True):
                if name != now and held:
                    yield kept(now, held)
                    held = []
                now = name
                held.append((at, follows))
        if held:
            yield kept(now, held)

    def kept(name, held):
        offsets, follows = np.array(held, np.int64).T
        good = offsets[reachable(offsets, follows)]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(good), pa.string()), pa.array(good)], ["name", "at"])

    # A task holds two numbers for each candidate of a file.
    links = found.select("name", "at", "follows").repartition("name").sortWithinPartitions("name", "at")
    good = links.mapInArrow(chain, "name string, at long")
    return found.join(good, ["name", "at"]).drop("follows")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record, read back from archives written for `pages`.

    Null html is the empty payload, a null url about:blank. Repeated rows of the response's page_id are all responses, those of
    other page_ids all revisits. Long payloads are read in parts. A row with a null page_id is a response under a record id of
    its own, and comes back with a null page_id. An empty table gives no file and no row. Other columns are ignored.
    """
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    found = read(spark, *write(pages))

    def each(batches):
        for b in batches:
            out = []
            for h, block in zip(b.column("headers").to_pylist(), b.column("block").to_pylist(), strict=True):
                h, body = dict(h), block.partition(b"\r\n\r\n")[2]
                whole = h["warc-type"] == "response"
                number = lambda name: None if ":none:" in h[name] else int(h[name].rsplit(":", 1)[1].rstrip(">"))
                out.append((number("warc-record-id"), len(body) if whole else int(h["x-payload-length"]), hashlib.sha1(body).hexdigest() if whole else h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], None if whole else number("warc-refers-to")))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    out = found.select("headers", "block").mapInArrow(each, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return out.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < keeper THEN keeper END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d
"""
