"""WARC archives with a two-level capture index (operator 9).

Writing: each row becomes one WARC record, a gzip member of its own. Of records
with equal payloads the one with the smallest page_id is the response, the others
are revisits that refer to it and carry no payload. Spark's text writer commits
the files; an empty gzip member, which readers skip, serves as its separator, so
the files are plain concatenations of gzip members.

Index: the archives are read once, as streams that hold one record at a time; their captures are range-partitioned by
reversed-host URL key (com,example)/path, cut into compressed blocks of sorted
lines, and a sparse directory keeps the first key of each block.

Reading: keys are matched to blocks by binary search in the directory, to lines
by binary search in the block, and the lines' byte ranges are read from the
archives. A directory beyond ``DIRECTORY`` entries is joined by range pieces
instead of being handed to the tasks.

Defined results: null html counts as an empty payload, a null url as an empty
one; rows whose page_id and payload repeat are all responses; rows with a null
page_id are dropped. Line breaks and tabs of a url are percent-encoded before
anything else, in the record as in the key, and urls that differ in nothing else
share a key; each row is found by its own. Payloads of any length are written and
read whole, as long as one fits a task; an empty table gives an empty archive, index
and result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import urlsplit

import pandas as pd
from pyarrow import NativeFile, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, saved, scratch_path

#: Payload bytes from which on equal payloads are written once.
LEAST = 0
#: Lines of a block; records of an archive file, at most; directory entries handed to tasks.
LINES, RECORDS, DIRECTORY = 1_000, 32_768, 100_000
LEVEL = 4
EMPTY_MEMBER = gzip.compress(b"", 9, mtime=0)
CRLF = b"\r\n"


def escaped(url: str | None) -> str:
    """The url as records and keys hold it: without line breaks and tabs."""
    return (url or "").replace("\r", "%0D").replace("\n", "%0A").replace("\t", "%09")


def surt(url: str | None) -> str:
    """Reversed-host key: lower-case host labels from the last to the first, port
    and user dropped, then path and query; the fragment goes."""
    url = escaped(url)
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return url
    if not host:
        return url
    labels = host.split(".")
    if labels[0] == "www" and len(labels) > 2:
        labels = labels[1:]
    return ",".join(reversed(labels)) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + kind.encode(),
        b"WARC-Record-ID: <urn:page:%d>" % page_id,
        b"WARC-Target-URI: " + escaped(url).encode(),
        b"WARC-Payload-Digest: sha1:" + digest(payload).encode(),
        b"X-Payload-Length: %d" % len(payload),
        b"Content-Type: text/html; charset=utf-8",
    ]
    body = payload
    if refers_to is not None:
        head += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        body = b""
    head.append(b"Content-Length: %d" % len(body))
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(CRLF.join(head) + CRLF + CRLF + body + CRLF + CRLF) + c.flush()


def parse(data: bytes) -> dict:
    """Headers (lower-case names) and body of one uncompressed record."""
    head, _, rest = data.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    out = {k.decode().lower(): v.decode() for k, _, v in (x.partition(b": ") for x in lines[1:])}
    return out | {"body": rest[: int(out["content-length"])]}


def page_of(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn else None


def write(pages: DataFrame, path: str) -> None:
    """Write an archive of ``pages`` (page_id, url, html) under ``path``."""
    rows = pages.where("page_id IS NOT NULL").select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    )
    # the payload's digest decides; once two are known to be equal, 64 bits of it tell a page's rows apart
    key = [F.sha1("payload").alias("k"), F.octet_length("payload").alias("size")]
    short = F.xxhash64("k").alias("h")
    first = saved(rows.select("page_id", *key).where(F.col("size") >= LEAST).groupBy("k", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "payloads")
    # of payloads that repeat, ids meet; the list of revisits is broadcast, and only
    # beyond its bound do the pages move to meet it
    again = rows.select("page_id", *key).join(first, ["k", "size"]).where("page_id != first").select("page_id", short, "first").distinct()
    marked = rows.withColumn("k", key[0]).withColumn("h", short).drop("k").join(bounded(saved(again, "revisits"), 24), ["page_id", "h"], "left")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"member": [record(i, u, bytes(p), None if pd.isna(r) else int(r)) for i, u, p, r in zip(b["page_id"], b["url"], b["payload"], b["first"], strict=True)]})

    members = marked.select("page_id", "url", "payload", "first").mapInPandas(build, "member binary")
    members.select(F.col("member").cast("string")).write.options(lineSep=EMPTY_MEMBER.decode("latin-1"), encoding="ISO-8859-1", maxRecordsPerFile=RECORDS).text(path)


def members(source: BinaryIO, step: int = 1 << 18) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member that is not empty; one at a time is held."""
    at, data = 0, b""
    while data or (data := source.read(step)):
        d, parts, size = zlib.decompressobj(31), [], 0
        while True:
            parts.append(d.decompress(data))
            size += len(data)
            if d.eof:
                break
            if not (data := source.read(step)):
                raise ValueError("truncated archive")
        data = d.unused_data
        size -= len(data)
        if content := b"".join(parts):
            yield at, size, content
        at += size


def opened(file: str) -> NativeFile:
    """A file where Spark's path names it (local, or a store that pyarrow reads)."""
    store, path = fs.FileSystem.from_uri(file.replace("file:/", "file:///", 1) if file.startswith("file:/") and not file.startswith("file://") else file)
    return store.open_input_file(path)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The captures of an archive: key, url, file, offset, length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["key", "url", "file", "offset", "length"]
        for batch in batches:
            for file in batch["path"]:
                out = []
                with opened(file) as source:
                    for o, n, c in members(source):
                        url = parse(c)["warc-target-uri"]
                        out.append((surt(url), url, file, o, n))
                        if len(out) == LINES:
                            yield pd.DataFrame(out, columns=columns)
                            out = []
                if out:
                    yield pd.DataFrame(out, columns=columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path")
    return files.mapInPandas(run, "key string, url string, file string, offset long, length long")


def index(captures: DataFrame, lines: int = LINES) -> DataFrame:
    """Blocks (shard, block, first_key, last_key, lines, data): sorted by key over
    the whole index, each the gzip of up to ``lines`` sorted lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def block(k: int, rows: list[tuple]) -> tuple:
            text = "\n".join("\t".join((key, str(o), str(n), file)) for key, o, n, file in rows)
            return k, rows[0][0], rows[-1][0], len(rows), gzip.compress(text.encode(), LEVEL, mtime=0)

        held: list[tuple] = []
        k = 0
        for batch in batches:
            held += batch[["key", "offset", "length", "file"]].itertuples(index=False, name=None)
            full = [held[i : i + lines] for i in range(0, len(held) - lines + 1, lines)]
            held = held[len(full) * lines :]
            if full:
                yield pd.DataFrame([block(k + i, r) for i, r in enumerate(full)], columns=["block", "first_key", "last_key", "lines", "data"])
                k += len(full)
        if held:
            yield pd.DataFrame([block(k, held)], columns=["block", "first_key", "last_key", "lines", "data"])

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # offset takes part in the range, so that a hot key is dealt to several shards
    dealt = captures.repartitionByRange(n, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    out = dealt.mapInPandas(run, "block int, first_key string, last_key string, lines int, data binary")
    return out.withColumn("shard", F.spark_partition_id())


def candidates(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(shard, block, key) for each wanted key and each block that may hold it:
    binary search in the sparse directory."""
    sparse = blocks.select("first_key", "last_key", "shard", "block")
    n = sparse.count()
    if n <= DIRECTORY:
        rows = sorted(tuple(r) for r in sparse.collect())
        shared = wanted.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = shared.value
            firsts, lasts = [r[0] for r in rows], [r[1] for r in rows]
            for batch in batches:
                out = [(rows[j][2], rows[j][3], key) for key in batch["key"] for j in range(bisect_left(lasts, key), bisect_right(firsts, key))]
                yield pd.DataFrame(out, columns=["shard", "block", "key"])

        return wanted.mapInPandas(run, "shard int, block int, key string")
    # many blocks: those of one shard follow each other, so shards are searched first, then their blocks
    shards = sparse.groupBy("shard").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi"))
    at = wanted.join(F.broadcast(shards), F.col("key").between(F.col("lo"), F.col("hi"))).select("shard", "key")
    return at.join(sparse, "shard").where(F.col("key").between(F.col("first_key"), F.col("last_key"))).select("shard", "block", "key")


def locate(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, file, offset, length) of every capture of the wanted keys."""
    found = candidates(blocks, wanted.select("key").distinct())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, keys, lines = None, [], []
        for batch in batches:
            out = []
            for shard, block, key, data in zip(batch["shard"], batch["block"], batch["key"], batch["data"], strict=True):
                if (shard, block) != at:
                    at = shard, block
                    lines = [x.split("\t") for x in gzip.decompress(data).decode().split("\n")]
                    keys = [x[0] for x in lines]
                out += [(key, x[3], int(x[1]), int(x[2])) for x in lines[bisect_left(keys, key) : bisect_right(keys, key)]]
            yield pd.DataFrame(out, columns=["key", "file", "offset", "length"])

    joined = found.join(blocks.select("shard", "block", "data"), ["shard", "block"])
    return joined.select("shard", "block", "key", "data").mapInPandas(run, "key string, file string, offset long, length long")


def fetch(places: DataFrame) -> DataFrame:
    """Range reads: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest and payload (null for revisits) of each (file, offset, length)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, source = None, None
        for batch in batches:
            out = []
            for file, offset, length in zip(batch["file"], batch["offset"], batch["length"], strict=True):
                if file != name:
                    name, source = file, opened(file)
                h = parse(zlib.decompress(source.read_at(length, offset), 31))
                revisit = h["warc-type"] == "revisit"
                payload = None if revisit else h["body"]
                said = h["warc-payload-digest"].partition(":")[2]
                if payload is not None and digest(payload) != said:
                    raise ValueError(f"digest of {h['warc-record-id']} does not match its payload")
                out.append((page_of(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], page_of(h.get("warc-refers-to")), int(h["x-payload-length"]), said, payload))
            yield pd.DataFrame(out, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]).astype({"refers_to": "Int64"})

    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # neighbouring records of a file are read by one task, in order
    near = places.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    return near.select("file", "offset", "length").mapInPandas(run, schema)


def lookup(blocks: DataFrame, urls: DataFrame) -> DataFrame:
    """Captures of the given urls (column url), read through the index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": [surt(u) for u in batch["url"]]})

    wanted = urls.select(F.coalesce("url", F.lit("")).alias("url")).distinct().mapInPandas(run, "key string")
    # written first: dealing by ranges reads its rows twice
    return fetch(saved(locate(blocks, wanted), "places"))


def archive(pages: DataFrame) -> tuple[str, DataFrame]:
    """Write an archive of ``pages`` and its index in the shared folder: (path, blocks)."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path)
    # the archives are read once, for narrow captures; dealing by ranges reads these twice
    return path, saved(index(saved(scan(spark, path), "captures")), "index")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages and read every capture back through the index."""
    _, blocks = archive(pages)
    return lookup(blocks, pages.where("page_id IS NOT NULL"))
