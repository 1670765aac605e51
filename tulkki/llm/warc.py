"""WARC archives with an embedded Zstandard dictionary.

Each archive is a ``.warc.zst`` stream: a skippable frame that holds the
dictionary, then every record compressed on its own with it.  The dictionary
is built from the first records that go into that archive, up to a bounded
number of bytes.  Spark's text writer puts the streams down, so any file
system Spark knows will do and lost tasks are redone by its commit protocol:
a row is one frame, and the line separator is itself an empty skippable
frame, which readers of the format pass over.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tulkki.llm.store import new_path

# Frame magics of the Zstandard format and the WARC profile URI.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGIC = 0x184D2A50
ZSTD_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An empty skippable frame; all its bytes are ASCII.
SEPARATOR = struct.pack("<II", SKIPPABLE_MAGIC, 0).decode("ascii")
NAMESPACE = uuid.UUID("6f0f3f2e-6d0c-4a2e-9c55-0d6f8f1f2a10")
RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, record_id string, payload binary")


def _record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}/{copy}')}>"


def _record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, copy: int, date: str) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http + payload if kind == "response" else http
    target = " ".join(url.split()) if url else "urn:page:unknown"
    head = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page_id, digest, copy)), ("WARC-Date", date),
            ("WARC-Target-URI", target), ("Content-Type", "application/http;msgtype=response"),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload)), ("Content-Length", len(block))]
    if page_id is not None:
        head.append(("X-Page-Id", page_id))
    if url is None:
        head.append(("X-No-Url", 1))
    if kind == "revisit":
        head.append(("WARC-Profile", REVISIT_PROFILE))
        head.append(("WARC-Refers-To", _record_id(refers_to, digest, 0)))
        if refers_to is not None:
            head.append(("X-Refers-To-Page-Id", refers_to))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _frames(dictionary_bytes: int, sample_bytes: int, level: int, date: str):
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        copies: dict = {}  # rows repeated with their page_id; such rows share a partition
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "html", "revisit", "refers_to")]
            for page_id, url, html, revisit, refers_to in zip(*(c.to_pylist() for c in cols), strict=True):
                payload = (html or "").encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                copy = copies[page_id, digest] = copies.get((page_id, digest), -1) + 1
                again = revisit or copy > 0
                yield _record(page_id, url, payload, digest, "revisit" if again else "response",
                              refers_to if revisit else page_id, copy, date)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = records(batches)
        first, size = [], 0
        for record in source:
            first.append(record)
            size += len(record)
            if size >= sample_bytes:
                break
        if not first:
            return
        try:
            trained = zstandard.train_dictionary(dictionary_bytes, [x[:1 << 17] for x in first]).as_bytes()
        except zstandard.ZstdError:  # too few or too small records to train on: their text serves as a raw dictionary
            trained = b"".join(first)[:dictionary_bytes]
        compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True)
        frames = itertools.chain([struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained],
                                 map(compressor.compress, itertools.chain(first, source)))
        while part := list(itertools.islice(frames, 256)):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary())], names=["frame"])
    return task


def write_archives(pages: DataFrame, path: str, archive_bytes: int = 64 << 20, dictionary_bytes: int = 64 << 10,
                   sample_bytes: int = 4 << 20, level: int = 9, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a WARC record for each row of ``pages`` (page_id, url, html).

    Of rows with equal payloads, one with the largest page_id is a response
    and the others revisit it; a null page_id counts as the smallest.  A null
    html is an empty payload, a null url gets a URN.  Rows repeated with
    their page_id keep a record each: the first is the response, the others
    revisit it.  ``archive_bytes`` is the payload aimed at for each archive.
    An empty table gives no record.
    """
    pages = pages.select("page_id", "url", "html")
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    archives = int(total // archive_bytes) + 1
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    ids = pages.select("page_id", digest.alias("digest"))
    latest = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    revisits = (ids.join(latest, "digest").where("NOT page_id <=> refers_to").distinct()
                .select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to", F.lit(True).alias("revisit")))
    # whether or not page_id is null, all copies of a row meet in one archive
    key = F.xxhash64("page_id", "digest")
    placed = (pages.withColumn("digest", digest).repartition(archives, key)
              .join(revisits.repartition(archives, F.xxhash64("r_page", "r_digest")).hint("shuffle_hash"),
                    (key == F.xxhash64("r_page", "r_digest")) & F.col("page_id").eqNullSafe(F.col("r_page")), "left")
              .select("page_id", "url", "html", F.coalesce("revisit", F.lit(False)).alias("revisit"), "refers_to"))
    (placed.mapInArrow(_frames(dictionary_bytes, sample_bytes, level, date), "frame binary")
     .select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", SEPARATOR).text(path))


def split_frames(data: bytes | memoryview) -> Iterator[bytes]:
    """The records of one archive, decompressed with the dictionary in its first frame."""
    data, at, reader, step = memoryview(data), 0, None, 1 << 16
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
            if magic == DICTIONARY_MAGIC:
                raw = bytes(data[at + 8:at + 8 + size])
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
            continue
        if magic != ZSTD_MAGIC:
            raise ValueError(f"no Zstandard frame at byte {at}")
        frame, parts = (reader or zstandard.ZstdDecompressor()).decompressobj(), []
        while not frame.eof:
            piece = data[at:at + step]
            if not piece:
                raise ValueError("the archive ends inside a frame")
            parts.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        yield b"".join(parts)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RECORDS.split(", ")]
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for record in split_frames(content.as_buffer()):
                head, _, rest = record.partition(b"\r\n\r\n")
                field = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                block = rest[:int(field["Content-Length"])]
                payload = block.partition(b"\r\n\r\n")[2] if field["WARC-Type"] == "response" else None
                digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
                if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"payload and digest differ in {field['WARC-Record-ID']}")
                number = lambda k, f=field: int(f[k]) if k in f else None
                rows.append((number("X-Page-Id"), None if "X-No-Url" in field else field["WARC-Target-URI"],
                             int(field["X-Payload-Length"]) if payload is None else len(payload), digest, field["WARC-Type"],
                             number("X-Refers-To-Page-Id"), field["WARC-Record-ID"], payload))
                if len(rows) == 256:
                    yield _batch(rows, names)
                    rows = []
            if rows:
                yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in a folder; revisits have no payload."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parsed, RECORDS)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
bits AS (
  SELECT hex, list_transform(range(20), lambda i: CAST('0x' || substr(hex, 2 * i + 1, 2) AS INT)) || [0] AS b
  FROM (SELECT DISTINCT hex FROM d)),
digests AS (
  SELECT hex, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((b[5 * i // 8 + 1] * 256 + b[5 * i // 8 + 2]) >> CAST(11 - 5 * i % 8 AS INT)) & 31), 1)), '') AS payload_digest FROM bits)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM d JOIN digests USING (hex)
"""
