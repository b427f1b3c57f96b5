"""WARC archives: writing with deduplication and segmentation, and reading back.

Writing.  Each page becomes an HTTP response with chunked transfer framing.  A
block longer than ``segment_bytes`` is cut into a first record and continuation
records (identifier of the first, segment number, total length on the last one).  Of
pages with equal payloads of at least ``revisit_bytes`` the one with the largest
key is written in full and the others as revisit records that refer to it.
Archives are gzip files of Spark's own writer, one per partition, in any store
that Spark writes to.

Reading.  Files are cut at the version line of records, so that no file needs to
fit a task's memory.  Payloads can't forge that line: wherever a payload holds
``WARC/1.1`` a new chunk begins inside it.  Continuation records are grouped by
the identifier of their first record and put in order of their segment numbers, gaps and the
total length are verified, and chunked framing is decoded.

Defined cases: a null payload is an empty one; a null key leaves the key field
out and reads back as null.  Record identifiers follow from key, URI and digest,
so rows that repeat all three are one record written repeatedly, and stay as
many rows.  A record that is cut short or lacks a segment reads as
``complete`` = false with a null payload.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm.common import map_runs, runs, small_batches

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEGMENT_BYTES, CHUNK_BYTES, REVISIT_BYTES = 32_768, 4_096, 1_000
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

RECORD = (
    "record_id string, record_type string, uri string, record_key string, refers_to string, digest string, "
    "segment int, first_id string, total_length long, block binary, whole boolean"
)


def _slices(data: Column, size: int) -> Column:
    """A binary column as an array of slices of at most ``size`` bytes; none of an empty one."""
    n = F.octet_length(data)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(data, i + 1, F.lit(size)))


def _text(data: Column) -> Column:
    return data.cast("string")


def _framed(payload: Column, chunk_bytes: int) -> Column:
    """Chunked transfer framing of a string; a chunk begins inside every ``WARC/1.1``."""
    # The expression is only tried where there is something to cut.
    parts = F.when(F.contains(payload, F.lit(VERSION)), F.split(payload, "(?<=WARC)(?=/1\\.1)")).otherwise(F.array(payload))
    chunks = F.flatten(F.transform(parts, lambda p: _slices(p.cast("binary"), chunk_bytes)))
    framed = F.transform(chunks, lambda c: F.concat(F.hex(F.octet_length(c)), F.lit("\r\n"), _text(c), F.lit("\r\n")))
    return F.concat(F.array_join(framed, ""), F.lit("0\r\n\r\n"))


def _identifier(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p, F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _plain(value: Column) -> Column:
    """A value fit for a header line."""
    return F.replace(F.regexp_replace(value, "[\\x00-\\x20\\x7f]", "%20"), F.lit(VERSION), F.lit("WARC%2F1.1"))


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html",
    segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, revisit_bytes: int = REVISIT_BYTES,
) -> None:
    """Write one response or revisit per row, in segments where needed."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(key).alias("key"), _plain(F.col(uri)).alias("uri"), body.alias("body"), F.sha1(body).alias("digest"),
        F.octet_length(body).alias("n"),
    )
    rows = rows.withColumn("id", _identifier(F.col("key").cast("string"), F.col("uri"), F.col("digest")))
    sources = (
        rows.where(F.col("n") >= revisit_bytes).groupBy("digest")
        .agg(F.count("*").alias("_rows"), F.max(F.struct("key", "id"))["id"].alias("source"))
        .where("_rows > 1").select("digest", "source")
    )
    # Hashed, so that the payloads of the other side need no sort.
    rows = rows.join(sources.hint("shuffle_hash"), "digest", "left")
    revisit = F.col("source").isNotNull() & (F.col("source") != F.col("id"))
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(_framed(F.col("body"), chunk_bytes)))
    rows = rows.select(
        "key", "uri", "digest", "id", F.when(revisit, F.col("source")).alias("source"),
        block.cast("binary").alias("block"),
    )
    # One row per segment; a block of at most segment_bytes is a single one.
    pieces = rows.select(
        "key", "uri", "digest", "id", "source", F.octet_length("block").alias("total"),
        F.posexplode(_slices(F.col("block"), segment_bytes)).alias("at", "piece"),
    )
    parts = F.ceil(F.col("total") / F.lit(segment_bytes)).cast("int")
    first, several = F.col("at") == 0, parts > 1
    kind = F.when(~first, "continuation").when(F.col("source").isNotNull(), "revisit").otherwise("response")
    own = F.when(first, F.col("id")).otherwise(_identifier(F.col("id"), F.col("at").cast("string")))
    record = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _field("WARC-Type", kind), _field("WARC-Record-ID", own), _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", F.col("uri")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _field("WARC-Refers-To", F.when(first, F.col("source"))),
        _field("WARC-Profile", F.when(first & F.col("source").isNotNull(), F.lit(PROFILE))),
        _field("WARC-Segment-Number", F.when(several, (F.col("at") + 1).cast("string"))),
        _field("WARC-Segment-Origin-ID", F.when(~first, F.col("id"))),
        _field("WARC-Segment-Total-Length", F.when(several & (F.col("at") + 1 == parts), F.col("total").cast("string"))),
        _field("X-Record-Key", F.when(first, _plain(F.col("key").cast("string")))),
        _field("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))),
        _field("Content-Length", F.octet_length("piece").cast("string")),
        F.lit("\r\n"), _text(F.col("piece")),
    )
    pieces.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What stands between two version lines -> the fields of a record and its block."""
    for batch in batches:
        out = []
        for raw in batch["value"]:
            if not raw.strip():
                continue
            head, _, rest = raw.partition(b"\r\n\r\n")
            lines = (line.partition(b":") for line in head.split(b"\r\n"))
            fields = {name.strip().lower(): value.strip().decode() for name, _, value in lines}
            length = int(fields.get(b"content-length", -1))
            number, total = fields.get(b"warc-segment-number"), fields.get(b"warc-segment-total-length")
            out.append((
                fields.get(b"warc-record-id"), fields.get(b"warc-type"), fields.get(b"warc-target-uri"),
                fields.get(b"x-record-key"), fields.get(b"warc-refers-to"),
                (fields.get(b"warc-payload-digest") or "").removeprefix("sha1:"),
                int(number) if number else 0, fields.get(b"warc-segment-origin-id"), int(total) if total else -1,
                rest[:max(length, 0)], 0 <= length <= len(rest),
            ))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``, as they stand; columns of RECORD."""
    raw = spark.read.option("lineSep", f"{VERSION}\r\n").text(path).select(F.col("value").cast("binary").alias("value"))
    return map_runs(raw, _parsed, RECORD)


def reassembled(records: DataFrame) -> DataFrame:
    """Whole records: segments joined in order; complete is false where one is missing or the length is wrong."""
    alone = records.where("segment = 0").withColumn("complete", F.col("whole"))
    segments = records.where("segment > 0").withColumn("_first", F.coalesce("first_id", "record_id"))
    # Rows that repeat a segment are taken once; a record written n times stays n rows.
    once = segments.groupBy("_first", "segment").agg(
        F.count("*").alias("_rows"), F.first("block").alias("block"), F.min("whole").alias("whole"),
        F.max("total_length").alias("total_length"),
        *[F.first(c).alias(c) for c in ("record_type", "uri", "record_key", "refers_to", "digest")],
    )
    start = F.col("segment") == 1
    joined = once.groupBy("_first").agg(
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("segment", "block"))), lambda s: _text(s["block"])
        ), "").cast("binary").alias("block"),
        F.min("whole").alias("whole"), F.max("total_length").alias("total_length"),
        F.count("*").alias("_parts"), F.max("segment").alias("_last"),
        F.max(F.when(start, F.col("_rows"))).alias("_rows"),
        *[F.max(F.when(start, F.col(c))).alias(c) for c in ("record_type", "uri", "record_key", "refers_to", "digest")],
    )
    complete = F.col("whole") & (F.col("_parts") == F.col("_last")) & (F.octet_length("block") == F.col("total_length"))
    columns = ["record_id", "record_type", "uri", "record_key", "refers_to", "digest", "block", "complete"]
    joined = joined.withColumn("complete", complete).withColumn("record_id", F.col("_first"))
    joined = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.coalesce("_rows", F.lit(1)).cast("int"))))
    return alone.select(columns).unionByName(joined.select(columns))


def http_payload(block: bytes) -> bytes | None:
    """The payload of an HTTP message, chunked framing decoded; None if the framing is broken."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        return None
    if b"chunked" not in next((x.lower() for x in head.split(b"\r\n") if x.lower().startswith(b"transfer-encoding:")), b""):
        return body
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(body[at:line].partition(b";")[0], 16)
        except ValueError:
            return None
        at = line + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size:at + size + 2] != b"\r\n":
            return None
        parts.append(body[at:at + size])
        at += size + 2


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits: record_id, record_type, uri, record_key, refers_to, digest, payload, complete.

    A revisit has no payload of its own (null).
    """
    small_batches(spark)

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([http_payload(b or b"") for part in runs(batch) for b in part.to_pylist()], pa.binary())

    records = reassembled(read_records(spark, path))
    decoded = F.when(F.col("complete") & (F.col("record_type") == "response"), decode("block"))
    out = records.withColumn("payload", decoded).drop("block")
    return out.withColumn("complete", F.col("complete") & ((F.col("record_type") != "response") | F.col("payload").isNotNull()))
