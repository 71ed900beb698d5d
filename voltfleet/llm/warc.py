"""WARC archives with segmented records: writing, reading, and putting segments together.

A response record holds an HTTP message with its payload in chunked transfer framing. A block
longer than a segment is cut, as WARC has it: the first part stays in the response record
with segment number 1, the others go to continuation records which name the first one's
record as their origin, and the last tells the total length. Reading groups segments by
origin, orders them by number, checks the total and undoes the framing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltfleet.session import working_dir

from .common import small_batches, staged

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
RECORDS_PER_FILE = 8192  # so that a file is 128 MB at most before compression
_END = "\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"  # the table has no time of capture
_SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

_RECORD = pa.schema(
    [
        ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
        ("payload_digest", pa.string()), ("refers_to", pa.string()), ("copies", pa.int64()),
        ("origin_id", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary()),
    ]
)
_RECORD_DDL = (
    "record_id string, record_type string, target_uri string, payload_digest string, "
    "refers_to string, copies long, origin_id string, segment long, total long, block binary"
)
_FOUND = pa.struct([("state", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
_OPENED = _RECORD.append(pa.field("found", _FOUND))
_FOUND_DDL = "struct<state: string, payload_bytes: long, payload_digest: string>"
_OPENED_DDL = f"{_RECORD_DDL}, found {_FOUND_DDL}"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are passed over.

    Raises ValueError where the framing is broken or ends too early.
    """
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        parts.append(body[at : at + size])
        at += size + 2


def _record(kind: str, record_id: str, block: bytes, fields: dict[str, str | None]) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {_DATE}",
        *(f"{k}: {v}" for k, v in fields.items() if v is not None),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + _END.encode() + block


def capture_records(capture: dict, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one capture, without the blank lines that end each."""
    url = capture["url"]
    told = {
        "WARC-Target-URI": None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": f"sha1:{base64.b32encode(bytes.fromhex(capture['digest'])).decode()}",
        "WARC-Copies": str(capture["copies"]),
    }
    name = capture["record_id"]
    if capture["refers_to"] is not None:
        told |= {"WARC-Refers-To": f"<{capture['refers_to']}>", "WARC-Profile": _SAME}
        yield _record("revisit", name, _HTTP.split(b"Transfer")[0] + b"\r\n", told)
        return
    block = _HTTP + chunked(capture["payload"])
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        yield _record("response", name, block, told)
        return
    yield _record("response", name, parts[0], told | {"WARC-Segment-Number": "1"})
    for number, part in enumerate(parts[1:], 2):
        fields = {"WARC-Segment-Number": str(number), "WARC-Segment-Origin-ID": f"<{name}>"}
        if number == len(parts):
            fields["WARC-Segment-Total-Length"] = str(len(block))
        yield _record("continuation", f"{name}:{number}", part, fields)


def captures(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """``page_id, url, digest, copies, record_id, refers_to, payload`` of each different
    (page, payload); the payload is there where the record is a response.

    Of equal payloads of at least ``min_payload`` bytes the one with the smallest
    ``page_id`` is the response (null is larger than any other). Digests and ids
    settle that before a payload moves, so a copy never does.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    given = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.sha1(payload).alias("digest"), payload.alias("payload")
    )

    def name_of(page: str) -> Column:
        return F.concat_ws(":", F.lit("urn:page"), F.coalesce(F.col(page).cast("string"), F.lit("null")), "digest")

    light = given.groupBy("digest", "page_id").agg(
        F.count("*").alias("copies"), F.min("url").alias("url"), F.first(F.length("payload")).alias("bytes")
    )
    light = staged(light, "warc-pages")  # read twice below, without hashing the payloads again
    first = light.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    told = light.join(first, "digest").select(
        "page_id", "url", "digest", "copies", name_of("page_id").alias("record_id"),
        F.when(~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("bytes") >= min_payload), name_of("first_id")).alias("refers_to"),
    )
    responses = told.where("refers_to is null")
    texts = given.select(name_of("page_id").alias("record_id"), "payload")
    full = texts.join(responses, "record_id").dropDuplicates(["record_id"])
    bare = told.where("refers_to is not null").withColumn("payload", F.lit(None).cast("binary"))
    return full.select(bare.columns).union(bare)


def write_archives(found: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write captures as compressed WARC files."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            records = [r for c in batch.to_pylist() for r in capture_records(c, segment_bytes)]
            yield pa.record_batch([pa.array(records, pa.binary())], names=["record"])

    records = found.mapInArrow(each, "record binary").select(F.col("record").cast("string"))
    (
        records.write.option("lineSep", _END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


def parse_records(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of one archive, by their content lengths."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        bare = {k: v.strip("<>") for k, v in head.items()}
        yield {
            "record_id": bare["warc-record-id"],
            "record_type": head["warc-type"],
            "target_uri": bare.get("warc-target-uri"),
            "payload_digest": head.get("warc-payload-digest"),
            "refers_to": bare.get("warc-refers-to"),
            "copies": int(head.get("warc-copies", 1)),
            "origin_id": bare.get("warc-segment-origin-id", bare["warc-record-id"]),
            "segment": int(head["warc-segment-number"]) if "warc-segment-number" in head else None,
            "total": int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None,
            "block": stream.read(int(head["content-length"])),
        }


def read_archives(spark: SparkSession, path: str, opened: bool = False) -> DataFrame:
    """The records of all archives in a folder, one row per segment.

    If ``opened``, responses that are whole are looked into where they are read: their
    ``found`` is the state, length and digest of the payload, and the block is null.
    """
    schema = _OPENED if opened else _RECORD

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for record in parse_records(gzip.open(pa.BufferReader(content.as_buffer()))):
                    size += len(record["block"])
                    if opened:
                        _open(record)
                    rows.append(record)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(each, _OPENED_DDL if opened else _RECORD_DDL)


def _open(record: dict) -> None:
    if record["segment"] is None:
        whole = record["record_type"] == "response"
        record["found"] = _told(*_decoded([record], record["payload_digest"])) if whole else None
        record["block"] = None


def _decoded(parts: list[dict], digest: str | None) -> tuple[str, bytes | None, str | None]:
    """What became of a record's segments, given in order, its payload and that one's digest."""
    if any(p["segment"] not in (None, i) for i, p in enumerate(parts, 1)):
        return "missing segment", None, None
    if parts[0]["segment"] is not None and parts[-1]["total"] is None:
        return "missing segment", None, None
    block = b"".join([p["block"] for p in parts])
    if parts[-1]["total"] not in (None, len(block)):
        return "wrong length", None, None
    head, _, body = block.partition(b"\r\n\r\n")
    try:
        payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError:
        return "broken framing", None, None
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return ("complete" if digest in (None, f"sha1:{found}") else "wrong digest"), payload, found


def _told(state: str, payload: bytes | None, digest: str | None) -> dict:
    return {"state": state, "payload_bytes": None if payload is None else len(payload), "payload_digest": digest}


def reassemble(records: DataFrame, carry: bool = True) -> DataFrame:
    """``record_id, target_uri, copies, state, payload_bytes, payload_digest, payload`` of each
    response.

    Records that are whole need no shuffle; segments meet by origin, as many as one
    record has. ``state`` is ``complete``, ``missing segment``, ``wrong length``,
    ``broken framing`` or ``wrong digest``; a segment given twice counts once. Without
    ``carry`` the payload is null.

    Records that were read ``opened`` give their revisits as well, with ``record_type`` and
    ``refers_to`` as further columns, and no payload of whole ones. All of them go through
    the shuffle, without blocks unless they are segments, so that the archives are read
    once; those of one id become one.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = []
            for row in batch.to_pylist():
                told, payload = row["found"], None
                if told is None and row["record_type"] != "revisit":
                    state, payload, digest = _decoded(row["parts"], row["payload_digest"])
                    told = _told(state, payload, digest)
                out.append(
                    {
                        "record_id": row["record_id"], "target_uri": row["target_uri"],
                        "copies": row["copies"], **(told or {}),
                        "payload": payload if carry else None,
                        "record_type": row["record_type"], "refers_to": row["refers_to"],
                    }
                )
            yield pa.RecordBatch.from_pylist(out, _PAYLOAD)

    part = F.struct("segment", "total", "block")
    opened = "found" in records.columns
    head = ("record_type", "refers_to", "target_uri", "copies", "payload_digest", "found")
    first = F.coalesce(F.col("segment"), F.lit(1)) == 1

    def together(some: DataFrame) -> DataFrame:
        return some.groupBy(F.col("origin_id").alias("record_id")).agg(
            *(F.max(F.when(first, F.col(name))).alias(name) for name in head),
            F.sort_array(F.collect_set(F.when(F.col("segment").isNotNull(), part))).alias("parts"),
        )

    if opened:
        known = records.where("segment is not null or record_type in ('response', 'revisit')")
        return together(known).mapInArrow(each, _PAYLOAD_DDL)
    records = records.withColumn("found", F.lit(None).cast(_FOUND_DDL))
    # A segment holds part of a payload, whatever its record is called.
    cut = together(records.where("segment is not null").withColumn("record_type", F.lit("response")))
    whole = records.where("record_type = 'response' and segment is null").select(
        "record_id", *head, F.array(part).alias("parts")
    )
    return whole.union(cut).mapInArrow(each, _PAYLOAD_DDL).drop("record_type", "refers_to")


_PAYLOAD = pa.schema(
    [
        ("record_id", pa.string()), ("target_uri", pa.string()), ("copies", pa.int64()), ("state", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
        ("record_type", pa.string()), ("refers_to", pa.string()),
    ]
)
_PAYLOAD_DDL = (
    "record_id string, target_uri string, copies long, state string, payload_bytes long, "
    "payload_digest string, payload binary, record_type string, refers_to string"
)


def page_of(record_id: Column) -> Column:
    return F.element_at(F.split(record_id, ":"), 3).try_cast("long")


def archive_round_trip(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, min_payload: int = 0) -> DataFrame:
    """Pages written to archives and read back:
    ``page_id, payload_bytes, payload_digest, record_type, refers_to, state``.

    Null html is an empty payload, a null url is left out. Equal rows are written once
    with their number: the first is the response, the others revisit it. An empty table
    gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    path = working_dir(spark, "warc")
    write_archives(captures(pages, min_payload), path, segment_bytes)
    # Written, as it is needed twice: else each use would read the archives anew.
    read = reassemble(read_archives(spark, path, opened=True), carry=False).drop("payload", "target_uri")
    read = staged(read, "warc-payloads")
    payloads = read.where("record_type is distinct from 'revisit'").drop("record_type", "refers_to")
    revisits = read.where("record_type = 'revisit'").select(
        F.col("record_id").alias("own"), F.col("refers_to").alias("other"), F.col("copies").alias("times")
    )
    again = revisits.join(payloads, F.col("other") == F.col("record_id")).select(
        page_of(F.col("own")).alias("page_id"), "payload_bytes", "payload_digest",
        F.lit("revisit").alias("record_type"), page_of(F.col("other")).alias("refers_to"),
        "state", F.col("times").alias("copies"), F.lit(1).alias("copy"),
    )
    again = again.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    page, repeat = page_of(F.col("record_id")), (F.col("copy") > 1) & (F.col("payload_bytes") >= min_payload)
    own = payloads.withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    ).select(
        page.alias("page_id"), "payload_bytes", "payload_digest",
        F.when(repeat, "revisit").otherwise("response").alias("record_type"),
        F.when(repeat, page).alias("refers_to"), "state", "copies", "copy",
    )
    return own.union(again).drop("copies", "copy")
