"""WARC archives with segmented records and chunked transfer coding: writing, reading, reassembly.

Archives are written by Spark's own committer, a record a row, so that a lost executor leaves no half file; a file holds at most RECORDS
records of at most SEGMENT bytes of content, and so has a bounded size. Each record is a gzip member of its own, so that a reader can seek to it; an
empty member stands between two, since Spark's text writer puts something between rows (that writer also gives the files their names). Reading parses each
file once. Segments of a record may lie in different files: they are grouped by the identifier of their first record, ordered by segment
number, checked against the total length, joined, and their chunks are decoded. What is broken is a row with an error, and does not end the reading.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import delete, flag_among, id_bits, materialise, new_path, scratch

SEGMENT = 32 << 10  # content bytes of a record
CHUNK = 8 << 10  # bytes of a chunk of the transfer coding
RECORDS = 256  # records of a file
END = b"\r\n\r\n"
MEMBER = b"\x1f\x8b\x08"


def member(content: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


EMPTY = member(b"")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Payload of a body in chunked transfer coding, extensions and trailers ignored; a broken one is a ValueError."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("a chunk has no size")
        size = int(body[at:line].partition(b";")[0], 16)
        if size < 0:
            raise ValueError("a chunk has no size")
        if not size:
            return b"".join(out)
        at = line + 2
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, str]], content: bytes) -> bytes:
    """A record without the two line ends that close it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(content)))])
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + content


def records_of(page_id: int, url: str | None, payload: bytes, refers_to: int | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The record of a page and its continuations, or its revisit record; bytes without the closing line ends."""
    sha = digest(payload)
    name = f"<urn:page:{page_id}:{sha}>"
    fields = [("WARC-Record-ID", name), ("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "about:blank")), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Payload-Length: %d\r\nTransfer-Encoding: chunked\r\n\r\n" % len(payload)
    if refers_to is not None:
        more = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}:{sha}>")]
        yield record(more + fields, head)
        return
    content = head + chunked(payload)
    parts = [content[i : i + segment] for i in range(0, len(content), segment)]
    if len(parts) == 1:
        yield record([("WARC-Type", "response"), *fields], content)
        return
    for k, part in enumerate(parts, 1):
        if k == 1:
            yield record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", "1")], part)
        else:
            last = [("WARC-Segment-Total-Length", str(len(content)))] * (k == len(parts))
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{page_id}:{sha}:{k}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k)), *last], part)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, content) of a record with its closing line ends."""
    stop = data.find(END)
    if data[:5] != b"WARC/" or stop < 0:
        raise ValueError("not a record")
    lines = data[:stop].decode().split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    content = data[stop + 4 : stop + 4 + size]
    if size < 0 or len(content) < size:
        raise ValueError("a record is cut off")
    if data[stop + 4 + size :] != END:
        raise ValueError("a record does not end where it should")
    return fields, content


def members(data: bytes) -> Iterator[tuple[bytes, str | None]]:
    """(content, null) of each gzip member that is not empty, or (empty, error) for one that is broken, behind which reading goes on at the next member."""
    at = 0
    while at < len(data):
        reader = zlib.decompressobj(31)
        try:
            content = reader.decompress(data[at:])
            if not reader.eof:
                raise zlib.error("a member is cut off")
        except zlib.error as error:
            yield b"", f"{type(error).__name__}: {error}"
            at = data.find(MEMBER, at + 1)
            if at < 0:
                return
            continue
        if content:
            yield content, None
        at = len(data) - len(reader.unused_data)


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, records: int = RECORDS) -> None:
    """Writes pages(page_id, url, payload, refers_to) to compressed archives; refers_to is null for a response."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in zip(*batch.columns, strict=True):
                page, url, payload, refers = (x.as_py() for x in row)
                for r in records_of(page, url, payload or b"", refers, segment):
                    out.append(member(r + END))
                    size += len(out[-1])
                if size > 4 << 20:
                    yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])

    # A cast from binary keeps the bytes as they are, and the text writer writes them as they are.
    rows = pages.select("page_id", "url", "payload", "refers_to").mapInArrow(write, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", records).text(path)


_ID = re.compile(r"<urn:page:(-?\d+):([A-Z2-7]{32})>")


def _http(content: bytes) -> tuple[dict[bytes, bytes], bytes]:
    head, _, body = content.partition(END)
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}, body


def _finish(name: str, refers: str | None, declared: str, content: bytes) -> tuple:
    page, sha = _ID.fullmatch(name).groups()
    fields, body = _http(content)
    if refers is not None:
        return int(page), int(fields[b"x-payload-length"]), sha, "revisit", int(_ID.fullmatch(refers)[1])
    payload = unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
    if digest(payload) != sha or declared != f"sha1:{sha}":
        raise ValueError(f"the payload of {name} does not have its digest")
    return int(page), len(payload), sha, "response", None


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, error string"
_RESULT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("error", pa.string())])
_PARTS = "origin string, number long, total long, declared string, content binary"
_PARSED = pa.schema([*_RESULT, ("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("declared", pa.string()), ("content", pa.binary())])


def _failed(name: str | None, error: Exception | str) -> tuple:
    page = _ID.fullmatch(name or "")
    return int(page[1]) if page else None, None, None, None, None, error if isinstance(error, str) else f"{type(error).__name__}: {error}"


def _result(name: str | None, refers: str | None, declared: str | None, content: bytes) -> tuple:
    try:
        return *_finish(name, refers, declared, content), None
    except (ValueError, KeyError, AttributeError, TypeError) as error:
        return _failed(name, error)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _parsed(data: bytes) -> Iterator[tuple]:
    """Results of whole records, and segments, whose origin is not null."""
    for record_bytes, error in members(data):
        name = None
        try:
            if error is not None:
                raise ValueError(error)
            fields, content = parse(record_bytes)
            name = fields.get("warc-record-id")
            number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
            if number is not None:
                origin = fields.get("warc-segment-origin-id", name)
                if origin is None:
                    raise ValueError("a segment has no origin")
                yield (None,) * 6 + (origin, int(number), int(total) if total else None, fields.get("warc-payload-digest"), content)
            else:
                yield _result(name, fields.get("warc-refers-to"), fields.get("warc-payload-digest"), content) + (None,) * 5
        except (ValueError, KeyError) as problem:
            yield _failed(name, problem) + (None,) * 5


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, error of every record that is whole or has segments.

    error is null for a good record. A missing or repeated segment, a wrong total length, a broken chunk, a wrong digest, a record that is cut off and a broken
    member give one row each with the error, the page_id as far as it is known, and nulls. An empty folder gives an empty table.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield _rows(_PARSED, list(_parsed(x.as_py())))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, parts in zip(batch.column("origin").to_pylist(), batch.column("parts"), strict=True):
                parts = sorted(parts.as_py(), key=lambda p: p["number"])
                content = b"".join(p["content"] for p in parts)
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] is None:
                    rows.append(_failed(origin, "ValueError: a segment is missing or comes twice"))
                elif parts[-1]["total"] != len(content):
                    rows.append(_failed(origin, "ValueError: the segments do not have the total length"))
                else:
                    rows.append(_result(origin, None, parts[0]["declared"], content))
            yield _rows(_RESULT, rows)

    with scratch(spark) as keep:
        read = spark.read.format("binaryFile").load(path).select("content").mapInArrow(parsed, f"{RESULT}, {_PARTS}")
        # Archives are parsed once; of whole records only the result is written, of segments the content.
        read = materialise(read, "parsed")
        alone = read.where("origin is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
        parts = read.where("origin is not null").groupBy("origin").agg(F.collect_list(F.struct("number", "total", "declared", "content")).alias("parts"))
        out = materialise(alone.unionAll(parts.mapInArrow(joined, RESULT)), "records")
        keep.append(out)
    return out


def archive(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes pages(page_id, url, html, ...): of equal payloads of at least `least` bytes the one with the largest page_id is a response, others revisit it.

    A null html is empty. Rows without a page_id have no name in an archive and are left out; rows that repeat both page_id and html are one record; of
    one page_id with several payloads each is a record. A payload of any length is written, in segments, and is one row while it is read. An empty table
    gives an archive without records. Other columns are ignored.
    """
    with scratch(pages.sparkSession):
        _archive(pages, path, least)


def _archive(pages: DataFrame, path: str, least: int) -> None:
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("key", F.xxhash64("sha"))
    light = materialise(keyed.where(F.octet_length("payload") >= least).select("page_id", "sha", "key"), "digests")
    copies = materialise(light.groupBy("sha", "key").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "key", "first"), "copies")
    bits = id_bits(copies, "key")
    # Payloads that are surely unique are written where they are read; only those that may repeat are shuffled.
    flagged = flag_among(keyed, "key", bits, "maybe")
    some = materialise(flag_among(light, "key", bits, "maybe").where("maybe").select("page_id", "sha"), "maybe")
    decided = some.join(copies.select(F.col("sha").alias("s"), "first"), F.col("sha") == F.col("s")).select(F.col("page_id").alias("pid"), F.col("sha").alias("psha"), "first")
    decided = materialise(decided.distinct(), "decided")
    again = flagged.where("maybe").dropDuplicates(["page_id", "sha"]).join(decided, (F.col("page_id") == F.col("pid")) & (F.col("sha") == F.col("psha")), "left")
    refers = F.when(F.col("first") != F.col("page_id"), F.col("first"))
    again = again.select("page_id", "url", "payload", refers.alias("refers_to"))
    unique = flagged.where(~F.col("maybe")).select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to"))
    write_archives(unique.unionAll(again), path)


def op9_warc_segments(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    out = read_archives(spark, path)
    delete(spark, path)
    return out


OP9_SQL = """
with payloads as (select distinct page_id, coalesce(html, '') as payload from pages where page_id is not null),
named as (select page_id, strlen(payload) as n, sha1(payload) as hex, max(page_id) over (partition by payload) as first from payloads)
select page_id, n::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, (i // 4 * 5 + 1)::bigint, 5))::int >> (15 - i % 4 * 5)::int) & 31) + 1, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to, null::varchar as error
from named
"""
