"""WARC archives with revisit records, written and read through Spark.

Payload digests are shuffled without their payloads: for every digest the page
with the largest id becomes the original, and the small header rows are joined to
their original. The resolved headers then meet the payloads by page and digest,
so a payload that a third of all pages share doesn't gather in one task. Originals
are written as response records, others as revisit records without a payload that
name their original's record, address and date. Every record has fresh headers.
Payloads shorter than ``least_bytes`` are always responses.

A record is a gzip member of its own, as archive tools expect. A task closes an
archive when it reaches ``archive_bytes``, so an archive is as large as that or as
one record. Each is handed to Spark as one value and written to a file of its own
by the text writer, so any file system that Spark knows will do; the line end that
this writer puts behind a value is an empty gzip member, which holds nothing.
Reading inflates an archive in small blocks and goes by Content-Length, so payloads
may hold anything; digests are taken block by block, and a payload is held as a
whole only where it is asked for.

Defined results: a null payload is empty; a null url writes no target header, one
with line ends has them percent-encoded; pages without id are never originals while another has the
same payload, and are responses if none has; rows that repeat the original's id
are responses too. Column names of pages beside page_id, url and html are never
looked at. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import removed, saved, shared_dir

CRLF = "\r\n"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string"
#: Window size that makes zlib write and read gzip members.
_GZIP = 31
_NOTHING = zlib.compress(b"", wbits=_GZIP)


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string, eight groups of 20 bits."""
    hexed = F.sha1(text.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), _HEX32, _BASE32)


def _pages(pages: DataFrame) -> DataFrame:
    """id, url, payload and digest of every page."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.replace(F.replace(F.col("url").cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return pages.select(F.col("page_id").alias("id"), url.alias("url"), payload.alias("payload"), base32_sha1(payload).alias("digest"))


def resolved(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Distinct (page_id, payload_digest) with payload_bytes, and refers_to and its refers_url (null for responses)."""
    headers = _pages(pages).select(F.col("id").alias("page_id"), "url", F.col("digest").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    headers = saved(headers.groupBy("page_id", "payload_digest", "payload_bytes").agg(F.max("url").alias("url")))
    originals = headers.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("payload_digest").alias("__digest")).agg(F.max(F.struct("page_id", "url")).alias("__original"))
    joined = headers.join(originals, F.col("payload_digest") == F.col("__digest"), "left")
    original = F.col("__original")
    revisit = original["page_id"].isNotNull() & ~F.col("page_id").eqNullSafe(original["page_id"])
    return joined.select("page_id", "payload_digest", "payload_bytes", F.when(revisit, original["page_id"]).alias("refers_to"), F.when(revisit, original["url"]).alias("refers_url"))


def _record_id(page_id: Column, digest: Column) -> Column:
    """A name-based identifier in the layout of a UUID."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def records(pages: DataFrame, least_bytes: int = 0, date: str | None = None) -> DataFrame:
    """One WARC record per page as text, with the blank line that ends it. date is that of writing, the present if not given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    both = _pages(pages).join(resolved(pages, least_bytes), F.col("id").eqNullSafe(F.col("page_id")) & (F.col("digest") == F.col("payload_digest")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    if_any = lambda name, value: F.when(value.isNotNull(), line(name, value)).otherwise("")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    size = F.when(revisit, F.lit(0)).otherwise(F.octet_length(http) + F.col("payload_bytes"))
    return both.select(
        F.concat(
            F.lit(f"WARC/1.1{CRLF}"),
            line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            line("WARC-Record-ID", _record_id(F.col("id"), F.col("digest"))),
            line("WARC-Date", F.lit(date)),
            if_any("WARC-Target-URI", F.col("url")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            line("X-Payload-Bytes", F.col("payload_bytes").cast("string")),
            line("X-Page-ID", F.coalesce(F.col("id").cast("string"), F.lit(""))),
            F.when(revisit, F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("digest"))),
                if_any("WARC-Refers-To-Target-URI", F.col("refers_url")),
                line("WARC-Refers-To-Date", F.lit(date)),
                line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")))).otherwise(""),
            line("Content-Type", F.lit("application/http;msgtype=response")),
            line("Content-Length", size.cast("string")),
            F.lit(CRLF),
            F.when(revisit, "").otherwise(F.concat(http, F.col("payload"))),
            F.lit(CRLF * 2),
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = 16 << 20, level: int = 6) -> None:
    """Archives of about archive_bytes (compressed) below path, or of one record where that is larger."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            for value in b.column(0):
                held.append(zlib.compress(value.as_buffer(), level, _GZIP))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])

    archives = records(pages, least_bytes).mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
    # A string of any bytes; what ends a line is taken as one byte a character.
    lines = {"lineSep": _NOTHING.decode("latin-1"), "encoding": "ISO-8859-1", "compression": "none", "maxRecordsPerFile": 1}
    archives.write.options(**lines).mode("errorifexists").text(path)


def inflated(data: bytes | memoryview, fed: int = 1 << 15, block: int = 1 << 16) -> Iterator[bytes]:
    """The contents of gzip members in blocks of at most ``block`` bytes; takes ``fed`` bytes at a time, so no rest is ever copied as a whole."""
    view, at, d = memoryview(data), 0, None
    while at < len(view):
        part = view[at : at + fed]
        at += len(part)
        while part:
            d = d or zlib.decompressobj(_GZIP)
            yield d.decompress(part, block)
            while not d.eof and not d.unconsumed_tail and (more := d.decompress(b"", block)):
                yield more
            part, d = (d.unused_data, None) if d.eof else (d.unconsumed_tail, d)
    if d is not None:
        raise ValueError("the archive ends within a gzip member")


def parse(blocks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """(headers, parts of the block) of every record of an archive that comes in parts.

    The parts of a record must be taken before the next record is asked for; those
    left over are skipped. Held are one part and a record's headers.
    """
    source, held = iter(blocks), b""

    def taken(n: int, what: str) -> Iterator[bytes]:
        nonlocal held
        while n:
            if not held and (held := next(source, None)) is None:
                raise ValueError(f"the archive ends within {what}")
            part, held = held[:n], held[n:]
            n -= len(part)
            if part:
                yield part

    while True:
        head, looked = bytearray(held), 0
        held = b""
        while (end := head.find(b"\r\n\r\n", looked)) < 0:
            looked = max(0, len(head) - 3)
            if (more := next(source, None)) is None:
                if head:
                    raise ValueError("the archive ends within a record's headers")
                return
            head += more
        version, *lines = bytes(head[:end]).decode().split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        held = bytes(head[end + 4 :])
        named = dict(x.split(": ", 1) for x in lines)
        body = taken(int(named["Content-Length"]), "a record")
        yield named, body
        for _ in body:
            pass
        if b"".join(taken(4, "a record")) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")


def _payload(parts: Iterable[bytes]) -> Iterator[bytes]:
    """The parts of an HTTP response after its headers."""
    head, inside = b"", False
    for part in parts:
        if inside:
            yield part
            continue
        head += part
        if (end := head.find(b"\r\n\r\n")) >= 0:
            inside = True
            yield head[end + 4 :]


def _record(head: dict[str, str], parts: Iterator[bytes], payloads: bool) -> tuple:
    digest, kind, size, body = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], int(head["X-Payload-Bytes"]), None
    if kind == "response":
        sha, n, kept = hashlib.sha1(), 0, []
        for part in _payload(parts):
            sha.update(part)
            n += len(part)
            if payloads:
                kept.append(part)
        if (is_ := base64.b32encode(sha.digest()).decode()) != digest or n != size:
            raise ValueError(f"payload of {head['WARC-Record-ID']} has digest {is_}")
        body = b"".join(kept).decode() if payloads else None
    page, refers = head["X-Page-ID"], head.get("X-Refers-To-Page-ID")
    return (int(page) if page else None, head.get("WARC-Target-URI"), kind, size, digest, int(refers) if refers else None, body)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records below path. The digests of responses are taken from their payloads, and checked."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for head, parts in parse(inflated(content.as_buffer())):
                    rows.append(_record(head, parts, payloads))
                    size += len(rows[-1][-1] or "")
                    if size > 1 << 24 or len(rows) >= 10_000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return files.mapInArrow(run, RECORDS)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder, list what they hold and remove them."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least_bytes)
    listed = saved(read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    removed(spark, path)
    return listed
