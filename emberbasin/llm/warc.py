"""WARC archives: written by Spark's text writer, read back with segments put together.

A page becomes a response record that holds an HTTP message in chunked transfer framing, or a revisit of the
response with an equal payload. A message longer than ``segment`` code points is cut: the first part is the response with
segment number 1, each further part a continuation record that names its origin; the last also gives the total length.
Reading parses each archive, groups continuation records by their origin, orders them by segment number, verifies
that none is missing and that the total length holds, decodes the chunks, and compares the digest.

Archives of others are read too, gzipped or not: records without the fields of ours, other record types, digests in base32. A damaged
record doesn't end the job: it is a row that says what is wrong, and reading goes on at the next place where a record begins.

Null html is an empty payload. A null url leaves the target header out; line breaks in a url are dropped. Of repeated rows with one payload of
1000 bytes or more one is the response. A null page_id is written as an empty header and read as null; it is the response only if no row of its payload has an id.
An empty table gives an empty archive. ``pages`` has to come from files or a written table, whose scan always deals the same rows to a task.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberbasin.llm.common import stored

REVISIT_BYTES = 1000
#: Code points of a message in a record, and of a chunk in a message.
SEGMENT = 32_768
CHUNK = 8_192
#: Records in a file: with the limits above a file stays below 150 MB, and near 5 MB with usual pages.
FILE_RECORDS = 1_000
DATE = "2024-01-01T00:00:00Z"
EOL = "\r\n"

RECORD = (
    "page_id long, record_id string, record_type string, target_uri string, payload_digest string, refers_to string, "
    "origin_id string, segment int, total_length long, damage string, block binary"
)


def chunked(payload: Column, chunk: int) -> Column:
    """The payload as HTTP chunks of ``chunk`` code points; sizes are in bytes."""
    count = F.ceil(F.length(payload) / chunk).cast("int")
    parts = F.when(
        count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.substring(payload, i * chunk + 1, F.lit(chunk)))
    ).otherwise(F.array().cast("array<string>"))
    framed = F.transform(parts, lambda p: F.concat(F.lower(F.hex(F.octet_length(p))), F.lit(EOL), p, F.lit(EOL)))
    return F.concat(F.array_join(framed, ""), F.lit(f"0{EOL}{EOL}"))


def roles(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, row and, where the page revisits another, the row and page_id it refers to."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    raw = payload.cast("binary")
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.col("url").cast("string"), r"[\r\n]", "").alias("url"),
        payload.alias("payload"),
        F.octet_length(raw).alias("payload_bytes"),
        F.sha1(raw).alias("digest"),
        F.unhex(F.sha2(raw, 256)).alias("same"),
        F.monotonically_increasing_id().alias("row"),
    )
    # The largest id of each payload; rows are combined before the shuffle, so a hot payload is one row a task.
    first = (
        base.filter(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy("same")
        .agg(F.max(F.struct(F.col("page_id"), F.col("row"))).alias("first"))
    )
    other = (F.col("payload_bytes") >= REVISIT_BYTES) & (F.col("first.row") != F.col("row"))
    return base.join(first, "same", "left").select(
        "page_id", "url", "payload", "digest", "row",
        F.when(other, F.col("first.row")).alias("to_row"),
        F.when(other, F.col("first.page_id")).alias("to_page"),
    )


def record_id(page: Column, row: Column, part: Column | None = None) -> Column:
    ends = [F.lit("."), part.cast("string")] if part is not None else []
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), *ends, F.lit(">"))


def records(pages: DataFrame, segment: int = SEGMENT, chunk: int = CHUNK, date: str = DATE) -> DataFrame:
    """One text column ``value``, a record a row, without the two line breaks that end a record."""
    rows = roles(pages)
    is_revisit = F.col("to_row").isNotNull()
    head = f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}"
    message = F.when(is_revisit, F.lit(head + EOL)).otherwise(
        F.concat(F.lit(f"{head}Transfer-Encoding: chunked{EOL}{EOL}"), chunked(F.col("payload"), chunk))
    )
    count = F.greatest(F.lit(1), F.ceil(F.length("message") / segment)).cast("int")
    cut = rows.select("page_id", "url", "digest", "row", "to_row", "to_page", message.alias("message")).select(
        "*",
        count.alias("parts"),
        F.octet_length("message").alias("total"),
        F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring("message", i * segment + 1, F.lit(segment)))).alias("at", "block"),
    )
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    only = lambda when, value: F.when(when, value).otherwise(F.lit(""))
    first, whole = F.col("at") == 0, record_id(F.col("page_id"), F.col("row"))
    header = [
        F.lit(f"WARC/1.1{EOL}"),
        line("WARC-Type", F.when(~first, "continuation").when(is_revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.when(first, whole).otherwise(record_id(F.col("page_id"), F.col("row"), F.col("at")))),
        line("WARC-Date", F.lit(date)),
        only(F.col("url").isNotNull(), line("WARC-Target-URI", F.col("url"))),
        only(first, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))),
        only(first, line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit("")))),
        only(first & is_revisit, line("WARC-Refers-To", record_id(F.col("to_page"), F.col("to_row")))),
        only(first & is_revisit, F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{EOL}")),
        only(F.col("parts") > 1, line("WARC-Segment-Number", (F.col("at") + 1).cast("string"))),
        only(~first, line("WARC-Segment-Origin-ID", whole)),
        only(~first & (F.col("at") == F.col("parts") - 1), line("WARC-Segment-Total-Length", F.col("total").cast("string"))),
        F.lit(f"Content-Type: application/http;msgtype=response{EOL}"),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit(EOL),
        F.col("block"),
    ]
    safe = [F.coalesce(part, F.lit("")) for part in header]
    return cut.select(F.concat(*safe).alias("value"))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, chunk: int = CHUNK, date: str = DATE) -> None:
    """Gzipped archives of at most ``FILE_RECORDS`` records each below ``path``."""
    lines = records(pages, segment, chunk, date).write.option("lineSep", EOL + EOL).option("maxRecordsPerFile", FILE_RECORDS)
    lines.option("compression", "gzip").text(path)


# -- reading -----------------------------------------------------------------------------


def unzipped(data: bytes) -> tuple[bytes, str | None]:
    """The content of a gzip file of any number of members, such as one for each record; what can be read, and what is wrong with the rest."""
    if data[:2] != b"\x1f\x8b":
        return data, None
    parts = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            parts.append(member.decompress(data))
        except zlib.error as wrong:
            return b"".join(parts), f"gzip: {wrong}"
        if not member.eof:
            return b"".join(parts), "gzip: cut short"
        data = member.unused_data
    return b"".join(parts), None


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """The header fields (names in lower case), the block and the damage, if any, of each record of an archive."""
    data, wrong = unzipped(data)
    at = 0
    while at < len(data):
        fields, block, damage, after = one_record(data, at)
        yield fields, block, damage
        if damage is None:
            at = after
        else:
            found = data.find(b"\r\nWARC/", at + 1)
            at = found + 2 if found >= 0 else len(data)
        while data[at : at + 2] == b"\r\n":
            at += 2
    if wrong:
        yield {}, b"", wrong


def one_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, str | None, int]:
    """Fields, block and damage of the record at a place, and where it ends."""
    end = data.find(b"\r\n\r\n", at)
    if not data.startswith(b"WARC/", at):
        return {}, b"", f"no record at byte {at}", at
    if end < 0:
        return {}, b"", f"the header at byte {at} is cut short", at
    fields = {}
    for text in data[at:end].decode("utf-8", "replace").split(EOL)[1:]:
        name, _, value = text.partition(":")
        fields[name.strip().lower()] = value.strip()
    start, length = end + 4, fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return fields, b"", f"the record at byte {at} has no length", at
    stop = start + int(length)
    if stop > len(data):
        return fields, b"", f"the record at byte {at} is cut short", at
    if stop < len(data) and not data.startswith(b"\r\n", stop):
        return fields, b"", f"the record at byte {at} isn't as long as it says", at
    return fields, data[start:stop], None, stop


def whole_number(text: str | None, bits: int = 63) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() and int(text) < 1 << bits else None


def sha1_digest(text: str | None) -> str | None:
    """A SHA-1 digest field as lower-case hex, whether it is written in hex or in base32; other digests as they are."""
    if not text:
        return None
    label, _, value = text.rpartition(":")
    if label.lower() not in ("", "sha1"):
        return text
    try:
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()
    except binascii.Error:
        return value.lower()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``, continuation records and damaged ones among them."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 6, pa.int32(), pa.int64(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for f, block, damage in parsed(content.as_py()):
                    rows.append((
                        whole_number(f.get("x-page-id")), f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"),
                        sha1_digest(f.get("warc-payload-digest")), f.get("warc-refers-to"), f.get("warc-segment-origin-id"),
                        whole_number(f.get("warc-segment-number"), 31), whole_number(f.get("warc-segment-total-length")), damage, block,
                    ))
                    held += len(block)
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    files = spark.read.format("binaryFile").schema(schema).load(path)
    return files.select("content").mapInArrow(read, RECORD)


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked framing."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        if size < 0:
            raise ValueError("a chunk of less than nothing")
        if not size:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        if len(parts[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + size


def payload_of(message: bytes) -> bytes:
    head, _, body = message.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def reassembled(read: DataFrame) -> DataFrame:
    """Whole records: page_id, record_id, record_type, target_uri, payload_digest, refers_to, payload, payload_bytes, payload_sha1, whole, damage.

    ``whole`` is false, and the payload null, where a record is damaged, a segment is missing or the length or digest differs; a record without
    a digest, or with another than SHA-1, is taken at its word. ``damage`` says why. Of records that aren't a response or revisit the block is the payload.
    Only segmented records are shuffled; a group is one record.
    """
    first = F.col("origin_id").isNull()
    fields = ["page_id", "record_type", "target_uri", "payload_digest", "refers_to", "damage"]
    alone = (first & F.col("segment").isNull()) | F.col("damage").isNotNull() | F.coalesce("origin_id", "record_id").isNull()
    single = read.filter(alone).select("record_id", *fields, "block", F.col("damage").isNull().alias("whole"))
    pieces = read.filter(~alone)
    grouped = pieces.groupBy(F.coalesce("origin_id", "record_id").alias("record_id")).agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in fields],
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total_length").alias("total"),
    )
    block = F.aggregate("parts", F.lit(b"").cast("binary"), lambda held, p: F.concat(held, p["block"]))
    joined = grouped.select("record_id", *fields, block.alias("block"), "parts.segment", "total").select(
        "record_id", *fields, "block",
        F.coalesce(
            (F.col("segment") == F.sequence(F.lit(1), F.size("segment"))) & (F.octet_length("block") == F.col("total")) & F.col("record_type").isNotNull(),
            F.lit(False),
        ).alias("whole"),
    )
    both = single.unionByName(joined)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, fine, sizes, digests, damages = [], [], [], [], []
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for block, whole, kind, digest, damage in zip(at["block"], *(at[n].to_pylist() for n in ("whole", "record_type", "payload_digest", "damage"))):
                payload, found = None, None
                if whole and kind != "revisit":
                    try:
                        payload = payload_of(block.as_py()) if kind == "response" else block.as_py()
                    except ValueError as wrong:
                        damage = f"chunks: {wrong}"
                    else:
                        found = hashlib.sha1(payload).hexdigest()
                        if digest is not None and ":" not in digest and found != digest:
                            payload, damage = None, "the digest differs"
                elif not whole:
                    damage = damage or "segments are missing, or their length differs"
                payloads.append(payload)
                fine.append(bool(whole and (kind == "revisit" or payload is not None)))
                sizes.append(len(payload) if payload is not None else None)
                digests.append(found if payload is not None else None)
                damages.append(damage)
            kept = ["record_id", *fields[:-1]]
            made = [pa.array(payloads, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(fine, pa.bool_()), pa.array(damages, pa.string())]
            yield pa.RecordBatch.from_arrays([*[at[n] for n in kept], *made], [*kept, "payload", "payload_bytes", "payload_sha1", "whole", "damage"])

    return both.mapInArrow(
        decode,
        "record_id string, page_id long, record_type string, target_uri string, payload_digest string, refers_to string, "
        "payload binary, payload_bytes long, payload_sha1 string, whole boolean, damage string",
    )


def resolved(rows: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and whole of each page; a revisit has what its response holds.

    Archives are parsed once for it: what is joined is stored without the payloads."""
    seen = stored(rows.select(
        "record_id", "page_id", "record_type", "refers_to", "payload_bytes", F.col("payload_sha1").alias("digest"), "payload_digest", "whole",
    ))
    responses = seen.filter("record_type = 'response'").select(
        F.col("record_id").alias("to_id"), F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("to_bytes"),
        F.col("digest").alias("to_digest"), F.col("whole").alias("to_whole"),
    )
    revisit = F.col("record_type") == "revisit"
    return seen.join(responses, F.col("refers_to") == F.col("to_id"), "left").select(
        "page_id",
        F.when(revisit, F.col("to_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("to_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit, F.col("to_page")).alias("refers_to"),
        F.when(revisit, F.coalesce("to_whole", F.lit(False)) & (F.col("to_digest") == F.col("payload_digest"))).otherwise(F.col("whole")).alias("whole"),
    )
