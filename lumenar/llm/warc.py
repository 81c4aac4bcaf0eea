"""Legacy web archives to WARC: parse ARC by its declared lengths, synthesise WARC records.

ARC files come in two versions, told by the version block that opens each file: version 1
record headers have five fields (URL, IP, date, content type, length), version 2 ten (with
result code, checksum, location, offset and file name before the length). A record's bytes
are the declared length after its header line, whatever they hold.

Each record becomes a WARC 1.1 record: its identifier is a name-based UUID over file, offset
and payload digest, its timestamp the ARC date in ISO form, its address the ARC's IP address, its
payload digest the SHA-1 in base32 of the HTTP body. A version block becomes a warcinfo record; a
record that is no HTTP message (it doesn't begin with ``HTTP/``) is a resource of the ARC's content
type, and its payload is all of it. HTTP heads may end their lines with LF alone. Of records of one
kind with equal payloads of at least ``least_bytes`` bytes the one with the smallest page id is a
response (or resource), the others are revisits that keep the HTTP headers and refer to it; groups
are found from digests, sizes and ids alone, and what is known of a hot payload is broadcast, so
that a payload with a third of all records doesn't meet in one task.

Archives are written by Spark's text writer with the record's trailing bytes as separator,
gzipped, one per task: the output committer keeps files of lost executors out. They are read
back as binary files and parsed by Content-Length, streaming through the compression.

Defined results: null html is an empty payload; a null page id has no X-Page-Id header, is
null when read back and never the referred one while another record has an id; rows that
repeat a page are records each; a null url becomes ``about:blank``, and blanks in URLs are
percent-encoded; an empty table gives no records; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenar.llm.hot_keys import join_facts, look_up
from lumenar.storage import Scratch, new_path, remove, table, written

FETCH_DATE = "20240101000000"
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
CRLF = b"\r\n"
#: Gzip at its fast level: files are somewhat larger, and written in less than half the time.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def is_http(message: bytes) -> bool:
    return message.startswith(b"HTTP/")


def _payload(message: bytes) -> tuple[bytes, bytes]:
    """Head and body of an HTTP message; any other is all body, a message without a blank line all head."""
    if not is_http(message):
        return b"", message
    ends = [(at, len(gap)) for gap in (b"\r\n\r\n", b"\n\n") if (at := message.find(gap)) >= 0]
    at, size = min(ends, default=(len(message), 0))
    return message[:at], message[at + size :]


def _header(head: bytes, name: bytes) -> bytes | None:
    for line in head.splitlines():
        key, sep, value = line.partition(b":")
        if sep and key.strip().lower() == name:
            return value.strip()
    return None


# --- ARC -----------------------------------------------------------------------------


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 lumenar\n{ARC_FIELDS[version]}\n".encode()
    blanks = "" if version == 1 else "200 - - 0 " + name + " "
    return f"filedesc://{name} 0.0.0.0 {FETCH_DATE} text/plain {blanks}{len(body)}\n".encode() + body


def arc_record(version: int, name: str, url: str | None, page_id: int | None, html: bytes) -> bytes:
    url = "".join(f"%{b:02X}" if b <= 0x20 or b == 0x7F else chr(b) for b in (url or "about:blank").encode("utf-8")).encode("latin-1")
    head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(html)]
    if page_id is not None:
        head.append(b"X-Page-Id: %d" % page_id)
    message = CRLF.join(head) + b"\r\n\r\n" + html
    middle = b"" if version == 1 else b"200 - - 0 %s " % name.encode()
    return b"%s 0.0.0.0 %s text/html %s%d\n" % (url, FETCH_DATE.encode(), middle, len(message)) + message


def write_arc(pages: DataFrame, path: str) -> None:
    """page_id, url, html to gzipped ARC files; tasks take turns in writing version 1 and version 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, version = None, 1
        for batch in batches:
            if name is None and len(batch):
                part = batch.column(3)[0].as_py()
                name, version = f"part-{part:05d}.arc", 1 + part % 2
                yield pa.RecordBatch.from_arrays([pa.array([arc_version_block(version, name)], pa.binary())], ["record"])
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            records = [arc_record(version, name, url, page_id, html) for page_id, url, html in rows]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

    slim = pages.select(F.col("page_id").cast("long"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"), F.spark_partition_id().alias("part"))
    slim.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").options(**GZIP).text(path)


def parse_arc(stream: io.BufferedIOBase, with_version_block: bool = False) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, record bytes) of each record after the version block, and of that block if asked."""
    fields, offset = None, 0
    while line := stream.readline():
        start, offset = offset, offset + len(line)
        if not line.strip():
            continue  # the separator after a record
        values = line.decode("utf-8").rstrip("\r\n").split(" ")
        length = int(values[-1])
        body = stream.read(length)
        offset += length
        if len(body) != length:
            raise ValueError(f"record at {start} declares {length} bytes and has {len(body)}")
        if values[0].startswith("filedesc://"):
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            fields = body.split(b"\n")[1].decode().split(" ")
            if with_version_block:
                yield start, dict(zip(fields, values, strict=True)), body
            continue
        if fields is None:
            raise ValueError("the file does not open with a version block")
        if len(values) != len(fields):
            raise ValueError(f"record at {start} has {len(values)} header fields, its version {len(fields)}")
        yield start, dict(zip(fields, values, strict=True)), body


# --- WARC ----------------------------------------------------------------------------


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(path: str, offset: int, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{offset}#{digest}')}"


def warc_record(url: str, date: str, ident: str, digest: str, message: bytes, refers_to: str | None, ip: str = "", content_type: str = "", kind: str = "response") -> bytes:
    """One WARC record but for the two line ends after it. kind is that of a record that refers to no other."""
    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else kind}", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {stamp}"]
    if kind == "warcinfo":
        message = f"software: lumenar\r\nformat: WARC File Format 1.1\r\nisPartOf: {url}\r\n".encode()
        lines += [f"WARC-Filename: {url}", "Content-Type: application/warc-fields"]
    else:
        lines.append(f"WARC-Target-URI: {url}")
        lines += [f"WARC-IP-Address: {ip}"] if ip not in ("", "-", "0.0.0.0") else []
        if refers_to:
            head, _ = _payload(message)
            message = head + b"\r\n\r\n" if head else b""
            lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        lines += [f"Content-Type: {'application/http; msgtype=response' if kind == 'response' else content_type or 'application/octet-stream'}", f"WARC-Payload-Digest: sha1:{digest}"]
    lines += [f"WARC-Block-Digest: sha1:{base32_sha1(message)}", f"Content-Length: {len(message)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + message


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record does not begin with a WARC version line")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8").partition(":")
            fields[key.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("a record is shorter than its Content-Length")
        yield fields, block


ARC_SCHEMA = "path string, offset long, kind string, url string, date string, ip string, content_type string, page_id long, digest string, payload_bytes long, message binary"
WARC_SCHEMA = "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to_id string"
#: Rows are handed on as soon as they have so many bytes.
BATCH_BYTES = 4 << 20


def _batches(rows: Iterator[tuple[list, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row, weight in rows:
        held.append(row)
        size += weight + 200
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _open(content: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw


def read_arc(spark: SparkSession, path: str, with_message: bool = True) -> DataFrame:
    """One row per ARC record, version blocks too: where it lies, its kind and header, its payload's digest and size, and its bytes if asked."""
    text, number = pa.string(), pa.int64()
    schema = pa.schema([("path", text), ("offset", number), ("kind", text), ("url", text), ("date", text), ("ip", text), ("content_type", text), ("page_id", number), ("digest", text), ("payload_bytes", number), ("message", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, int]]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                for offset, fields, message in parse_arc(_open(content.as_py()), with_version_block=True):
                    head, payload = _payload(message)
                    page = _header(head, b"x-page-id")
                    kind = "warcinfo" if fields["URL"].startswith("filedesc://") else "response" if is_http(message) else "resource"
                    told = [fields["URL"].removeprefix("filedesc://") if kind == "warcinfo" else fields["URL"], fields["Archive-date"], fields["IP-address"], fields["Content-type"]]
                    yield [name.as_py(), offset, kind, *told, None if page is None else int(page), base32_sha1(payload), len(payload), message if with_message else None], len(message)

    return _archives(spark, path).mapInArrow(lambda batches: _batches(rows(batches), schema), ARC_SCHEMA)


def write_warc(spark: SparkSession, arc_path: str, path: str, least_bytes: int = 0) -> None:
    """Convert ARC files to WARC files: types from the digests alone, then each record with its type."""
    scratch = Scratch(spark)
    keys = scratch.written(read_arc(spark, arc_path, with_message=False).select("path", "offset", "kind", "page_id", "digest", "payload_bytes"), "arc-records")
    place = F.struct(F.col("page_id").isNull().alias("no_page"), "page_id", "path", "offset")
    alike = F.concat_ws(":", "kind", "digest", "payload_bytes").alias("alike")
    grouped = keys.where((F.col("kind") != "warcinfo") & (F.col("payload_bytes") >= least_bytes)).select("path", "offset", "page_id", alike)
    first = grouped.groupBy("alike").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    revisits = (
        join_facts(grouped, first, "alike", "copies", keys.count())
        .where((F.col("first.path") != F.col("path")) | (F.col("first.offset") != F.col("offset")))
        .select("path", "offset", F.col("first.path").alias("of_path"), F.col("first.offset").alias("of_offset"))
    )
    typed = read_arc(spark, arc_path).join(revisits, ["path", "offset"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record", pa.binary())])

        def rows() -> Iterator[tuple[list, int]]:
            for batch in batches:
                for r in batch.to_pylist():
                    ident = record_id(r["path"], r["offset"], r["digest"])
                    refers_to = None if r["of_path"] is None else record_id(r["of_path"], r["of_offset"], r["digest"])
                    yield [warc_record(r["url"], r["date"], ident, r["digest"], r["message"], refers_to, r["ip"], r["content_type"], r["kind"])], len(r["message"])

        yield from _batches(rows(), schema)

    typed.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").options(**GZIP).text(path)
    scratch.clear()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record but warcinfo; a revisit's payload size is the Content-Length of its HTTP headers, null without one."""
    text, number = pa.string(), pa.int64()
    schema = pa.schema([("record_id", text), ("page_id", number), ("payload_bytes", number), ("payload_digest", text), ("record_type", text), ("refers_to_id", text)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, int]]:
        for batch in batches:
            for content in batch.column(1):
                for fields, block in parse_warc(_open(content.as_py())):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    head, payload = _payload(block)
                    page, digest = _header(head, b"x-page-id"), fields["warc-payload-digest"].removeprefix("sha1:")
                    declared = _header(head, b"content-length")
                    size = len(payload) if kind != "revisit" else None if declared is None else int(declared)
                    if kind != "revisit" and base32_sha1(payload) != digest:
                        raise ValueError(f"the payload of {fields['warc-record-id']} does not match its digest")
                    yield [fields["warc-record-id"].strip("<>"), None if page is None else int(page), size, digest, kind, fields.get("warc-refers-to", "").strip("<>") or None], 0

    return _archives(spark, path).mapInArrow(lambda batches: _batches(rows(batches), schema), WARC_SCHEMA)


def convert_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC files read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    write_warc(spark, arc, warc, least_bytes)
    remove(spark, arc)
    records = written(read_warc(spark, warc), "warc-records")
    remove(spark, warc)
    referred = records.where("refers_to_id is null").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    told = look_up(records, referred, "refers_to_id", records.count(), "left")
    return told.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGEST = "concat(" + ", ".join(
    f"substr('{_ALPHABET}', 1 + CAST(floor(v{block} / {32 ** (3 - digit)}) AS BIGINT) % 32, 1)" for block in range(8) for digit in range(4)
) + ")"
_BLOCKS = ", ".join(f"CAST(concat('0x', substr(hex40, {1 + 5 * block}, 5)) AS BIGINT) AS v{block}" for block in range(8))

ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex40 FROM pages),
b AS (SELECT page_id, body, {_BLOCKS} FROM p)
SELECT page_id, octet_length(encode(body)) AS payload_bytes, {_DIGEST} AS payload_digest,
       CASE WHEN page_id = min(page_id) OVER g THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = min(page_id) OVER g THEN NULL ELSE min(page_id) OVER g END AS refers_to
FROM b WINDOW g AS (PARTITION BY body)
"""
