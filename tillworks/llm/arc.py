"""Legacy archives to WARC: parse ARC headers of either version and their declared lengths, write equivalent WARC records.

An ARC file is a version block, whose second line names the version, and records of one header line plus a declared
number of bytes.  Version 1 has five fields (URL, IP, date, type, length), version 2 ten (result code, checksum,
location, offset and file name before the length).  Headers are read from the right, so a URL may hold spaces.

WARC files are written by Spark's text writer with the record end as line separator: the commit protocol of the writer
makes them safe against lost executors, on any file system.  Tasks write segments of a bounded number of bytes and files
of a bounded number of segments, so a file can be read back whole whatever the length of a page.

Cases: NULL or empty payloads give records of length 0; NULL URLs are written as ``-``; white space in URLs is percent-coded; rows
that repeat key and payload are records of their own with the same identifier; NULL keys have an empty key part; an empty
table gives an archive without records.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.llm.common import staged
from tillworks.session import scratch

#: Fixed values of the two formats.
FIELDS = {1: ("url", "ip", "date", "mime", "length"),
          2: ("url", "ip", "date", "mime", "code", "checksum", "location", "offset", "file", "length")}
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SEGMENT_BYTES = 4 << 20
FILE_SEGMENTS = 4
LEAST_REVISIT_BYTES = 1000


def parse_header(line: bytes, version: int) -> dict[str, str]:
    """Fields of an ARC header line; raises ValueError where the line does not fit its version."""
    names = FIELDS[version]
    parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
    if len(parts) != len(names) or not parts[-1].isdigit():
        raise ValueError(f"not an ARC version {version} header: {line[:200]!r}")
    return dict(zip(names, parts, strict=True))


def split_record(data: bytes, at: int, version: int) -> tuple[dict[str, str], bytes, int]:
    """(header, body, next position) of the record that starts at ``at``."""
    end = data.find(b"\n", at)
    if end < 0:
        raise ValueError(f"no header line at byte {at}")
    header = parse_header(data[at:end], version)
    stop = end + 1 + int(header["length"])
    if stop > len(data):
        raise ValueError(f"record at byte {at} ends before its declared length")
    body = data[end + 1:stop]
    while data[stop:stop + 1] == b"\n":
        stop += 1
    return header, body, stop


def arc_version(data: bytes) -> int:
    """Version of a file from the second line of its version block."""
    first = data.find(b"\n")
    second = data[first + 1:data.find(b"\n", first + 1)].split(b" ")
    if not data.startswith(b"filedesc://") or second[0] not in (b"1", b"2"):
        raise ValueError("not an ARC version block")
    return int(second[0])


def arc_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(version, offset, header, body) of each record behind the version block; the block itself has version 1 fields.  Files
    of gzip members are inflated first; offsets are those of the inflated file."""
    if data.startswith(b"\x1f\x8b"):
        data = gzip.decompress(data)
    version = arc_version(data)
    _, _, at = split_record(data, 0, 1)
    while at < len(data):
        header, body, after = split_record(data, at, version)
        yield version, at, header, body
        at = after


def _iso(date: str) -> str:
    """14 digits to a WARC date; shorter dates of old crawlers start their period."""
    d = (date + "00000101000000"[len(date):])[:14] if date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def payload_of(body: bytes) -> tuple[bytes, bytes]:
    """(HTTP head with its end, payload); a body without HTTP head is all payload."""
    head, gap, payload = body.partition(b"\r\n\r\n") if body.startswith(b"HTTP/") else (b"", b"", body)
    return head + gap, payload


def record_id(key: object, digest: str) -> str:
    """An identifier that reruns agree on."""
    return f"<urn:x-arc:{'' if key is None else key}:{digest}>"


def warc_record(header: dict[str, str], body: bytes, key: object, original: object = None, revisit: bool = False) -> str:
    """``warc_bytes`` of a record that is UTF-8, as text."""
    return warc_bytes(header, body, key, original, revisit).decode()


def warc_bytes(header: dict[str, str], body: bytes, key: object, original: object = None, revisit: bool = False) -> bytes:
    """The WARC record equivalent to an ARC record, without the record end.  A revisit keeps the HTTP head only.  The block is
    copied as it is, whatever its encoding."""
    head, payload = payload_of(body)
    digest = hashlib.sha1(payload).hexdigest()
    block = head if revisit else body
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key, digest)}",
             f"WARC-Date: {_iso(header['date'])}", f"WARC-Target-URI: {header['url']}", f"WARC-IP-Address: {header['ip']}",
             f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
             f"Content-Type: {'application/http; msgtype=response' if head else header['mime']}"]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(original, digest)}", f"WARC-Profile: {REVISIT_PROFILE}",
                  f"X-Payload-Length: {len(payload)}"]  # an HTTP head need not tell it
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def legacy_records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Captured pages as ARC records (key, version, record): even keys in version 1, odd ones in version 2."""
    body = F.coalesce(F.col(payload), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body),
                    F.lit("\r\n\r\n"), body)
    odd = F.coalesce(F.pmod(F.xxhash64(key), F.lit(2)), F.lit(0)) == 1
    target = F.when(F.coalesce(F.col(url), F.lit("")) == "", "-").otherwise(
        F.regexp_replace(F.col(url), "[\\x00-\\x20]", "%20"))
    common = F.concat(target, F.lit(" 127.0.0.1 20010101000000 text/html "))
    middle = F.when(odd, "200 - - 0 legacy.arc ").otherwise("")
    record = F.concat(common, middle, F.octet_length(http), F.lit("\n"), http, F.lit("\n"))
    return pages.select(F.col(key).alias("key"), F.when(odd, 2).otherwise(1).alias("version"),
                        F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("payload_bytes"),
                        record.cast("binary").alias("record"))


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """ARC files as records (key, version, digest, payload_bytes, record); the key is file name and offset."""
    schema = pa.schema([("key", pa.string()), ("version", pa.int32()), ("digest", pa.string()),
                        ("payload_bytes", pa.int32()), ("record", pa.binary())])

    def parse(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for version, at, header, body in arc_records(data.as_py()):
                    line = " ".join(header[f] for f in FIELDS[version]).encode()
                    payload = payload_of(body)[1]
                    rows.append((f"{name.rsplit('/', 1)[-1]}@{at}", version, hashlib.sha1(payload).hexdigest(),
                                 len(payload), line + b"\n" + body + b"\n"))
                columns = list(zip(*rows, strict=True)) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, "key string, version int, digest string, payload_bytes int, record binary")


def write_warc(records: DataFrame, path: str, least: int = LEAST_REVISIT_BYTES, segment_bytes: int = SEGMENT_BYTES,
               file_segments: int = FILE_SEGMENTS) -> None:
    """Convert ARC records to WARC files under ``path``.  Of records with equal payloads of at least ``least`` bytes the
    one with the largest key is written whole, the others revisit it.  The payload digests are grouped as narrow rows,
    folded in the map tasks; only groups with copies come back, in a join that adaptive execution can split."""
    groups = staged(records.where(F.col("payload_bytes") >= least).groupBy("digest").agg(
        F.max("key").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("digest").alias("of_digest"), "original"), "warc-groups")
    # payloads that are never revisited, empty ones among them, must not meet in one task by their digest
    spread = records.withColumn("wanted", F.when(F.col("payload_bytes") >= least, F.col("digest")).otherwise(
        F.concat(F.lit("-"), F.coalesce(F.col("key").cast("string"), F.lit("")))))
    joined = spread.join(groups, F.col("wanted") == F.col("of_digest"), "left")
    rows = joined.select(
        F.col("key").cast("string").alias("key"), "version", "record", F.col("original").cast("string").alias("original"),
        (F.col("of_digest").isNotNull() & ~F.col("key").eqNullSafe(F.col("original"))).alias("revisit"))

    def convert(batches):
        segment, held = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                key, version, data, original, revisit = (x.as_py() for x in row)
                header, body, _ = split_record(data, 0, version)
                segment.append(warc_bytes(header, body, key, original, revisit))
                held += len(segment[-1])
                if held >= segment_bytes:
                    yield pa.RecordBatch.from_pydict({"value": [END.encode().join(segment)]})
                    segment, held = [], 0
        if segment:
            yield pa.RecordBatch.from_pydict({"value": [END.encode().join(segment)]})

    # a cast takes the bytes as they are, and so does the writer
    (rows.mapInArrow(convert, "value binary").select(F.col("value").cast("string")).write.option("lineSep", END)
     .option("maxRecordsPerFile", file_segments).text(path))


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared length."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:stop].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"not a WARC record: {first[:100]!r}")
        headers = dict(x.split(": ", 1) for x in lines)
        end = stop + 4 + int(headers["Content-Length"])
        yield headers, data[stop + 4:end]
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError("record does not end at its declared length")
        at = end + 4


WARC_SCHEMA = ("record_type string, record_id string, refers_to_id string, target_uri string, date string, "
               "payload_bytes bigint, payload_digest string")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files.  Digests of whole records are computed from the payload and checked against
    the header; those of revisits and their payload length come from the header."""
    names = [c.split(" ")[0] for c in WARC_SCHEMA.split(", ")]

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse_warc(content.as_py()):
                    payload = payload_of(block)[1]
                    stated = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "revisit":
                        size = int(h["X-Payload-Length"])
                    else:
                        size = len(payload)
                        if hashlib.sha1(payload).hexdigest() != stated:
                            raise ValueError(f"digest of {h['WARC-Record-ID']} does not match its payload")
                    rows.append((h["WARC-Type"], h["WARC-Record-ID"], h.get("WARC-Refers-To"), h["WARC-Target-URI"],
                                 h["WARC-Date"], size, stated))
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                types = [pa.string()] * 5 + [pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, WARC_SCHEMA)


def key_of(record: str):
    """The key inside a record identifier, as text; NULL where there is none."""
    return F.nullif(F.regexp_extract(record, "^<urn:x-arc:(.*):[0-9a-f]*>$", 1), F.lit(""))


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write pages to WARC through the converter, read the archives back."""
    path = scratch(pages.sparkSession, "warc")
    write_warc(legacy_records(pages, key, url, payload), path)
    return read_warc(pages.sparkSession, path)
