"""Legacy ARC archives converted to WARC records, written to and read back from WARC files.

The converter reads an ARC archive's version block, which becomes a warcinfo record, takes the version-specific field
names from it, and walks the records by their declared lengths alone. Header lines are read from the right, by the shape
of each version's fields, as old archives have addresses and content types with spaces in them. For each record it
synthesises the WARC identifier (a UUID derived from address, time and payload digest, so that runs agree and a capture
that is there twice is the same record), the time, the record type and the digests. Payloads seen elsewhere become
revisits of the record that keeps them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, written

#: The header fields of an ARC record line, by archive version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed value: the profile of a revisit that names an identical payload.
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
#: The shape of a header line, by archive version.
_LINE = {
    1: re.compile(rb"(.*) (\S+) (\d{4,17}) (.*) (\d+)", re.S),
    2: re.compile(rb"(.*) (\S+) (\d{4,17}) (.*) (\d{1,3}|-) (\S+) (\S+) (\d+|-) (\S+) (\d+)", re.S),
}
_HEAD_END = re.compile(rb"\r?\n\r?\n")
#: The time of records whose own can't be read.
_NO_TIME = "1970-01-01T00:00:00Z"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:quarrylight:arc-to-warc")


@dataclass(frozen=True)
class ArcRecord:
    version: int
    uri: str
    ip: str
    date: str
    content_type: str
    block: bytes
    truncated: bool = False


@dataclass(frozen=True)
class WarcRecord:
    headers: dict[str, str]
    block: bytes


def sha1_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_uri(uri: str | None) -> str:
    """An address fit for a space-separated header line: white space and controls percent-encoded, null is urn:none."""
    if not uri:
        return "urn:none"
    return "".join("".join(f"%{b:02X}" for b in c.encode()) if c.isspace() or ord(c) < 33 else c for c in uri)


def write_arc(records: list[ArcRecord], version: int, name: str = "records.arc") -> bytes:
    """An ARC archive of that version: the version block, then the records."""
    about = f"{version} 0 quarrylight\n{ARC_FIELDS[version]}\n".encode()
    out = [f"filedesc://{name} 0.0.0.0 19960101000000 text/plain ".encode() + (b"200 - - 0 " + name.encode() + b" " if version == 2 else b"") + str(len(about)).encode() + b"\n" + about]
    offset = len(out[0]) + 1
    for r in records:
        middle = "" if version == 1 else f"200 - - {offset} {name} "
        line = f"{r.uri} {r.ip} {r.date} {r.content_type} {middle}{len(r.block)}\n".encode()
        out.append(line + r.block)
        offset += len(out[-1]) + 1
    return b"\n".join(out) + b"\n"


def version_block(data: bytes) -> tuple[int, bytes, int]:
    """(version, the version block, where it ends) of an ARC archive."""
    first = data.find(b"\n")
    declared = data[:first].rsplit(b" ", 1)[-1] if first > 0 else b""
    about = data[first + 1 : first + 1 + int(declared)] if declared.isdigit() else b""
    lines = about.split(b"\n")
    version = int(lines[0].split()[0]) if lines[0].split()[:1] and lines[0].split()[0].isdigit() else 0
    if version not in ARC_FIELDS or len(lines) < 2 or lines[1].decode("utf-8", "replace").split() != ARC_FIELDS[version].split():
        raise ValueError(f"not an ARC version block: {lines[:2]!r}")
    return version, about, first + 1 + int(declared)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC archive; the version block decides which fields a header line has.

    Declared lengths alone tell where a record ends, whatever bytes it holds. A last record that the archive's end cuts
    short is marked as truncated. A header line that doesn't fit its version raises ValueError: nothing tells where the
    next record starts.
    """
    version, _, at = version_block(data)
    names = ARC_FIELDS[version].split()
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        m = _LINE[version].fullmatch(data[at : end if end >= 0 else len(data)].rstrip(b"\r"))
        if not m:
            raise ValueError(f"no record line of version {version} at byte {at}")
        field = dict(zip(names, (x.decode("utf-8", "replace") for x in m.groups()), strict=True))
        size = int(field["Archive-length"])
        block = data[end + 1 : end + 1 + size] if end >= 0 else b""
        yield ArcRecord(version, arc_uri(field["URL"]), field["IP-address"], field["Archive-date"], field["Content-type"], block, len(block) < size)
        if len(block) < size:
            return
        at = end + 1 + size


def http_payload(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(HTTP header fields, header bytes, payload) of a block; a block that is no HTTP message is all payload.

    Lines may end in LF alone; a message that has no empty line is all header.
    """
    if not block.startswith(b"HTTP/"):
        return {}, b"", block
    m = _HEAD_END.search(block)
    head, body = (block[: m.end()], block[m.end() :]) if m else (block, b"")
    lines = head.decode("utf-8", "replace").splitlines()[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}, head, body


def record_id(uri: str, date: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{uri} {date} {digest}')}>"


def iso_time(date: str) -> str:
    """The ARC's 14 digits (12 or 8 in old files) as a WARC-Date; the epoch if they are no time."""
    for size, form in ((14, "%Y%m%d%H%M%S"), (12, "%Y%m%d%H%M"), (8, "%Y%m%d")):
        try:
            if len(date) >= size:
                return datetime.strptime(date[:size], form).strftime("%Y-%m-%dT%H:%M:%SZ")
        except ValueError:
            continue
    return _NO_TIME


def warcinfo(name: str, about: bytes, date: str = "") -> WarcRecord:
    """The warcinfo record of a file: what the ARC version block said of it."""
    block = b"software: quarrylight\r\nformat: WARC File Format 1.0\r\nisPartOf: " + name.encode() + b"\r\ndescription: " + b" ".join(about.split()) + b"\r\n"
    headers = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(name, date, sha1_digest(block)), "WARC-Date": iso_time(date), "WARC-Filename": name, "Content-Type": "application/warc-fields"}
    return WarcRecord(headers | {"WARC-Block-Digest": f"sha1:{sha1_digest(block)}", "Content-Length": str(len(block))}, block)


def to_warc(arc: ArcRecord, original: Callable[[str], tuple[str, str] | None] = lambda digest: None) -> WarcRecord:
    """The equivalent WARC record. original: (address, ARC date) of the record that keeps a payload, None for itself."""
    _, head, payload = http_payload(arc.block)
    digest = sha1_digest(payload)
    kept_by = original(digest)
    kind = "response" if head or arc.uri.partition(":")[0].lower() in ("http", "https", "dns", "urn") else "resource"
    block = head if kept_by else arc.block
    headers = {
        "WARC-Type": "revisit" if kept_by else kind,
        "WARC-Record-ID": record_id(arc.uri, arc.date, digest),
        "WARC-Date": iso_time(arc.date),
        "WARC-Target-URI": arc.uri,
        "WARC-IP-Address": arc.ip,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{sha1_digest(block)}",
        "Content-Type": "application/http;msgtype=response" if head else arc.content_type,
    }
    if headers["WARC-Date"] == _NO_TIME:
        headers["X-ARC-Date"] = arc.date
    if arc.truncated:
        headers["WARC-Truncated"] = "unspecified"
    if kept_by:
        uri, date = kept_by
        headers |= {"WARC-Profile": IDENTICAL_PAYLOAD, "WARC-Refers-To": record_id(uri, date, digest), "WARC-Refers-To-Target-URI": uri, "WARC-Refers-To-Date": iso_time(date)}
    return WarcRecord(headers | {"Content-Length": str(len(block))}, block)


def warc_bytes(record: WarcRecord) -> bytes:
    """The record without the two line ends that close it."""
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in record.headers.items()) + "\r\n").encode() + record.block


def read_warc(data: bytes) -> Iterator[WarcRecord]:
    """The records of a WARC file, by their declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not at a WARC record")
        headers = {k: v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record's declared length is wrong")
        yield WarcRecord(headers, data[start:stop])
        at = stop + 4


def _capture_date(page_id: int | None) -> str:
    """Pages carry no time: a fixed day plus the id in seconds, within a century."""
    return (datetime(2000, 1, 1, tzinfo=UTC) + timedelta(seconds=(page_id or 0) % 3_000_000_000)).strftime("%Y%m%d%H%M%S")


def page_record(page_id: int | None, url: str | None, html: str | None, version: int) -> ArcRecord:
    """A page as a captured HTTP response; the page id travels as a response header."""
    body = (html or "").encode()
    named = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(body)}\r\n\r\n".encode()
    return ArcRecord(version, arc_uri(url), "0.0.0.0", _capture_date(page_id), "text/html", head + body)


def keepers(pages: DataFrame, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """pages plus keep_id, keep_url: of the row with the largest page_id among those of an equal payload, if it is another.

    Payloads are compared by SHA-1 of ids and digests only. The payloads found more than once are broadcast only if
    their measured size, addresses included, is under broadcast_bytes; otherwise ids and digests are joined, and the
    result to the pages by id and digest.
    """
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    rows = pages.select("page_id", "url", "html", digest.alias("digest"))
    top = F.max(F.struct(F.col("page_id").alias("keep_id"), F.col("url").alias("keep_url"))).alias("keep")
    again = rows.groupBy("digest").agg(top, F.count("*").alias("n")).where("n > 1").select("digest", "keep.*")
    again = written(again, "payloads")
    other = ~F.col("page_id").eqNullSafe(F.col("keep_id"))
    if (again.agg(F.sum(F.coalesce(F.octet_length("keep_url"), F.lit(0)) + 100)).first()[0] or 0) <= broadcast_bytes:
        joined = rows.join(F.broadcast(again), "digest", "left")
    else:
        moved = rows.select("page_id", "digest").join(again, "digest").where(other).distinct()
        joined = rows.alias("p").join(moved.alias("m"), F.expr("p.page_id <=> m.page_id and p.digest = m.digest"), "left").select("p.*", "keep_id", "keep_url")
    return joined.select("page_id", "url", "html", F.when(other, F.col("keep_id")).alias("keep_id"), F.when(other, F.col("keep_url")).alias("keep_url"))


def write_archives(pages: DataFrame, archive_bytes: int = 16 << 20) -> str:
    """Convert pages, by way of ARC archives of both versions, to WARC files in the shared folder; their path.

    A file closes once it has archive_bytes, so a reader holds no more than that and one record. Each file opens with a
    warcinfo record.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, filled, part = 0, -1, TaskContext.get().partitionId()
        for b in batches:
            rows = b.to_pylist()
            values, numbers = [], []
            for version in ARC_FIELDS:
                own = [r for r in rows if (r["page_id"] or 0) % 2 + 1 == version]
                arc = write_arc([page_record(r["page_id"], r["url"], r["html"], version) for r in own], version)
                for r, record in zip(own, read_arc(arc), strict=True):
                    if filled < 0:
                        values.append(warc_bytes(warcinfo(f"part-{part:05d}-{archive:05d}.warc", version_block(arc)[1])).decode())
                        numbers.append(archive)
                        filled = len(values[-1])
                    kept_by = (arc_uri(r["keep_url"]), _capture_date(r["keep_id"])) if r["keep_id"] is not None else None
                    value = warc_bytes(to_warc(record, lambda _, k=kept_by: k))
                    filled += len(value)
                    values.append(value.decode())
                    numbers.append(archive)
                    if filled >= archive_bytes:
                        archive, filled = archive + 1, -1
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(numbers, pa.int32())], names=["value", "archive"])

    path = fresh_path(pages.sparkSession, "warc")
    records = keepers(pages).mapInArrow(convert, "value string, archive int")
    records.write.partitionBy("archive").option("lineSep", RECORD_END).text(path)
    return path


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the WARC files below path; payload_bytes and payload_digest are of the full payload."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_id", "record_type", "refers_to_record", "target_uri", "payload_bytes", "payload_digest"]
        for b in batches:
            for content in b.column(0):
                cols = [[] for _ in names]
                for r in read_warc(content.as_py()):
                    if r.headers["WARC-Type"] == "warcinfo":
                        continue
                    fields, _, payload = http_payload(r.block)
                    digest = r.headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(fields.get("content-length", len(payload)))
                    if r.headers["WARC-Type"] != "revisit" and (size != len(payload) or sha1_digest(payload) != digest):
                        raise ValueError(f"payload of {r.headers['WARC-Record-ID']} doesn't match its headers")
                    page = fields.get("x-page-id")
                    found = [int(page) if page else None, r.headers["WARC-Record-ID"], r.headers["WARC-Type"], r.headers.get("WARC-Refers-To"), r.headers["WARC-Target-URI"], size, digest]
                    for col, value in zip(cols, found, strict=True):
                        col.append(value)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(parse, "page_id long, record_id string, record_type string, refers_to_record string, target_uri string, payload_bytes long, payload_digest string")


_CONVERTED = "path string, record_type string, record_id string, target_uri string, date string, payload_bytes long, payload_digest string, warc binary, error string"


def convert_files(spark: SparkSession, path: str) -> DataFrame:
    """The ARC files (gzipped or not) below path -> a row per WARC record, its bytes in warc, the warcinfo of a file first.

    Where a file is damaged, the records before the damage come and a row with the error in place of the rest. Payloads
    are not compared between files: `keepers` does that for tables. An empty folder gives an empty result.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in _CONVERTED.split(", ")])
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data, rows = content.as_py(), []
                try:
                    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                    about = version_block(data)[1]
                    info = warcinfo(file.rsplit("/", 1)[-1], about)
                    rows.append((file, "warcinfo", info.headers["WARC-Record-ID"], None, info.headers["WARC-Date"], None, None, warc_bytes(info) + RECORD_END.encode(), None))
                    for arc in read_arc(data):
                        r = to_warc(arc)
                        payload = http_payload(arc.block)[2]
                        rows.append((file, r.headers["WARC-Type"], r.headers["WARC-Record-ID"], arc.uri, r.headers["WARC-Date"], len(payload), sha1_digest(payload), warc_bytes(r) + RECORD_END.encode(), None))
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema)
                            rows = []
                except (ValueError, OSError, EOFError) as error:
                    rows.append((file, *[None] * 7, str(error)))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(convert, _CONVERTED)


def op1_arc_to_warc(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, payload_bytes, payload_digest, record_type, refers_to, out of the archives.

    Null html is an empty payload and shares its record like any other; a null page_id never wins over another and
    stays null; rows that repeat the largest page_id of a payload are all responses. An empty table gives no archive
    and an empty result. Other columns are ignored.
    """
    spark = pages.sparkSession
    records = read_archives(spark, write_archives(pages)) if not pages.isEmpty() else None
    if records is None:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    records = written(records, "records")
    kept = records.where("record_type = 'response'").groupBy("record_id").agg(F.max("page_id").alias("refers_to"))
    kept = kept.withColumnRenamed("record_id", "refers_to_record")
    revisits = records.where("record_type = 'revisit'").join(kept, "refers_to_record", "left")
    whole = records.where("record_type != 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return whole.select(cols).union(revisits.select(cols))


OP1_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
     d as (select p.*, max(page_id) over (partition by html) as keep from p)
select page_id,
       cast(strlen(html) as bigint) as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           cast(1 + ((cast('0x' || substr(hex, 5 * (i // 4) + 1, 5) as bigint) >> (5 * (3 - i % 4))) & 31) as bigint), 1)), '') as payload_digest,
       case when page_id = keep then 'response' else 'revisit' end as record_type,
       case when page_id = keep then null else keep end as refers_to
from d
"""
