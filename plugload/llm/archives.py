"""Conversion of legacy ARC archives to WARC, and the writing and reading of both."""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plugload.llm.common import as_bytes
from plugload.session import materialized, new_folder

#: An archive file holds records of about so many bytes, and one more.
FILE_BYTES = 8 << 20
#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000

# The field lists of the two ARC versions, in the order of a header line.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
# Fixed value: the WARC profile of a revisit that has the same payload digest.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:plugload:arc")
_EPOCH = datetime(2000, 1, 1, tzinfo=timezone.utc)


# -- ARC ----------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ArcRecord:
    version: int
    url: str
    ip: str
    date: str
    kind: str
    block: bytes
    declared: int
    status: str = "-"

    @property
    def truncated(self) -> bool:
        return len(self.block) < self.declared


def arc_line(version: int, url: str, date: str, kind: str, length: int, status: int = 200, offset: int = 0, name: str = "-") -> bytes:
    middle = f" {status} - - {offset} {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {kind}{middle} {length}\n".encode()


def arc_head(version: int, date: str) -> bytes:
    body = f"{version} 0 plugload\n{ARC_FIELDS[version]}\n".encode()
    return arc_line(version, "filedesc://plugload.arc", date, "text/plain", len(body)) + body + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an uncompressed ARC file, the version block first.

    A header line is read from its end by the field list that the version block gives, so a URL may hold blanks. The
    block is what the line declares as its length, or less if the file ends before. Blank lines between records are
    passed over; a line with too few fields or no number at its end is passed over as well.
    """
    at, version, fields = 0, 1, ARC_FIELDS[1].split()
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].decode("utf-8", "replace").strip()
        at = end + 1
        opening = line.startswith("filedesc:")
        if opening:
            version, fields = _version(data[at : at + 400], line)
        parts = line.rsplit(" ", len(fields) - 1)
        if len(parts) < len(fields) or not parts[-1].isdigit():
            continue
        named = dict(zip(fields, parts))
        length = int(named["Archive-length"])
        yield ArcRecord(
            version, named["URL"], named["IP-address"], named["Archive-date"], named["Content-type"],
            data[at : at + length], length, named.get("Result-code", "-"),
        )
        at += length


def _version(head: bytes, line: str) -> tuple[int, list[str]]:
    lines = head.decode("utf-8", "replace").split("\n")
    number = lines[0].split(" ")[0]
    version = int(number) if number in ("1", "2") else 1
    declared = lines[1].split() if len(lines) > 1 else []
    usable = declared[-1:] == ["Archive-length"] and {"URL", "IP-address", "Archive-date", "Content-type"} <= set(declared)
    fields = declared if usable else ARC_FIELDS[version].split()
    # The version block's own line may be in the short form.
    return version, fields if len(line.split(" ")) >= len(fields) else ARC_FIELDS[1].split()


def write_arc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """One HTTP response per page in gzipped ARC files, of version 1 and version 2 by turns.

    ARC has no place for the page's number, so it travels as an HTTP header. Null html is an empty body; white space
    in a URL is escaped; a null URL is replaced by a URN of the page. Dates are derived from the number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, parts, size = 1, [], 0
        for batch in batches:
            for number, address, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                body = body.as_py()
                seconds = (number or 0) % 1_000_000_000
                date = (_EPOCH + timedelta(seconds=seconds)).strftime("%Y%m%d%H%M%S")
                if not parts:
                    parts, size = [arc_head(version, date)], 0
                named = "" if number is None else f"X-Page-Id: {number}\r\n"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(body)}\r\n\r\n".encode() + body
                address = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", address or f"urn:page:{number}")
                parts += [arc_line(version, address, date, "text/html", len(block), offset=size), block, b"\n"]
                size += len(block)
                if size >= FILE_BYTES:
                    yield _file(parts)
                    version, parts = 3 - version, []
        if parts:
            yield _file(parts)

    _write(pages.select(F.col(page_id).cast("bigint"), F.col(url).cast("string"), as_bytes(html)).mapInArrow(run, "value binary"), folder)


def _file(parts: list[bytes]) -> pa.RecordBatch:
    """A file as one row; its last byte, a line feed, is added by the writer."""
    return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], ["value"])


def _write(files: DataFrame, folder: str) -> None:
    """Each row becomes a gzipped file of exactly these bytes, through Spark's writer, on whatever file system it has."""
    text = files.select(F.col("value").cast("string").alias("value"))
    text.write.option("compression", "gzip").option("maxRecordsPerFile", 1).text(folder)


def _read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")


def _gunzip(data: bytes) -> bytes:
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out)


# -- from ARC to WARC -----------------------------------------------------------------------------------------------------


def http_parts(block: bytes) -> tuple[bytes, bytes] | None:
    """Headers with their blank line, and body, of an HTTP response; None for anything else."""
    if not block.startswith(b"HTTP/"):
        return None
    head, mark, body = block.partition(b"\r\n\r\n")
    return (head + mark, body) if mark else (block, b"")


def page_number(head: bytes) -> int | None:
    found = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
    return int(found[1]) if found else None


def warc_date(date: str) -> str:
    """A 14-digit ARC date, or a shorter one filled up with the first moment it may mean."""
    digits = re.sub(r"\D", "", date)[:14]
    full = digits + "00000101000000"[len(digits) :]
    try:
        return datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1(data).digest()).decode()


def warc_type(record: ArcRecord) -> tuple[str, str]:
    """WARC type and content type: the version block is warcinfo, HTTP is a response, all else a resource."""
    if record.url.startswith("filedesc:"):
        return "warcinfo", "application/warc-fields"
    if record.block.startswith(b"HTTP/"):
        return "response", "application/http; msgtype=response"
    return "resource", record.kind if "/" in record.kind else "application/octet-stream"


def record_id(record: ArcRecord) -> str:
    """The same for the same record, whenever it is converted."""
    name = "\n".join((record.url, record.date, record.ip, digest(record.block)))
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>"


def warc_record(record: ArcRecord, refers: dict | None = None) -> bytes:
    """The equivalent WARC record; with ``refers`` (id, url, date of a response) a revisit without payload."""
    kind, content = warc_type(record)
    block, parts = record.block, http_parts(record.block)
    if kind == "warcinfo":
        block = f"software: plugload\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC version {record.version}\r\n".encode()
    lines = ["WARC/1.1"]
    add = lambda name, value: lines.append(f"{name}: {value}")
    if refers:
        kind, block = "revisit", parts[0]
    add("WARC-Type", kind)
    if kind != "warcinfo":
        add("WARC-Target-URI", record.url)
    add("WARC-Date", warc_date(record.date))
    add("WARC-Record-ID", record_id(record))
    if kind != "warcinfo":
        add("WARC-IP-Address", record.ip)
        add("WARC-Payload-Digest", digest(parts[1] if parts else record.block))
    if refers:
        add("WARC-Profile", SAME_PAYLOAD)
        add("WARC-Refers-To", refers["id"])
        add("WARC-Refers-To-Target-URI", refers["url"])
        add("WARC-Refers-To-Date", warc_date(refers["date"]))
    if record.truncated:
        add("WARC-Truncated", "length")
    add("WARC-Block-Digest", digest(block))
    add("Content-Type", content)
    add("Content-Length", len(block))
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def arc_index(spark: SparkSession, folder: str) -> DataFrame:
    """(path, ordinal, page_id, id, url, date, size, sha1) of all HTTP records in the ARC files of a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "ordinal", "page_id", "id", "url", "date", "size", "sha1"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for k, record in enumerate(parse_arc(_gunzip(content.as_py()))):
                    if parts := http_parts(record.block):
                        rows.append((path, k, page_number(parts[0]), record_id(record), record.url, record.date, len(parts[1]), sha1(parts[1]).digest()))
                columns = zip(*rows) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    schema = "path string, ordinal bigint, page_id bigint, id string, url string, date string, size bigint, sha1 binary"
    return _read(spark, folder).mapInArrow(run, schema)


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write the WARC equivalent of all ARC files of a folder; equal payloads of revisit_bytes or more are stored once.

    Of equal payloads the record with the largest page number stays a response. A first pass reads digests only; the
    winners come from a partial aggregation. Then each file gets the list of its own revisits, so what is shuffled
    are digests and compressed files, never payloads.
    """
    index = materialized(arc_index(spark, arc_folder))
    large = index.where(F.col("size") >= revisit_bytes)
    first = large.groupBy("sha1", "size").agg(
        F.count("*").alias("n"), F.max(F.struct("page_id", "id", "url", "date")).alias("first")
    ).where("n > 1").select("sha1", "size", "first")
    again = large.join(first, ["sha1", "size"]).where(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    lists = again.groupBy("path").agg(F.collect_list(F.struct("ordinal", "first.id", "first.url", "first.date")).alias("revisits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, revisits in zip(batch.column(0), batch.column(1).to_pylist()):
                refers = {r["ordinal"]: r for r in revisits or ()}
                yield _file([warc_record(r, refers.get(k)) for k, r in enumerate(parse_arc(_gunzip(content.as_py())))])

    files = _read(spark, arc_folder).join(lists, "path", "left").select("content", "revisits")
    _write(files.mapInArrow(run, "value binary"), warc_folder)


# -- WARC -----------------------------------------------------------------------------------------------------------------


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of an uncompressed WARC file, by the declared lengths."""
    at = 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
        headers = {k.lower(): v for k, v in headers.items()}
        start = end + 4
        length = int(headers.get("content-length", 0))
        yield headers, data[start : start + length]
        at = start + length + 4


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(id, page_id, type, uri, date, payload_bytes, payload_digest, refers, payload) of the page records of WARC files.

    Size and digest are those of the full payload: of a response its own, of a revisit as its headers state them.
    payload_digest is lower-case hex; a response whose payload does not have the stated digest raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "page_id", "type", "uri", "date", "payload_bytes", "payload_digest", "refers", "payload"]
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 3, pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse_warc(_gunzip(content.as_py())):
                    kind, parts = h.get("warc-type"), http_parts(block)
                    if kind not in ("response", "revisit") or not parts:
                        continue
                    stated = h["warc-payload-digest"]
                    if kind == "response":
                        if digest(parts[1]) != stated:
                            raise ValueError(f"payload of {h['warc-record-id']} has not the stated digest")
                        size = len(parts[1])
                    else:
                        found = re.search(rb"\r\nContent-Length: (\d+)\r\n", parts[0])
                        size = int(found[1]) if found else None
                    hexed = base64.b32decode(stated.removeprefix("sha1:")).hex()
                    rows.append((h["warc-record-id"], page_number(parts[0]), kind, h.get("warc-target-uri"), h.get("warc-date"),
                                 size, hexed, h.get("warc-refers-to"), parts[1] if kind == "response" else None))
                columns = zip(*rows) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    schema = ("id string, page_id bigint, type string, uri string, date string, payload_bytes bigint, payload_digest string, "
              "refers string, payload binary")
    return _read(spark, folder).select("content").mapInArrow(run, schema)


def page_records(warc: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): refers_to is the page of the response."""
    light = materialized(warc.select("id", "page_id", "type", "payload_bytes", "payload_digest", "refers"))
    responses = light.where("type = 'response'").groupBy(F.col("id").alias("_id")).agg(F.max("page_id").alias("refers_to"))
    revisits = light.where("type = 'revisit'").join(responses, F.col("refers") == F.col("_id"), "left")
    every = light.where("type = 'response'").withColumn("refers_to", F.lit(None).cast("bigint"))
    columns = ["page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"]
    return every.select(*columns).union(revisits.select(*columns))


def through_archives(pages: DataFrame, **names: str) -> DataFrame:
    """Write pages as ARC, convert the archives to WARC in the shared folder, and read the records of all pages back.

    Equal rows are equal records and stay responses both, as both have the largest number. Pages without number count
    as the smallest. An empty table gives no record. Columns beyond the three named are ignored.
    """
    spark = pages.sparkSession
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    write_arc(pages, arc, **names)
    convert(spark, arc, warc)
    return page_records(read_warc(spark, warc))
