"""Legacy ARC archives, their conversion to WARC, and reading WARC back.

ARC comes in two versions that differ in the header line of a record: version 1 has URL, IP address, date, content type and
length, version 2 adds result code, checksum, location, offset and file name before the length. The first record of a file
(``filedesc:``) names its version. The converter trusts declared lengths only, never separators, and makes up what WARC
needs besides: record ids, ISO dates, record types and SHA-1 digests of block and payload.

A record id is a custom (version 8) UUID: the page id, if the HTTP header names one, and a hash of URL, date and digest.
So a revisit's reference leads back to a page without another join. A ``warcinfo`` record is named after what follows it; rows
equal in all columns are one capture and share an id. Address and content type of an ARC record go on to its WARC record, the
latter as that of a resource; a date that leaves out its end begins the span it names. Files are one gzip member each, as the
text writer makes them.

Of records with equal payloads of ``least`` bytes or more that with the largest page id is the response, others revisit it.
Defined cases: null or empty html is an empty payload; one of any length goes whole, alone in its file; a null URL becomes ``http://unknown.invalid/``; null page ids are smaller than
all others and written without an id; rows that repeat the largest page id are responses all of them; an empty table gives
no archives and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.llm._base import lookup_salted, new_path, settle
from pagemill.llm._files import read_files, write_files

#: The fields of a record's header line, by version of the format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
CHUNK = 16_000_000


def _quoted(url: str | None) -> str:
    """``url`` without what would end a field of a header line."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url) if url else "http://unknown.invalid/"


def arc_record(url: str | None, date: str, mime: str, body: bytes, version: int = 1, ip: str = "0.0.0.0", offset: int = 0, name: str = "-") -> bytes:
    more = f" 200 - - {offset} {name}" if version == 2 else ""
    return f"{_quoted(url)} {ip} {date} {mime}{more} {len(body)}\n".encode() + body + b"\n"


def arc_head(name: str, date: str, version: int = 1) -> bytes:
    return arc_record(f"filedesc://{name}", date, "text/plain", f"{version} 0 pagemill\n{ARC_FIELDS[version]}\n".encode(), version, name=name)


def http_block(page_id: int | None, payload: bytes) -> bytes:
    page = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{page}\r\n".encode() + payload


def _text(head: bytes) -> str:
    """Header bytes of any age: UTF-8, or else Latin-1."""
    try:
        return head.decode("utf-8")
    except UnicodeDecodeError:
        return head.decode("latin-1")


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of each record; the ``filedesc:`` record first."""
    at, fields = 0, ARC_FIELDS[1].split()
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # some writers leave more than one line between records
            at += 1
            continue
        end = data.index(b"\n", at)
        values = _text(data[at:end]).rstrip("\r").split(" ")
        if values[0].startswith("filedesc:"):
            length = int(values[-1])
            version = int(data[end + 1 : end + 1 + length].split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            fields = ARC_FIELDS[version].split()
        if len(values) != len(fields):
            raise ValueError(f"an ARC header line at byte {at} has {len(values)} fields, not {len(fields)}")
        head = dict(zip(fields, values, strict=True))
        body = data[end + 1 : end + 1 + int(head["Archive-length"])]
        if len(body) != int(head["Archive-length"]):
            raise ValueError(f"the ARC record at byte {at} is cut off")
        yield head, body
        at = end + 1 + len(body)


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """(HTTP header with its empty line, payload); a body without HTTP header is all payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    end = body.find(b"\r\n\r\n")
    return (body[: end + 4], body[end + 4 :]) if end >= 0 else (body, b"")


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    pairs = (line.split(":", 1) for line in _text(head).split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def record_id(page_id: int | None, *rest: str) -> str:
    """A version 8 UUID: 64 bits of page id (all ones and flag 0 where there is none), flag, 57 bits of hash."""
    page = (page_id if page_id is not None else -1) & (1 << 64) - 1
    h = int.from_bytes(hashlib.sha256("\n".join(rest).encode()).digest()[:8], "big") >> 7
    tail = (page & 15) << 58 | (page_id is not None) << 57 | h
    x = (page >> 16) << 80 | 8 << 76 | (page >> 4 & 0xFFF) << 64 | 2 << 62 | tail
    s = f"{x:032x}"
    return f"<urn:uuid:{s[:8]}-{s[8:12]}-{s[12:16]}-{s[16:20]}-{s[20:]}>"


def page_of(record: str) -> int | None:
    """The page id in a record id."""
    x = int(record.strip("<>").rsplit(":", 1)[1].replace("-", ""), 16)
    page = (x >> 80) << 16 | (x >> 64 & 0xFFF) << 4 | x >> 58 & 15
    return (page - (1 << 64) if page >> 63 else page) if x >> 57 & 1 else None


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(kind: str, block: bytes, **fields: str) -> bytes:
    """A WARC/1.1 record; names of ``fields`` have "_" for "-"."""
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{head}WARC-Block-Digest: {_sha1(block)}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def iso_date(date: str) -> str:
    """An ARC date of 4 to 14 digits; months and days left out are the first."""
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert(url: str, date: str, page_id: int | None, http: bytes, payload: bytes, digest: str, original: int | None, original_url: str | None = None, original_date: str | None = None, ip: str | None = None, mime: str | None = None) -> bytes:
    """The WARC record for an ARC record; ``original`` is the page it revisits, if any, with that record's URL and date."""
    own = record_id(page_id, url, date, digest)
    about = {"WARC_Record_ID": own, "WARC_Date": iso_date(date), "WARC_Target_URI": url, "WARC_IP_Address": ip if ip not in (None, "-", "0.0.0.0") else None, "WARC_Payload_Digest": digest}
    if original is not None:
        more = {"WARC_Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC_Refers_To": record_id(original, original_url, original_date, digest), "WARC_Refers_To_Target_URI": original_url, "WARC_Refers_To_Date": iso_date(original_date), "Content_Type": "application/http; msgtype=response"}
        return warc_record("revisit", http, **about, **more)
    return warc_record("response" if http else "resource", http + payload, **about, Content_Type="application/http; msgtype=response" if http else mime or "application/octet-stream")


def info_record(first: bytes) -> bytes:
    """The ``warcinfo`` record of a file that begins with the record ``first``."""
    own = record_id(None, "warcinfo", hashlib.sha256(first).hexdigest())
    return warc_record("warcinfo", b"software: pagemill\r\nformat: WARC File Format 1.1\r\n", WARC_Record_ID=own, WARC_Date="2024-01-01T00:00:00Z", Content_Type="application/warc-fields")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, by declared length."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record begins at byte {at}")
        end = data.index(b"\r\n\r\n", at) + 4
        head = fields_of(data[at:end])
        block = data[end : end + int(head["content-length"])]
        if len(block) != int(head["content-length"]) or data[end + len(block) : end + len(block) + 4] != b"\r\n\r\n":
            raise ValueError(f"the WARC record at byte {at} is cut off")
        yield head, block
        at = end + len(block) + 4


def _chunks(records: Iterator[bytes], head: Callable[[bytes], bytes]) -> Iterator[bytes]:
    """``records`` in files of about CHUNK bytes, each beginning with what ``head`` makes of its first record."""
    held, size = [], 0
    for r in records:
        held += [r] if held else [head(r), r]
        size += len(r)
        if size >= CHUNK:
            yield b"".join(held)
            held, size = [], 0
    if size:
        yield b"".join(held)


def _as_files(chunks: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    for c in chunks:
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary())], ["content"])


def write_arc(pages: DataFrame, folder: str, version: int = 1, date: str = "20240101000000", key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write gzipped ARC files of all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for p, u, h in zip(*batch.columns, strict=True):
                    yield arc_record(u.as_py(), date, "text/html", http_block(p.as_py(), h.as_py() or b""), version)

        yield from _as_files(_chunks(records(), lambda _: arc_head("pagemill.arc", date, version)))

    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), F.col(html).cast("string").cast("binary").alias("h"))
    write_files(rows.mapInArrow(run, "content binary"), folder, gzip=True)


def read_arc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, date, digest, size, ip, mime, http, payload) of every record; without the last two unless ``payloads``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for head, body in parse_arc(gzip.decompress(content.as_py())):
                    if head["URL"].startswith("filedesc:"):
                        continue
                    http, payload = split_http(body)
                    page = fields_of(http).get("x-page-id") if http else None
                    rows.append((int(page) if page is not None else None, head["URL"], head["Archive-date"], _sha1(payload), len(payload), head["IP-address"], head["Content-type"], http if payloads else None, payload if payloads else None))
                    size += len(body) * payloads
                    if size >= CHUNK // 2:
                        yield batched(rows)
                        rows, size = [], 0
                if rows:
                    yield batched(rows)

    def batched(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "date", "digest", "size", "ip", "mime", "http", "payload"])

    return read_files(spark, folder).select("content").mapInArrow(run, "page_id long, url string, date string, digest string, size long, ip string, mime string, http binary, payload binary")


def arc_to_warc(spark: SparkSession, arcs: str, folder: str, least: int = 1000) -> None:
    """Convert all ARC files of ``arcs`` to gzipped WARC files in ``folder``."""
    seen = settle(read_arc(spark, arcs, payloads=False).select("page_id", "url", "date", "digest", "size"), "arc-index")
    groups = seen.filter(F.col("size") >= least).groupBy("digest").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "date"))).alias("o"), F.count("*").alias("n"))
    groups = groups.select("digest", "n", F.col("o.page_id").alias("original"), F.col("o.url").alias("original_url"), F.col("o.date").alias("original_date"))
    groups = settle(groups.filter("n > 1 and original is not null"), "arc-groups")
    records = lookup_salted(read_arc(spark, arcs), groups, "digest", "n")
    # the page that is the largest itself does not revisit
    records = records.withColumn("original", F.expr("CASE WHEN NOT page_id <=> original THEN original END"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[bytes]:
            for batch in batches:
                for row in zip(*batch.columns, strict=True):
                    yield convert(*[x.as_py() for x in row])

        yield from _as_files(_chunks(rows(), info_record))

    write_files(records.select("url", "date", "page_id", "http", "payload", "digest", "original", "original_url", "original_date", "ip", "mime").mapInArrow(run, "content binary"), folder, gzip=True)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record but ``warcinfo``.

    A response's payload is measured and its digest checked; a revisit tells both in its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in parse_warc(gzip.decompress(content.as_py())):
                    kind = head["warc-type"]
                    if kind == "warcinfo":
                        continue
                    http, payload = split_http(block)
                    about = fields_of(http) if http else {}
                    if kind == "revisit":
                        size = int(about["content-length"])
                    elif _sha1(payload) == head["warc-payload-digest"]:
                        size = len(payload)
                    else:
                        raise ValueError(f"{head['warc-record-id']}: the payload does not have its digest")
                    digest = base64.b32decode(head["warc-payload-digest"].split(":")[1]).hex()
                    page = about.get("x-page-id")
                    rows.append((int(page) if page is not None else None, size, digest, kind, page_of(head["warc-refers-to"]) if "warc-refers-to" in head else None))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return read_files(spark, folder).select("content").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, version: int = 1, least: int = 1000) -> DataFrame:
    """Pages to ARC files, these to WARC files, and what those hold; all in the shared folder."""
    spark = pages.sparkSession
    arcs, warcs = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arcs, version)
    arc_to_warc(spark, arcs, warcs, least)
    return read_warc(spark, warcs)
