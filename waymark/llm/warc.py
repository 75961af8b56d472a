"""WARC archives out of legacy ARC archives.

Pages are stored as ARC files, of version 1 or 2; the converter reads those: it takes the layout of header
lines from each file's version block, cuts records by their declared lengths, and gives every record the WARC
identifier, timestamp, type and digests it would have had.  Records whose payload equals that of a
later page become revisits.  All files are written and read by Spark (:mod:`waymark.llm.binary_files`), gzip-compressed, in
pieces of bounded size.

Each ARC record is followed by the line feed the format asks for, each WARC record by
its two CRLF, of which the last byte is the line feed that Spark's writer adds.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.binary_files import read_files, write_records
from waymark.llm.common import BROADCAST_BYTES, batches
from waymark.session import materialize, scratch_path

#: Payload bytes of a file, about, before compression.
FILE_BYTES = 16 << 20
#: Payloads below so many bytes are stored again rather than referred to.
REVISIT_BYTES = 1000
#: Archive date of pages that carry none.
ARCHIVED = "20000101000000"

# Fixed values of the formats: header fields of the ARC versions by their version line.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.NAMESPACE_URL


def arc_head(name: str, version: int, date: str) -> bytes:
    """The version block a file starts with."""
    body = f"{version} 0 waymark\n{ARC_FIELDS[version]}\n".encode()
    first = f"filedesc://{name} 0.0.0.0 {date} text/plain "
    if version == 2:
        first += f"200 - - 0 {name} "
    return f"{first}{len(body)}\n".encode() + body


def arc_record(url: str, page_id: int | None, payload: bytes, version: int, name: str, offset: int) -> bytes:
    """One record: header line, then the server's answer."""
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if page_id is not None:
        head += f"X-Page-Id: {page_id}\r\n"
    block = f"{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    line = f"{url} 0.0.0.0 {ARCHIVED} text/html "
    if version == 2:
        line += f"200 {hashlib.md5(payload).hexdigest()} - {offset} {name} "
    return f"{line}{len(block)}\n".encode() + block


def safe_url(url: str | None, page_id: int | None) -> str:
    """A URL without white space or control characters; pages without one are named by their id."""
    text = (url or "").strip()
    if not text:
        return f"urn:page:{page_id if page_id is not None else 'none'}"
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text)


def _to_arc(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of pages as the records of one ARC file, its version block first."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId()
    name, version = f"part-{number:05d}.arc", 1 + number % 2
    head = arc_head(name, version, ARCHIVED)
    offset, started = len(head) + 1, False
    for batch in batches(rows, 256):
        records = [] if started else [head]
        started = True
        for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            record = arc_record(safe_url(url, page_id), page_id, (html or "").encode("utf-8", "surrogatepass"), version, name, offset)
            offset += len(record) + 1
            records.append(record)
        yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])


def parse_arc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of an ARC file, the version block excepted."""
    at, fields = 0, None
    while at < len(content):
        if content[at] == 10:  # separators between records
            at += 1
            continue
        line_end = content.index(b"\n", at)
        values = content[at:line_end].decode("utf-8", "replace").split(" ")
        size = int(values[-1])
        block = content[line_end + 1 : line_end + 1 + size]
        if len(block) < size:
            raise ValueError(f"the record at byte {at} is cut off")
        at = line_end + 1 + size
        if fields is None:
            version = int(block.split(b" ", 1)[0])
            layout = block.split(b"\n")[1].decode().split(" ") if block.count(b"\n") > 1 else []
            fields = layout or ARC_FIELDS[version].split(" ")
            continue
        yield dict(zip(fields, header_values(values, fields), strict=True)), block


def inflate(content: bytes) -> bytes:
    """All members of a gzip file, one after the other; what is not gzip stays as it is."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts, rest = [], content
    while rest[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(rest))
        if not member.eof:
            raise ValueError("a gzip member is cut off")
        rest = member.unused_data
    if rest.strip(b"\0"):
        raise ValueError("no gzip member where the last one ends")
    return b"".join(parts)


def header_values(values: list[str], fields: list[str]) -> list[str]:
    """One value for each field: a content type may hold spaces, so what stands right of it counts from the end."""
    at = next((i for i, f in enumerate(fields) if f.lower() == "content-type"), -1)
    extra = len(values) - len(fields)
    if extra < 0 or (extra and at < 0):
        raise ValueError(f"{len(values)} header fields where the version has {len(fields)}")
    return values if not extra else [*values[:at], " ".join(values[at : at + extra + 1]), *values[at + extra + 1 :]]


def warc_date(date: str) -> str:
    """An ARC date of 14 digits (or 12 in the first version) as WARC writes it."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


_PARSED = (
    "file string, place int, record_id string, url string, date string, head binary, payload binary,"
    " payload_bytes long, sha1 string, page_id long"
)


def _convert(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, content of ARC files -> their records as WARC needs them."""
    for batch in rows:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            name, out = path.rsplit("/", 1)[-1], []
            for place, (fields, block) in enumerate(parse_arc(inflate(content.as_py()))):
                head, _, payload = block.partition(b"\r\n\r\n")
                page = re.search(rb"(?i)^X-Page-Id: *(-?\d+)", head, re.M)
                record_id = uuid.uuid5(_NAMESPACE, f"{name}#{place}")
                out.append(
                    (
                        name, place, f"<urn:uuid:{record_id}>", fields["URL"], warc_date(fields["Archive-date"]), head, payload,
                        len(payload), hashlib.sha1(payload).hexdigest(), int(page[1]) if page else None,
                    )
                )
                if len(out) == 256:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "long": pa.int64()}
    names, kinds = zip(*(c.split(" ") for c in _PARSED.split(", ")), strict=True)
    columns = [pa.array(c, types[t]) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=list(names))


#: Extension header: revisits leave the payload out, and an answer need not tell its length.
PAYLOAD_LENGTH = "X-Payload-Length"


def digest(sha1: str) -> str:
    """A digest as WARC writes it."""
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the last byte of the CRLF CRLF behind it."""
    lines = [WARC_VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r"


def _to_warc(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records as WARC; those with ``original`` are revisits of it."""
    for batch in batches(rows, 128):
        out = []
        for r in batch.to_pylist():
            headers = [
                ("WARC-Type", "revisit" if r["original"] else "response"),
                ("WARC-Record-ID", r["record_id"]),
                ("WARC-Date", r["date"]),
                ("WARC-Target-URI", r["url"]),
                ("Content-Type", "application/http; msgtype=response"),
                ("WARC-Payload-Digest", digest(r["sha1"])),
                (PAYLOAD_LENGTH, str(r["payload_bytes"])),
            ]
            block = r["head"] + b"\r\n\r\n"
            if r["original"]:
                headers += [("WARC-Refers-To", r["original"]), ("WARC-Profile", REVISIT_PROFILE)]
            else:
                block += r["payload"]
            headers.append(("WARC-Block-Digest", digest(hashlib.sha1(block).hexdigest())))
            out.append(warc_record(headers, block))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of every record of a WARC file."""
    at = 0
    while at < len(content):
        head_end = content.find(b"\r\n\r\n", at)
        lines = content[at:head_end].decode("utf-8", "replace").split("\r\n")
        if head_end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = head_end + 4
        end = start + int(headers["content-length"])
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield headers, content[start:end]
        at = end + 4


def _length(headers: dict[str, str], http: dict[str, str]) -> int | None:
    """The payload length a revisit tells, if it does."""
    told = headers.get(PAYLOAD_LENGTH.lower(), http.get("content-length", ""))
    return int(told) if told.isdigit() else None


def _from_warc(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "page_id", "url", "date", "record_type", "refers_to_id", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]
    for batch in rows:
        for content in batch.column("content"):
            out = []
            for headers, block in parse_warc(inflate(content.as_py())):
                head, _, payload = block.partition(b"\r\n\r\n")
                http = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
                sha1 = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                stored = headers["warc-type"] == "response"
                if stored and hashlib.sha1(payload).hexdigest() != sha1:
                    raise ValueError(f"{headers['warc-record-id']} does not have its digest")
                page = http.get("x-page-id")
                out.append(
                    (
                        headers["warc-record-id"], None if page is None else int(page), headers["warc-target-uri"], headers["warc-date"],
                        headers["warc-type"], headers.get("warc-refers-to"), len(payload) if stored else _length(headers, http), sha1, payload if stored else None,
                    )
                )
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def write_arc(pages: DataFrame, path: str) -> None:
    """Pages (page_id, url, html) as ARC files of both versions."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    size = pages.agg(F.sum(F.octet_length("html") + 200)).first()[0] or 0
    files = max(1, -(-size // FILE_BYTES))
    # Rows are dealt by content and id, so a repeated task writes the same file.
    dealt = pages.repartition(files, F.xxhash64("page_id", "url"))
    write_records(dealt.mapInArrow(_to_arc, "record binary"), "record", path, compression="gzip")


def convert_arc(spark: SparkSession, arc: str, path: str) -> None:
    """WARC files, one for each ARC file under ``arc``, with revisits of equal payloads.

    Of records with equal payloads of ``REVISIT_BYTES`` or more, that with the
    largest page_id (then record id) is the response.
    """
    records = read_files(spark, arc).mapInArrow(_convert, _PARSED)
    large = records.where(F.col("payload_bytes") >= REVISIT_BYTES)
    groups = large.groupBy("sha1", "payload_bytes").agg(
        F.max(F.struct("page_id", "record_id")).alias("last"), F.count("*").alias("n")
    )
    originals = groups.where("n > 1").selectExpr("sha1 as s", "payload_bytes as size", "last.record_id as original")
    originals = materialize(originals, "originals")
    small = originals.count() * 160 <= BROADCAST_BYTES
    joined = records.join(
        F.broadcast(originals) if small else originals, (F.col("sha1") == F.col("s")) & (F.col("payload_bytes") == F.col("size")), "left"
    )
    original = F.when(F.col("original") != F.col("record_id"), F.col("original")).alias("original")
    columns = ["record_id", "url", "date", "head", "payload", "payload_bytes", "sha1", original]
    write_records(joined.select(*columns).mapInArrow(_to_warc, "record binary"), "record", path, compression="gzip")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the WARC files: its headers, the page's id and the payload (null for revisits).

    The digest of every stored payload is checked; a damaged file raises.
    """
    schema = (
        "record_id string, page_id long, url string, date string, record_type string, refers_to_id string,"
        " payload_bytes long, payload_digest string, payload binary"
    )
    return read_files(spark, path).mapInArrow(_from_warc, schema)


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages as ARC, convert them to WARC, and read that back, with ``refers_to`` (page_id of the response).

    One record for each row; null html is an empty payload, a null url becomes a name made of the id.  Rows
    that repeat a page_id are records of their own.  Other columns are ignored, an empty table gives no records.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "archive")
    write_arc(pages, f"{path}/arc")
    convert_arc(spark, f"{path}/arc", f"{path}/warc")
    records = read_warc(spark, f"{path}/warc")
    known = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return records.join(known, "refers_to_id", "left")
