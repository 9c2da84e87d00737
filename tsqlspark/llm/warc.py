"""Legacy archive converter: ARC archives to WARC archives, and both formats' readers.

An ARC archive is a version block, whose second line names the version and whose third the fields of a record's header
line, followed by records of such a line and as many bytes of content as the line's last field declares.  The converter
reads archives of version 1 and 2, and writes for every record an equivalent WARC record: identifier from the record's
address, date and content, timestamp from the 14-digit date, type from the content, SHA-1 digests of block and payload,
and a revisit record without content, which names the record it refers to, for a payload that another record holds.

Records are compressed in gzip members of about ``MEMBER_BYTES``, and an archive holds about ``ARCHIVE_BYTES`` (or one
longer record).  Spark's text sink writes each archive as a file and its binary source reads it back whole, up to its limit of
2 GB a file; all file access is Spark's.  An archive is parsed for its digests and once more when it is converted: its
contents are not shuffled, only moved compressed to the decisions on its records.
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

from .common import join_counted, scratch_root, written

#: Content bytes after which an archive is closed, so that a whole archive fits in memory.
ARCHIVE_BYTES = 1 << 22
#: Content bytes after which a gzip member is closed, and how hard it is packed.
MEMBER_BYTES, LEVEL = 1 << 17, 3
#: The names of the header line's fields in the two versions of the format.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
DATE = "19970801000000"
#: An empty gzip member.  Its last byte is left to the text sink, which ends every line, and so every archive, with it.
_LAST_MEMBER = zlib.compressobj(LEVEL, zlib.DEFLATED, 31).flush()
_END = "\x00"
#: Packed bytes that are looked at together.
_STEP = 1 << 14


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _members(records: list[bytes]) -> Iterator[bytes]:
    """The gzip members of whole records."""
    lo, size = 0, 0
    for hi, record in enumerate(records, 1):
        size += len(record)
        if size >= MEMBER_BYTES or hi == len(records):
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            yield packer.compress(b"".join(records[lo:hi])) + packer.flush()
            lo, size = hi, 0


def _unpacked(data: bytes) -> bytes:
    """The members of a gzip archive one after the other; data of any other kind as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    view, at, out = memoryview(data), 0, []
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a gzip member")
            part = view[at : at + _STEP]
            out.append(member.decompress(part))
            at += len(part)
        at -= len(member.unused_data)
    return b"".join(out)


def _archive_batch(records: list[bytes]) -> pa.RecordBatch:
    """An archive of the records as one value; bytes of any encoding pass through the text sink as they are."""
    _, offsets, data = pa.array([b"".join([*_members(records), _LAST_MEMBER[:-1]])], pa.binary()).buffers()
    return pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(1, offsets, data)], names=["value"])


def _write_archives(archives: DataFrame, path: str) -> None:
    archives.write.option("maxRecordsPerFile", 1).option("lineSep", _END).text(path)


# ---------------------------------------------------------------------------------------------------------------------
# ARC


def arc_version_block(version: int, name: str) -> str:
    """The first record of an archive, without the line feed that ends every record."""
    body = f"{version} 0 corpus\n{' '.join(ARC_FIELDS[version])}\n"
    fields = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": DATE, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]) + "\n" + body


def arc_record(version: int, name: str, url: str | None, page_id: int | None, html: str, offset: int) -> str:
    head = "HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Page-Id: {page_id}\r\n" if page_id is not None else "") + "\r\n"
    address = re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"
    content = head + html
    size = len(content.encode())
    fields = {"URL": address, "IP-address": "0.0.0.0", "Archive-date": DATE, "Content-type": "text/html", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(size)}
    return " ".join(fields[f] for f in ARC_FIELDS[version]) + "\n" + content


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive: header fields by name, content.  The version block comes first.

    Lengths are taken as declared; blank lines between records are passed over.  A header line with more fields than the
    version names has spaces in its address.  Raises ValueError on an unknown version, a bad line or a short record.
    """
    at, names = 0, None
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        if end < 0 or not line.rpartition(" ")[2].isdigit():
            raise ValueError(f"not an ARC header line at byte {at}: {line[:80]!r}")
        size = int(line.rpartition(" ")[2])
        content = data[end + 1 : end + 1 + size]
        if len(content) < size:
            raise ValueError(f"record at byte {at} declares {size} bytes, {len(content)} are left")
        if names is None:
            version = content.split(b" ", 1)[0]
            if version not in (b"1", b"2") or not line.startswith("filedesc:"):
                raise ValueError("no ARC version block")
            names = ARC_FIELDS[int(version)]
        parts = line.split(" ")
        spare = len(parts) - len(names)
        if spare < 0:
            raise ValueError(f"header line at byte {at} has {len(parts)} fields, {len(names)} are named")
        parts = [" ".join(parts[: spare + 1]), *parts[spare + 1 :]]
        yield dict(zip(names, parts, strict=True)), content
        at = end + 1 + size


def split_http(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Lower-case headers, the header bytes and the payload of an HTTP response; any other content is all payload."""
    end = content.find(b"\r\n\r\n")
    if not content.startswith(b"HTTP/") or end < 0:
        return {}, b"", content
    lines = content[:end].decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, content[: end + 4], content[end + 4 :]


def write_arc(pages: DataFrame, path: str) -> None:
    """``pages`` (page_id, url, html) as ARC archives of versions 1 and 2 under ``path``; null html is empty."""

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        version, name, offset = 0, "", 0
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if offset >= ARCHIVE_BYTES:
                    yield _archive_batch(held)
                    held = []
                if not held:
                    version = version % 2 + 1
                    name = f"{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {version}').hex}.arc"
                    record = arc_version_block(version, name).encode() + b"\n"
                    held, offset = [record], len(record)
                record = arc_record(version, name, url, page_id, html or "", offset).encode() + b"\n"
                held.append(record)
                offset += len(record)
        if held:
            yield _archive_batch(held)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    _write_archives(rows.mapInArrow(archives, "value string"), path)


# ---------------------------------------------------------------------------------------------------------------------
# WARC


def stamped(date: str) -> str:
    """The WARC timestamp of a date of up to 14 digits."""
    date = date.ljust(14, "0")
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def record_id(url: str, date: str, page: str | None, digest: str) -> str:
    """The same for the same address, date, page and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {stamped(date)} {page} {digest}')}>"


def warc_record(fields: dict[str, str], content: bytes, first: tuple[int, str, str] | None) -> bytes:
    """The WARC record equivalent to an ARC record, without the two line ends that end every record.

    ``first``: page, address and date of the record with the same payload that this one is a revisit of, if it is one.
    """
    http, head, payload = split_http(content)
    page, url = http.get("x-page-id"), fields["URL"]
    digest = base32_sha1(payload)
    kind = "warcinfo" if url.startswith("filedesc:") else "revisit" if first else "response" if head else "resource"
    block = head if first else content
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(url, fields['Archive-date'], page, digest)}", f"WARC-Date: {stamped(fields['Archive-date'])}"]
    if kind == "warcinfo":
        lines.append(f"WARC-Filename: {url.rpartition('/')[2]}")
    else:
        lines += [f"WARC-Target-URI: {url}", f"WARC-IP-Address: {fields['IP-address']}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
        if page is not None:
            lines.append(f"X-Page-Id: {page}")
    if first:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(first[1], first[2], str(first[0]), digest)}", f"WARC-Refers-To-Target-URI: {first[1]}", f"WARC-Refers-To-Date: {stamped(first[2])}",
            f"X-Refers-To-Page: {first[0]}",
        ]
    mime = "application/warc-fields" if kind == "warcinfo" else "application/http;msgtype=response" if head else fields["Content-type"]
    lines += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Type: {mime}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive: header fields by lower-case name, block.  Raises ValueError on a bad or short record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"record at byte {at} declares {size} bytes, {len(block)} are left")
        yield fields, block
        at = end + 4 + size + 4


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every archive."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Convert the ARC archives under ``arc_path`` into WARC archives under ``warc_path``.

    Of records with equal payloads that with the smallest page number is written whole, the others as its revisits; a
    record without a number revisits one that has one.  Digests are grouped and joined without contents, a digest of many
    records by broadcast; the decisions on an archive's records are brought together by its path.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(*(c for c in batch.columns), strict=True):
                rows = []
                for n, (fields, content) in enumerate(parse_arc(_unpacked(data.as_py()))):
                    if not fields["URL"].startswith("filedesc:"):
                        http, _, payload = split_http(content)
                        rows.append((path.as_py(), n, hashlib.sha1(payload).digest(), int(http["x-page-id"]) if "x-page-id" in http else None, fields["URL"], fields["Archive-date"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["path", "n", "digest", "page", "url", "date"])

    thin = written(_archives(spark, arc_path).mapInArrow(digests, "path string, n int, digest binary, page long, url string, date string"), "digests")
    named = F.when(F.col("page").isNotNull(), F.struct("page", "url", "date"))
    firsts = thin.groupBy("digest").agg(F.min(named).alias("first"), F.count("*").alias("rows")).where("rows > 1 and first is not null")
    again = join_counted(thin.select("path", "n", "digest", "page"), firsts, "digest").where("page is null or page <> first.page")
    decided = again.groupBy("path").agg(F.collect_list(F.struct("n", "first.*")).alias("again"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, again in zip(*(c for c in batch.columns), strict=True):
                first = {x["n"]: (x["page"], x["url"], x["date"]) for x in again.as_py() or []}
                yield _archive_batch([warc_record(*record, first.get(n)) + b"\r\n\r\n" for n, record in enumerate(parse_arc(_unpacked(data.as_py())))])

    _write_archives(_archives(spark, arc_path).join(decided, "path", "left").select("content", "again").mapInArrow(render, "value string"), warc_path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_id, date, record_type, payload_bytes, payload_digest, refers_to, refers_to_id) of response and revisit records.

    Block digests, and payload digests where the payload is there, are computed anew; a mismatch raises.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                out = []
                for f, block in parse_warc(_unpacked(data.as_py())):
                    if f["warc-type"] not in ("response", "revisit", "resource"):
                        continue
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    payload = split_http(block)[2]
                    if f["warc-block-digest"] != f"sha1:{base32_sha1(block)}" or f["warc-type"] != "revisit" and base32_sha1(payload) != digest:
                        raise ValueError(f"digest mismatch in {f['warc-record-id']}")
                    size = int(f["x-payload-length"]) if f["warc-type"] == "revisit" else len(payload)
                    page, first = f.get("x-page-id"), f.get("x-refers-to-page")
                    out.append((int(page) if page else None, f["warc-target-uri"], f["warc-record-id"], f["warc-date"], f["warc-type"], size, digest, int(first) if first else None, f.get("warc-refers-to")))
                types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["page_id", "url", "record_id", "date", "record_type", "payload_bytes", "payload_digest", "refers_to", "refers_to_id"])

    return _archives(spark, path).select("content").mapInArrow(rows, "page_id long, url string, record_id string, date string, record_type string, payload_bytes long, payload_digest string, refers_to long, refers_to_id string")


def archive_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) written as ARC archives, converted to WARC archives and read back.

    One row for each page, as ``read_warc`` gives it.  Null html is an empty payload, a null address "-"; rows that
    repeat a page are records of their own, all whole or all revisits.  Other columns are ignored; no pages, no rows.
    """
    spark = pages.sparkSession
    root = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    write_arc(pages, f"{root}-arc")
    convert(spark, f"{root}-arc", f"{root}-warc")
    return read_warc(spark, f"{root}-warc")
