"""Legacy archive conversion: ARC 1 and 2 files to WARC records, and back to rows.

An archive is a row of bytes in a table, one file each, bounded in size; every record is a gzip member of its own, as in
.arc.gz and .warc.gz files. The converter reads the version block for the field names of that version, takes each
record's declared length, and makes the WARC record from it: identifier, timestamp, type and digests. Records with equal
payloads are written in full once and as revisits elsewhere; which one is full is decided by a grouped minimum over
digests, so no payload is compared with another.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: The URL record lines of the two ARC versions.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
DATE = "20240101000000"
#: Uncompressed bytes at which an archive is closed.
ARCHIVE_BYTES = 8 << 20
LEAST_REVISIT = 100
_LIMIT = re.compile(r"\s")


def _member(data: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def version_block(name: str, version: int) -> bytes:
    """The first record of an ARC file: its own line in the form of version 1, then the version and the field names."""
    body = f"{version} 0 tidemark\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    return f"filedesc://{name} 0.0.0.0 {DATE} text/plain {len(body)}\n".encode() + body


def arc_record(url: str, content: bytes, version: int, name: str, offset: int, date: str = DATE, ip: str = "0.0.0.0", kind: str = "text/html") -> bytes:
    fields = [url, ip, date, kind]
    if version == 2:
        fields += ["200", hashlib.md5(content).hexdigest(), "-", str(offset), name]
    return " ".join([*fields, str(len(content))]).encode("utf-8", "surrogatepass") + b"\n" + content + b"\n"


def http(body: bytes, page: int | None) -> bytes:
    """The archived response: status line, headers, body. The page's number is a header."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body


def read_arc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields and content of each record of an ARC file, after its version block. Also plain (not gzipped) files."""
    source = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    names = None
    while line := source.readline():
        if not line.strip():
            continue
        values = line.rstrip(b"\r\n").decode("utf-8", "surrogatepass").split(" ")
        length = int(values[-1])
        content = source.read(length)
        if len(content) != length:
            raise ValueError("record shorter than its declared length")
        if names is None:
            if not values[0].startswith("filedesc://"):
                raise ValueError("no version block")
            version = int(content.split(b" ", 1)[0])
            names = ARC_FIELDS[version]
            if tuple(content.split(b"\n")[1].decode().split(" ")) != names:
                raise ValueError("field names that the version doesn't have")
            continue
        if len(values) != len(names):
            raise ValueError("header line with another number of fields than its version")
        yield dict(zip(names, values)), content


def split_http(content: bytes) -> tuple[dict, bytes]:
    head, _, body = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body


def warc_record(header: dict, content: bytes, kind: str, refers_to: int | None) -> bytes:
    """The WARC record of an ARC record. A revisit keeps the HTTP headers alone; digests and length are of the full payload."""
    own, body = split_http(content)
    page = own.get("x-page-id", "")
    at = datetime.strptime(header["Archive-date"], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)
    block = content if kind == "response" else content[: len(content) - len(body)]
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(page, header['URL'])}>", f"WARC-Date: {at:%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {header['URL']}", f"WARC-IP-Address: {header['IP-address']}", f"WARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"X-Page-Id: {page}", f"X-Payload-Length: {len(body)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page: str, url: str) -> str:
    """The same record gets the same identifier at every run."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page} {url}").urn


def read_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Headers (lower case) and block of each record of a WARC file, gzipped by record or plain; block digests are verified."""
    source = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC version line")
        headers = {}
        while (line := source.readline()).strip():
            k, _, v = line.decode("utf-8", "surrogatepass").partition(":")
            headers[k.strip().lower()] = v.strip()
        block = source.read(int(headers["content-length"]))
        if headers.get("warc-block-digest", "").removeprefix("sha256:") not in ("", hashlib.sha256(block).hexdigest()):
            raise ValueError("block digest differs")
        yield headers, block


def _files(records: Iterator[bytes]) -> Iterator[bytes]:
    """Files of gzipped records, each closed at ARCHIVE_BYTES."""
    held, size = [], 0
    for r in records:
        held.append(_member(r))
        size += len(r)
        if size >= ARCHIVE_BYTES:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def write_arc(pages: DataFrame) -> DataFrame:
    """Archives (name, version, data) of page_id, url and html; versions 1 and 2 alternate. Blanks of a URL are percent-encoded, a null URL is "-"."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, version, size = 0, 1, 0
        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal number, version, held, size
            data, name = b"".join(held), f"part-{TaskContext.get().partitionId():05d}-{number:05d}.arc.gz"
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([version], pa.int32()), pa.array([data], pa.binary())], names=["name", "version", "data"])
            number, version, held, size = number + 1, 3 - version, [], 0
            return out

        for batch in batches:
            for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if not held:
                    held.append(_member(version_block(f"part-{number}", version)))
                content = http((html.as_py() or "").encode("utf-8", "surrogatepass"), page)
                url = _LIMIT.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "-")
                record = arc_record(url, content, version, f"part-{number}", size)
                held.append(_member(record))
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield close()
        if held:
            yield close()

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(work, "name string, version int, data binary")


def _bounded(rows: Iterator[tuple], types: list[tuple[str, pa.DataType]], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose sizes (the first value of each row) sum up to ``most``."""
    held, size = [], 0
    for n, *row in rows:
        held.append(row)
        size += n
        if size >= most or len(held) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), types)], names=[n for n, _ in types])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), types)], names=[n for n, _ in types])


def arc_records(archives: DataFrame, contents: bool = True) -> DataFrame:
    """One row per ARC record: page, digest and length of its payload, and the record itself (header line fields and content, compressed).

    Without ``contents`` they are null: what only counts digests needn't compress them."""
    types = [("page", pa.int64()), ("digest", pa.string()), ("n", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("content", pa.binary())]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for data in batch.column(0):
                for header, content in read_arc(data.as_py()):
                    own, body = split_http(content)
                    page = own.get("x-page-id")
                    yield len(content), int(page) if page else None, hashlib.sha256(body).hexdigest(), len(body), header["URL"], header["IP-address"], header["Archive-date"], _member(content, 1) if contents else None

    return archives.select("data").mapInArrow(lambda b: _bounded(each(b), types, 4 << 20), "page long, digest string, n long, url string, ip string, date string, content binary")


def convert(archives: DataFrame) -> DataFrame:
    """WARC archives (data) of ARC archives. Equal payloads of at least LEAST_REVISIT bytes: the smallest page is the response."""
    records = arc_records(archives)
    first = arc_records(archives, contents=False).filter(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("copies"))
    first = settle(first.filter("copies > 1"), "first-pages").select("digest", "first")
    again = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    decided = records.join(first, "digest", "left").withColumn("first", F.when(again, F.col("first")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[bytes]:
            for batch in batches:
                cols = [batch.column(c) for c in ("url", "ip", "date", "content", "first")]
                for url, ip, date, content, to in zip(*cols):
                    to = to.as_py()
                    header = {"URL": url.as_py(), "IP-address": ip.as_py(), "Archive-date": date.as_py()}
                    yield warc_record(header, zlib.decompress(content.as_py(), 31), "response" if to is None else "revisit", to)

        for data in _files(each()):
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

    return decided.select("url", "ip", "date", "content", "first").mapInArrow(work, "data binary")


def read_back(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of every record; a response's payload is verified against its digest."""
    types = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for data in batch.column(0):
                for h, block in read_warc(data.as_py()):
                    digest, n = h["warc-payload-digest"].removeprefix("sha256:"), int(h["x-payload-length"])
                    if h["warc-type"] == "response":
                        body = split_http(block)[1]
                        if hashlib.sha256(body).hexdigest() != digest or len(body) != n:
                            raise ValueError("payload differs from its digest")
                    to = h.get("x-refers-to-page-id")
                    yield 200, int(h["x-page-id"]) if h["x-page-id"] else None, n, digest, h["warc-type"], int(to) if to else None, h["warc-target-uri"]

    return archives.select("data").mapInArrow(lambda b: _bounded(each(b), types, 1 << 20), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as ARC archives, convert them to WARC archives, read those back: one row per page.

    Page ids are integers; pages of any length are written whole. Null html is an empty payload, a null url "-". Null page ids are kept; of equal payloads, rows with an id go before
    those without. Repeated rows of the response's id are responses too. An empty table gives an empty result; other
    columns are ignored. Both sets of archives are tables in the shared folder.
    """
    return read_back(settle(convert(settle(write_arc(pages), "arc")), "warc"))


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""
