"""WARC records in ZIP packages: a writer, and a reader by byte ranges.

A package is a ZIP file with two stored members: ``archive/data.warc.gz``, one
gzip member for each record, and ``indexes/index.cdxj``, a line for each record
with its offset and length inside the archive.  The reader parses the central
directory (and its ZIP64 form), finds where the stored members lie in the file,
and reads records by byte range; nothing is extracted.

Records with equal payloads: the one with the largest page id is written as
``response``, the others as ``revisit`` records without payload.

Defined results: null html is an empty payload; a null url is written as
``about:blank``; a null page id sorts below every id and is read back as null;
of repeated rows with the largest id one is the response; a payload of any length
is one record; an empty table gives no package and no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import BATCH_BYTES, bound_batches, cut, scratch_path, table

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
#: A package is closed when its archive has grown past this.
PACKAGE_BYTES = 512 << 20
#: Neighbouring records are fetched together up to this many bytes.
FETCH_BYTES = 4 << 20


class Member(NamedTuple):
    name: str
    method: int
    packed: int
    size: int
    header_at: int


class ZipDirectory:
    """The members of a ZIP file, from its central directory.

    ``read_at(offset, length)`` returns bytes of a file of ``size`` bytes.
    """

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        tail_at = max(0, size - 65557 - 20)
        tail = read_at(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("not a ZIP file: no end-of-directory record")
        count, length, at = struct.unpack_from("<HLL", tail, end + 10)
        locator = end - 20
        if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
            (zip64_at,) = struct.unpack_from("<Q", tail, locator + 8)
            record = read_at(zip64_at, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("damaged ZIP64 end-of-directory record")
            count, length, at = struct.unpack_from("<QQQ", record, 32)
        self.members = self._parse(read_at(at, length), count)

    @staticmethod
    def _parse(directory: bytes, count: int) -> dict[str, Member]:
        found, at = {}, 0
        for _ in range(count):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            flags, method = struct.unpack_from("<HH", directory, at + 8)
            packed, size = struct.unpack_from("<LL", directory, at + 20)
            n_name, n_extra, n_note = struct.unpack_from("<HHH", directory, at + 28)
            (header_at,) = struct.unpack_from("<L", directory, at + 42)
            name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
            wide = iter(_zip64_values(extra))
            if size == 0xFFFFFFFF:
                size = next(wide)
            if packed == 0xFFFFFFFF:
                packed = next(wide)
            if header_at == 0xFFFFFFFF:
                header_at = next(wide)
            found[name] = Member(name, method, packed, size, header_at)
            at += 46 + n_name + n_extra + n_note
        return found

    def start(self, member: Member) -> int:
        """Where the data of a stored member begins in the file."""
        if member.method:
            raise ValueError(f"{member.name} is compressed; byte ranges need a stored member")
        header = self.read_at(member.header_at, 30)
        n_name, n_extra = struct.unpack_from("<HH", header, 26)
        return member.header_at + 30 + n_name + n_extra

    def read(self, name: str) -> bytes:
        member = self.members[name]
        return self.read_at(self.start(member), member.packed)


def _zip64_values(extra: bytes) -> list[int]:
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return list(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
        at += 4 + length
    return []


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url, payload: bytes, refers_to, revisit: bool) -> tuple[bytes, str]:
    digest = base32_sha1(payload)
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    uri = urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else "about:blank"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush(), digest


def parse_record(packed: bytes) -> dict:
    """Headers, and what the query reports, of one gzip-packed record."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    revisit = fields["warc-type"] == "revisit"
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and base32_sha1(payload) != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
    return {
        "page_id": _page(fields["warc-record-id"]),
        "url": fields["warc-target-uri"],
        "payload": None if revisit else payload,
        "payload_bytes": int(said["content-length"]) if revisit else len(payload),
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": _page(fields.get("warc-refers-to")),
    }


def _page(urn: str | None) -> int | None:
    tail = urn.strip("<>").rpartition(":")[2] if urn else "None"
    return None if tail == "None" else int(tail)


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder or file, and the path in it."""
    return pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


class PackageWriter:
    """Writes packages into a folder; each gets a name of its own.

    A task that runs twice writes other files, and only those named in the
    stored manifest of the successful attempt are ever read.
    """

    def __init__(self, folder: str, package_bytes: int = PACKAGE_BYTES):
        self.files, self.base = _files(folder)
        self.folder, self.limit = folder.rstrip("/"), package_bytes
        self.zip = None

    def add(self, *args) -> tuple[str, int] | None:
        """Write a record; the closed package's uri and record count when one fills up."""
        if self.zip is None:
            self.name = f"{uuid.uuid4().hex}.wacz"
            self.files.create_dir(self.base, recursive=True)
            self.out = self.files.open_output_stream(f"{self.base}/{self.name}")
            self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
            self.data = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
            self.at, self.lines = 0, []
        packed, digest = _record(*args)
        self.data.write(packed)
        self.lines.append(f"{self.at} {len(packed)} {digest}\n")
        self.at += len(packed)
        return self.close() if self.at >= self.limit else None

    def close(self) -> tuple[str, int] | None:
        if self.zip is None:
            return None
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.lines))
        self.zip.close()
        self.out.close()
        self.zip = None
        return f"{self.folder}/{self.name}", len(self.lines)


def roles(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html; a table's scan) with ``refers_to`` and ``revisit``.

    The response among equal payloads is found by aggregation on digests, ids and urls
    alone: the largest id, among rows that share it the first url, and among rows alike in
    all the first of the scan.  Only digests with several records are joined back, and that join may be
    split where one payload holds many rows, with or without an id.
    """
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", "html", F.sha1(body).alias("__digest"), F.monotonically_increasing_id().alias("__row"))
    keyed = keyed.withColumn("__page", F.coalesce(F.col("page_id"), F.lit(-(1 << 63)).cast("long")))
    shared = (
        keyed.where(F.octet_length(F.coalesce(F.col("html"), F.lit(""))) >= smallest)
        .groupBy("__digest", "__page")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("url", "__row")).alias("first"))
        .groupBy("__digest")
        .agg(F.max_by(F.struct("__page", "first"), "__page").alias("top"), F.sum("n").alias("n"))
        .where("n > 1")
        .select("__digest", F.col("top.__page").alias("__best"), F.col("top.first.__row").alias("__first"))
    )
    joined = keyed.join(cut(shared, "warc-shared"), "__digest", "left")
    revisit = F.coalesce(F.col("__row") != F.col("__first"), F.lit(False))
    target = F.when(revisit & (F.col("__best") > -(1 << 63)), F.col("__best"))
    return joined.select("page_id", "url", "html", target.alias("refers_to"), revisit.alias("revisit"))


def write_packages(pages: DataFrame, folder: str, smallest: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write ``pages`` as packages; returns the stored manifest (package, records)."""
    bound_batches(pages.sparkSession)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = PackageWriter(folder, package_bytes), []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit"))):
                page_id, url, html, refers_to, revisit = row
                done.append(writer.add(page_id, url, (html or "").encode(), refers_to, revisit))
        done.append(writer.close())
        done = [x for x in done if x]
        yield pa.RecordBatch.from_pydict({"package": [x[0] for x in done], "records": [x[1] for x in done]})

    return cut(roles(pages, smallest).mapInArrow(write, "package string, records long"), "warc-manifest")


FIELDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_packages(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """Every record of the packages named in ``manifest``, with its payload unless that isn't asked for."""
    packages = max(1, manifest.count())
    fields = FIELDS if payload else FIELDS.replace("payload binary, ", "")
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in fields.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("package").to_pylist():
                yield from _bounded(_read_package(uri), schema)

    return manifest.repartition(packages).mapInArrow(run, fields)


def _bounded(records: Iterable[dict], schema: pa.Schema, rows: int = 500, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """``records`` in batches of at most ``rows`` and about ``most`` bytes of payload, or of one record."""
    held: list[dict] = []
    size = 0
    for record in records:
        more = len(record["payload"]) if "payload" in schema.names else 0
        if held and (len(held) == rows or size + more > most):
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
        held.append({n: record[n] for n in schema.names})
        size += more
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _read_package(uri: str) -> Iterator[dict]:
    files, path = _files(uri)
    with files.open_input_file(path) as source:

        def read_at(offset: int, length: int) -> bytes:
            source.seek(offset)
            return source.read(length)

        directory = ZipDirectory(read_at, source.size())
        start = directory.start(directory.members[ARCHIVE])
        ranges = [tuple(map(int, line.split()[:2])) for line in directory.read(INDEX).decode().splitlines()]
        at = 0
        while at < len(ranges):
            first, end, to = ranges[at][0], sum(ranges[at]), at + 1
            while to < len(ranges) and ranges[to][0] == end and end - first < FETCH_BYTES:
                end += ranges[to][1]
                to += 1
            chunk = read_at(start + first, end - first)
            for offset, length in ranges[at:to]:
                yield parse_record(chunk[offset - first : offset - first + length])
            at = to


def op5_zip_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to packages in the shared folder and read them back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    manifest = write_packages(pages, scratch_path(spark, "op5-packages"))
    return read_packages(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
    row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS rn,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best
  FROM pages
), q AS (
  SELECT *, [('0x' || substr(hex, i * 5 + 1, 5))::INTEGER for i in range(8)] AS fives FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (fives[i // 4 + 1] >> (15 - 5 * (i % 4))) % 32 + 1, 1)
    for i in range(32)], '') AS payload_digest,
  CASE WHEN rn = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN rn > 1 THEN best END AS refers_to
FROM q
"""
