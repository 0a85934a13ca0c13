"""Web archives: WARC records packed into ZIP files, read back by byte ranges without extraction.

Each archive is a ZIP whose members are stored, not compressed: ``archive/data.warc.gz`` (every
record its own gzip member), ``indexes/index.cdxj`` (one line a record: page id, offset, length) and
``datapackage.json``. The reader finds the end record, follows the ZIP64 locator where there is one,
parses the central directory, locates the stored members, and reads each record by its own range.

Archives are files below a folder that all executors share, written and read by the tasks through
Arrow's file systems (local paths, HDFS, S3, GCS). A file is named by its content and only counts once
its row is in the manifest, so an attempt that is lost leaves nothing that is read. Records are read
by ranges: neighbours in the index in one request of about ``RANGE_BYTES``. For stores that Arrow does
not know, archives can travel as binary rows (id, content) instead.

Defined results: null html is an empty payload; of rows with equal payloads those with the smallest
page id are responses and the others revisit it; rows without a page id revisit a page that has one,
and are responses where none has; line breaks in a URL are dropped; a null URL is empty; pages of any
length are one record; a page id that is no whole number is read back as null; an archive that is
listed twice gives its records twice; other columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandex.runtime import shared_path, stage

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
ARCHIVE_BYTES = 8 << 20
RANGE_BYTES = 1 << 20
ARCHIVES_A_TASK = 8
DATE = "2000-01-01T00:00:00Z"
MIN_REVISIT_BYTES = 0


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member with a response, or a revisit whose block ends with the HTTP headers."""
    digest = digest32(payload)
    clean = " ".join((url or "").split())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def build_archive(records: list[tuple[int | None, bytes]], zip64: bool = False) -> bytes:
    """The ZIP of some records; ``zip64`` writes 64-bit member headers even where 32 bits suffice."""
    lines, at = [], 0
    for page_id, member in records:
        lines.append(f"{'-' if page_id is None else page_id} {json.dumps({'offset': at, 'length': len(member)})}")
        at += len(member)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as pack:
        for name, parts in ((DATA, [m for _, m in records]), (INDEX, ["\n".join(lines).encode()]), (PACKAGE, [json.dumps({"profile": "data-package", "resources": [DATA, INDEX]}).encode()])):
            with pack.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as member:
                for part in parts:
                    member.write(part)
    return out.getvalue()


class ZipRanges:
    """Members of a ZIP that is only read by ranges: ``read_at(offset, length)`` over ``size`` bytes."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at, self.size = read_at, size
        self.members = {name: (method, packed, offset) for name, method, packed, offset in self._directory()}

    @classmethod
    def of_bytes(cls, content: bytes) -> ZipRanges:
        view = memoryview(content)
        return cls(lambda at, n: bytes(view[at : at + n]), len(content))

    @classmethod
    def of_file(cls, uri: str) -> ZipRanges:
        """A path, or a URI of a store that Arrow knows."""
        system, path = fs.FileSystem.from_uri(uri)
        file = system.open_input_file(path)
        return cls(lambda at, n: file.read_at(n, at), file.size())

    def _end_record(self) -> tuple[int, int, int]:
        """(entries, size, offset) of the central directory."""
        tail_at = max(0, self.size - 65557)
        tail = self.read_at(tail_at, self.size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory record")
        entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
        if entries == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
            locator = self.read_at(tail_at + at - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            wide = self.read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
            if wide[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            entries, size, offset = struct.unpack_from("<QQQ", wide, 32)
        return entries, size, offset

    def _directory(self) -> Iterator[tuple[str, int, int, int]]:
        entries, size, offset = self._end_record()
        central, at = self.read_at(offset, size), 0
        for _ in range(entries):
            if central[at : at + 4] != b"PK\x01\x02":
                raise ValueError("bad central directory entry")
            flags, method = struct.unpack_from("<HH", central, at + 8)
            packed, plain, name_len, extra_len, note_len = struct.unpack_from("<IIHHH", central, at + 20)
            header = struct.unpack_from("<I", central, at + 42)[0]
            name = central[at + 46 : at + 46 + name_len].decode("utf-8" if flags & 0x800 else "cp437")
            extra, x = central[at + 46 + name_len : at + 46 + name_len + extra_len], 0
            while x + 4 <= len(extra):
                tag, length = struct.unpack_from("<HH", extra, x)
                if tag == 1:  # the fields that did not fit, in this order
                    wide, y = extra[x + 4 : x + 4 + length], 0
                    if plain == 0xFFFFFFFF:
                        y += 8
                    if packed == 0xFFFFFFFF:
                        packed, y = struct.unpack_from("<Q", wide, y)[0], y + 8
                    if header == 0xFFFFFFFF:
                        header = struct.unpack_from("<Q", wide, y)[0]
                x += 4 + length
            yield name, method, packed, header
            at += 46 + name_len + extra_len + note_len

    def locate(self, name: str) -> tuple[int, int]:
        """(offset, length) of a stored member's bytes in the ZIP."""
        method, packed, header = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; ranges need stored members")
        local = self.read_at(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("bad local header")
        name_len, extra_len = struct.unpack_from("<HH", local, 26)
        return header + 30 + name_len + extra_len, packed

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        start, size = self.locate(name)
        return self.read_at(start + offset, size - offset if length is None else length)


def parse_record(member: bytes) -> dict:
    """Headers, HTTP headers and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode("latin-1").split("\r\n")[1:])
    return {"version": lines[0], "headers": headers, "http": fields, "payload": payload}


def _runs(entries: list[tuple[int, int]], most: int) -> Iterator[list[tuple[int, int]]]:
    """Entries (offset, length) that lie one after another, in runs of up to ``most`` bytes."""
    run: list[tuple[int, int]] = []
    for offset, length in entries:
        if run and (offset != run[-1][0] + run[-1][1] or offset + length - run[0][0] > most):
            yield run
            run = []
        run.append((offset, length))
    if run:
        yield run


def read_records(zip_file: ZipRanges, range_bytes: int = RANGE_BYTES) -> Iterator[dict]:
    """Every record that the index names, neighbours in one range."""
    start, _ = zip_file.locate(DATA)
    lines = [json.loads(line.partition(" ")[2]) for line in zip_file.read(INDEX).decode().splitlines()]
    for run in _runs([(entry["offset"], entry["length"]) for entry in lines], range_bytes):
        first, end = run[0][0], run[-1][0] + run[-1][1]
        held = zip_file.read_at(start + first, end - first)
        for offset, length in run:
            yield parse_record(held[offset - first : offset - first + length])


def with_revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(page_id, url, payload, refers_to). Only payloads found more than once meet in the join."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    firsts = rows.where(F.length("payload") >= MIN_REVISIT_BYTES).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = stage(firsts.where("n > 1 and first is not null").select("sha1", "first"), "warcdup")
    joined = rows.join(firsts, "sha1", "left")
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _archives(batches: Iterator[pa.RecordBatch], archive_bytes: int) -> Iterator[bytes]:
    """ZIPs of about ``archive_bytes`` from (page_id, url, payload, refers_to), made in one pass."""
    records: list[tuple[int | None, bytes]] = []
    held = 0
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "refers_to")]
        for i in range(batch.num_rows):
            page_id, url, payload, refers_to = (c[i].as_py() for c in columns)
            member = warc_record(page_id, url, payload, refers_to)
            if records and held + len(member) > archive_bytes:
                yield build_archive(records)
                records, held = [], 0
            records.append((page_id, member))
            held += len(member)
    if records:
        yield build_archive(records)


def write_archives(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive_id, content): the archives as binary rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in _archives(batches, archive_bytes):
            yield pa.RecordBatch.from_pydict({"archive_id": [hashlib.sha1(content).hexdigest()], "content": pa.array([content], pa.binary())})

    return rows.mapInArrow(pack, "archive_id string, content binary")


def write_files(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(uri, bytes) of the archives written below ``folder``, which all executors must share.

    Run it once, by staging or collecting the result: that is the manifest of what is to be read.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        for content in _archives(batches, archive_bytes):
            name = f"{hashlib.sha1(content).hexdigest()}.wacz"
            # another attempt writes the same bytes to the same place, so it is moved there whole
            part = f"{path}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as file:
                file.write(content)
            system.move(part, f"{path}/{name}")
            yield pa.RecordBatch.from_pydict({"uri": [f"{folder}/{name}"], "bytes": [len(content)]})

    return rows.mapInArrow(pack, "uri string, bytes long")


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _whole_number(text: str | None) -> int | None:
    return int(text) if text is not None and text.removeprefix("-").isdecimal() and text.isascii() else None


def _record_rows(archive: ZipRanges, payloads: bool) -> Iterator[pa.RecordBatch]:
    """Records as rows. Digests of responses are recomputed and must match their headers."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [f.split(" ")[0] for f in RECORDS.split(", ")]
    out = []
    for record in read_records(archive):
        headers = record["headers"]
        named = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        response = headers["WARC-Type"] == "response"
        size = len(record["payload"]) if response else int(record["http"]["Content-Length"])
        if response and digest32(record["payload"]) != named:
            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
        out.append((_whole_number(headers.get("X-Page-Id")), headers["WARC-Target-URI"], headers["WARC-Type"], size, named, _whole_number(headers.get("X-Refers-To-Page-Id")), record["payload"] if response and payloads else None))
    columns = list(zip(*out, strict=True)) or [[]] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of archives in binary rows (content)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(batch.schema.get_field_index("content")):
                yield from _record_rows(ZipRanges.of_bytes(content.as_py()), payloads)

    return archives.mapInArrow(unpack, RECORDS)


def read_files(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the archives named in ``manifest`` (uri), read by ranges where they are."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(batch.schema.get_field_index("uri")):
                yield from _record_rows(ZipRanges.of_file(uri.as_py()), payloads)

    n = manifest.count()
    tasks = max(1, -(-n // ARCHIVES_A_TASK), min(n, manifest.sparkSession.sparkContext.defaultParallelism))
    return manifest.repartition(tasks).mapInArrow(unpack, RECORDS)


def _arrow_knows(folder: str) -> bool:
    try:
        fs.FileSystem.from_uri(folder)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def op10_warc_zip(spark, sf_dir: str) -> DataFrame:
    rows = with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    folder = shared_path(spark, "wacz")
    if _arrow_knows(folder):
        records = read_files(stage(write_files(rows, folder), "warc"), payloads=False)
    else:
        records = read_archives(stage(write_archives(rows), "warc"), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex, min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 15) & 31), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 10) & 31), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 5) & 31), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v & 31), 1)
    FOR v IN [CAST('0x' || substr(hex, 5 * k + 1, 5) AS INTEGER) FOR k IN range(0, 8)]], 'string_agg', '') AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM h
"""
