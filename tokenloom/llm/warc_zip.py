"""Web archives packed in ZIP files: written by tasks, read by ranges.

An archive holds, all stored without ZIP compression, a WARC file whose records are
gzip members of their own, an index with a line per record, and a description.
The reader never extracts anything. It reads the end of a file, the central
directory (or the ZIP64 one) and the local headers, which gives the place of each
stored member; then the index, spread as rows over all tasks; then each record's
own byte range.

A task writes under a name of its own try and renames the whole file, so a repeated
task replaces a file by the same bytes. Files go to the shared folder.

Cases: a null payload is empty. Of equal payloads the record with the largest
page id (nulls count as smallest) is the response, the others revisit it; repeated rows
of that id are all responses. A null url gives no target. Empty tables give
no archive and no rows. A payload must fit into a worker's memory, not an archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import posixpath
import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tokenloom.llm.common import ready
from tokenloom.session import file_system, qualified, stage, staging_path, wide_partitions

DATA, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 20
#: Bytes of records that one task reads, at most on average.
TASK_BYTES = 128 << 20
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the ZIP format: signatures, sizes and field layouts.
_END, _END64, _LOCATOR = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_ENTRY, _LOCAL = b"PK\x01\x02", b"PK\x03\x04"
_END_FIELDS = struct.Struct("<4s4H2LH")
_LOCATOR_FIELDS = struct.Struct("<4sLQL")
_END64_FIELDS = struct.Struct("<4sQ2H2L4Q")
_ENTRY_FIELDS = struct.Struct("<4s6H3L5H2L")
_LOCAL_FIELDS = struct.Struct("<4s5H3L2H")
_FULL32, _FULL16, _ZIP64_EXTRA, _STORED = 0xFFFFFFFF, 0xFFFF, 1, 0


# Writing.

def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    tail = urn.strip("<>").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit has the payload's digest and length but not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + quote(url, safe="%:/?#[]@!$&'()*+,;=~"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Streams records into one ZIP file; ``close`` adds the index and gives the file its name."""

    def __init__(self, uri: str, name: str, attempt: int):
        self.system, base = file_system(uri)
        self.system.create_dir(base, recursive=True)
        self.final = posixpath.join(base, name)
        self.temp = posixpath.join(base, f"_{name}.{attempt}")
        self.uri = posixpath.join(uri, name)
        self.out = self.system.open_output_stream(self.temp)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.lines: list[str] = []
        self.size = 0

    def add(self, record: bytes, page_id: int | None, url: str | None) -> None:
        member = gzip.compress(record, mtime=0)
        self.data.write(member)
        self.lines.append(json.dumps({"id": _urn(page_id), "url": url, "offset": self.size, "length": len(member),
                                      "filename": posixpath.basename(DATA)}))
        self.size += len(member)

    def close(self) -> tuple[str, int]:
        self.data.close()
        self.zip.writestr(INDEX, "".join(f"{line}\n" for line in self.lines))
        self.zip.writestr(ABOUT, json.dumps({"profile": "data-package", "resources": [DATA, INDEX]}))
        self.zip.close()
        self.out.close()
        if self.system.get_file_info(self.final).type == fs.FileType.File:
            self.system.delete_file(self.final)
        self.system.move(self.temp, self.final)
        return self.uri, len(self.lines)


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, keeper (page id of the response) and revisit."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    # Only payloads found more than once are joined back. Stored first: then their size is known,
    # and Spark sends a small table to the payloads instead of shuffling those.
    keepers = stage(
        rows.where(F.length("payload") >= least_bytes).groupBy("sha1")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1").select("sha1", "keeper", F.lit(True).alias("shared")), "keepers")
    joined = rows.join(keepers, "sha1", "left")
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select("page_id", "url", "payload", "keeper", revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of (page_id, url, html); gives the table of archives (archive, records)."""
    spark = pages.sparkSession
    ready(spark)
    uri = qualified(spark, folder or staging_path(spark, "archives"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, writer = TaskContext.get(), [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    writer = ArchiveWriter(uri, f"part-{task.partitionId():06d}-{len(done):04d}.wacz", task.taskAttemptId())
                page_id, url, payload, keeper, revisit = row
                writer.add(warc_record(page_id, url, payload, keeper, revisit), page_id, url)
                if writer.size >= archive_bytes:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())],
            names=["archive", "records"])

    return stage(mark_revisits(pages, least_bytes).mapInArrow(write, "archive string, records long"), "archives")


# Reading.

def _at(handle: pa.NativeFile, offset: int, size: int) -> bytes:
    handle.seek(offset)
    return handle.read(size)


def members(handle: pa.NativeFile) -> Iterator[tuple[str, int, int, int]]:
    """(name, method, offset of the data, stored size) of each member, from the central directory."""
    total = handle.size()
    tail_at = max(0, total - _END_FIELDS.size - _FULL16)
    tail = _at(handle, tail_at, total - tail_at)
    found = tail.rfind(_END)
    while found >= 0:  # the signature may also stand in the comment
        fields = _END_FIELDS.unpack_from(tail, found) if found + _END_FIELDS.size <= len(tail) else None
        if fields and found + _END_FIELDS.size + fields[7] == len(tail):
            break
        found = tail.rfind(_END, 0, found)
    if found < 0:
        raise ValueError("not a ZIP file")
    count, size, begin = fields[4], fields[5], fields[6]
    end_at = tail_at + found
    if end_at >= _LOCATOR_FIELDS.size and (locator := _at(handle, end_at - _LOCATOR_FIELDS.size, _LOCATOR_FIELDS.size)).startswith(_LOCATOR):
        end64 = _END64_FIELDS.unpack(_at(handle, _LOCATOR_FIELDS.unpack(locator)[2], _END64_FIELDS.size))
        if end64[0] != _END64:
            raise ValueError("broken ZIP64 directory")
        count, size, begin = end64[7], end64[8], end64[9]
    directory, at = _at(handle, begin, size), 0
    for _ in range(count):
        e = _ENTRY_FIELDS.unpack_from(directory, at)
        if e[0] != _ENTRY:
            raise ValueError("broken central directory")
        method, stored, plain, name_size, extra_size, note_size, header = e[4], e[8], e[9], e[10], e[11], e[12], e[16]
        at += _ENTRY_FIELDS.size
        name = directory[at:at + name_size].decode()
        extra = directory[at + name_size:at + name_size + extra_size]
        while len(extra) >= 4:
            tag, length = struct.unpack_from("<2H", extra)
            if tag == _ZIP64_EXTRA:  # holds, in this order, only the fields that are full
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                plain = next(wide) if plain == _FULL32 else plain
                stored = next(wide) if stored == _FULL32 else stored
                header = next(wide) if header == _FULL32 else header
            extra = extra[4 + length:]
        at += name_size + extra_size + note_size
        local = _LOCAL_FIELDS.unpack(_at(handle, header, _LOCAL_FIELDS.size))
        if local[0] != _LOCAL:
            raise ValueError("broken local header")
        yield name, method, header + _LOCAL_FIELDS.size + local[9] + local[10], stored


def _lines(handle: pa.NativeFile, offset: int, size: int) -> Iterator[bytes]:
    rest, end = b"", offset + size
    while offset < end:
        block = _at(handle, offset, min(READ_BYTES, end - offset))
        offset += len(block)
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


def index_entries(archives: DataFrame) -> DataFrame:
    """archive, begin, length: the byte range of every record, from the stored indexes."""
    ready(archives.sparkSession)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = file_system(uri)
                with system.open_input_file(path) as handle:
                    held = {name: place for name, *place in members(handle)}
                    indexes = [place for name, place in held.items() if name.startswith("indexes/")]
                    if not indexes:
                        raise ValueError(f"{uri} has no index")
                    for method, offset, size in indexes:
                        if method != _STORED:
                            raise ValueError(f"{uri}: an index is not stored")
                        rows: list[tuple[int, int]] = []
                        for line in _lines(handle, offset, size):
                            entry = json.loads(line[line.index(b"{"):])
                            data_method, data_at, _ = held[f"archive/{entry['filename']}"]
                            if data_method != _STORED:
                                raise ValueError(f"{uri}: an archive member is not stored")
                            rows.append((data_at + int(entry["offset"]), int(entry["length"])))
                            if len(rows) >= 10_000:
                                yield _ranges(uri, rows)
                                rows = []
                        yield _ranges(uri, rows)

    return archives.select("archive").mapInArrow(entries, "archive string, begin long, length long")


def _ranges(uri: str, rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([uri] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()),
         pa.array([r[1] for r in rows], pa.int64())], names=["archive", "begin", "length"])


def parse_record(member: bytes) -> dict:
    """Headers and payload of one gzip member."""
    head, _, body = zlib.decompress(member, 16 + zlib.MAX_WBITS).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = body[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't match its digest")
    return {
        "page_id": _page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind,
        "refers_to": _page_of(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                     ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("payload", pa.binary())])


def read_records(entries: DataFrame) -> DataFrame:
    """One row per index entry; neighbouring ranges of an archive are read together."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, handle, window, window_at = None, None, b"", 0
        for batch in batches:
            out: list[dict] = []
            size = 0
            for uri, begin, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if uri != opened:
                    if handle is not None:
                        handle.close()
                    system, path = file_system(uri)
                    opened, handle, window = uri, system.open_input_file(path), b""
                if begin < window_at or begin + length > window_at + len(window):
                    window, window_at = _at(handle, begin, max(length, READ_BYTES)), begin
                out.append(parse_record(window[begin - window_at:begin - window_at + length]))
                size += out[-1]["payload_bytes"]
                if size >= 4 * READ_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema=_RECORD)
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=_RECORD)
        if handle is not None:
            handle.close()

    # Runs of neighbouring records stay together, and each archive is spread over many tasks: as many as
    # the bytes to read ask for, as index rows are far narrower than what they point to.
    size = entries.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-size // TASK_BYTES), min(wide_partitions(entries.sparkSession), -(-size // (4 * READ_BYTES))), 1)
    spread = entries.repartition(tasks, "archive", F.floor(F.col("begin") / (4 * READ_BYTES)))
    return spread.sortWithinPartitions("archive", "begin").mapInArrow(
        read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
              "payload_digest string, payload binary")


def archive_round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages, then read every record back through the indexes."""
    if not isinstance(pages.schema["page_id"].dataType, LongType):
        pages = pages.withColumn("page_id", F.col("page_id").cast("long"))
    return read_records(stage(index_entries(write_archives(pages, least_bytes=least_bytes)), "record_index"))
