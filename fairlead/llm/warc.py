"""WARC archives as a Python data source for Spark: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Records are gzip members.  The writer notes the member's compressed length in the gzip header ("sl" subfield), so a
reader inflates only the record's header lines, tests the pushed-down predicates on them, and seeks past payloads that
are not wanted.  Archives of other writers, without that note, are read by inflating each member to its end.
Files are split into ranges; a range owns the records that begin in it.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from fairlead.llm.stage import attach, new_path, stage

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
    "content_length long, payload binary"
)
#: Columns that are header lines, and the line that each is.
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest",
}
#: Fixed start of a member with an "sl" subfield: magic, deflate, extra field; no time; extra length 12, "sl", 8 bytes.
_START = re.compile(rb"\x1f\x8b\x08\x04\x00\x00\x00\x00[\x00-\xff]{2}\x0c\x00sl\x08\x00", re.S)
_HEAD = 24
_PIECE = 1 << 16


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else "file://" + path)


def member(data: bytes) -> bytes:
    """One gzip member that holds ``data`` and says how long it is, compressed and not."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    extra = b"sl" + struct.pack("<HII", 8, (_HEAD + len(body) + 8) & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """The record of a row with SCHEMA's columns; a revisit carries no payload, only its length in the HTTP lines."""
    revisit = row["record_type"] == "revisit"
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['content_length']}\r\n\r\n".encode()
    block = http + (b"" if revisit else payload)
    lines = [f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Date: {row['date']}"]
    for name, column in (("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Payload-Digest", "payload_digest")):
        if row[column] is not None:
            lines.append(f"{name}: " + re.sub(r"[\r\n]+", " ", row[column]))
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes archives of bounded size under a name of its own; only committed files get their final name."""

    def __init__(self, path: str, most: int) -> None:
        self.path, self.most = path, most

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = _open(self.path)
        fs.create_dir(base, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > self.most:
                    if out is not None:
                        out.close()
                    files.append(f".{uuid.uuid4().hex}.warc.gz.tmp")
                    out, size = fs.open_output_stream(f"{base}/{files[-1]}", compression=None), 0
                data = member(record(row))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = _open(self.path)
        fs.create_dir(base, recursive=True)
        for name in (n for m in messages if m for n in m.files):
            fs.move(f"{base}/{name}", f"{base}/{name[1:-4]}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = _open(self.path)
        for name in (n for m in messages if m for n in m.files):
            fs.delete_file(f"{base}/{name}")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, path: str, split: int, payload: bool) -> None:
        self.path, self.split, self.payload, self.tests = path, split, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[Range]:
        fs, base = _open(self.path)
        info = fs.get_file_info(base)
        files = fs.get_file_info(pa.fs.FileSelector(base, recursive=True)) if info.type == pa.fs.FileType.Directory else [info]
        found = [f for f in files if f.is_file and f.path.endswith((".warc", ".warc.gz")) and not f.base_name.startswith((".", "_"))]
        return [
            Range(f.path, at, min(at + self.split, f.size), f.size)
            for f in sorted(found, key=lambda f: f.path) for at in range(0, f.size, self.split)
        ] or [Range("", 0, 0, 0)]

    def wanted(self, head: dict[str, str]) -> bool:
        for f in self.tests:
            value = head.get(HEADERS[f.attribute[0]])
            if value is None or isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value \
                    or isinstance(f, StringStartsWith) and not value.startswith(f.value):
                return False
        return True

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.string()) for c in HEADERS] + [("content_length", pa.int64()), ("payload", pa.binary())])
        rows, size = [], 0
        if partition.path:
            fs, _ = _open(self.path)
            with fs.open_input_file(partition.path) as file:
                for head, payload in self.records(file, partition):
                    rows.append({c: head.get(h) for c, h in HEADERS.items()} | {"content_length": int(head.get("content-length", 0)), "payload": payload})
                    size += len(payload or b"")
                    if len(rows) >= 1000 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    def records(self, file: pa.NativeFile, part: Range) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """(header lines by lower-case name, payload or None) of the wanted records that begin in the range."""
        at = first_member(file, part)
        while at is not None and at < part.end:
            file.seek(at)
            start = file.read(_HEAD)
            if start[:2] != b"\x1f\x8b":
                at = yield from self._plain(file, at)
                continue
            inflate, data, raw = zlib.decompressobj(31), b"", start
            while b"\r\n\r\n" not in data and not inflate.eof:
                raw = raw or file.read(1024)
                if not raw:
                    return
                data += inflate.decompress(raw)
                raw = b""
            head, _, body = data.partition(b"\r\n\r\n")
            lines = _lines(head)
            take = self.wanted(lines)
            noted = struct.unpack("<I", start[16:20])[0] if _START.match(start) else 0
            if not (take and self.payload) and noted:
                if take:
                    yield lines, None
                at += noted
                continue
            parts, total = [body], len(body)
            while not inflate.eof:
                more = file.read(_PIECE)
                if not more:
                    break
                out = inflate.decompress(more)
                if take and self.payload:
                    parts.append(out)
                    total += len(out)
            at = file.tell() - len(inflate.unused_data)
            if take:
                yield lines, _payload(lines, b"".join(parts)) if self.payload else None

    def _plain(self, file: pa.NativeFile, at: int) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """One record of an archive that is not compressed; gives where the next begins."""
        file.seek(at)
        data = b""
        while b"\r\n\r\n" not in data:
            more = file.read(4096)
            if not more:
                return None
            data += more
        head = data.partition(b"\r\n\r\n")[0]
        lines = _lines(head)
        start, length = at + len(head) + 4, int(lines.get("content-length", 0))
        if self.wanted(lines):
            file.seek(start)
            yield lines, _payload(lines, file.read(length)) if self.payload else None
        return start + length + 4


def first_member(file: pa.NativeFile, part: Range) -> int | None:
    """Where the first record at or after the range's start begins.

    Without the note there is no telling where members begin, so such a file belongs to its first range as a whole.
    """
    file.seek(0)
    noted = _START.match(file.read(_HEAD))
    if not noted:
        part.end = part.size if part.start == 0 else part.start
        return 0 if part.start == 0 else None
    if part.start == 0:
        return 0
    at, tail = part.start, b""
    file.seek(at)
    while data := file.read(_PIECE):
        data = tail + data
        for m in _START.finditer(data):
            found = at - len(tail) + m.start()
            if _chained(file, found, part.size):
                return found if found < part.end else None
        at += len(data) - len(tail)
        if at >= part.end + _HEAD:
            return None
        tail = data[-_HEAD + 1 :]
        file.seek(at)
    return None


def _chained(file: pa.NativeFile, at: int, size: int) -> bool:
    """Whether the member that seems to begin at ``at`` is followed by another or by the end of the file."""
    file.seek(at)
    after = at + struct.unpack("<I", file.read(_HEAD)[16:20])[0]
    file.seek(min(after, size))
    return after == size or bool(_START.match(file.read(_HEAD)))


def _lines(head: bytes) -> dict[str, str]:
    pairs = (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _payload(lines: dict[str, str], body: bytes) -> bytes:
    block = body[: int(lines.get("content-length", len(body)))]
    return block.partition(b"\r\n\r\n")[2] if lines.get("content-type", "").startswith("application/http") else block


class WarcSource(DataSource):
    """Options: path; splitBytes (64 MiB) for reading, fileBytes (64 MiB) for writing; payload=false leaves payloads."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], int(self.options.get("splitBytes", 64 << 20)), self.options.get("payload", "true") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("fileBytes", 64 << 20)))


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(path=path, **options).load()


def write_warc(records: DataFrame, path: str, **options: str) -> None:
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").mode("append").options(path=path, **options).save()


def page_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """``pages(page_id, url, html, ...)`` -> rows with SCHEMA's columns; of equal payloads all but one are revisits.

    A null html is an empty payload.  Payloads under ``least`` bytes are responses all.  Of the others the row with
    the smallest page_id is the response; rows repeated whole have its type alike.  Rows without a page_id are
    responses and come back without one.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    light = pages.select("page_id", F.octet_length(payload).alias("n"), F.sha2(payload, 256).alias("digest")).where(F.col("n") >= least)
    first = light.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    again = light.join(first.select("digest", "first"), "digest").where("page_id <> first").select("page_id", "first").distinct()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    joined = attach(pages.select("page_id", "url", payload.alias("payload")), again, "page_id")
    revisit = F.col("first").isNotNull()
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), F.sha2("payload", 256)).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("content_length"),
        F.when(~revisit, F.col("payload")).alias("payload"))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives, read them back -> page_id, payload_bytes, payload_digest, record_type, refers_to.

    Bytes and digest of a response are those of the payload as read; a revisit has those of the response it names.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(page_records(pages), path)
    number = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)", 1).try_cast("long")
    response = read_warc(spark, path).where("record_type = 'response'").select(
        number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"))
    response = stage(response, "responses")
    revisit = read_warc(spark, path, payload="false").where("record_type = 'revisit'").select(
        number("record_id").alias("page_id"), number("refers_to").alias("refers_to"))
    named = response.dropDuplicates(["page_id"]).withColumnRenamed("page_id", "refers_to")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return response.select("*", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).select(columns).unionByName(
        revisit.join(named, "refers_to").withColumn("record_type", F.lit("revisit")).select(columns))

