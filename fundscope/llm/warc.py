"""WARC archives as a PySpark data source (``format("warc")``), and pages written with revisits.

Reading: the driver lists the files and packs small ones into partitions; a file is the unit of
work, and the writer starts a new one after ``file_bytes``. Predicates on the header columns
(``=``, ``IN``, ``<=>``, prefix, null tests) are pushed into the scan. A task parses a record's
headers first and decodes the payload only if the header passes every predicate and the option
``payload`` asks for it (``all``, ``none`` or a comma-separated list of record types). Records are
gzip members that carry their own length (the extra field ``sl``), so an unwanted payload is
skipped by seeking, without inflating it; members and plain files of other writers work too, with
``Content-Length`` or by inflating.

Writing: every task writes files below ``_temporary-<id>`` and the driver moves them to their
place when all tasks are done, so lost or repeated attempts leave nothing behind in a reading.

Files are reached through pyarrow's file systems, so the folder may be on any store that these
open (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In,
                                    InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage)

SCHEMA = ("record_id string, record_type string, target_uri string, warc_date string, payload_digest string, "
          "refers_to string, payload_length long, content_type string, content_length long, "
          "headers map<string,string>, payload binary")
#: column -> header it shows
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
           "warc_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
           "payload_length": "x-payload-length", "content_type": "content-type", "content_length": "content-length"}
_LONGS = ("payload_length", "content_length")
_ARROW = pa.schema([(c, pa.int64() if c in _LONGS else pa.string()) for c in HEADERS]
                   + [("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


# -- records ---------------------------------------------------------------------------------------


def _clean(value: str) -> str:
    """A header value on one line: control characters and % are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in value) if any(
        c < " " or c == "\x7f" for c in value) else value


def pack(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member whose header holds the member's length."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    raw = head.encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    size = 24 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body
            + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF))


def _parse(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, sep, value = line.partition(":")
        if sep:
            out.setdefault(key.strip().lower(), value.strip())
    return out


class _Stream:
    """Buffered reading from a seekable file, without reading what is skipped."""

    def __init__(self, f, step: int = 1 << 18):
        self.f, self.step, self.buf, self.size = f, step, b"", f.size()
        self.at = 0  # of the first byte in buf

    def peek(self, n: int) -> bytes:
        while len(self.buf) < n and (more := self.f.read(max(self.step, n - len(self.buf)))):
            self.buf += more
        return self.buf[:n]

    def skip(self, n: int) -> None:
        self.at += n
        if n <= len(self.buf):
            self.buf = self.buf[n:]
        else:
            self.buf = b""
            self.f.seek(min(self.at, self.size))


def records(f, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block) for each record that ``wanted(headers)`` answers with None for left out, False
    for headers only and True for headers and block."""
    s = _Stream(f)
    while start := s.peek(2):
        if start != b"\x1f\x8b":  # a plain record
            if start == b"\r\n":
                s.skip(2)
                continue
            n = 4096
            while (end := s.peek(n).find(b"\r\n\r\n")) < 0 and len(s.peek(n)) == n:
                n *= 4
            if end < 0:
                raise ValueError("a WARC record's header does not end")
            headers = _parse(s.peek(end))
            s.skip(end + 4)
            length = int(headers.get("content-length", 0))
            want = wanted(headers)
            if want is not None:
                yield headers, (bytes(s.peek(length)) if want else None)
            s.skip(length)
            continue
        fixed = s.peek(24)
        size = struct.unpack("<I", fixed[16:20])[0] if fixed[3] == 4 and fixed[12:14] == b"sl" else 0
        z, raw, used, n = zlib.decompressobj(31), b"", 0, 4096
        while b"\r\n\r\n" not in raw and not z.eof:  # the header only
            piece = s.peek(n)
            if used == len(piece):
                raise ValueError("a gzip member is cut off")
            raw, used, n = raw + z.decompress(piece[used:]), len(piece), n * 4
        head, _, rest = raw.partition(b"\r\n\r\n")
        headers = _parse(head)
        want = wanted(headers)
        length = int(headers.get("content-length", 0))
        if want or not size:
            parts = [rest]
            while not z.eof:
                piece = s.peek(n)
                if used == len(piece):
                    raise ValueError("a gzip member is cut off")
                more, used, n = z.decompress(piece[used:]), len(piece), n * 4
                if want:
                    parts.append(more)
            size = used - len(z.unused_data)
            if want:
                rest = b"".join(parts)
        if want is not None:
            yield headers, (rest[:length] if want else None)
        s.skip(size)


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The payload: what follows the HTTP header in an HTTP record, otherwise the block."""
    if headers.get("content-type", "").lower().startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


# -- data source -----------------------------------------------------------------------------------


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.payload = options.get("payload", "all")
        self.tests: list[tuple] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            known = column in HEADERS
            if known and isinstance(f, (EqualTo, EqualNullSafe)):
                self.tests.append((column, "in", (f.value,)))
            elif known and isinstance(f, In):
                self.tests.append((column, "in", tuple(v for v in f.value if v is not None)))
            elif known and isinstance(f, StringStartsWith):
                self.tests.append((column, "prefix", f.value))
            elif known and isinstance(f, IsNotNull):
                self.tests.append((column, "some", None))
            elif known and isinstance(f, IsNull):
                self.tests.append((column, "in", (None,)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, root = _open(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pafs.FileType.Directory \
            else [fs.get_file_info(root)]
        hidden = lambda p: any(x[:1] in "._" for x in p[len(root):].split("/") if x)
        files = sorted((i.path, i.size) for i in found if i.type == pafs.FileType.File and not hidden(i.path))
        out, load = [], 0
        for path, size in files:
            if not out or load + size > self.partition_bytes:
                out.append(Files([]))
                load = 0
            out[-1].paths.append(path)
            load += size
        return out

    def _value(self, headers: dict[str, str], column: str):
        v = headers.get(HEADERS[column])
        if column in _LONGS:
            return int(v) if v is not None and v.isdigit() else None
        return v

    def _wanted(self, headers: dict[str, str]):
        for column, kind, value in self.tests:
            v = self._value(headers, column)
            if kind == "in" and v not in value or kind == "some" and v is None \
                    or kind == "prefix" and not (v or "").startswith(value):
                return None
        return self.payload == "all" or headers.get("warc-type") in self.payload.split(",")

    def read(self, partition: Files | None):
        fs, _ = _open(self.path)
        rows: list[tuple] = []
        load = 0
        for path in partition.paths if partition else []:
            with fs.open_input_file(path) as f:
                for headers, block in records(f, self._wanted):
                    payload = None if block is None else payload_of(headers, block)
                    rows.append((*(self._value(headers, c) for c in HEADERS), list(headers.items()), payload))
                    load += 500 + len(payload or b"")
                    if load > 8 << 20:
                        yield _batch(rows)
                        rows, load = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows: record_id, record_type, target_uri, warc_date, payload_digest, refers_to, payload_length,
    payload. A revisit's payload is not written."""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.file_bytes = int(options.get("file_bytes", 64 << 20))
        self.job = uuid.uuid4().hex

    def write(self, iterator) -> Written:
        fs, root = _open(self.path)
        fs.create_dir(tmp := f"{root}/_temporary-{self.job}", recursive=True)
        names, out = [], None
        for batch in iterator:
            for row in zip(*(batch.column(c).to_pylist() for c in (
                    "record_id", "record_type", "target_uri", "warc_date", "payload_digest", "refers_to", "payload_length", "payload"))):
                if out is None or out.tell() > self.file_bytes:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out = fs.open_output_stream(f"{tmp}/{names[-1]}", compression=None)
                out.write(self._record(*row))
        if out is not None:
            out.close()
        return Written(names)

    @staticmethod
    def _record(record_id, kind, uri, date, digest, refers_to, length, payload) -> bytes:
        payload = payload or b""
        h = [("WARC-Type", kind or "response"), ("WARC-Record-ID", record_id or f"<urn:uuid:{uuid.uuid4()}>"),
             ("WARC-Date", date or "1970-01-01T00:00:00Z")]
        h += [(k, v) for k, v in (("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), ("WARC-Refers-To", refers_to)) if v is not None]
        h.append(("X-Payload-Length", str(len(payload) if length is None else length)))
        if kind == "revisit":
            h.append(("WARC-Profile", REVISIT_PROFILE))
            payload = b""
        h.append(("Content-Type", "application/http; msgtype=response"))
        return pack(h, _HTTP % (length or 0) + payload)

    def commit(self, messages: list[Written]) -> None:
        fs, root = _open(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            fs.move(f"{root}/_temporary-{self.job}/{name}", f"{root}/{name}")
        self._drop(fs, root)

    def abort(self, messages) -> None:
        self._drop(*_open(self.path))

    def _drop(self, fs, root) -> None:
        if fs.get_file_info(f"{root}/_temporary-{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_temporary-{self.job}")


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# -- pages -----------------------------------------------------------------------------------------


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits of the digest at a time are four base32 digits."""
    h = F.sha1(data)
    part = lambda i: F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*map(part, range(8))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(col: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(col.cast("string"), F.lit("")), F.lit(">"))


def page_of(urn: Column) -> Column:
    """The page id in a record id of :func:`write_pages`; null where there was none."""
    return F.regexp_extract(urn, "^<urn:page:(.*)>$", 1).try_cast("long")


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                min_revisit_bytes: int = 0) -> None:
    """A WARC record per row. Of the rows with equal payloads (by SHA-1 and length, at least
    ``min_revisit_bytes`` long) the one with the largest id is the response, the others revisit it.

    Null payloads are empty ones; a null url is left out; rows without an id revisit the largest
    id, or are all responses if the payload has none; rows that repeat id and payload of the
    response are responses too. Other columns are ignored; an empty table writes no file.

    One shuffle of the payloads by digest against one narrow row per digest: Spark splits a digest
    that holds many rows (skew join), and each task writes its own files.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), payload.alias("payload"),
                     F.octet_length(payload).cast("long").alias("payload_length"), base32_sha1(payload).alias("digest"))
    best = p.groupBy("digest", "payload_length").agg(F.max("id").alias("keeper"))
    first = F.col("id").eqNullSafe(F.col("keeper")) | F.col("keeper").isNull() | (F.col("payload_length") < min_revisit_bytes)
    out = p.join(best, ["digest", "payload_length"]).select(
        _urn(F.col("id")).alias("record_id"), F.when(first, "response").otherwise("revisit").alias("record_type"), "target_uri",
        F.lit("1970-01-01T00:00:00Z").alias("warc_date"), F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.when(~first, _urn(F.col("keeper"))).alias("refers_to"), "payload_length",
        F.when(first, F.col("payload")).alias("payload"))
    _register(pages.sparkSession)
    out.write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: str = "all") -> DataFrame:
    """Records of all archives below ``path``; see the module for ``payload``."""
    _register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)
