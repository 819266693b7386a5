"""WARC files as a Spark data source, `warc`, with a writer that stores equal payloads once.

Reading plans whole files into partitions of similar size. Each record is its own gzip member with
the skip-length extra field `sl` (compressed and full size), so a reader inflates no more of a
member than its headers, applies the pushed predicates on record type and the other header
columns, and seeks past a record it doesn't want; only wanted payloads are inflated. Members
without that field, as other tools write them, and plain files are read too; there the
bytes of an unwanted payload are passed over without being kept.

Columns: record_id, record_type, target_uri, date, payload_digest, refers_to (strings, from
WARC headers), payload_length (of the HTTP header, else of the block), payload, and damage, which is null
for a whole record. Options: path, payload (false leaves payloads null), partition_bytes, mode. Paths
are those of pyarrow.fs.

A record is damaged if its header ends early or gives no length, if its block is shorter than said, or if its member
can't be inflated or fails its checksum. mode FAILFAST (the default) raises an error that names the file
and place; PERMISSIVE gives a row that says what is wrong, with what was read of the payload, and goes on with the next
member or record that begins like one. A payload that nobody wants is skipped unread, and so is damage in it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, WriterCommitMessage

from grainmill.session import settle, shared_path

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_length long, payload binary, damage string"
_ARROW = pa.schema([(c, pa.string()) for c in ("record_id", "record_type", "target_uri", "date", "payload_digest", "refers_to")] + [("payload_length", pa.int64()), ("payload", pa.binary()), ("damage", pa.string())])
_HEADER = {"record_id": b"warc-record-id", "record_type": b"warc-type", "target_uri": b"warc-target-uri", "date": b"warc-date", "payload_digest": b"warc-payload-digest", "refers_to": b"warc-refers-to"}
READ, FILE_BYTES, PARTITION_BYTES, BATCH_BYTES = 1 << 16, 128 << 20, 32 << 20, 8 << 20


@dataclass
class Files(InputPartition):
    names: tuple


@dataclass
class Written(WriterCommitMessage):
    names: tuple


class _Source:
    """Bytes of a file with a position; reads ahead by READ."""

    def __init__(self, file):
        self.file, self.size, self.at, self.base, self.buf = file, file.size(), 0, 0, b""

    def peek(self, n: int = READ) -> bytes:
        lo = self.at - self.base
        if not (0 <= lo and lo + n <= len(self.buf)) and self.at + len(self.buf[lo:] if 0 <= lo <= len(self.buf) else b"") < self.size:
            self.buf, self.base, lo = self.file.read_at(max(n, READ), self.at), self.at, 0
        return self.buf[lo : lo + n]


class _Member:
    """The inflated bytes of one record, taken as needed: a gzip member, or a plain record."""

    def __init__(self, src: _Source):
        self.src, self.begin, self.out = src, src.at, b""
        head = src.peek(18)
        self.gz = zlib.decompressobj(31) if head[:2] == b"\x1f\x8b" else None
        self.skip = None
        if self.gz and head[3] & 4 and head[12:14] == b"sl":
            self.skip = struct.unpack("<I", src.peek(24)[16:20])[0]

    def _more(self) -> bool:
        if self.gz is None:
            got = self.src.peek()
            self.src.at += len(got)
            self.out += got
            return bool(got)
        while not self.gz.eof:
            raw = self.gz.unconsumed_tail or self.src.peek()
            if not raw:
                return False
            fresh = not self.gz.unconsumed_tail
            got = self.gz.decompress(raw, READ)
            if fresh:
                self.src.at += len(raw)
            if self.gz.eof:
                self.src.at -= len(self.gz.unused_data)
            if got:
                self.out += got
                return True
        return False

    def until(self, mark: bytes, at: int = 0) -> int:
        """Position after `mark`, -1 without it."""
        while (k := self.out.find(mark, at)) < 0:
            if not self._more():
                return -1
        return k + len(mark)

    def take(self, lo: int, hi: int) -> bytes:
        parts = [self.out]
        have = len(self.out)
        while have < hi:
            self.out = b""
            if not self._more():
                break
            parts.append(self.out)
            have += len(self.out)
        self.out = b"".join(parts)
        return self.out[lo:hi]

    def leave(self, end: int) -> None:
        """Go to the next record; `end` is where this one's block ends."""
        if self.gz is None:
            self.src.at = self.begin + end + 4
        elif self.skip:
            self.src.at = self.begin + self.skip
        else:
            self.out = b""
            while self._more():
                self.out = b""


def _fields(head: bytes) -> dict[bytes, str]:
    found = {}
    for line in head.split(b"\r\n")[1:]:
        k, sep, v = line.partition(b":")
        if sep:
            found.setdefault(k.strip().lower(), v.strip().decode("utf-8", "replace"))
    return found


class Damaged(ValueError):
    """A record that isn't whole."""


def _length(fields: dict[bytes, str]) -> int:
    text = fields.get(b"content-length", "")
    if not (text.isascii() and text.isdigit()):
        raise Damaged("no length in the header")
    return int(text)


def _next_start(src: _Source, after: int) -> int:
    """Where the next gzip member or plain record begins."""
    src.at = after
    while src.at < src.size:
        part = src.peek()
        found = [k for mark in (b"\x1f\x8b\x08", b"WARC/1.") if (k := part.find(mark)) >= 0]
        if found:
            return src.at + min(found)
        src.at += max(1, len(part) - 8)
    return src.size


def _record(m: _Member, row: dict, wanted, payload: bool) -> int:
    """Fills the row from a record, or marks it as one to skip; returns where its block ends."""
    body = m.until(b"\r\n\r\n")
    if body < 0 or not m.out.startswith(b"WARC/"):
        raise Damaged("the header ends early" if body < 0 else "no WARC header")
    fields = _fields(m.out[: body - 4])
    row |= {c: fields.get(h) for c, h in _HEADER.items()}
    row["refers_to"], row["record_id"] = (x.strip("<>") if x else x for x in (row["refers_to"], row["record_id"]))
    end = body + _length(fields)
    if not wanted(row):
        row["skip"] = True
        return end
    start, row["payload_length"] = body, end - body
    if fields.get(b"content-type", "").startswith("application/http"):
        start = m.until(b"\r\n\r\n", body)
        if not 0 <= start <= end:
            start = end
        inner = _fields(m.out[body:start]).get(b"content-length", "")
        row["payload_length"] = int(inner) if inner.isascii() and inner.isdigit() else end - start
    if payload and row["record_type"] != "revisit":
        row["payload"] = m.take(start, end)
        if len(row["payload"]) < end - start:
            raise Damaged(f"{len(row['payload'])} of {end - start} bytes")
        if m.gz is not None and m.skip is None and not m.gz.eof:
            m.take(start, end + 5)  # to the checksum behind the block
    return end


def read_records(file, wanted, payload: bool, permissive: bool = False) -> Iterator[dict]:
    """The records of one open file whose header columns are `wanted`."""
    src = _Source(file)
    while src.at < src.size:
        if src.peek(2) == b"\r\n":
            src.at += 2
            continue
        m, row = _Member(src), dict.fromkeys([*_HEADER, "payload_length", "payload", "damage"])
        try:
            end = _record(m, row, wanted, payload)
            if not row.pop("skip", False):
                yield row
            m.leave(end)
        except (Damaged, zlib.error) as e:
            if not permissive:
                raise ValueError(f"damaged record at byte {m.begin}: {e}") from e
            row.pop("skip", None)
            yield row | {"damage": str(e)}
            src.at = _next_start(src, m.begin + 1)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true") != "false"
        self.limit = int(options.get("partition_bytes", PARTITION_BYTES))
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in _HEADER and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in _HEADER and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in _HEADER and isinstance(f, IsNotNull | IsNull):
                self.tests.append((column, "null", isinstance(f, IsNull)))
            else:
                yield f

    def partitions(self):
        store, root = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        info = sorted(((f.path, f.size) for f in info if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and "/_" not in f.path[len(root) :]), key=lambda x: (-x[1], x[0]))
        out, names, total = [], [], 0
        for name, size in info:
            if names and total + size > self.limit:
                out.append(Files(tuple(names)))
                names, total = [], 0
            names.append(name)
            total += size
        return [*out, Files(tuple(names))] if names or not out else out

    def _wanted(self, row: dict) -> bool:
        return all(row[c] in x if kind == "in" else (row[c] is None) == x for c, kind, x in self.tests)

    def _records(self, name: str, file) -> Iterator[dict]:
        try:
            yield from read_records(file, self._wanted, self.payload, self.permissive)
        except ValueError as e:
            raise ValueError(f"{name}: {e}") from e

    def read(self, partition):
        store, _ = fs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        for name in partition.names:
            with store.open_input_file(name) as f:
                for row in self._records(name, f):
                    rows.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


def _line(name: str, value: str | None) -> str:
    if value is None:
        return ""
    return f"{name}: " + value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") + "\r\n" if "\r" in value or "\n" in value else f"{name}: {value}\r\n"


def record_bytes(row: dict) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP header only."""
    payload = (row["payload"] or b"") if row["record_type"] == "response" else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    refers = f"<{row['refers_to']}>" if row["refers_to"] is not None else None
    head = "WARC/1.1\r\n" + _line("WARC-Type", row["record_type"]) + _line("WARC-Record-ID", f"<{row['record_id']}>") + _line("WARC-Date", row["date"]) + _line("WARC-Target-URI", row["target_uri"])
    head += _line("WARC-Payload-Digest", row["payload_digest"]) + _line("WARC-Refers-To", refers)
    if row["record_type"] == "revisit":
        head += "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
    head += f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(http) + len(payload)}\r\n\r\n"
    return head.encode("utf-8", "replace") + http + payload + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field `sl` holds its own size and that of the data."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 24 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class WarcWriter(DataSourceArrowWriter):
    """Tasks write below a staging folder; commit moves what successful tasks have named."""

    def __init__(self, options: dict):
        self.path, self.staging = options["path"].rstrip("/"), f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator):
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(f"{root}/{self.staging}", recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > FILE_BYTES:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{root}/{self.staging}/{names[-1]}", compression=None), 0
                member = gzip_member(record_bytes(row))
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
        return Written(tuple(names))

    def commit(self, messages):
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        for m in messages:
            for name in m.names if m else ():
                store.move(f"{root}/{self.staging}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages):
        store, root = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32_sha1(payload):
    """The same of a binary column, by column functions: each 40 bits are eight digits of base 32."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(payload), k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_pages(pages: DataFrame, path: str, at_least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record per page to `path`.

    Of pages with equal payloads of at least `at_least` bytes the one with the largest page_id is
    a response and the others revisit it; all others are responses. Where rows repeat
    that largest page_id, each of them is a response; where none has an id, all are. Payloads
    are equal if their lengths, SHA-1 and SHA-256 are. A
    null html is an empty payload; a page without url has no target uri.
    """
    register(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1("payload")).withColumn("sha256", F.unhex(F.sha2("payload", 256))).withColumn("length", F.octet_length("payload").cast("long"))
    same = rows.groupBy("sha256", "digest", "length").agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies")).where((F.col("copies") > 1) & (F.col("length") >= at_least) & F.col("first_id").isNotNull())
    same = settle(same.select("sha256", "digest", "length", "first_id"), "payloads")
    met = rows.join(same, ["sha256", "digest", "length"], "left")
    revisit = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    out = met.select(
        name("page_id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"), F.when(revisit, name("first_id")).alias("refers_to"), F.col("length").alias("payload_length"), F.when(~revisit, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").save(path)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and digest of the payloads as read, so damage would show."""
    for batch in batches:
        payload = batch.column("payload").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array(map(len, payload), pa.int64()), pa.array([digest(p) for p in payload], pa.string())], ["record_id", "payload_bytes", "payload_digest"])


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from the archives of `pages`.

    Null html is an empty payload. Rows that repeat a page_id, or have none, each are a record; where payloads are equal,
    all with the largest page_id are responses. A null page_id stays null and is a response only where no equal payload has an id. Other columns are left aside, and an empty table gives an empty one.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_pages(pages, path)
    page = lambda c: F.when(F.length(c) > len("urn:page:"), F.substring(c, len("urn:page:") + 1, 20)).cast("long")
    read = spark.read.format("warc")
    whole = read.load(path).where("record_type = 'response'").select("record_id", "payload").mapInArrow(_read_back, "record_id string, payload_bytes long, payload_digest string")
    whole = whole.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = read.option("payload", "false").load(path).where("record_type = 'revisit'")
    again = again.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.substring("payload_digest", 6, 32).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))
    return whole.unionByName(again)
