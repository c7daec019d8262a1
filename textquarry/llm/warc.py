"""WARC archives as a Spark data source, and archives of crawled pages.

``spark.read.format("warc")`` plans whole files into partitions of a target size.
Filters on record types and headers are pushed down and decided on the headers
of a record, which are parsed first: a record that is not wanted, or whose
payload no column asks for, is skipped by its length.  Compressed records are
gzip members of their own whose extra field ``sl`` (the WARC annex on gzip) holds
their lengths, so a skipped member is not inflated beyond its headers; members
without the field are inflated to find their end.

``df.write.format("warc")`` writes a file a task under a name of its own; the
commit lists the files of the tasks that succeeded, and readers follow that list.
"""

from __future__ import annotations

import base64
import binascii
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from textquarry.llm import storage
from textquarry.plans.joins import lookup_join

SPLIT_BYTES = 128 << 20
MIN_REVISIT_BYTES = 1000
LISTING = "_records"
DATE = "1970-01-01T00:00:00Z"
LEVEL = 1

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
)

# Columns that are a header each.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
}


def _bare(value: str | None) -> str | None:
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


def _digest_hex(value: str | None) -> str | None:
    """``sha1:`` digests, base 32 or hexadecimal, as lower-case hexadecimal."""
    if not value:
        return None
    bare = value.partition(":")[2] or value
    try:
        return base64.b32decode(bare).hex() if len(bare) == 32 else bare.lower()
    except binascii.Error:  # 32 characters of something else
        return bare.lower()


def _length(value: str | None) -> int | None:
    """A length header as a number; None where it is missing or no number."""
    bare = (value or "").strip()
    return int(bare) if bare.isascii() and bare.isdigit() else None


def _columns(headers: dict[str, str]) -> dict[str, str | None]:
    found = {k.lower(): v for k, v in headers.items()}
    return {c: _bare(found.get(h.lower())) for c, h in HEADERS.items()}


# -- records in bytes


def record_bytes(row: dict, date: str = DATE) -> bytes:
    """One record.  A response carries its payload, a revisit only the HTTP head."""
    payload = row["payload"] or b""
    kind = row["record_type"]
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['payload_bytes']}\r\n\r\n"
    ).encode()
    block = head + (payload if kind == "response" else b"")
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_clean(row['record_id'])}>",
        f"WARC-Date: {row.get('date') or date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {row['payload_bytes']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if row.get("target_uri") is not None:
        lines.insert(4, f"WARC-Target-URI: {_clean(row['target_uri'])}")
    if row.get("refers_to") is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        lines[4:4] = [f"WARC-Refers-To: <{_clean(row['refers_to'])}>", f"WARC-Profile: {profile}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _clean(value: str) -> str:
    """A value that cannot end its header line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def gzip_member(record: bytes, level: int = LEVEL) -> bytes:
    """A record as a gzip member with the ``sl`` field."""
    press = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = press.compress(record) + press.flush()
    size = 12 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(record) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + b"\x00" * 4 + b"\x00\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def parse_head(data: bytes) -> tuple[dict[str, str], int] | None:
    """(headers, length of the head) of a record's first bytes; None if it goes on."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = re.sub(r"\r\n[ \t]+", " ", data[:end].decode("utf-8", "replace")).split("\r\n")
    pairs = (line.partition(":") for line in lines[1:])
    return {k.strip(): v.strip() for k, _, v in pairs}, end + 4


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    """The block without its HTTP head."""
    if headers.get("Content-Type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


class _Stream:
    """Records of one file: ``(headers, read)``; ``read()`` gives the block."""

    def __init__(self, source):
        self.source = source
        self.size = source.size()

    def __iter__(self) -> Iterator:
        self.source.seek(0)
        zipped = self.source.read(2) == b"\x1f\x8b"
        at = 0
        while at < self.size:
            headers, read, at = self._member(at) if zipped else self._plain(at)
            if headers is not None:
                yield headers, read

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _plain(self, at: int):
        n = 4096
        while (head := parse_head(data := self._at(at, n))) is None:
            if len(data) < n:
                return None, None, self.size
            n *= 4
        headers, length = head
        size = _length(headers.get("Content-Length"))
        if size is None:  # the block ends where the next record begins
            size = self._next_record(at + length) - at - length
        return headers, lambda: self._at(at + length, size), at + length + size + 4

    def _next_record(self, at: int) -> int:
        """Where the block that begins at ``at`` ends, told by the next record."""
        mark, step = b"\r\n\r\nWARC/1.", 1 << 20
        while at < self.size:
            found = self._at(at, step + len(mark)).find(mark)
            if found >= 0:
                return at + found
            at += step
        return self.size - 4 * (self._at(self.size - 4, 4) == mark[:4])

    def _member(self, at: int):
        first = self._at(at, 4096)
        size = None
        if first[3] == 4 and first[12:14] == b"sl":
            size = struct.unpack("<I", first[16:20])[0]
        unzip = zlib.decompressobj(31)
        data = unzip.decompress(first[:size], 4096)
        read, n = len(first), 4096
        while (head := parse_head(data)) is None and not unzip.eof:
            more = unzip.unconsumed_tail or self._at(at + read, n)
            read += 0 if unzip.unconsumed_tail else len(more)
            if not more:
                return None, None, self.size
            data += unzip.decompress(more, 4096)
        if head is None:
            return None, None, at + size if size else self.size
        headers, length = head
        if size:
            whole = lambda: zlib.decompress(self._at(at, size), 31)
        else:  # the end is known only after inflating
            data, size = self._inflate(at)
            whole = lambda d=data: d
        block = _length(headers.get("Content-Length"))
        if block is None:  # what the member holds, without the record's end
            return headers, lambda: whole()[length:].removesuffix(b"\r\n\r\n"), at + size
        return headers, lambda: whole()[length : length + block], at + size

    def _inflate(self, at: int) -> tuple[bytes, int]:
        unzip, parts, read = zlib.decompressobj(31), [], 0
        while not unzip.eof and (more := self._at(at + read, 1 << 20)):
            parts.append(unzip.decompress(more))
            read += len(more)
        return b"".join(parts), read - len(unzip.unused_data)


# -- data source


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def _wanted(filters: list, headers: dict[str, str]) -> bool:
    columns = _columns(headers)
    for kind, name, value in filters:
        have = columns[name] if name in columns else headers.get(name[8:])
        if kind == "null":
            if have is None:
                return False
        elif have is None or not {
            "eq": lambda h, v: h == v,
            "in": lambda h, v: h in v,
            "starts": lambda h, v: h.startswith(v),
        }[kind](have, value):
            return False
    return True


class WarcReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.names = schema.names
        self.path = options["path"].rstrip("/")
        self.split = int(options.get("splitbytes") or options.get("splitBytes") or SPLIT_BYTES)
        self.filters: list[tuple] = []

    def pushFilters(self, filters: list) -> Iterable:  # noqa: N802
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            # A key of the headers map reads as headers.<name>.
            if name in HEADERS or name.startswith("headers."):
                if isinstance(f, EqualTo) and f.value is not None:
                    self.filters.append(("eq", name, f.value))
                    continue
                if isinstance(f, In):
                    self.filters.append(("in", name, tuple(f.value)))
                    continue
                if isinstance(f, StringStartsWith):
                    self.filters.append(("starts", name, f.value))
                    continue
                if isinstance(f, IsNotNull):
                    self.filters.append(("null", name, None))
                    continue
            yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = storage.filesystem(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [_Files([self.path])]
        base = path.rstrip("/")
        found = {
            i.base_name: i.size
            for i in system.get_file_info(fs.FileSelector(path))
            if re.search(r"\.warc(\.gz)?$", i.base_name) and i.is_file
        }
        if system.get_file_info(f"{base}/{LISTING}").type == fs.FileType.File:
            with system.open_input_file(f"{base}/{LISTING}") as listing:
                found = {n: found[n] for n in listing.read().decode().split("\n") if n}
        out: list[list[str]] = []
        room = 0
        for name in sorted(found):
            if not out or found[name] > room:
                out.append([])
                room = self.split
            out[-1].append(f"{self.path}/{name}")
            room -= found[name]
        return [_Files(files) for files in out]

    def read(self, partition: _Files | None) -> Iterator[tuple]:
        for name in partition.files if partition else []:  # no files: no partition
            system, path = storage.filesystem(name)
            with system.open_input_file(path) as source:
                for headers, read in _Stream(source):
                    if _wanted(self.filters, headers):
                        yield self._row(headers, read)

    def _row(self, headers: dict[str, str], read) -> tuple:
        row: dict = _columns(headers)
        if "payload" in self.names:
            row["payload"] = _payload(headers, read())
        row["payload_digest"] = _digest_hex(headers.get("WARC-Payload-Digest"))
        row["payload_bytes"] = _length(headers.get("X-Payload-Length", headers.get("Content-Length")))
        row["headers"] = headers
        return tuple(row[n] for n in self.names)


class _Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.zipped = options.get("compression", "gzip") == "gzip"

    def write(self, iterator: Iterator) -> _Written:
        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.zipped
        system, path = storage.filesystem(self.path)
        system.create_dir(path, recursive=True)
        out = None
        for batch in iterator:
            out = out or system.open_output_stream(f"{path}/{name}", compression=None)
            columns = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                record = record_bytes({n: c[i].as_py() for n, c in columns.items()})
                out.write(gzip_member(record) if self.zipped else record)
        if out is None:
            return _Written(None)
        out.close()
        return _Written(name)

    def commit(self, messages: list) -> None:
        """Name the files of the tasks that succeeded: a line a task."""
        names = sorted(m.name for m in messages if m is not None and m.name)
        system, path = storage.filesystem(self.path)
        system.create_dir(path, recursive=True)
        storage.write_bytes(f"{self.path}/{LISTING}", "\n".join(names).encode())

    def abort(self, messages: list) -> None:
        """Nothing to do: no list names the files."""


class WarcDataSource(DataSource):
    """``warc``: options path, splitBytes (reading), compression gzip or none (writing)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``warc`` known to a session, with filters pushed down to it."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# -- archives of pages


def page_records(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
) -> DataFrame:
    """A record for every page: ``SCHEMA`` without headers.

    Of records with equal payloads of at least ``min_revisit_bytes`` the one with
    the largest id is a response and the others revisit it.  A null html is an
    empty payload.  A null id stands as ``urn:page:none`` and is always a
    response; rows that share the largest id are all responses.  A null url has
    no header.  Other columns are not read.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").alias("page"),
        F.col(f"`{url_col}`").cast("string").alias("target_uri"),
        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "same": F.sha2("payload", 256)}
    )
    able = rows.where((F.col("payload_bytes") >= min_revisit_bytes) & F.col("page").isNotNull())
    groups = (
        able.groupBy("same")
        .agg(F.max("page").alias("kept"), F.min("page").alias("other"))
        .where("kept <> other")
        .select("same", "kept")
    )
    joined = lookup_join(rows, groups, ["same"], "left")
    revisit = F.coalesce(F.col("page") < F.col("kept"), F.lit(False))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    return joined.select(
        urn("page").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(DATE).alias("date"),
        F.when(revisit, urn("kept")).alias("refers_to"),
        F.sha1("payload").alias("payload_digest"),
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str, **settings) -> None:
    """Archive pages: one file a task.

    Groups of equal payloads measured to be few go to the pages, and no payload is
    shuffled; beyond that bound payloads meet their group by digest.  An empty table
    writes no record.
    """
    register(pages.sparkSession)
    page_records(pages, **settings).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """Records of a file or folder; payloads are decoded only if ``columns`` has them.

    A record without a readable length has null payload_bytes, and its block ends where
    the next record begins; a digest in neither base 32 nor hexadecimal is given as it is.
    """
    register(spark)
    return spark.read.format("warc").schema(columns).load(path)
