"""WARC as a Spark data source: write records, and read them back headers first.

Reading plans one partition for each group of files, takes record-type and header predicates, and
parses headers before anything else. Records written here carry the length of their compressed
member in the gzip header (subfield SL), so that a record which is not wanted is skipped without
being decompressed. A payload is decoded only if the schema that is read has the payload column.
Plain and gzip archives from elsewhere are read too: their headers also come first, and blocks that
are not wanted are inflated piece by piece and dropped.

Damaged archives: a record is damaged if its member cannot be inflated or is cut off, its block is cut off,
or its headers have no end within HEAD_MOST bytes or no usable Content-Length. Reading goes on at the next
place where a record or a gzip member begins, so that every good one after it is still read. Of a gzip member
from elsewhere the records before the damage stand, and what is left of the last one. Other damaged
records are left out; with the option `damaged` set to `rows` each is a row of record_type `damaged` whose
headers tell its place in the file and the reason, so that they can be counted. Lines may end with CRLF or LF.

Paths are opened through pyarrow's file systems: file and whatever else pyarrow reaches.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import DataType, StructType

from .common import cut, remove, scratch

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_length long, refers_to string, headers map<string,string>, payload binary"
#: Columns that stand in a header of their own.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "payload_length": "X-Payload-Length"}
KNOWN = {n.lower(): n for n in (*HEADERS.values(), "Content-Length", "Content-Type", "WARC-Profile", "WARC-Block-Digest")}
FILE_BYTES = 64 << 20
#: Plain bytes that are inflated at a time.
PIECE = 1 << 16
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Headers of a record may have so many bytes.
HEAD_MOST = 1 << 20
HEAD_END, LINE_END = re.compile(rb"\r?\n\r?\n"), re.compile(rb"\r?\n")
GZIP = b"\x1f\x8b\x08"
UNSAFE = re.compile(r"[\x00-\x1f\x7f]")


def field(value: object) -> bytes:
    """A header value; control characters are percent-encoded."""
    return UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", str(value)).encode("utf-8", "replace")


def record(row: dict) -> bytes:
    """One WARC record. A revisit has the HTTP head alone as its block."""
    revisit = row["record_type"] == "revisit"
    block = HTTP_HEAD + (b"" if revisit else row.get("payload") or b"")
    head = [b"WARC/1.1"]
    for column, name in HEADERS.items():
        if row.get(column) is not None:
            value = row[column]
            value = f"<{value}>" if column in ("record_id", "refers_to") else f"sha1:{value}" if column == "payload_digest" else value
            head.append(name.encode() + b": " + field(value))
    if revisit:
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: " + str(len(block)).encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose header tells its compressed and its plain length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"SL", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_head(head: bytes) -> dict[str, str]:
    """Headers by name; names that this module knows in its own spelling, whatever their letter case,
    others as they stand. A line that starts with white space goes on with the header before it."""
    out: dict[str, str] = {}
    last = None
    for line in LINE_END.split(head)[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            out[last] = f"{out[last]} {text.strip()}".strip()
            continue
        name, _, value = text.partition(":")
        if name:
            last = KNOWN.get(name.strip().lower(), name.strip())
            out[last] = value.strip()
    return out


def number(raw: str | None) -> int | None:
    """A length as headers tell it; None for what is no whole number of at least 0."""
    return int(raw) if raw is not None and raw.isascii() and raw.isdigit() and len(raw) < 19 else None


def damage(at: int, reason: str) -> dict[str, str]:
    return {"WARC-Type": "damaged", "X-File-Position": str(at), "X-Reason": reason}


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    paths: tuple[str, ...]


class Buffered:
    """Forward reading with a look ahead."""

    def __init__(self, stream, step: int = 1 << 20) -> None:
        self.stream, self.step, self.held = stream, step, b""
        self.end = stream.seek(0, 2) if stream.seekable() else None
        if self.end is not None:
            self.end = stream.tell()
            stream.seek(0)

    @property
    def at(self) -> int:
        return self.stream.tell() - len(self.held)

    def look(self, n: int) -> bytes:
        while len(self.held) < n and (more := self.stream.read(max(self.step, n - len(self.held)))):
            self.held += more
        return self.held[:n]

    def take(self, n: int) -> bytes:
        out = self.look(n)
        self.held = self.held[len(out) :]
        return out

    def has(self, n: int) -> bool:
        """Whether there are so many bytes left."""
        return self.at + n <= self.end if self.end is not None else len(self.look(n)) == n

    def skip(self, n: int) -> bool:
        """False where the file ends before."""
        there = self.has(n)
        if n <= len(self.held):
            self.held = self.held[n:]
        else:
            self.stream.seek(self.stream.tell() + n - len(self.held))
            self.held = b""
        return there

    def to_next(self, *marks: bytes) -> None:
        """On to the first of the marks after this place, or to the end."""
        self.take(1)
        longest = max(map(len, marks))
        while seen := self.look(self.step):
            found = [k for mark in marks if (k := seen.find(mark)) >= 0]
            if found:
                self.take(min(found))
                return
            self.take(len(seen) if len(seen) < self.step else len(seen) - longest + 1)


class Member:
    """The plain bytes of one gzip member, inflated piece by piece as they are asked for; what is
    skipped is never held whole."""

    def __init__(self, source: Buffered) -> None:
        self.source, self.opened, self.held, self.inflated = source, zlib.decompressobj(31), bytearray(), 0
        self.start, self.damaged = source.at, ""

    @property
    def at(self) -> int:
        return self.start

    def more(self) -> bool:
        """Inflates another piece; false at the member's end, and where it is damaged or cut off."""
        if self.opened.eof or self.damaged:
            return False
        packed = self.opened.unconsumed_tail or self.source.take(PIECE)
        if not packed:
            self.damaged = "the member is cut off"
            return False
        try:
            piece = self.opened.decompress(packed, PIECE)
        except zlib.error:  # what came before stands
            self.damaged = "the member cannot be inflated"
            self.source.held = packed + self.source.held
            return False
        self.inflated += len(piece)
        self.held += piece
        return True

    def look(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        return bytes(self.held[:n])

    def take(self, n: int) -> bytes:
        out = self.look(n)
        del self.held[: len(out)]
        return out

    def skip(self, n: int) -> bool:
        while n > len(self.held):
            n -= len(self.held)
            self.held.clear()
            if not self.more():
                return n == 0
        del self.held[:n]
        return True

    def to_next(self, *marks: bytes) -> None:
        """The place of a next record inside a member is not looked for."""
        while self.held or self.more():
            self.held.clear()

    def close(self) -> None:
        """To the member's end; bytes of the next one go back to the source. After damage the source goes
        on to the next member."""
        self.to_next()
        if self.damaged:
            self.source.to_next(GZIP)
        else:
            self.source.held = self.opened.unused_data + self.source.held


def head_and_size(reader: Buffered | Member) -> tuple[bytes, int] | None:
    """The next record's headers and the bytes that they take with what ends them; the reader stays before
    them. None where they have no end. Line ends that are left of the record before are passed over."""
    while reader.look(1) in (b"\r", b"\n"):
        reader.skip(1)
    n = 4096
    while not (found := HEAD_END.search(seen := reader.look(n))) and len(seen) == n and n < HEAD_MOST:
        n *= 2
    return (seen[: found.start()], found.end()) if found else None


def head_of(reader: Buffered | Member) -> bytes | None:
    found = head_and_size(reader)
    return found[0] if found else None


def plain_records(reader: Buffered | Member, wanted, need_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Records one after another, up to the end or to a gzip member; the block of one that is not wanted is
    skipped."""
    while True:
        head = head_and_size(reader)
        begin = reader.look(5)
        if not begin or (isinstance(reader, Buffered) and begin.startswith(GZIP)):
            return
        at, reason, headers, block = reader.at, "", {}, None
        if head is None or not begin.startswith(b"WARC/"):
            reason = "no headers"
        else:
            headers = parse_head(head[0])
            length = number(headers.get("Content-Length"))
            if length is None:
                reason = "no usable Content-Length"
            else:
                reader.skip(head[1])
                take = need_payload and wanted(headers)
                block = reader.take(length) if take else None
                there = len(block) == length if take else reader.skip(length)
                if not there and isinstance(reader, Buffered):  # of a member what came before the damage stands
                    reason = "the block is cut off"
        if reason:
            headers, block = damage(at, reason), None
            reader.to_next(b"WARC/1", GZIP)
        if wanted(headers):
            yield headers, block


def own_member(source: Buffered, wanted, need_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """The record of a member that tells its length: its first bytes alone are inflated for the headers, the
    rest only if the payload is wanted."""
    at, size = source.at, struct.unpack("<I", source.look(20)[16:20])[0]
    headers, block, reason = {}, None, ""
    try:
        n, found = 2048, None
        while not (found := HEAD_END.search(data := zlib.decompressobj(31).decompress(source.look(min(n, size))))) and n < size:
            n *= 4
        headers = parse_head(data[: found.start()]) if found else {}
        length = number(headers.get("Content-Length"))
        if not source.has(size):
            reason = "the member is cut off"
        elif length is None:
            reason = "no usable Content-Length" if found else "no headers"
        elif need_payload and wanted(headers):
            block = zlib.decompress(source.look(size), 31)[found.end() : found.end() + length]
            reason = "" if len(block) == length else "the block is cut off"
    except zlib.error:
        reason = "the member cannot be inflated"
    after = source.look(size + 3)[size:] if reason and source.has(size) else GZIP
    if reason and (size < 24 or not source.has(size) or (after and after != GZIP)):
        source.to_next(GZIP)
    else:
        source.skip(size)
    headers, block = (damage(at, reason), None) if reason else (headers, block)
    if wanted(headers):
        yield headers, block


def records_of(stream, wanted, need_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block or None) of each record that `wanted(headers)` accepts; damaged ones have the headers
    of `damage`. Headers are looked at first; members that do not tell their length are inflated piece by
    piece."""
    source = Buffered(stream)
    while start := source.look(24):
        if start[:2] != GZIP[:2]:
            yield from plain_records(source, wanted, need_payload)
        elif len(start) == 24 and start[3] == 4 and start[12:14] == b"SL":
            yield from own_member(source, wanted, need_payload)
        else:
            member_ = Member(source)
            yield from plain_records(member_, wanted, need_payload)
            member_.close()
            if member_.damaged and wanted(headers := damage(member_.start, member_.damaged)):
                yield headers, None


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns, self.options = schema.names, dict(options)
        self.equal: dict[str, set[str]] = {}
        if self.options.get("recordtypes"):
            self.equal["record_type"] = {x.strip() for x in self.options["recordtypes"].split(",")}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership on header columns; the rest stays with Spark."""
        for f in sorted(filters, key=lambda f: isinstance(f, IsNotNull)):  # a value that is asked for is not null
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and name != "payload_length" and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equal[name] = self.equal.get(name, values) & values
            elif isinstance(f, IsNotNull) and name in self.equal:
                continue
            else:
                yield f

    def partitions(self) -> list[Files]:
        where, base = fs.FileSystem.from_uri(self.options["path"])
        info = where.get_file_info(base)
        found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(base, recursive=True))
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path))
        groups, held, size = [], [], 0
        for path, n in files:
            if held and size + n > FILE_BYTES:
                groups.append(Files(tuple(held)))
                held, size = [], 0
            held.append(path)
            size += n
        return [*groups, Files(tuple(held))]

    def value(self, column: str, headers: dict[str, str]) -> object:
        raw = headers.get(HEADERS[column])
        if raw is None:
            return None
        if column in ("record_id", "refers_to"):
            return raw.strip("<>")
        if column == "payload_digest":
            return raw.rpartition(":")[2]
        return number(raw) if column == "payload_length" else raw

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(self.options["path"])
        told = self.options.get("damaged") == "rows"
        wanted = lambda h: (told or h.get("WARC-Type") != "damaged") and all(self.value(c, h) in v for c, v in self.equal.items())
        kinds = {"headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary(), "payload_length": pa.int64()}
        held: dict[str, list] = {c: [] for c in self.columns}
        size = 0
        need = "payload" in self.columns

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held[c], kinds.get(c, pa.string())) for c in self.columns], self.columns)

        for path in partition.paths:
            with where.open_input_file(path) as stream:
                for headers, block in records_of(stream, wanted, need):
                    for c in self.columns:
                        held[c].append(list(headers.items()) if c == "headers" else self.payload(headers, block) if c == "payload" else self.value(c, headers))
                    size += 500 + len(block or b"")
                    if size > 8 << 20:
                        yield batch()
                        held, size = {c: [] for c in self.columns}, 0
        if size:
            yield batch()

    @staticmethod
    def payload(headers: dict[str, str], block: bytes | None) -> bytes | None:
        """The block after its HTTP head, if it has one; null for a revisit."""
        if block is None or headers.get("WARC-Type") == "revisit":
            return None
        return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, base = fs.FileSystem.from_uri(self.path)
        where.create_dir(f"{base}/_unfinished", recursive=True)
        done, out, size = [], None, 0
        for batch in iterator:
            for k in range(batch.num_rows):
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    done.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = where.open_output_stream(f"{base}/_unfinished/{done[-1]}", compression=None), 0
                size += out.write(packed := member(record({n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}))) or len(packed)
        if out is not None:
            out.close()
        return Written(tuple(done))

    def commit(self, messages: list) -> None:
        """Only the files of tasks that succeeded move to their place."""
        where, base = fs.FileSystem.from_uri(self.path)
        where.create_dir(base, recursive=True)
        for m in messages:
            for name in m.paths if m else ():
                where.move(f"{base}/_unfinished/{name}", f"{base}/{name}")
        if where.get_file_info(f"{base}/_unfinished").type == fs.FileType.Directory:
            where.delete_dir(f"{base}/_unfinished")

    def abort(self, messages: list) -> None:
        where, base = fs.FileSystem.from_uri(self.path)
        if where.get_file_info(f"{base}/_unfinished").type == fs.FileType.Directory:
            where.delete_dir(f"{base}/_unfinished")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """Records of an archive or a folder of archives; only the columns of the given schema are
    read. Filters on header columns are pushed into the scan (this turns on the session setting
    that Spark needs for it). An empty folder gives an empty table; what has no type or id, which the
    format demands of records, is no record.

    Spark keeps the filters that one query pushed for the next query of the same table that pushes
    none. Each query is therefore given one, that the type (or the id) is not null."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    out = spark.read.format("warc").schema(columns).load(path)
    known = [c for c in ("record_type", "record_id") if c in out.columns]
    return out.where(F.col(known[0]).isNotNull()) if known else out


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32 without a prefix, in built-in functions: five hex digits make
    four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    digits = F.sha1(data)
    out = []
    for k in range(8):
        n = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substr(letters, F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


#: Rows of payloads that stand more than once that may be broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000


#: Record ids: a row's key after the first, percent-encoded; of a null key the second.
ROW, NO_ROW = "urn:row:", "urn:no-row"


def key_of(record_id: Column, kind: DataType) -> Column:
    """The key that a record id was made of."""
    return F.when(record_id.startswith(ROW), F.url_decode(F.substr(record_id, F.lit(len(ROW) + 1)))).cast(kind)


def archive(pages: DataFrame, path: str, *, key_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", smallest: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes one record for each row into the folder `path`.

    Of rows with equal payloads of at least `smallest` bytes, those with the largest key are
    responses and the others revisit it; smaller payloads are responses all. Null payloads are
    empty. A null key is below all others; where it is the only key of its payload, its row is a
    response. Repeated rows bring a record each. Other columns are not read. An empty table makes
    an empty folder.
    """
    rows = pages.select(F.col(key_col).alias("key"), F.col(uri_col).alias("target_uri"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload"))).withColumn("payload_length", F.octet_length("payload").cast("long"))
    narrow = rows.where(F.col("payload_length") >= smallest).groupBy("payload_digest").agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").select("payload_digest", "first").persist()
    few = narrow.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(narrow) if few else narrow, "payload_digest", "left")
    revisit = (F.col("payload_length") >= smallest) & F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    name = lambda c: F.coalesce(F.concat(F.lit(ROW), F.url_encode(F.col(c).cast("string"))), F.lit(NO_ROW))
    records = joined.select(name("key").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(date).alias("date"), "payload_digest", "payload_length", F.when(revisit, name("first")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"))
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").mode("append").save(path)
    narrow.unpersist()


def round_trip(pages: DataFrame, *, smallest: int = 0) -> DataFrame:
    """Archives the pages in the shared folder and reads the archives back: page_id, payload_bytes,
    payload_digest, record_type, refers_to. Length and digest of responses are taken from the
    payloads as read; revisits are read by their headers alone. The archives go once the result is
    kept in the shared folder; `archive` is for those that are to stay. Page ids of any kind come back
    as they were."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    archive(pages, path, smallest=smallest)
    kind = pages.schema["page_id"].dataType
    responses = read_warc(spark, path, "record_id string, record_type string, payload binary").where("record_type = 'response'")
    revisits = read_warc(spark, path, "record_id string, record_type string, payload_digest string, payload_length long, refers_to string").where("record_type = 'revisit'")
    key = lambda c: key_of(F.col(c), kind)
    read = responses.select(key("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    out = cut(read.unionAll(revisits.select(key("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", key("refers_to").alias("refers_to"))))
    remove(spark, path)
    return out
