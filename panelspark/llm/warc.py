"""WARC archives as a Python data source: written one file a task, read in file ranges with headers first.

Every record is a gzip member of its own whose header names its compressed
length, so a reader can go from record to record, inflating no more than the
headers, and inflate the payload of the wanted ones only. Archives of other
writers, without that field or without compression, are read as well.
"""

from __future__ import annotations

import datetime
import json
import os
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from panelspark.functions.stage import stage, stage_folder

HEADERS = ("record_type", "record_id", "target_uri", "date", "payload_digest", "refers_to")
FIELD = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
         "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_bytes long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"


def located(spark: SparkSession, path: str) -> str:
    """The path with its file system; one without a scheme lies where Spark itself would look for it."""
    if "://" in path or path.startswith("file:"):
        return path
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return ("file://" + os.path.abspath(path)) if default.startswith("file:") else default.rstrip("/") + "/" + path.lstrip("/")


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member with its own length and that of its content in the extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(record))
    return MAGIC + struct.pack("<BIBB", 4, 0, 0, 255) + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def clean(value) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " else " " for c in str(value))


def record(row: dict) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP headers of the payload only."""
    payload = row["payload"] or b""
    size = len(payload) if row["payload_bytes"] is None else row["payload_bytes"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (b"" if row["record_type"] == "revisit" else payload)
    lines = ["WARC/1.1", *(f"{FIELD[c]}: {clean(row[c])}" for c in HEADERS if row[c] is not None)]
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class Tail:
    """A file read forward from a place, in pieces; what was passed is let go when the next piece is read."""

    def __init__(self, file, place: int, piece: int = 1 << 20):
        self.file, self.place, self.piece, self.buffer, self.at, self.ended = file, place, piece, b"", 0, False
        file.seek(place)

    def left(self) -> int:
        return len(self.buffer) - self.at

    def peek(self, a: int, b: int) -> bytes:
        """Bytes a to b from here on, as far as they are held."""
        return self.buffer[self.at + a:self.at + b]

    def find(self, what: bytes) -> int:
        i = self.buffer.find(what, self.at)
        return i - self.at if i >= 0 else -1

    def more(self) -> bool:
        got = b"" if self.ended else self.file.read(self.piece)
        self.ended = not got
        if got:
            self.buffer, self.at = self.buffer[self.at:] + got, 0
        return bool(got)

    def need(self, n: int) -> bool:
        while self.left() < n and self.more():
            pass
        return self.left() >= n

    def skip(self, n: int) -> None:
        if n <= self.left():
            self.at += n
        else:
            self.file.seek(self.place + n)
            self.buffer, self.at, self.ended = b"", 0, False
        self.place += n


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    path: str
    size: int
    marks: list


class WarcSource(DataSource):
    """``spark.read.format("warc")``: options path, payload (default true), splitBytes, where (header values wanted, as JSON)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        pushes = self.options.get("pushdown", "false").lower() == "true"
        return (PushingReader if pushes else WarcReader)(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


class WarcWriter(DataSourceArrowWriter):
    """Files are named anew by every attempt; a manifest of each write, written last, names those that count.

    The manifest also holds places where records begin, one per ``markBytes`` or
    so, at which a reader may cut the file.
    """

    def __init__(self, options):
        self.path, self.level, self.mark = options["path"].rstrip("/"), int(options.get("level", 6)), int(options.get("markbytes", 1 << 20))

    def write(self, iterator):
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        name, size, marks = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    if size - marks[-1] >= self.mark:
                        marks.append(size)
                    size += out.write(member(record(row), self.level))
        return Written(name, size, marks)

    def commit(self, messages):
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps([[m.path, m.size, m.marks] for m in messages if m]).encode())

    def abort(self, messages):
        fs, root = filesystem(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{root}/{m.path}")


class WarcReader(DataSourceReader):
    """Equalities on header columns are tested before a payload is inflated.

    They come as the option ``where``, or pushed down by Spark where its setting
    allows that for Python sources. Files are cut only where a manifest says
    that a record begins; archives from elsewhere, whose payloads may hold
    anything that looks like a record, are read from their start by one task.
    """

    def __init__(self, options, schema):
        self.path, self.payload = options["path"].rstrip("/"), options.get("payload", "true").lower() != "false"
        self.split = int(options.get("splitbytes", 32 << 20))
        self.wanted = [(c, set(values)) for c, values in json.loads(options.get("where", "{}")).items()]

    def partitions(self):
        from pyarrow import fs as pafs

        fs, root = filesystem(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            files = {root: (fs.get_file_info(root).size, [0])}
        else:
            found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
            lists = [x.path for x in found if re.fullmatch(r"manifest(-[0-9a-f]{32})?\.json", x.base_name)]
            # a writer's own files count once a manifest names them, archives from elsewhere as they lie there
            own = re.compile(r"part-[0-9a-f]{32}\.warc\.gz").fullmatch if lists else lambda name: None
            files = {x.path: (x.size, [0]) for x in found if x.path.endswith((".warc", ".warc.gz")) and not own(x.base_name)}
            for path in lists:
                with fs.open_input_stream(path, compression=None) as f:
                    files |= {f"{path.rsplit('/', 1)[0]}/{name}": (size, rest[0] if rest else [0]) for name, size, *rest in json.loads(f.read())}
        out = []
        for path, (size, marks) in sorted(files.items()):
            cuts = [0]
            for mark in marks:
                if mark - cuts[-1] >= self.split:
                    cuts.append(mark)
            out += [Range(path, a, b) for a, b in zip(cuts, [*cuts[1:], size])]
        return out or [Range("", 0, 0)]

    def read(self, partition):
        if partition.end <= partition.start:
            return
        fs, _ = filesystem(self.path)
        rows, held = [], 0
        with fs.open_input_file(partition.path) as file:
            for row in self.records(Tail(file, partition.start), partition.start, partition.end):
                rows.append(row)
                held += len(row[-1] or b"")
                if len(rows) >= 2000 or held >= 1 << 23:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows):
        types = [*[pa.string()] * len(HEADERS), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[*HEADERS, "payload_bytes", "payload"])

    def records(self, tail, start, end):
        """The records of a range, which begins and ends with one."""
        while tail.place < end and tail.need(4):
            got = self.compressed(tail) if tail.peek(0, 3) == MAGIC else self.plain(tail)
            if got:
                yield got

    def skip_length(self, tail) -> int | None:
        """The compressed length that a member's extra field gives."""
        if not tail.need(12) or not tail.peek(3, 4)[0] & 4:
            return None
        size = struct.unpack("<H", tail.peek(10, 12))[0]
        tail.need(12 + size)
        at, extra = 0, tail.peek(12, 12 + size)
        while at + 4 <= len(extra):
            n = struct.unpack_from("<H", extra, at + 2)[0]
            if extra[at:at + 2] == b"sl" and n == 8:
                return struct.unpack_from("<I", extra, at + 4)[0]
            at += 4 + n
        return None

    def compressed(self, tail):
        length = self.skip_length(tail)
        inflate, content, used, fed = zlib.decompressobj(31), b"", 0, 0
        head = None
        while not inflate.eof:
            if fed >= tail.left() and not tail.more():
                break
            piece = tail.peek(fed, fed + (2048 if head is None else 1 << 20))
            fed += len(piece)
            content += inflate.decompress(piece)
            if head is None and (i := content.find(b"\r\n\r\n")) >= 0:
                head, used = parse(content[:i]), i + 4
                keep = self.passes(head)
                if length and (not keep or not self.body_needed(head, content, used)):
                    break
        consumed = length or fed - len(inflate.unused_data)
        tail.skip(consumed)
        return self.row(head, content[used:]) if head and keep else None

    def plain(self, tail):
        while tail.need(2) and tail.peek(0, 2) == b"\r\n":
            tail.skip(2)
        while (i := tail.find(b"\r\n\r\n")) < 0:
            if not tail.more():
                tail.skip(max(1, tail.left()))
                return None
        head = parse(tail.peek(0, i))
        size = int(head.get("content-length", 0))
        block = b""
        if keep := self.passes(head):
            tail.need(i + 4 + (size if self.body_needed(head, b"", 0) else min(size, 4096)))
            block = tail.peek(i + 4, i + 4 + size)
        tail.skip(i + 4 + size + 4)
        return self.row(head, block) if keep else None

    def passes(self, head) -> bool:
        return all(head.get(FIELD[c].lower()) in values for c, values in self.wanted)

    def body_needed(self, head, content, used) -> bool:
        """Whether more than the HTTP headers must be inflated."""
        return self.payload or b"\r\n\r\n" not in content[used:]

    def row(self, head, block):
        block = block[:int(head.get("content-length", len(block)))]
        http, found, payload = block.partition(b"\r\n\r\n")
        if "application/http" not in head.get("content-type", "") or not found:
            http, payload = b"", block
        size = int(parse(http).get("content-length", -1)) if http else int(head.get("content-length", 0))
        body = payload if self.payload and head.get("warc-type") != "revisit" else None
        return (*(head.get(FIELD[c].lower()) for c in HEADERS), size if size >= 0 else len(payload), body)


class PushingReader(WarcReader):
    """Takes over the filters that Spark offers; Spark allows this only with spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute[0] in HEADERS and len(f.attribute) == 1:
                self.wanted.append((f.attribute[0], {f.value}))
            elif isinstance(f, In) and f.attribute[0] in HEADERS and len(f.attribute) == 1:
                self.wanted.append((f.attribute[0], set(f.value)))
            else:
                yield f


def write_warc(records: DataFrame, path: str, **options) -> None:
    """Write rows of (HEADERS, payload_bytes, payload) as archives below ``path``, beside what lies there.

    Null headers are left out of the record; a null payload is an empty one, and
    a null payload_bytes is the payload's size. Repeated rows are records of
    their own. No rows write an empty list of files. Other columns are not
    looked at.
    """
    spark = records.sparkSession
    spark.dataSource.register(WarcSource)
    records.select(*HEADERS, "payload_bytes", "payload").write.format("warc").options(**options).mode("append").save(located(spark, path))


def read_warc(spark: SparkSession, path: str, payload: bool = True, where: dict | None = None, **options) -> DataFrame:
    """Records of the archives at ``path``: (HEADERS, payload_bytes, payload).

    ``where`` names header columns and the values wanted of each; other records
    are passed over before their payload is inflated. Where the session allows
    pushdown to Python sources, filters on header columns are taken over too. Without ``payload`` no
    payload is inflated beyond its HTTP headers, and it is null; that of a
    revisit is always null. Headers that a record lacks are null; an empty
    payload is empty. Records that are stored twice are read twice; a folder
    without archives, or none, has no records.
    """
    unknown = set(where or {}) - set(HEADERS)
    if unknown:
        raise ValueError(f"no header columns: {sorted(unknown)}")
    spark.dataSource.register(WarcSource)
    wanted = json.dumps({c: [v] if isinstance(v, str) else list(v) for c, v in (where or {}).items()})
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("warc").options(payload=str(payload).lower(), where=wanted, pushdown=pushes, **options).load(located(spark, path))


def page_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """Records for rows of (page_id, url, html): of equal payloads of ``least`` bytes the smallest page_id is the response.

    The others are revisits without payload that refer to it; rows that repeat
    its page_id are responses too. A null html is the empty payload, a null
    page_id comes after all others and its record has no id.
    """
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    again = stage(rows.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    rows = rows.join(again, "digest", "left")
    revisit = (F.col("payload_bytes") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    revisit = F.coalesce(revisit, F.lit(False))
    urn = F.lit("urn:x-page:")
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.concat(F.lit("<"), urn, "page_id", F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(datetime.datetime(2024, 1, 1).strftime("%Y-%m-%dT%H:%M:%SZ")).alias("date"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.when(revisit, F.concat(F.lit("<"), urn, "first", F.lit(">"))).alias("refers_to"),
        "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from the archives of ``pages``.

    Digest and size of a response are those of the payload that was read; a
    revisit has them from its headers. No pages, no rows. Columns other than
    page_id, url and html are not looked at.
    """
    spark = pages.sparkSession
    path = path or f"{stage_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(page_records(pages), path)
    whole = read_warc(spark, path, where={"record_type": "response"}).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    short = read_warc(spark, path, payload=False, where={"record_type": "revisit"}).withColumn("payload_digest", F.substring_index("payload_digest", ":", -1))
    page = r"^<urn:x-page:(-?\d+)>$"
    number = [F.expr(f"try_cast(nullif(regexp_extract({c}, r'{page}', 1), '') AS BIGINT)").alias(a) for c, a in (("record_id", "page_id"), ("refers_to", "refers_to"))]
    return whole.drop("payload").unionByName(short.drop("payload")).select(number[0], "payload_bytes", "payload_digest", "record_type", number[1])
