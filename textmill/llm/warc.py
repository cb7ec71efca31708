"""WARC archives as a PySpark Python data source, and a writer that deduplicates payloads.

The reader takes plain and gzip-compressed archives of any writer. It parses headers first, and of
records that the pushed predicates rule out it doesn't decode the payload: in a plain file it
seeks past the block, in a compressed one it inflates without keeping anything, or not at all
where this module wrote it: its members hold their length in the extra field (subfield "sl").
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from textmill.llm.common import discard, few, materialize, ship

SCHEMA = "page_id long, url string, record_id string, record_type string, refers_to long, refers_to_id string, payload_bytes long, payload_digest string, payload binary"
#: Payloads shorter than this are never revisits.
LEAST_BYTES = 100
#: A file is closed once it holds this much; a read partition takes files up to this much.
FILE_BYTES = 64 << 20
#: Bytes of an archive that are read at once.
CHUNK = 64 << 10
HEAD = struct.Struct("<2sBBIBB H2sHII")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INTEGERS = {"page_id", "refers_to", "payload_bytes"}


def record_id(page_id: int | None, digest: str, own: str = "") -> str:
    """The id of a page's record: the same whenever it is written again. Pages without an id tell their records by own."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{own}')}>"


def record(page_id: int | None, url: str | None, refers_to: int | None, size: int, digest: str, payload: bytes | None, own: str = "") -> bytes:
    """One gzip member with one WARC record; payload None makes a revisit."""
    block = HTTP % size + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, own if page_id is None or payload is None else '')}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=-._~')}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if payload is None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = squeeze.compress(whole) + squeeze.flush()
    tail = struct.pack("<II", zlib.crc32(whole), len(whole) & 0xFFFFFFFF)
    length = HEAD.size + len(body) + 8
    if length > 0xFFFFFFFF:  # too long for the subfield: an ordinary member
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + tail
    return HEAD.pack(b"\x1f\x8b", 8, 4, 0, 0, 255, 12, b"sl", 8, length, len(whole) & 0xFFFFFFFF) + body + tail


def named_fields(head: bytes) -> dict[str, str]:
    """A record's header lines by their lower-cased names; folded lines are joined, of a repeated name the first counts."""
    lines: list[str] = []
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        elif line:
            lines.append(line)
    fields: dict[str, str] = {}
    for line in lines:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), value.strip())
    return fields


def header_fields(fields: dict[str, str]) -> dict:
    """The data source's columns, but for the payload. page_id, refers_to and payload_bytes are known of this module's records only."""
    number = lambda text: int(text) if text is not None and text.lstrip("-").isdigit() else None
    uri = fields.get("warc-target-uri")
    return {
        "page_id": number(fields.get("x-page-id")),
        "url": unquote(uri.strip("<>")) if uri is not None else None,
        "record_id": fields.get("warc-record-id"),
        "record_type": fields.get("warc-type"),
        "refers_to": number(fields.get("x-refers-to-page-id")),
        "refers_to_id": fields.get("warc-refers-to"),
        "payload_bytes": number(fields.get("x-payload-length")),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:") or None,
    }


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The block without the HTTP header, if it has one."""
    if "application/http" in fields.get("content-type", ""):
        for gap in (b"\r\n\r\n", b"\n\n"):
            if (at := block.find(gap)) >= 0:
                return block[at + len(gap) :]
        return b""
    return block


class Plain:
    """A buffered view of an open file: read, and skip by seeking."""

    def __init__(self, source) -> None:
        self.source, self.held, self.at = source, b"", 0

    def more(self) -> bytes:
        return self.source.read(CHUNK)

    def until(self, *ends: bytes) -> bytes:
        """The bytes through the earliest of the ends, or all that is left."""
        start = 0
        while True:
            found = [(i, e) for e in ends if (i := self.held.find(e, start)) >= 0]
            if found:
                i, e = min(found)
                return self.take(i + len(e))
            start = max(0, len(self.held) - 4)
            more = self.more()
            if not more:
                return self.take(len(self.held))
            self.held += more

    def take(self, n: int) -> bytes:
        parts, have = [self.held[:n]], min(n, len(self.held))
        self.held = self.held[n:]
        while have < n and (more := self.more()):
            parts.append(more[: n - have])
            self.held = more[n - have :]
            have += len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        if n > len(self.held):
            self.source.seek(self.source.tell() + n - len(self.held))
            self.held = b""
        else:
            self.held = self.held[n:]


class Inflated(Plain):
    """The same of a file of gzip members, or of the one of a known length; what is skipped is inflated, but not kept."""

    def __init__(self, source, length: int | None = None) -> None:
        super().__init__(source)
        self.inflate, self.packed, self.left = zlib.decompressobj(31), b"", length
        self.chunk = CHUNK if length is None else 2048  # a header's worth at first

    def packed_more(self) -> bytes:
        got = self.source.read(self.chunk if self.left is None else min(self.chunk, self.left))
        self.chunk = CHUNK
        if self.left is not None:
            self.left -= len(got)
        return got

    def more(self) -> bytes:
        while True:
            if self.inflate.eof:  # the next member begins where this one ended
                self.packed, self.inflate = self.inflate.unused_data or self.packed, zlib.decompressobj(31)
            if not self.packed:
                self.packed = self.packed_more()
                if not self.packed:
                    return b""
            out = self.inflate.decompress(self.packed, CHUNK)
            self.packed = self.inflate.unconsumed_tail
            if out:
                return out

    def skip(self, n: int) -> None:
        while n > 0:
            gone = min(n, len(self.held)) if self.held else 0
            if gone:
                self.held, n = self.held[gone:], n - gone
            elif not (more := self.more()):
                return
            else:
                self.held = more


def member_length(head: bytes) -> int:
    """The length that this module's members hold in their extra field; 0 of others."""
    if len(head) < HEAD.size:
        return 0
    fixed = HEAD.unpack(head[: HEAD.size])
    return fixed[9] if fixed[0] == b"\x1f\x8b" and fixed[2] & 4 and fixed[7] == b"sl" and fixed[8] == 8 else 0


def one_record(stream: Plain, wants, decode: bool, alone: bool = False) -> dict | bool:
    """The next record's row, True if it isn't wanted, False at the end; leaves the stream behind the record, unless it is alone in it."""
    line = stream.until(b"\n")
    while line and not line.strip():
        line = stream.until(b"\n")
    if not line:
        return False
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record begins with {line[:20]!r}")
    fields = named_fields(line + stream.until(b"\r\n\r\n", b"\n\n"))
    row, length = header_fields(fields), int(fields.get("content-length", 0))
    if not wants(row):
        if not alone:
            stream.skip(length)
        return True
    if decode and row["record_type"] != "revisit":
        block = stream.take(length)
        if len(block) < length:
            raise ValueError(f"the record {row['record_id']} is cut off")
        row["payload"] = payload_of(fields, block)
        if alone:
            stream.skip(5)  # through the member's end, where zlib tests its checksum
    elif not alone:
        stream.skip(length)
    return row


def read_records(source, wants, decode: bool) -> Iterator[dict]:
    """Records of an open archive, plain or of gzip members, whose headers satisfy wants."""
    source.seek(0)
    head = source.read(HEAD.size)
    source.seek(0)
    if not head.startswith(b"\x1f\x8b"):
        stream = Plain(source)
    elif not member_length(head):
        stream = Inflated(source)
    else:
        at, end = 0, source.size()
        while at < end:
            source.seek(at)
            length = member_length(source.read(HEAD.size))
            source.seek(at)
            if not length:
                break
            row = one_record(Inflated(source, length), wants, decode, True)
            if isinstance(row, dict):
                yield row
            at += length
        if at >= end:
            return
        stream = Inflated(source)
    while row := one_record(stream, wants, decode):
        if isinstance(row, dict):
            yield row


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, schema, options) -> None:
        self.names, self.path, self.tests = schema.names, options["path"], []

    def pushFilters(self, filters):
        """Takes comparisons of header columns; Spark applies what is left."""
        kinds = {EqualTo: "==", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for test in filters:
            name = getattr(test, "attribute", ())
            if type(test) in kinds and len(name) == 1 and name[0] in (INTEGERS | {"record_type", "url", "payload_digest"}):
                self.tests.append((name[0], kinds[type(test)], test.value))
            else:
                yield test

    def partitions(self):
        """Files are grouped by size and not split: a gzip stream can't be entered in its midst. The writer ends a file at FILE_BYTES."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        files = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith((".warc", ".warc.gz")))
        groups: list[Files] = []
        room = 0
        for path, size in files:
            if size > room:
                groups.append(Files([]))
                room = FILE_BYTES
            groups[-1].paths.append(path)
            room -= size
        return groups or [Files([])]

    def wants(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            own = row[name]
            if own is None or not {"==": lambda: own == value, "in": lambda: own in value, ">": lambda: own > value, ">=": lambda: own >= value, "<": lambda: own < value, "<=": lambda: own <= value}[kind]():
                return False
        return True

    def read(self, partition: Files):
        fs, _ = pafs.FileSystem.from_uri(self.path)
        kinds = {"payload": pa.binary(), **dict.fromkeys(INTEGERS, pa.int64())}
        schema = pa.schema([(name, kinds.get(name, pa.string())) for name in self.names])
        rows, held = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as source:
                for row in read_records(source, self.wants, "payload" in self.names):
                    rows.append(row)
                    held += len(row.get("payload") or b"") + 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options) -> None:
        self.path, self.job = options["path"], uuid.uuid4().hex

    def write(self, iterator) -> Written:
        """Each task writes under names of its own; only commit() makes them part of the archive."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        paths: list[str] = []
        out, size, nth = None, 0, 0
        part = TaskContext.get().partitionId()
        for batch in iterator:
            columns = [batch.column(name) for name in ("page_id", "url", "refers_to", "payload_bytes", "payload_digest", "payload")]
            for i in range(batch.num_rows):
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    paths.append(f"{root}/{self.job}-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{paths[-1]}.part"), 0
                made = record(*(column[i].as_py() for column in columns), f"{part}:{nth}")
                nth += 1
                out.write(made)
                size += len(made)
        if out is not None:
            out.close()
        return Written(paths)

    def commit(self, messages) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for path in (p for m in messages if m is not None for p in m.paths):
            fs.move(f"{path}.part", path)
        self.clear(fs, root)

    def abort(self, messages) -> None:
        self.clear(*pafs.FileSystem.from_uri(self.path))

    def clear(self, fs, root: str) -> None:
        """Removes what tasks of this job left behind, killed ones included."""
        for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(self.job) and f.base_name.endswith(".part"):
                fs.delete_file(f.path)


class WarcDataSource(DataSource):
    """format("warc"): option path, a URI that pyarrow can open. A schema of fewer columns skips payloads."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes format("warc") known to the session; lets Spark push filters to Python sources unless the session says otherwise."""
    ship(spark)
    if "spark.sql.python.filterPushdown.enabled" not in spark.conf.getAll:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def write_warc(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Archives pages (page_id, url, html): a payload of least_bytes or more is stored once.

    The row with the smallest page_id of equal payloads is the response, the others revisit it;
    repeated rows with that id are all responses, and so are all when no copy has an id. Null
    html is an empty payload; null urls and ids leave their header out. Other columns are
    ignored. An empty table writes no file. Only digests are grouped, with partial sums, so a
    payload that a third of the rows share is no hot key; html is shuffled only if the
    duplicated digests are too large to broadcast, and then by a join that AQE can split.
    """
    register(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    firsts = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").select("payload_digest", "first")
    firsts = materialize(firsts, "warc-firsts")
    copy = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = rows.join(few(firsts), "payload_digest", "left").select("page_id", "url", F.when(copy, F.col("first")).alias("refers_to"), "payload_bytes", "payload_digest", F.when(~copy, F.col("payload")).alias("payload"))
    out.write.format("warc").mode("append").save(path)
    discard(firsts)


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """The records of the archives (.warc, .warc.gz) in a folder and those below it; a URI that pyarrow can open.

    One row for each record, whatever its type. payload is null for revisits, and not decoded
    at all if `columns` leaves it out. Records of other writers have null page_id, refers_to and
    payload_bytes. A missing header gives a null, a folder without archives no row; a damaged or
    cut record stops the read. Equal records give equal rows.
    """
    register(spark)
    return spark.read.format("warc").schema(columns).load(path)
