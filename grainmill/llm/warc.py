"""WARC archives as a Spark data source, and a corpus of pages written as archives.

``spark.read.format("warc")`` plans one partition per archive file. Record-type and header
predicates are pushed down: a record's headers are parsed first, and the payload of a record
that is not wanted, or that no column needs (``payload=false``), is stepped over. Each record is
a gzip member of its own; its ``SL`` extra field holds the compressed length, so stepping over
needs no inflating. Members without that field are inflated to find their end.

A task writes files that belong to its attempt alone; each commit writes a list of the files of
its successful attempts under a name of its own, and only files in some list are read. Lost or
repeated attempts leave nothing visible, and a second write adds to the first. Folders without
any list, as others make them, are read by the names of their files.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)

from grainmill.session import scratch_dir

COLUMNS = {
    "warc_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "content_type": "Content-Type",
    "content_length": "Content-Length",
    "payload_length": "WARC-X-Payload-Length",
}
SCHEMA = ", ".join(f"{c} {'long' if c.endswith('length') else 'string'}" for c in COLUMNS) + ", payload binary"
LISTINGS = "_archives"
ROLL_BYTES = 256 << 20
READ_BYTES = 64 << 10
LEAST_REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def filesystem(path: str):
    """The store of a path and the path inside it; any store that Arrow knows will do."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member with its own compressed length in the SL extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    extra = b"SL" + struct.pack("<HI", 4, 12 + 8 + len(body) + 8)
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def one_line(value: str) -> str:
    """A header value must not end its line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [f"{k}: {one_line(v)}" for k, v in headers.items()]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""])
    return head.encode() + block + b"\r\n\r\n"


class _Window:
    """A file read in pieces, with a position that can step ahead without reading."""

    def __init__(self, file):
        self.file, self.data, self.start = file, b"", 0

    def get(self, at: int, n: int) -> bytes:
        if at < self.start or at + n > self.start + len(self.data):
            self.file.seek(at)
            self.data, self.start = self.file.read(max(n, READ_BYTES)), at
        return self.data[at - self.start : at - self.start + n]


def _gzip_start(head: bytes) -> tuple[int, int | None]:
    """Where the deflated data begins, and the member's length if its extra field tells."""
    flags, at, length = head[3], 10, None
    if flags & 4:
        end = 12 + struct.unpack_from("<H", head, 10)[0]
        at = 12
        while at + 4 <= end:
            name, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
            if name == b"SL" and size == 4:
                length = struct.unpack_from("<I", head, at + 4)[0]
            at += 4 + size
        at = end
    for flag in (8, 16):
        if flags & flag:
            at = head.index(b"\0", at) + 1
    return at + 2 * bool(flags & 2), length


def _headers(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    pairs = (x.partition(":") for x in lines[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def read_records(path: str, wanted, with_block: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and block of the records of a ``.warc`` or ``.warc.gz`` file that are wanted."""
    store, inner = filesystem(path)
    with store.open_input_file(inner) as file:
        size, at, window = file.size(), 0, _Window(file)
        while at < size:
            if window.get(at, 2) != b"\x1f\x8b":
                text = window.get(at, 4096)
                while b"\r\n\r\n" not in text and at + len(text) < size:
                    text = window.get(at, 4 * len(text))
                head = text.partition(b"\r\n\r\n")[0]
                headers = _headers(head)
                n = int(headers["content-length"])
                block = at + len(head) + 4
                if wanted(headers):
                    yield headers, window.get(block, n) if with_block else None
                at = block + n + 4
                continue
            start, length = _gzip_start(window.get(at, 4096))
            unpack, text, place = zlib.decompressobj(-15), b"", at + start
            while b"\r\n\r\n" not in text and not unpack.eof and place < size:
                piece = unpack.unconsumed_tail or window.get(place, 4096)
                place += 0 if unpack.unconsumed_tail else len(piece)
                text += unpack.decompress(piece, 4096)
            head, _, block = text.partition(b"\r\n\r\n")
            headers = _headers(head)
            take = wanted(headers)
            if take and with_block or length is None:
                parts = [block, unpack.decompress(unpack.unconsumed_tail)]
                while not unpack.eof and place < size:
                    piece = window.get(place, READ_BYTES)
                    place += len(piece)
                    parts.append(unpack.decompress(piece))
                block = b"".join(parts)[: int(headers["content-length"])]
                length = length or place - len(unpack.unused_data) + 8 - at
            if take:
                yield headers, block if with_block else None
            at += length


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block without the HTTP head that response records begin with."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


@dataclass
class Archive(InputPartition):
    path: str


def archive_names(path: str) -> list[str]:
    """The archives of a folder: those that the lists of its finished writes name, or, if it has no
    such list, all ``.warc`` and ``.warc.gz`` files. An unfinished write is never read."""
    from pyarrow import fs

    store, inner = filesystem(path)
    lists = [
        x.path
        for x in store.get_file_info(fs.FileSelector(f"{inner}/{LISTINGS}", allow_not_found=True))
        if x.path.endswith(".json")
    ]
    names: list[str] = []
    for place in sorted(lists):
        with store.open_input_stream(place) as file:
            names += json.loads(file.read())
    if not lists:
        found = store.get_file_info(fs.FileSelector(inner))
        names = [x.base_name for x in found if x.type == fs.FileType.File]
        names = [x for x in names if x.endswith((".warc", ".warc.gz")) and x[0] not in "._"]
    return sorted(names)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.wants: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) else ""
            if COLUMNS.get(column) and not column.endswith("length"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = COLUMNS[column].lower()
                self.wants[name] = self.wants.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Archive]:
        return [Archive(f"{self.path}/{x}") for x in archive_names(self.path)]

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no archives
            return
        schema = pa.schema(
            [(c, pa.int64() if c.endswith("length") else pa.string()) for c in COLUMNS]
            + [("payload", pa.binary())]
        )

        def wanted(headers: dict[str, str]) -> bool:
            return all(headers.get(k) in v for k, v in self.wants.items())

        rows: list[tuple] = []
        held = 0
        for headers, block in read_records(partition.path, wanted, self.with_payload):
            values = [headers.get(h.lower()) for h in COLUMNS.values()]
            values = [int(v) if v and c.endswith("length") else v for c, v in zip(COLUMNS, values)]
            payload = None if block is None else payload_of(headers, block)
            rows.append((*values, payload))
            held += 500 + len(payload or b"")
            if held > 4 << 20:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of ``page_id, url, payload, payload_sha1, payload_length, refers_to``."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.roll_bytes = int(options.get("roll_bytes", ROLL_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, inner = filesystem(self.path)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        store.create_dir(inner, recursive=True)
                        files.append(f"pages-{uuid.uuid4().hex}.warc.gz")
                        out, size = store.open_output_stream(f"{inner}/{files[-1]}", compression=None), 0
                    size += out.write(member(page_record(row)))
                    if size > self.roll_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, inner = filesystem(self.path)
        store.create_dir(f"{inner}/{LISTINGS}", recursive=True)
        names = sorted(x for m in messages if m for x in m.files)
        place = f"{inner}/{LISTINGS}/{uuid.uuid4().hex}"
        with store.open_output_stream(f"{place}.tmp") as file:
            file.write(json.dumps(names).encode())
        store.move(f"{place}.tmp", f"{place}.json")

    def abort(self, messages: list[Written | None]) -> None:
        """Without a listing, nothing of the attempt can be read."""


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_urn(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def page_record(row: dict) -> bytes:
    """A response record with the page as payload, or a revisit record without a block."""
    revisit = row["refers_to"] is not None
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": page_urn(row["page_id"]),
        "WARC-Date": DATE,
    }
    if row["url"] is not None:
        headers["WARC-Target-URI"] = row["url"]
    digest = base64.b32encode(bytes.fromhex(row["payload_sha1"])).decode()
    headers["WARC-Payload-Digest"] = f"sha1:{digest}"
    headers["WARC-X-Payload-Length"] = str(row["payload_length"])
    if revisit:
        headers["WARC-Refers-To"] = page_urn(row["refers_to"])
        headers["WARC-Profile"] = PROFILE
        return record(headers, b"")
    headers["Content-Type"] = "application/http;msgtype=response"
    return record(headers, HTTP_HEAD + row["payload"])


def plan_records(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Rows for the writer: of equal payloads the largest page_id is the response.

    Only digests are grouped, with partial maxima before the exchange; then each page meets
    the winner of its own digest. A digest that a third of all pages share is a skewed join,
    which adaptive execution splits. Payloads below ``least_bytes`` are always responses. A page
    whose page_id is null, or as large as the winner's, is a response or refers to the winner
    like any other row; if no page of a group has an id, all are responses.
    """
    rows = pages.select(
        "page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    )
    rows = rows.withColumn("payload_sha1", F.sha1("payload")).withColumn(
        "payload_length", F.octet_length("payload").cast("long")
    )
    winners = (
        rows.where(F.col("payload_length") >= least_bytes)
        .groupBy("payload_sha1", "payload_length")
        .agg(F.max("page_id").alias("_winner"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    other = F.col("page_id").isNull() | (F.col("page_id") < F.col("_winner"))
    return (
        rows.join(winners, ["payload_sha1", "payload_length"], "left")
        .withColumn("refers_to", F.when(other, F.col("_winner")))
        .select("page_id", "url", "payload", "payload_sha1", "payload_length", "refers_to")
    )


def write_pages(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    plan_records(pages).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` from the archives.

    Length and digest of a response are taken anew from its payload; revisits are read with
    their headers alone.
    """
    def number(column: str):
        return F.expr(f"try_cast(regexp_extract({column}, '<urn:page:(-?[0-9]*)>', 1) AS bigint)")

    responses = read_archives(spark, path).where("warc_type = 'response'").select(
        number("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"),
    )
    heads = read_archives(spark, path, payload=False).where("warc_type = 'revisit'")
    revisits = heads.mapInArrow(_hex_digests, "record_id string, refers_to string, payload_length long, digest string").select(
        number("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.lit("revisit").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )
    return responses.unionByName(revisits)


def _hex_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [
            base64.b32decode(x.partition(":")[2]).hex() if x else None
            for x in batch.column("payload_digest").to_pylist()
        ]
        yield pa.record_batch(
            [batch.column(c) for c in ("record_id", "refers_to", "payload_length")] + [pa.array(digests, pa.string())],
            names=["record_id", "refers_to", "payload_length", "digest"],
        )


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write a record for each page into the shared folder and read the archives back."""
    path = scratch_dir(spark, "warc")
    write_pages(pages, path)
    return archived_pages(spark, path)
