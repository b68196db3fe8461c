"""A store of training batches that knows which file has which batches.

Tasks write parquet files of whole batches under new names. Only when all tasks are done, the
commit writes a manifest: for each file its rank, its first and last batch, its rows and a
checksum. Readers go by manifests alone. A filter on ``rank`` or ``batch_id`` is turned into the
files that may match, so a run that resumes at batch k opens no file of earlier batches, and a
rank opens its own files. Rows are in order inside a batch.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from grainmill.session import shuffle_partitions
from grainmill.sources.stores import filesystem

MANIFESTS = "_manifests"
FILE_BYTES = 64 << 20


@dataclass(frozen=True)
class StoredFile:
    name: str
    rank: int
    first_batch: int
    last_batch: int
    rows: int
    sha256: str


@dataclass
class Stored(WriterCommitMessage):
    files: list[StoredFile]


@dataclass
class Planned(InputPartition):
    file: StoredFile


class BatchWriter(DataSourceArrowWriter):
    """Takes rows sorted by rank and batch; a file ends between two batches."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.schema = options["path"].rstrip("/"), schema.json()
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Stored:
        from pyarrow import parquet

        store, inner = filesystem(self.path)
        store.create_dir(inner, recursive=True)
        files: list[StoredFile] = []
        held: list[pa.RecordBatch] = []
        size = 0

        def close() -> None:
            nonlocal held, size
            if not held:
                return
            table = pa.Table.from_batches(held)
            sink = io.BytesIO()
            parquet.write_table(table, sink, compression="zstd")
            data = sink.getbuffer()
            ranks, batches = table.column("rank").to_numpy(), table.column("batch_id").to_numpy()
            name = f"rank-{ranks[0]:05d}-{uuid.uuid4().hex}.parquet"
            with store.open_output_stream(f"{inner}/{name}", compression=None) as out:
                out.write(data)
            files.append(
                StoredFile(
                    name, int(ranks[0]), int(batches.min()), int(batches.max()), table.num_rows,
                    hashlib.sha256(data).hexdigest(),
                )
            )
            held, size = [], 0

        last = None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if batch.column("rank").null_count or batch.column("batch_id").null_count:
                raise ValueError("rank and batch_id must not be null")
            ranks, numbers = (batch.column(c).to_numpy().astype(np.int64) for c in ("rank", "batch_id"))
            cuts = np.flatnonzero((np.diff(ranks) != 0) | (np.diff(numbers) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                now = int(ranks[a]), int(numbers[a])
                if last is not None and now < last:
                    raise ValueError("rows must be sorted by rank and batch_id")
                if last is not None and now != last and (now[0] != last[0] or size >= self.file_bytes):
                    close()
                last = now
                part = batch.slice(a, b - a)
                held.append(part)
                size += part.get_total_buffer_size() * (b - a) // batch.num_rows
        close()
        return Stored(files)

    def commit(self, messages: list[Stored | None]) -> None:
        store, inner = filesystem(self.path)
        files = sorted(
            (f for m in messages if m for f in m.files), key=lambda f: (f.rank, f.first_batch, f.name)
        )
        manifest = {"schema": self.schema, "files": [asdict(f) for f in files]}
        store.create_dir(f"{inner}/{MANIFESTS}", recursive=True)
        name = f"{inner}/{MANIFESTS}/{uuid.uuid4().hex}"
        with store.open_output_stream(f"{name}.tmp") as out:
            out.write(json.dumps(manifest).encode())
        store.move(f"{name}.tmp", f"{name}.json")

    def abort(self, messages: list[Stored | None]) -> None:
        """Files that no manifest names are no part of the store; what is known of is taken away."""
        store, inner = filesystem(self.path)
        for file in (f for m in messages if m for f in m.files):
            store.delete_file(f"{inner}/{file.name}")


def read_manifests(path: str) -> tuple[str, list[StoredFile]]:
    """The schema (JSON) of a store and its files."""
    from pyarrow import fs

    store, inner = filesystem(path.rstrip("/"))
    found = store.get_file_info(fs.FileSelector(f"{inner}/{MANIFESTS}", allow_not_found=True))
    schema, files = None, []
    for info in sorted(found, key=lambda f: f.path):
        if info.path.endswith(".json"):
            with store.open_input_stream(info.path) as file:
                manifest = json.loads(file.read())
            if schema not in (None, manifest["schema"]):
                raise ValueError(f"{path} has batches of several schemas")
            schema = manifest["schema"]
            files += [StoredFile(**f) for f in manifest["files"]]
    if schema is None:
        raise ValueError(f"{path} is no store of batches")
    return schema, files


class BatchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.check = options.get("check", "true").lower() == "true"
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """All filters come back: those used here only rule out files."""
        for f in filters:
            if getattr(f, "attribute", None) in (("rank",), ("batch_id",)):
                self.tests.append(f)
            yield f

    def _may_match(self, file: StoredFile) -> bool:
        def one(f: Filter) -> bool:
            low, high = (
                (file.rank, file.rank) if f.attribute == ("rank",) else (file.first_batch, file.last_batch)
            )
            match f:
                case EqualTo():
                    return low <= f.value <= high
                case In():
                    return any(v is not None and low <= v <= high for v in f.value)
                case GreaterThan():
                    return high > f.value
                case GreaterThanOrEqual():
                    return high >= f.value
                case LessThan():
                    return low < f.value
                case LessThanOrEqual():
                    return low <= f.value
            return True

        return all(one(f) for f in self.tests)

    def planned(self) -> list[StoredFile]:
        return [f for f in read_manifests(self.path)[1] if self._may_match(f)]

    def partitions(self) -> list[Planned]:
        return [Planned(f) for f in self.planned()]

    def read(self, partition: Planned | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file may match
            return
        from pyarrow import parquet

        store, inner = filesystem(self.path)
        with store.open_input_file(f"{inner}/{partition.file.name}") as file:
            if self.check:
                data = file.read()
                if hashlib.sha256(data).hexdigest() != partition.file.sha256:
                    raise ValueError(f"{partition.file.name} is not as it was written")
                yield from parquet.ParquetFile(pa.BufferReader(data)).iter_batches(4096)
            else:
                yield from parquet.ParquetFile(file).iter_batches(4096)


class BatchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "batch_store"

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(read_manifests(self.options["path"])[0]))

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("a store of batches is added to; write a new one elsewhere")
        return BatchWriter(self.options, schema)


def _register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BatchSource)


def write_batch_store(df: DataFrame, path: str, *, place: str = "pos", file_bytes: int = FILE_BYTES) -> None:
    """Add batches (``rank``, ``batch_id``, and ``place`` for the order inside a batch) to a store.

    Rows are dealt by ranges of (rank, batch), so a large rank fills many files.
    """
    _register(df.sparkSession)
    (
        df.repartitionByRange(shuffle_partitions(df.sparkSession), "rank", "batch_id")
        .sortWithinPartitions("rank", "batch_id", place)
        .write.format("batch_store")
        .mode("append")
        .option("file_bytes", file_bytes)
        .save(path)
    )


def read_batch_store(spark: SparkSession, path: str, *, check: bool = True) -> DataFrame:
    """The rows of a store; ``check`` compares each file that is read with its checksum."""
    _register(spark)
    return spark.read.format("batch_store").option("check", str(check).lower()).load(path)
