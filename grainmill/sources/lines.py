"""Lines of files with the place of each one, as a table and as a stream.

A file is cut into ranges of bytes. A range has the lines that begin in it, so a task looks for
the first line start itself, and reads on to the end of its last line. ``(path, offset)`` names a
line for good, whatever the ranges are; it is the row key of sources that have none.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from grainmill.functions.text import source_tag
from grainmill.sources.jsonl import check_suffix
from grainmill.sources.stores import filesystem, matching_files

SCHEMA = "path string, offset long, value string"
SPLIT_BYTES = 64 << 20
READ_BYTES = 4 << 20


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


def byte_ranges(path: str, start: int, end: int, size: int) -> list[ByteRange]:
    return [ByteRange(path, a, min(a + size, end)) for a in range(start, end, size)]


def _lines(path: str, base: int, data: bytes) -> pa.RecordBatch:
    """The lines of ``data``, which begins at ``base`` and is empty or ends with a line end."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    offsets = np.concatenate(([0], ends + 1)).astype(np.int32)
    lines = pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    try:
        lines.validate(full=True)
    except pa.ArrowInvalid:  # some line is not UTF-8
        cut = [data[a:b].decode("utf-8", "replace") for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        lines = pa.array(cut, pa.string())
    lines = pc.replace_substring_regex(lines, pattern=r"\r?\n$", replacement="")
    paths = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(ends), np.int32)), pa.array([path]))
    return pa.record_batch(
        [paths.cast(pa.string()), pa.array(starts + base, pa.int64()), lines], names=["path", "offset", "value"]
    )


def read_range(part: ByteRange, read_bytes: int = READ_BYTES) -> Iterator[pa.RecordBatch]:
    """The lines that begin in a range; a last line without an end counts as one."""
    store, inner = filesystem(part.path)
    with store.open_input_file(inner) as file:
        # The byte before tells whether a line begins at the start of the range.
        at = max(part.start - 1, 0)
        file.seek(at)
        if part.start:
            while True:
                block = file.read(read_bytes)
                found = block.find(b"\n")
                if found >= 0 or not block:
                    break
                at += len(block)
            if found < 0 or at + found + 1 >= part.end:
                return
            at += found + 1
            file.seek(at)
        pending: list[bytes] = []
        base = at
        while True:
            block = file.read(read_bytes)
            if not block:
                rest = b"".join(pending)
                if rest:
                    yield _lines(part.path, base, rest + b"\n")
                return
            # Up to the end of the line that the end of the range lies in.
            last = part.end - 1 - at
            stop = block.find(b"\n", max(last, 0)) if last < len(block) else -1
            at += len(block)
            if stop >= 0:
                yield _lines(part.path, base, b"".join([*pending, block[: stop + 1]]))
                return
            cut = block.rfind(b"\n") + 1
            if cut:
                whole = b"".join([*pending, block[:cut]])
                yield _lines(part.path, base, whole)
                base += len(whole)
                pending = [block[cut:]] if cut < len(block) else []
            else:
                pending.append(block)


class LineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[ByteRange]:
        files = matching_files(self.path)
        return [r for path, size in files for r in byte_ranges(path, 0, size, self.split_bytes)]

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # there is something to read
            yield from read_range(partition)


def end_of_lines(path: str, size: int) -> int:
    """The place after the last line end before ``size``."""
    store, inner = filesystem(path)
    with store.open_input_file(inner) as file:
        end = size
        while end > 0:
            start = max(0, end - READ_BYTES)
            file.seek(start)
            found = file.read(end - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
    return 0


class LineStreamReader(DataSourceStreamReader):
    """New files of a folder, and lines added to old ones; a line is taken once its end is there.

    The offset of the stream names each file and how far it has been read.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path, size in matching_files(self.path):
            if self.known.get(path, (0, 0))[0] != size:
                self.known[path] = size, end_of_lines(path, size)
        return {path: end for path, (_, end) in self.known.items() if end}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        return [
            r
            for path, stop in sorted(end.items())
            for r in byte_ranges(path, int(start.get(path, 0)), int(stop), self.split_bytes)
        ]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        yield from read_range(partition)


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)

    def streamReader(self, schema) -> LineStreamReader:
        return LineStreamReader(self.options)


def read_lines(
    spark: SparkSession, pattern: str, *, split_bytes: int = SPLIT_BYTES, source: str = "source"
) -> DataFrame:
    """``path, offset, value`` of the lines of JSON-lines files, and the source that a name holds."""
    check_suffix(pattern)
    spark.dataSource.register(LineSource)
    lines = spark.read.format("lines").option("split_bytes", split_bytes).load(pattern)
    return lines.withColumn(source, source_tag(F.col("path")))


def stream_lines(
    spark: SparkSession, pattern: str, *, split_bytes: int = SPLIT_BYTES, source: str = "source"
) -> DataFrame:
    """The same as a stream that takes up new files and new lines."""
    check_suffix(pattern)
    spark.dataSource.register(LineSource)
    lines = spark.readStream.format("lines").option("split_bytes", split_bytes).load(pattern)
    return lines.withColumn(source, source_tag(F.col("path")))


def read_named(spark: SparkSession, patterns: Mapping[str, str], *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``name, path, offset, value`` of all files of all named patterns."""
    parts = []
    for name, pattern in patterns.items():
        if not matching_files(pattern):
            raise ValueError(f"source {name!r}: no file matches {pattern}")
        parts.append(read_lines(spark, pattern, split_bytes=split_bytes).drop("source").withColumn("name", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)
