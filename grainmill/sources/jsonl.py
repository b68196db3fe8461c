"""JSON-lines sources: named glob patterns, strict or lenient parsing, streams."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from grainmill.functions.text import source_tag
from grainmill.operators.dispatch import REASON

SUFFIX = ".jsonl"
CORRUPT = "_corrupt_record"


def check_suffix(path: str) -> None:
    if not path.endswith(SUFFIX):
        raise ValueError(f"{path} is not a {SUFFIX} file")


def read_jsonl(
    spark: SparkSession, patterns: Mapping[str, str], schema: T.StructType, name: str = "name"
) -> DataFrame:
    """All files of all named patterns as one table, with the pattern's name per row.

    A pattern that matches no file is an error, and so is a line that is not valid JSON.
    """
    if not patterns:
        raise ValueError("no source patterns given")
    parts = {}
    for source, pattern in patterns.items():
        check_suffix(pattern)
        try:
            parts[source] = spark.read.schema(schema).json(pattern, mode="FAILFAST")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            raise ValueError(f"source {source!r}: no file matches {pattern}") from e
    return union_sources(parts, name)


def union_sources(parts: Mapping[str, DataFrame], name: str = "name") -> DataFrame:
    """All rows of all named tables, with the table's name per row."""
    named = [df.withColumn(name, F.lit(source)) for source, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def read_lines(spark: SparkSession, pattern: str, source: str = "source") -> DataFrame:
    """Raw lines (``value``) with the file's ``path`` and the source named in it."""
    check_suffix(pattern)
    path = F.input_file_name()
    return spark.read.text(pattern).select("value", path.alias("path")).withColumn(
        source, source_tag(F.col("path"))
    )


def parse_lines(
    lines: DataFrame, schema: T.StructType, *, value: str = "value", strict: bool = False
) -> DataFrame:
    """Columns of ``schema`` from one JSON object per line.

    Strict parsing fails on the first bad line. Otherwise a bad line is kept, with the raw
    line and a ``reject_reason``, for ``accepted`` and ``rejects`` to split.
    """
    with_raw = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    mode = "FAILFAST" if strict else "PERMISSIVE"
    options = {"mode": mode, "columnNameOfCorruptRecord": CORRUPT}
    kept = [c for c in lines.columns if c != value]
    if strict:
        parsed = F.from_json(value, schema, options)
        return lines.select(*kept, parsed.alias("row")).select(*kept, "row.*")
    return (
        lines.select(*kept, F.from_json(value, with_raw, options).alias("row"))
        .select(*kept, "row.*")
        .withColumn(REASON, F.when(F.col(CORRUPT).isNotNull(), "invalid JSON"))
    )


def stream_jsonl(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    *,
    max_files: int = 1000,
    source: str = "source",
    strict: bool = True,
) -> DataFrame:
    """JSON-lines files of a folder as a stream, at most ``max_files`` per micro-batch.

    A bad line stops a strict stream. Otherwise it is kept with a ``reject_reason``, for
    ``accepted`` and ``rejects`` to split, and never becomes a row of data.
    """
    lines = (
        spark.readStream.option("maxFilesPerTrigger", max_files)
        .option("pathGlobFilter", f"*{SUFFIX}")
        .text(folder)
        .withColumn(source, source_tag(F.input_file_name()))
    )
    return parse_lines(lines, schema, strict=strict)
