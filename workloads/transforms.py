"""Queries on user transforms: rows that fail, and results of several types."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from grainmill.functions.hashing import shard_of
from grainmill.functions.text import code_points
from grainmill.operators import batches, evaluate
from workloads.base import big, digest, query, sql_digest, sql_order, sql_points, sql_shard
from workloads.shaping import documents

LEAST_WORDS = 40
SOURCES = [f"src{i}" for i in range(20)]


def long_enough(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch; it stops at the first one that is too short."""
    blanks = pc.count_substring(batch.column("text"), " ")
    for doc, n in zip(batch.column("doc_id").to_pylist(), blanks.to_pylist()):
        if n < LEAST_WORDS:
            raise ValueError(f"document {doc} has {n} blanks")
    return batch.column("text")


@query(
    "failing_transform",
    f"""SELECT doc_id, CASE WHEN n >= {LEAST_WORDS} THEN md5(text) END AS text_md5,
       CASE WHEN n < {LEAST_WORDS} THEN 'transform failed: ValueError: document ' || doc_id || ' has '
            || n || ' blanks' END AS reject_reason
    FROM (SELECT *, length(text) - length(replace(text, ' ', '')) AS n FROM documents)""",
)
def failing_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = evaluate.apply_transforms(documents(spark, sf_dir), {s: long_enough for s in SOURCES})
    return done.select("doc_id", F.md5("result.text").alias("text_md5"), "reject_reason")


def first_line(batch: pa.RecordBatch) -> list[str]:
    return [text.partition("\n")[0] for text in batch.column("text").to_pylist()]


@evaluate.each_row
def line_points(row: dict) -> list[list[int]]:
    return [[ord(c) + 4 for c in line] for line in row["text"].split("\n") if line]


@evaluate.each_row
def odd_only(row: dict) -> str | None:
    return row["text"] if row["doc_id"] % 2 else None


def sizes(batch: pa.RecordBatch) -> pa.Array:
    """No valid transform: its results are numbers."""
    return pc.utf8_length(batch.column("text"))


MIXED = {
    **{f"src{i}": first_line for i in (0, 1, 2)},
    **{f"src{i}": line_points for i in (3, 4, 5)},
    **{f"src{i}": None for i in (6, 7)},
    "src8": sizes,
    **{f"src{i}": odd_only for i in (9, 10)},
}


def mixed_transforms():
    lines = F.filter(F.split("text", "\n"), lambda line: line != "")
    return {**MIXED, "src11": F.upper("lang"), "src12": F.transform(lines, code_points)}


SQL_MIXED = f"""made AS (
  SELECT doc_id, source, CASE
      WHEN source IN ('src0', 'src1', 'src2') THEN [string_split(text, chr(10))[1]]
      WHEN source IN ('src9', 'src10') AND doc_id % 2 = 1 THEN [text]
      WHEN source = 'src11' THEN [upper(lang)] END AS texts,
    CASE WHEN source IN ('src3', 'src4', 'src5', 'src12') THEN
      list_filter(string_split(text, chr(10)), lambda s: s <> '') END AS lines
  FROM documents)"""


@query(
    "mixed_dispatch",
    f"""WITH {SQL_MIXED}
    SELECT doc_id, 'text' AS kind, md5(unnest(texts)) AS text_md5, NULL::VARCHAR AS ids_md5,
           NULL::VARCHAR AS row_source, NULL::VARCHAR AS reject_reason FROM made
    UNION ALL SELECT doc_id, 'ids', NULL, {sql_digest(sql_points('line'))}, NULL, NULL
    FROM (SELECT doc_id, unnest(lines) AS line FROM made)
    UNION ALL SELECT doc_id, 'row', NULL, NULL, source, NULL FROM made WHERE source IN ('src6', 'src7')
    UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, CASE
        WHEN source = 'src8' THEN 'unsupported result: int'
        WHEN source IN ('src9', 'src10') THEN 'transform gave nothing'
        WHEN lines = [] THEN 'unsupported result: an empty list' ELSE 'unknown source' END
    FROM made WHERE texts IS NULL AND (lines IS NULL OR lines = []) AND source NOT IN ('src6', 'src7')""",
)
def mixed_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings, lists of ids and whole rows in one VARIANT column, and rejects of each kind."""
    docs = documents(spark, sf_dir)
    done = evaluate.apply_transforms(docs, mixed_transforms())
    value = done.withColumn("value", evaluate.as_variant("result", docs.columns))
    is_ids = F.col("result.kind") == evaluate.IDS
    ids = F.variant_get(F.when(is_ids, F.col("value")), "$", "array<int>")
    text = F.variant_get(F.when(F.col("result.kind") == evaluate.TEXT, F.col("value")), "$", "string")
    return value.select(
        "doc_id", F.col("result.kind").alias("kind"), F.md5(text).alias("text_md5"), digest(ids).alias("ids_md5"),
        F.variant_get(F.when(F.col("result.kind") == evaluate.ROW, F.col("value")), "$.source", "string").alias(
            "row_source"
        ),
        "reject_reason",
    )


BATCH_ROWS, BATCH_SHARDS = 16, 4


def running_sizes(batch: pa.Table, shard: int, number: int) -> pa.Table:
    """Characters so far in the batch for each row, and a last row with the number of rows."""
    upto = pc.cumulative_sum(pc.utf8_length(batch.column("text")).cast(pa.int64()))
    sizes = pa.chunked_array([*upto.chunks, pa.array([batch.num_rows])], pa.int64())
    docs = pa.chunked_array([*batch.column("doc_id").chunks, pa.nulls(1, pa.int64())], pa.int64())
    return pa.table({"doc_id": docs, "n_chars": sizes})


@query(
    "batch_map",
    f"""WITH placed AS (
      SELECT doc_id, text, shard, row_number() OVER (PARTITION BY shard ORDER BY {sql_order()}, doc_id) - 1 AS pos
      FROM (SELECT doc_id, text, {sql_shard(BATCH_SHARDS)} AS shard FROM documents)),
    summed AS (
      SELECT shard, pos // {BATCH_ROWS} AS batch, doc_id, sum(length(text)) OVER (
        PARTITION BY shard, pos // {BATCH_ROWS} ORDER BY pos)::BIGINT AS n_chars FROM placed)
    SELECT shard::BIGINT AS shard, batch, doc_id, n_chars FROM summed
    UNION ALL SELECT shard, batch, NULL, count(*) FROM summed GROUP BY shard, batch""",
)
def batch_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    sharded = docs.withColumn("shard", shard_of(42, F.col("doc_id"), BATCH_SHARDS))
    made = batches.map_batches(
        sharded, running_sizes, BATCH_ROWS, "doc_id long, n_chars long", key="doc_id", seed=42
    )
    return made.select("doc_id", "n_chars", big("shard").alias("shard"), "batch")
