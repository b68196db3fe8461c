"""Queries on lines with offsets and on stores of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from grainmill.session import scratch_dir
from grainmill.sources import batch_store as stored, jsonl, lines, sinks
from workloads import rows
from workloads.base import big, query
from workloads.shaping import documents

LINE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_md5", T.StringType())])


def numbered_lines(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """A JSON-lines folder with a line for each document, by doc_id, and the size of its largest file."""
    made = documents(spark, sf_dir).select("doc_id", F.md5("text").alias("text_md5")).orderBy("doc_id")
    folder = scratch_dir(spark, "numbered")
    line = F.to_json(F.struct("doc_id", "text_md5"))
    sinks.write_jsonl(made.select(F.lit("md5").alias("source"), line.alias("value")), folder)
    return folder, max(size for _, size in lines.matching_files(f"{folder}/*.jsonl"))


@query(
    "jsonl_offsets",
    """WITH l AS (
      SELECT doc_id, md5(text) AS text_md5,
             '{"doc_id":' || doc_id || ',"text_md5":"' || md5(text) || '"}' AS line FROM documents)
    SELECT n_splits, doc_id, text_md5, coalesce(sum(length(line) + 1) OVER (
      PARTITION BY n_splits ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
    FROM l CROSS JOIN (VALUES (1), (7)) t(n_splits)""",
)
def jsonl_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's place, whether a file is read in one range of bytes or in seven."""
    folder, size = numbered_lines(spark, sf_dir)

    def places(n_splits: int) -> DataFrame:
        read = lines.read_lines(spark, f"{folder}/*.jsonl", split_bytes=-(-size // n_splits))
        sizes = read.groupBy("path").agg(F.max(F.col("offset") + F.octet_length("value") + 1).alias("size"))
        # One row a file: where it begins in the line of all files.
        earlier = W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)
        begins = sizes.select("path", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("begin"))
        parsed = jsonl.parse_lines(read, LINE, strict=True).join(begins, "path")
        return parsed.select(
            F.lit(n_splits).alias("n_splits"), "doc_id", "text_md5", (F.col("begin") + F.col("offset")).alias("place")
        )

    return places(1).unionByName(places(7))


def store_of_batches(spark: SparkSession, sf_dir: str) -> str:
    """Batches of documents in a store, in small files, from two writes."""
    path = scratch_dir(spark, "batch-store")
    placed = rows.batched(spark, sf_dir, "pos")
    for part in (F.col("batch_id") < 3, F.col("batch_id") >= 3):
        stored.write_batch_store(placed.where(part), path, file_bytes=4096)
    return path


@query(
    "batch_store",
    f"""WITH {rows.SQL_SHUFFLED}
    SELECT doc_id, (pos % {rows.RANKS})::BIGINT AS rank, (pos // {rows.RANKS}) // {rows.BATCH} AS batch_id,
           ((pos // {rows.RANKS}) % {rows.BATCH})::BIGINT AS place FROM shuffled""",
)
def batch_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store gives back, and the place of each row in its batch as the file has it."""
    read = stored.read_batch_store(spark, store_of_batches(spark, sf_dir))
    # A file is read by one task in its order, so a batch's rows are numbered on.
    numbered = read.withColumn("_at", F.monotonically_increasing_id())
    place = F.row_number().over(W.partitionBy("rank", "batch_id").orderBy("_at")) - 1
    return numbered.select("doc_id", big("rank").alias("rank"), "batch_id", big(place).alias("place"))


@query(
    "resume_store",
    f"""WITH {rows.SQL_BATCHES}
    SELECT doc_id, rank, batch_id FROM batches WHERE batch_id >= 5 AND rank = 1""",
)
def resume_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rank goes on after a stop; files of other ranks and of used batches stay closed."""
    read = stored.read_batch_store(spark, store_of_batches(spark, sf_dir))
    return read.where("batch_id >= 5 AND rank = 1").select("doc_id", big("rank").alias("rank"), "batch_id")
