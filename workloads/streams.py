"""Queries that run documents as a stream, and return the table the stream wrote."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from grainmill.config import PrepConfig
from grainmill.constants import PAD_ID
from grainmill.functions import sequences as S
from grainmill.functions.text import text_points
from grainmill.plans import prepare
from grainmill.session import scratch_dir
from grainmill.sources.tables import stream_table
from grainmill.streaming import carry, run
from workloads.base import big, digest, query, sql_digest, sql_order, sql_points, sql_shard, sql_word
from workloads.shaping import (
    PACKED,
    SQL_CHUNK_DIGESTS,
    SQL_GROUPS,
    SQL_LABELS,
    SQL_IDS,
    SQL_STREAM,
    chunk_digests,
    documents,
)

# A stream's state is kept per shard, so the shards are the parallelism of the stateful step.
STREAMED = replace(PACKED, num_shards=32)

# Documents come in ARRIVALS parts, a micro-batch each; inside one they are shuffled by their key.
ARRIVALS = 8
SQL_ARRIVED = f"""placed AS (
  SELECT doc_id, text, shard, row_number() OVER (
    PARTITION BY shard ORDER BY doc_id % {ARRIVALS}, {sql_order()}, doc_id) - 1 AS pos
  FROM (SELECT doc_id, text, {sql_shard(STREAMED.num_shards)} AS shard FROM documents))"""


def arriving(spark: SparkSession, sf_dir: str, name: str, step: carry.Step) -> None:
    """Let the documents arrive part by part; each batch is played twice, and each part is a
    restart from the checkpoint."""
    folder = scratch_dir(spark, name)
    docs = documents(spark, sf_dir).select("doc_id", "text")

    def twice(batch: DataFrame, batch_id: int) -> None:
        step(batch, batch_id)
        step(batch, batch_id)

    for part in range(ARRIVALS):
        docs.where(F.col("doc_id") % ARRIVALS == part).write.mode("append").parquet(f"{folder}/in")
        arrived = spark.readStream.schema(docs.schema).parquet(f"{folder}/in")
        sharded = prepare.with_shard(arrived, STREAMED, "doc_id")
        carry.run_batches(sharded, twice, f"{folder}/checkpoint")


def encoded(step: carry.Step) -> carry.Step:
    """The step on batches whose texts have become ids."""
    return lambda batch, n: step(batch.withColumn("input_ids", text_points(F.col("text"))), n)


def finished(stream: DataFrame, name: str) -> DataFrame:
    folder = scratch_dir(stream.sparkSession, name)
    return run.run_to_table(stream, f"{folder}/out", f"{folder}/checkpoint")


@query(
    "stream_prep",
    f"""WITH {SQL_IDS}
    SELECT doc_id, {sql_digest('ids')} AS ids_md5, {sql_digest(SQL_LABELS)} AS labels_md5
    FROM ids""",
)
def stream_prep(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = PrepConfig(
        mode="pretrain", seq_length=1024, pad_to_max=False, sequence_sample_mode="none"
    )
    docs = stream_table(spark, sf_dir, "documents")
    rows = finished(prepare.pretrain(docs, cfg, text_points), "stream_prep")
    return rows.select(
        "doc_id", digest("input_ids").alias("ids_md5"), digest("labels").alias("labels_md5")
    )


@query("stream_pack", f"WITH {SQL_ARRIVED}, {SQL_STREAM} {SQL_CHUNK_DIGESTS} FROM cut")
def stream_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "stream-pack")
    arriving(spark, sf_dir, "pack-in", encoded(carry.pack_stream_step(root, STREAMED.seq_length)))
    return chunk_digests(carry.finished_rows(spark, root, carry.chunk_schema()))


@query(
    "stream_groups",
    f"""WITH {SQL_ARRIVED}, {SQL_GROUPS}
    SELECT shard::BIGINT AS shard, grp, chunk,
           len(list_filter(ids, lambda x: x <> {PAD_ID}))::BIGINT AS n_tokens,
           {sql_digest('ids')} AS ids_md5 FROM chunks""",
)
def stream_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "stream-groups")
    step = carry.pack_groups_step(root, STREAMED.seq_length, STREAMED.num_sequences)
    arriving(spark, sf_dir, "groups-in", encoded(step))
    rows = carry.finished_rows(spark, root, carry.group_schema())
    return rows.select(
        big("shard").alias("shard"), "grp", "chunk",
        big(S.n_loss_tokens(S.pretrain_labels(F.col("input_ids")))).alias("n_tokens"),
        digest("input_ids").alias("ids_md5"),
    )


BUFFER = 20
SQL_SLOT = f"floor({sql_word(f'concat({chr(39)}42:u:buffer:{chr(39)}, shard, {chr(39)}:{chr(39)}, m)')} / 4294967296.0 * {BUFFER})"


@query(
    "stream_shuffle",
    f"""WITH came AS (
      SELECT doc_id, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id % {ARRIVALS}, doc_id) - 1 AS m
      FROM (SELECT doc_id, {sql_shard(STREAMED.num_shards)} AS shard FROM documents)),
    slotted AS (SELECT *, CASE WHEN m < {BUFFER} THEN m ELSE {SQL_SLOT}::BIGINT END AS slot FROM came),
    turned AS (
      SELECT *, lead(m) OVER (PARTITION BY shard, slot ORDER BY m) - {BUFFER} AS turn,
             max(m) OVER (PARTITION BY shard) AS last FROM slotted)
    SELECT doc_id, shard::BIGINT AS shard, coalesce(turn, greatest(last + 1 - {BUFFER}, 0) + row_number() OVER (
      PARTITION BY shard, turn IS NULL ORDER BY md5(concat('42:flush:', shard, ':', m)), m) - 1) AS turn
    FROM turned""",
)
def stream_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which a shuffle buffer lets arriving documents out, and empties at the end."""
    root, columns = scratch_dir(spark, "stream-shuffle"), "doc_id bigint"
    step = carry.shuffle_step(root, BUFFER, columns, by=["doc_id"])
    arriving(spark, sf_dir, "shuffle-in", lambda batch, n: step(batch.drop("text"), n))
    rows = carry.flush_shuffle(spark, root, BUFFER, columns)
    return rows.select("doc_id", big("shard").alias("shard"), "turn")
