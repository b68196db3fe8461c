"""Streams that keep what is left over of each micro-batch in a table.

A micro-batch is worked on by the operators for tables: its rows come behind what the batch before
left over, the line of each shard is cut by ``with_shuffled_spans``, and full chunks and new
leftovers are written in one pass and committed as one write under the number of the batch. A
batch that is played again finds its write and does nothing, or makes the same rows from the same
leftovers. Tasks hold one chunk or one group at a time, never a shard.

Rows of a micro-batch are taken in a seeded shuffle of their keys, so results do not depend on the
order in which tasks deliver them. What a shard carries over is bounded: fewer than
``seq_length`` tokens, fewer than ``num_sequences`` rows, or ``buffer_size`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from grainmill.constants import PAD_ID
from grainmill.operators import order, packing
from grainmill.operators.packing import SHARD
from grainmill.sources.commits import WriteLog, read_writes, write_once
from grainmill.sources.tables import via_table

Step = Callable[[DataFrame, int], None]
TABLE, KIND = "packed", "kind"
DONE, LEFT = "done", "left"


def write_id(batch_id: int) -> str:
    return f"{batch_id:012d}"


def start_batches(stream: DataFrame, step: Step, checkpoint: str) -> StreamingQuery:
    """Give each micro-batch of what is available to ``step``, then stop."""
    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_batches(stream: DataFrame, step: Step, checkpoint: str) -> None:
    start_batches(stream, step, checkpoint).awaitTermination()


def _left_over(spark: SparkSession, root: str, batch: str, schema: str) -> DataFrame:
    before = WriteLog(spark, root).last_before(batch)
    return read_writes(spark, root, TABLE, schema, only=[before] if before else [], inside=f"{KIND}={LEFT}")


def left_over(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """What the last finished batch has left over."""
    ids = WriteLog(spark, root).ids()
    return read_writes(spark, root, TABLE, schema, only=ids[-1:], inside=f"{KIND}={LEFT}")


def finished_rows(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows that all finished batches have put out."""
    return read_writes(spark, root, TABLE, schema, inside=f"{KIND}={DONE}")


def _commit(rows: DataFrame, root: str, batch: str) -> bool:
    return write_once({TABLE: rows}, root, batch, partition_by={TABLE: [KIND]})


def chunk_schema(ids: str = "input_ids") -> str:
    return f"{SHARD} int, chunk bigint, {ids} array<int>"


def pack_stream_step(
    root: str, seq_length: int, *, seed: int = 42, key: str = "doc_id", ids: str = "input_ids"
) -> Step:
    """Carry-over packing: the token stream of each shard, cut every ``seq_length`` tokens.

    Batches have ``shard``, ``key`` and ``ids``. Output: ``shard, chunk, ids``.
    """
    schema = chunk_schema(ids)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, write_id(batch_id)
        if WriteLog(spark, root).has(name):
            return
        left = _left_over(spark, root, name, schema)
        columns = [SHARD, F.col(key).alias("_key"), F.col(ids), F.lit(False).alias("_first")]
        line = left.select(SHARD, F.lit(0).alias("_key"), ids, F.lit(True).alias("_first")).unionByName(
            batch.select(*columns)
        )
        # Written, so that a batch is read from its source once; lengths are read on their own.
        line = via_table(line.withColumn("n_tokens", F.coalesce(F.size(ids), F.lit(0))), "arrived")
        placed = order.with_shuffled_spans(
            line, "_key", seed, seq_length, shard=SHARD, num_shards=0, weight="n_tokens", first="_first"
        )
        chunks = packing.pack_stream(placed, seq_length, ids=ids, keep_tail=True)
        # A shard whose tokens come out even leaves no tokens, but its next number.
        even = (
            line.groupBy(SHARD)
            .agg(F.sum("n_tokens").alias("_n"))
            .where(F.col("_n") % seq_length == 0)
            .select(SHARD, F.floor(F.col("_n") / seq_length).alias("chunk"), F.array().cast("array<int>").alias(ids))
        )
        base = left.select(SHARD, F.col("chunk").alias("_base"))
        rows = (
            chunks.unionByName(even)
            .join(base, SHARD, "left")
            .withColumn("chunk", F.col("chunk") + F.coalesce("_base", F.lit(0)))
            .withColumn(KIND, F.when(F.size(ids) == seq_length, DONE).otherwise(LEFT))
        )
        _commit(rows.select(SHARD, "chunk", ids, KIND), root, name)

    return step


def group_schema(ids: str = "input_ids") -> str:
    return f"{SHARD} int, grp bigint, chunk bigint, {ids} array<int>"


def pack_groups_step(
    root: str,
    seq_length: int,
    num_sequences: int,
    *,
    seed: int = 42,
    key: str = "doc_id",
    ids: str = "input_ids",
    pad_id: int = PAD_ID,
) -> Step:
    """Group packing: every ``num_sequences`` rows of a shard together, cut and padded.

    Output: ``shard, grp, chunk, ids``. A group that never fills up is never put out.
    """
    schema = group_schema(ids)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, write_id(batch_id)
        if WriteLog(spark, root).has(name):
            return
        left = _left_over(spark, root, name, schema)
        # A row without a place only says which group a shard is at.
        held = left.where("chunk is not null").select(
            SHARD, F.col("chunk").alias("_key"), ids, F.lit(True).alias("_first")
        )
        new = batch.select(
            SHARD, F.col(key).alias("_key"), F.coalesce(ids, F.array().cast("array<int>")).alias(ids),
            F.lit(False).alias("_first"),
        )
        line = via_table(held.unionByName(new), "arrived")
        placed = order.with_shuffled_spans(
            line, "_key", seed, num_sequences, shard=SHARD, num_shards=0, first="_first"
        )
        made = packing.pack_groups_and_rest(placed, seq_length, num_sequences, ids=ids, pad_id=pad_id)
        base = left.groupBy(SHARD).agg(F.max("grp").alias("_base"))
        counts = line.groupBy(SHARD).agg(F.count(F.lit(1)).alias("_n"))
        even = (
            base.join(counts, SHARD, "full")
            .withColumn("_n", F.coalesce("_n", F.lit(0)))
            .where(F.col("_n") % num_sequences == 0)
            .select(
                SHARD, F.floor(F.col("_n") / num_sequences).alias("grp"), F.lit(None).cast("bigint").alias("chunk"),
                F.lit(False).alias("full"), F.lit(None).cast("array<int>").alias(ids),
            )
        )
        rows = (
            made.unionByName(even)
            .join(base, SHARD, "left")
            .withColumn("grp", F.col("grp") + F.coalesce("_base", F.lit(0)))
            .withColumn(KIND, F.when(F.col("full"), DONE).otherwise(LEFT))
        )
        _commit(rows.select(SHARD, "grp", "chunk", ids, KIND), root, name)

    return step


def shuffle_schema(columns: str) -> str:
    return f"{SHARD} int, position bigint, slot bigint, turn bigint, {columns}"


def shuffle_step(
    root: str, buffer_size: int, columns: str, *, by: Sequence[Column | str], seed: int = 42
) -> Step:
    """A shuffle through a buffer of ``buffer_size`` rows of each shard, seeded.

    ``columns`` is the schema of the rows besides ``shard``; ``by`` orders the rows of a
    micro-batch. Output: those columns, ``shard`` and the ``turn`` at which the row leaves.
    """
    schema = shuffle_schema(columns)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, write_id(batch_id)
        if WriteLog(spark, root).has(name):
            return
        left = _left_over(spark, root, name, schema).drop("slot", "turn")
        new = order.with_sorted_positions(batch, by, group=[SHARD], position="position")
        # The row that came last is always among those left.
        base = left.groupBy(SHARD).agg((F.max("position") + 1).alias("_base"))
        new = new.join(base, SHARD, "left").withColumn(
            "position", F.col("position") + F.coalesce("_base", F.lit(0))
        )
        line = left.unionByName(new.select(left.columns))
        turns = order.with_buffer_turns(line, seed, buffer_size, shard=SHARD, position="position")
        rows = turns.withColumn(KIND, F.when(F.col("turn").isNull(), LEFT).otherwise(DONE))
        names = [c for c in rows.columns if c not in (SHARD, "position", "slot", "turn", KIND)]
        _commit(rows.select(SHARD, "position", "slot", "turn", *names, KIND), root, name)

    return step


def flush_shuffle(spark: SparkSession, root: str, buffer_size: int, columns: str, *, seed: int = 42) -> DataFrame:
    """All rows of a shuffled stream that has come to its end: those put out, then the buffer."""
    schema = shuffle_schema(columns)
    rest = order.with_flushed_turns(
        left_over(spark, root, schema), seed, buffer_size, shard=SHARD, position="position"
    )
    return finished_rows(spark, root, schema).unionByName(rest)
