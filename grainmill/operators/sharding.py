"""Files, rows and batches to ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.operators.order import with_positions, with_shuffled_positions
from grainmill.sources.tables import via_table


def number_paths(
    paths: DataFrame, *, path: str = "path", repeat: int = 1, seed: int | None = None
) -> DataFrame:
    """``shard_idx, path`` for a table of unique paths, the whole list ``repeat`` times over.

    With a seed the paths are in seeded random order. Without one they are sorted, in one
    slice: use that for listed files, which the driver's file index holds anyway.
    """
    if seed is None:
        numbered = with_positions(paths, [path], F.lit(0), position="_idx")
    else:
        numbered = with_shuffled_positions(paths, path, seed, position="_idx")
    if repeat == 1:
        return numbered.withColumnRenamed("_idx", "shard_idx")
    rounds = F.explode(F.sequence(F.lit(0), F.lit(repeat - 1)))
    return (
        numbered.withColumn("_round", rounds)
        .withColumn("shard_idx", F.col("_round") * n_rows(paths) + F.col("_idx"))
        .drop("_round", "_idx")
    )


def n_rows(df: DataFrame) -> Column:
    """The number of rows, as a scalar subquery."""
    return df.agg(F.count(F.lit(1))).scalar()


def repeat_rows(df: DataFrame, times: int) -> DataFrame:
    """Over-sample: every row ``times`` times, numbered from 1 in ``copy``."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def assign_rank(df: DataFrame, num_ranks: int, index: str = "shard_idx") -> DataFrame:
    """Round robin: item i goes to rank i modulo the number of ranks."""
    return df.withColumn("rank", (F.col(index) % num_ranks).cast("int"))


def trim_shards(df: DataFrame, num_ranks: int, index: str = "shard_idx") -> DataFrame:
    """Drop the last few shards so that every rank gets the same number."""
    df = via_table(df, "shards")  # counted and then cut, but numbered once
    return df.filter(F.col(index) < F.floor(n_rows(df) / num_ranks) * num_ranks)


def rank_of_row(shard: Column, position: Column, num_shards: int, num_ranks: int) -> Column:
    """Whole shards per rank when they divide evenly, else every n-th row."""
    owner = shard if num_shards % num_ranks == 0 else position
    return (owner % num_ranks).cast("int")


def assign_batches(
    df: DataFrame, num_ranks: int, batch_size: int, position: str = "pos"
) -> DataFrame:
    """``rank`` and ``batch_id`` from a row position; a rank's last batch may be short."""
    turn = F.floor(F.col(position) / num_ranks)
    return assign_rank(df, num_ranks, position).withColumn(
        "batch_id", F.floor(turn / batch_size)
    )
