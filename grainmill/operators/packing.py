"""Fixed-length sequences from token arrays: splitting, group packing, carry-over packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.constants import PAD_ID
from grainmill.functions.sequences import pad_to

SHARD = "shard"


def _count_up(n: Column) -> Column:
    """0..n-1, empty for n = 0 (``sequence`` would count down)."""
    empty = F.array().cast("array<bigint>")
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(empty)


def split_sequences(
    df: DataFrame, seq_length: int, ids: str = "input_ids", chunk: str = "chunk"
) -> DataFrame:
    """One row per full chunk of ``seq_length`` tokens; a shorter tail is left out.

    Chunk numbers are exploded first and each chunk is cut afterwards, so the token array is
    read once and no array of arrays is built.
    """
    n_chunks = F.floor(F.size(ids) / seq_length)
    return (
        df.withColumn(chunk, F.explode(_count_up(n_chunks)))
        .withColumn(ids, F.slice(F.col(ids), _start(chunk, seq_length), F.lit(seq_length)))
    )


def _start(chunk: str, seq_length: int) -> Column:
    return (F.col(chunk) * seq_length + 1).cast("int")


def pack_groups(
    df: DataFrame,
    seq_length: int,
    num_sequences: int,
    *,
    ids: str = "input_ids",
    shard: str = SHARD,
    pad_id: int = PAD_ID,
) -> DataFrame:
    """Concatenate every ``num_sequences`` consecutive rows of a shard and cut into chunks.

    Takes the output of ``with_shuffled_spans`` with spans of ``num_sequences`` rows: a group
    is a span, and its rows are already in one partition. The end of a group is padded to a
    multiple of ``seq_length``; the last, incomplete group of a shard is left out.
    """
    doc = F.struct("before", F.col(ids).alias("ids"))
    groups = (
        df.withColumn("grp", F.floor(F.col("before") / num_sequences))
        .where((F.col("grp") >= F.col("first_span")) & (F.col("grp") < F.col("end_span")))
        .groupBy(shard, "cell", "grp")
        .agg(F.collect_list(doc).alias("docs"))
        .filter(F.size("docs") == num_sequences)
        .select(shard, "grp", F.flatten(F.array_sort("docs")["ids"]).alias(ids))
    )
    return cut_padded(groups, seq_length, ids=ids, pad_id=pad_id)


def pack_groups_and_rest(
    df: DataFrame,
    seq_length: int,
    num_sequences: int,
    *,
    ids: str = "input_ids",
    shard: str = SHARD,
    pad_id: int = PAD_ID,
) -> DataFrame:
    """As ``pack_groups``, with the rows of incomplete groups: ``full`` is false for them, and
    ``chunk`` is their place in the group."""
    doc = F.struct("before", F.col(ids).alias("ids"))
    docs = F.array_sort("docs")["ids"]
    n_out = F.when(F.col("full"), F.ceil(F.size("flat") / seq_length)).otherwise(F.size("docs"))
    cut = F.slice(F.col("flat"), _start("chunk", seq_length), F.lit(seq_length))
    return (
        df.withColumn("grp", F.floor(F.col("before") / num_sequences))
        .where((F.col("grp") >= F.col("first_span")) & (F.col("grp") < F.col("end_span")))
        .groupBy(shard, "cell", "grp")
        .agg(F.collect_list(doc).alias("docs"))
        .select(shard, "grp", docs.alias("docs"), (F.size("docs") == num_sequences).alias("full"))
        .withColumn("flat", F.when(F.col("full"), F.flatten("docs")))
        .withColumn("chunk", F.explode(_count_up(n_out.cast("bigint"))))
        .select(
            shard, "grp", "chunk", "full",
            F.when(F.col("full"), pad_to(cut, seq_length, pad_id))
            .otherwise(F.get("docs", F.col("chunk").cast("int")))
            .alias(ids),
        )
    )


def cut_padded(
    df: DataFrame, seq_length: int, *, ids: str, pad_id: int = PAD_ID, chunk: str = "chunk"
) -> DataFrame:
    """Chunks of ``seq_length``, the last one padded; no rows for an empty array."""
    n_chunks = F.ceil(F.size(ids) / seq_length)
    cut = F.slice(F.col(ids), _start(chunk, seq_length), F.lit(seq_length))
    return (
        df.withColumn(chunk, F.explode(_count_up(n_chunks)))
        .withColumn(ids, pad_to(cut, seq_length, pad_id))
    )


def pack_stream(
    df: DataFrame,
    seq_length: int,
    *,
    ids: str = "input_ids",
    shard: str = SHARD,
    keep_tail: bool = False,
) -> DataFrame:
    """Cut the endless token stream of each shard every ``seq_length`` tokens.

    Takes the output of ``with_shuffled_spans`` with spans of ``seq_length`` tokens: a chunk is
    a span. Rows are cut at chunk borders into pieces, and the pieces of a chunk, which are
    already in one partition, are put together; a task holds one chunk at a time, never a
    shard. A last, shorter chunk is left out unless ``keep_tail`` is set.
    """
    before, n = F.col("before"), F.size(ids)
    first = F.greatest(F.floor(before / seq_length), F.col("first_span"))
    last = F.least(F.floor((before + n - 1) / seq_length), F.col("end_span") - 1)
    chunks = F.when((n > 0) & (first <= last), F.sequence(first, last)).otherwise(
        F.array().cast("array<bigint>")
    )
    # Begin and end of the piece inside its row.
    begin = F.greatest(F.col("chunk") * seq_length - before, F.lit(0))
    end = F.least((F.col("chunk") + 1) * seq_length - before, n)
    piece = F.struct(
        (before + begin).alias("at"),
        F.slice(F.col(ids), (begin + 1).cast("int"), (end - begin).cast("int")).alias("ids"),
    )
    # Pieces are cut before they are grouped: the grouping then never holds whole rows.
    pieces = df.withColumn("chunk", F.explode(chunks)).select(
        shard, "cell", "chunk", piece.alias("piece"), (end - begin).alias("n")
    )
    return (
        pieces.groupBy(shard, "cell", "chunk")
        .agg(F.collect_list("piece").alias("pieces"), F.sum("n").alias("n"))
        .filter(F.lit(keep_tail) | (F.col("n") == seq_length))
        .select(shard, "chunk", F.flatten(F.array_sort("pieces")["ids"]).alias(ids))
    )
