"""Vocabulary tables (id, piece, score, kind) and piece/id lookup."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from grainmill.constants import FIRST_BYTE_ID, FIRST_PIECE_ID, SPECIAL_TOKENS, UNK_ID
from grainmill.functions.steps import list_steps
from grainmill.functions.text import words
from grainmill.sources.tables import via_table

# A vocabulary is sent to every task, so its size is checked before it is collected.
MAX_VOCAB = 1_000_000


def with_kind(vocab: DataFrame) -> DataFrame:
    """Mark ids as special tokens, single bytes or pieces of text."""
    kind = F.when(F.col("id") < FIRST_BYTE_ID, "special").when(
        (F.col("id") < FIRST_PIECE_ID) & F.col("piece").rlike("^<0x[0-9A-F]{2}>$"), "byte"
    )
    return vocab.withColumn("kind", F.coalesce(kind, F.lit("piece")))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary file: one ``piece TAB score`` per line, the id is the line number from 0.

    The file is read as one text, since lines of a split file have no line numbers.
    """
    lines = F.split(F.rtrim(F.col("value"), F.lit("\n")), "\n")
    return with_kind(
        spark.read.text(path, wholetext=True)
        .select(F.posexplode(lines).alias("id", "line"))
        .select(
            "id",
            F.substring_index("line", "\t", 1).alias("piece"),
            F.substring_index("line", "\t", -1).cast("double").alias("score"),
        )
    )


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``word, n``; counts are combined inside each task before they are exchanged."""
    return (
        df.select(F.explode(words(F.col(text))).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def rank_pieces(counts: DataFrame, size: int, first_id: int) -> DataFrame:
    """The ``size`` most frequent pieces (column ``piece``, ``n``) with ids from ``first_id``.

    How many pieces have each count tells the least count that gets in, so that hardly more than
    ``size`` rows are sorted and numbered, however many tasks hold pieces.
    """
    counts = via_table(counts, "piece-counts")
    table = counts.groupBy("n").agg(F.count(F.lit(1)).alias("pieces")).orderBy(F.desc("n"))
    border, taken = 0, 0
    for row in table.limit(size).collect():  # each count has a piece or more
        border, taken = row["n"], taken + row["pieces"]
        if taken >= size:
            break
    best = counts.where(F.col("n") >= border).orderBy(F.desc("n"), "piece").limit(size)
    rank = F.row_number().over(W.orderBy(F.desc("n"), "piece")) - 1
    return best.select(
        (rank + first_id).cast("int").alias("id"), "piece", (-rank).cast("double").alias("score")
    )


def word_vocab(df: DataFrame, size: int, text: str = "text") -> DataFrame:
    """Word vocabulary of a corpus with ``size`` entries, special tokens included."""
    ranked = rank_pieces(
        word_counts(df, text).withColumnRenamed("word", "piece"),
        size - len(SPECIAL_TOKENS),
        len(SPECIAL_TOKENS),
    )
    rows = [(i, piece, 0.0) for i, piece in enumerate(SPECIAL_TOKENS)]
    special = df.sparkSession.createDataFrame(rows, "id int, piece string, score double")
    return special.unionByName(ranked)


def collect_vocab(vocab: DataFrame) -> list[tuple[int, str, float]]:
    """The vocabulary's rows by id, to be sent to the tasks; ids must be 0, 1, 2, .."""
    rows = vocab.select("id", "piece", "score").limit(MAX_VOCAB + 1).collect()
    if len(rows) > MAX_VOCAB:
        raise ValueError(f"vocabulary has more than {MAX_VOCAB} entries")
    rows = sorted((r.id, r.piece, r.score) for r in rows)
    if [r[0] for r in rows] != list(range(len(rows))):
        raise ValueError("vocabulary ids must be 0, 1, 2, .. without gaps")
    return rows


def _relist(source: pa.ListArray, values: pa.Array) -> pa.ListArray:
    """A list array with new values and the list lengths (and nulls) of ``source``."""
    lengths = pc.fill_null(pc.list_value_length(source), 0)
    ends = pc.cumulative_sum(lengths.cast(pa.int32()))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pa.ListArray.from_arrays(offsets, values, mask=source.is_null())


def piece_ids(spark: SparkSession, vocab: list[tuple]) -> Callable[[Column], Column]:
    """Lookup pieces -> ids, unknown pieces to the unknown id; no shuffle, an Arrow call a step."""
    table = spark.sparkContext.broadcast(pa.array([v[1] for v in vocab], pa.string()))

    def ids_of(pieces: pa.Array) -> pa.Array:
        found = pc.index_in(pieces.flatten().cast(pa.string()), value_set=table.value)
        return _relist(pieces, pc.fill_null(found, UNK_ID).cast(pa.int32()))

    @F.arrow_udf("array<int>")
    def lookup(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from map(ids_of, list_steps(batch))

    return lookup


def id_pieces(spark: SparkSession, vocab: list[tuple]) -> Callable[[Column], Column]:
    """Lookup ids -> pieces; ids outside the vocabulary give the unknown piece."""
    table = spark.sparkContext.broadcast(pa.array([v[1] for v in vocab], pa.string()))

    def pieces_of(ids: pa.Array) -> pa.Array:
        flat = ids.flatten()
        known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table.value)))
        flat = pc.if_else(pc.fill_null(known, False), flat, UNK_ID)
        return _relist(ids, table.value.take(flat))

    @F.arrow_udf("array<string>")
    def lookup(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from map(pieces_of, list_steps(batch))

    return lookup
