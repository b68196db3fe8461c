"""The preparation jobs: a recipe and a table in, training rows out.

``encode`` is any Column -> ids Column function (code points, word lookup, subwords).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from grainmill.config import PrepConfig
from grainmill.functions import sequences as S
from grainmill.functions.hashing import shard_of
from grainmill.operators import packing
from grainmill.operators.dispatch import accepted, apply_by_source
from grainmill.operators.order import sanity_limit, with_shuffled_spans, with_shuffled_positions
from grainmill.operators.sharding import assign_batches
from grainmill.session import small_batches
from grainmill.sources import lines
from grainmill.sources.jsonl import parse_lines, read_jsonl
from grainmill.sources.tables import via_table
from grainmill.operators.templates import filter_pair_length, preference_pairs, render_instructions

INSTRUCTION_COLUMNS = (
    "instruction string, input string, output string, history array<array<string>>"
)
PREFERENCE_COLUMNS = "question string, response_j string, response_k string"
COLUMNS = {
    "pretrain": "text string", "instruct": INSTRUCTION_COLUMNS, "preference": PREFERENCE_COLUMNS,
}
ROW_KEY = "row_key"
Encode = Callable[[Column], Column]


def with_shard(df: DataFrame, cfg: PrepConfig, key: str) -> DataFrame:
    return df.withColumn(packing.SHARD, shard_of(cfg.seed, F.col(key), cfg.num_shards))


def shape_rows(df: DataFrame, cfg: PrepConfig, key: str, ids: str = "input_ids") -> DataFrame:
    """Padding and the recipe's sample mode; row by row, so it serves streams as well."""
    length, mode = cfg.seq_length, cfg.sequence_sample_mode
    if mode == "truncation":
        df = df.withColumn(ids, S.truncate(F.col(ids), length))
    if cfg.pad_to_max:
        df = df.withColumn(ids, S.pad_to(F.col(ids), length))
    if mode == "sample":
        df = df.withColumn(ids, S.sample_window(F.col(ids), length, cfg.seed, F.col(key)))
    if mode == "split":
        df = packing.split_sequences(df, length, ids)
    return df


def pretrain(
    df: DataFrame,
    cfg: PrepConfig,
    encode: Encode,
    *,
    key: str = "doc_id",
    text: str = "text",
    n_slices: int | None = None,
) -> DataFrame:
    """``input_ids, labels`` rows of a text table, packed if the recipe says so.

    For packing, rows are put in groups of the shuffled order while they are still text; that
    is the only exchange of wide rows, and the ids are made after it.
    """
    rows = df.select(key, text)
    if cfg.concat_multiple_sequence:
        rows = with_shuffled_spans(
            with_shard(rows, cfg, key), key, cfg.seed, cfg.num_sequences,
            shard=packing.SHARD, num_shards=cfg.num_shards, n_slices=n_slices,
        )
    rows = rows.withColumn("input_ids", encode(F.col(text))).drop(text)
    rows = shape_rows(rows, cfg, key)
    if cfg.concat_multiple_sequence:
        rows = packing.pack_groups(rows, cfg.seq_length, cfg.num_sequences)
    return rows.withColumn("labels", S.pretrain_labels(F.col("input_ids")))


def answer_rows(df: DataFrame, cfg: PrepConfig, encode: Encode) -> DataFrame:
    """``input_ids, labels, attention_mask`` of fixed length from ``text`` and ``answer``.

    The answer is a suffix of the text; the tokens of the rest carry no loss. Rows whose
    source part fills the length have no loss tokens and are kept: see ``n_loss_tokens``.
    """
    length = cfg.seq_length
    source = F.substring("text", F.lit(1), F.length("text") - F.length("answer"))
    kept = [c for c in df.columns if c not in ("text", "answer")]
    return (
        df.select(*kept, encode(F.col("text")).alias("ids"), encode(source).alias("source_ids"))
        .select(
            *kept,
            F.least(F.size("ids"), F.lit(length)).alias("n_tokens"),
            F.least(F.size("source_ids"), F.lit(length)).alias("n_source"),
            S.pad_to(S.truncate(F.col("ids"), length), length).alias("input_ids"),
        )
        .withColumn(
            "labels", S.answer_labels(F.col("input_ids"), F.col("n_source"), F.col("n_tokens"))
        )
        .withColumn("attention_mask", S.attention_mask(F.col("n_tokens"), length))
        .withColumn("n_loss_tokens", S.n_loss_tokens(F.col("labels")))
        .drop("n_source")
    )


def instruct(df: DataFrame, cfg: PrepConfig, encode: Encode) -> DataFrame:
    """Training rows of instruction records."""
    return answer_rows(accepted(render_instructions(df)), cfg, encode)


def preference(df: DataFrame, *order: str, sanity_check: bool = False) -> DataFrame:
    """``prompt, chosen, rejected`` rows; only the first 1000 for a sanity check."""
    return preference_pairs(sanity_limit(df, *order) if sanity_check else df)


def pack_tokens(
    df: DataFrame,
    cfg: PrepConfig,
    encode: Encode,
    n_tokens: Column,
    *,
    key: str = "doc_id",
    text: str = "text",
    n_slices: int | None = None,
) -> DataFrame:
    """A text table as one endless token stream per shard, cut every ``seq_length`` tokens.

    ``n_tokens`` is the number of tokens that ``encode`` makes of the text. For a tokeniser
    whose counts are as costly as its ids, tokenise first, write with ``via_table``, and give
    the identity as ``encode``.
    """
    rows = with_shard(df.select(key, text, n_tokens.alias("n_tokens")), cfg, key)
    placed = with_shuffled_spans(
        rows, key, cfg.seed, cfg.seq_length, shard=packing.SHARD, num_shards=cfg.num_shards,
        weight="n_tokens", n_slices=n_slices,
    )
    return packing.pack_stream(
        placed.withColumn("input_ids", encode(F.col(text))), cfg.seq_length
    )


def read_sequences(
    df: DataFrame,
    transforms: Mapping[str, Column],
    cfg: PrepConfig,
    *,
    key: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """Per-source transforms to lists of token lists, packed end to end within each shard.

    Packing needs the lengths of the lists before it needs the lists, so they are written once
    and read twice; the transforms run once.
    """
    done = accepted(
        apply_by_source(df, transforms, source=source, out="parts", split_rows=False)
    )
    tokens = via_table(done.select(key, F.flatten("parts").alias("input_ids")), "sequences")
    return pack_tokens(tokens, cfg, lambda ids: ids, F.size("input_ids"), key=key, text="input_ids")


def read_rows(spark: SparkSession, cfg: PrepConfig, key: str | None) -> DataFrame:
    """The rows of a recipe's files, with the column ``key`` of the files or a ``row_key`` made for
    them: the pattern's name, the path of the file, and the offset of the line."""
    if not cfg.data:
        raise ValueError("the recipe names no data")
    small_batches(spark)
    columns = COLUMNS[cfg.mode]
    if key is not None:
        return read_jsonl(spark, cfg.data, T.StructType.fromDDL(f"{key} long, {columns}"))
    found = lines.read_named(spark, cfg.data).withColumn(ROW_KEY, F.concat_ws(":", "name", "path", "offset"))
    return parse_lines(found.drop("path", "offset"), T.StructType.fromDDL(columns), strict=True)


def run(
    spark: SparkSession, cfg: PrepConfig, encode: Encode | None = None, *, key: str | None = None
) -> DataFrame:
    """The whole job of a recipe: its files, its mode, its ranks and batches.

    ``key`` names a unique column of the files; without one, a row is known by its place. Rows made
    of one row of the files are told apart by the number of their turn or chunk. With
    ``split_by_shard`` a rank gets whole shards, otherwise every ``world_size``-th row. Preference
    rows stay text and need no ``encode``.
    """
    rows = read_rows(spark, cfg, key)
    key = key or ROW_KEY
    if cfg.mode == "preference":
        whole = F.col("question").isNotNull() & F.col("response_j").isNotNull() & F.col("response_k").isNotNull()
        made = preference(rows.where(whole), key, sanity_check=cfg.sanity_check)
        if cfg.max_pair_chars is not None:
            made = filter_pair_length(made, cfg.max_pair_chars)
        parts = []
    elif cfg.mode == "pretrain":
        made = pretrain(rows, cfg, encode, key=key)
        packed = cfg.concat_multiple_sequence
        parts = [packing.SHARD, "grp", "chunk"] if packed else [key, "chunk"] if "chunk" in made.columns else []
    else:
        made = instruct(rows, cfg, encode)
        parts = [key, "turn"]
    if parts:
        key = "_made_from"
        made = made.withColumn(key, F.concat_ws("-", *parts))
    if not cfg.split_by_shard:
        return to_batches(made, cfg, key).drop("_made_from")
    if packing.SHARD not in made.columns:
        made = with_shard(made, cfg, key)
    made = via_table(made.withColumn("rank", F.col(packing.SHARD) % cfg.world_size), "rows")
    placed = with_shuffled_positions(made, key, cfg.seed, group=["rank"])
    return placed.withColumn("batch_id", F.floor(F.col("pos") / cfg.train_batch_size)).drop("_made_from")


def to_batches(df: DataFrame, cfg: PrepConfig, key: str) -> DataFrame:
    """Final shuffle, ranks and batches of finished training rows (``key`` is unique).

    Rows are counted and then placed, so they are written once instead of being made twice.
    """
    placed = with_shuffled_positions(via_table(df, "rows"), key, cfg.seed)
    return assign_batches(placed, cfg.world_size, cfg.train_batch_size)


