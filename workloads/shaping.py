"""Queries over documents: packing, splitting, padding, sampling, labels."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from grainmill.config import PrepConfig
from grainmill.constants import IGNORE_INDEX, PAD_ID
from grainmill.functions import sequences as S
from grainmill.functions.text import text_points
from grainmill.operators import packing
from grainmill.plans import prepare
from grainmill.sources.tables import read_table
from workloads.base import (
    big,
    digest,
    query,
    sql_digest,
    sql_order,
    sql_points,
    sql_shard,
    sql_word,
)

SHARDS = 4
PACKED = PrepConfig(
    mode="pretrain", seq_length=600, pad_to_max=False, sequence_sample_mode="none",
    concat_multiple_sequence=True, num_sequences=10, num_shards=SHARDS,
)
ROW_LENGTH = 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", text_points(F.col("text")).alias("input_ids"))


SQL_IDS = f"ids AS (SELECT doc_id, {sql_points()} AS ids FROM documents)"
SQL_PADDED = f"""{SQL_IDS}, padded AS (
  SELECT doc_id, len(ids) AS n, list_resize(ids[1:{ROW_LENGTH}], {ROW_LENGTH}, {PAD_ID}) AS ids
  FROM ids)"""
# Every text in rows of ROW_LENGTH, the last one padded: no token is left out.
SQL_PIECES = f"""{SQL_IDS}, pieces AS (
  SELECT doc_id, chunk, least({ROW_LENGTH}, len(ids) - chunk * {ROW_LENGTH}) AS n,
         list_resize(ids[chunk * {ROW_LENGTH} + 1 : (chunk + 1) * {ROW_LENGTH}], {ROW_LENGTH}, {PAD_ID}) AS ids
  FROM (SELECT doc_id, ids, unnest(range((len(ids) + {ROW_LENGTH} - 1) // {ROW_LENGTH})) AS chunk FROM ids))"""
SQL_LABELS = f"list_transform(ids, lambda x: CASE WHEN x = {PAD_ID} THEN {IGNORE_INDEX} ELSE x END)"
SQL_PLACED = f"""placed AS (
  SELECT doc_id, text, shard,
         row_number() OVER (PARTITION BY shard ORDER BY {sql_order()}, doc_id) - 1 AS pos
  FROM (SELECT doc_id, text, {sql_shard(SHARDS)} AS shard FROM documents))"""
SQL_GROUPS = f"""groups AS (
  SELECT shard, pos // 10 AS grp, flatten(list({sql_points()} ORDER BY pos)) AS ids
  FROM placed GROUP BY shard, pos // 10 HAVING count(*) = 10),
chunks AS (
  SELECT shard, grp, chunk,
         list_resize(ids[chunk * 600 + 1 : chunk * 600 + 600], 600, {PAD_ID}) AS ids
  FROM (SELECT *, unnest(range((len(ids) + 599) // 600)) AS chunk FROM groups))"""


@query(
    "pack_groups",
    f"""WITH {SQL_PLACED}, {SQL_GROUPS}
    SELECT shard::BIGINT AS shard, grp, chunk,
           len(list_filter(ids, lambda x: x <> {PAD_ID}))::BIGINT AS n_tokens,
           {sql_digest('ids')} AS ids_md5, {sql_digest(SQL_LABELS)} AS labels_md5
    FROM chunks""",
)
def pack_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare.pretrain(documents(spark, sf_dir), PACKED, text_points)
    return rows.select(
        big("shard").alias("shard"), "grp", "chunk",
        big(S.n_loss_tokens(F.col("labels"))).alias("n_tokens"),
        digest("input_ids").alias("ids_md5"), digest("labels").alias("labels_md5"),
    )


@query(
    "pretrain_batches",
    f"""WITH {SQL_PLACED}, {SQL_GROUPS}, shuffled AS (
      SELECT shard, grp, chunk, row_number() OVER (ORDER BY {sql_order('key')}, key) - 1 AS pos
      FROM (SELECT shard, grp, chunk, concat(shard, '-', grp, '-', chunk) AS key FROM chunks))
    SELECT shard::BIGINT AS shard, grp, chunk, (pos % 4)::BIGINT AS rank,
           (pos // 4) // 24 AS batch_id FROM shuffled""",
)
def pretrain_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = replace(PACKED, world_size=4, train_batch_size=24)
    rows = prepare.pretrain(documents(spark, sf_dir), cfg, text_points)
    keyed = rows.withColumn("key", F.concat_ws("-", "shard", "grp", "chunk"))
    return prepare.to_batches(keyed, cfg, "key").select(
        big("shard").alias("shard"), "grp", "chunk", big("rank").alias("rank"), "batch_id"
    )


def streamed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return prepare.pack_tokens(docs, PACKED, text_points, F.length("text"))


def chunk_digests(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        big("shard").alias("shard"), big("chunk").alias("chunk"),
        digest("input_ids").alias("ids_md5"),
    )


# The stream of a shard is one long text here; its chunks are cut from the text.
SQL_STREAM = """streams AS (
  SELECT shard, string_agg(text, '' ORDER BY pos) AS text FROM placed GROUP BY shard),
cut AS (
  SELECT shard, chunk, substr(text, chunk * 600 + 1, 600) AS text
  FROM (SELECT shard, text, unnest(range(length(text) // 600)) AS chunk FROM streams))"""
SQL_CHUNK_DIGESTS = f"""SELECT shard::BIGINT AS shard, chunk::BIGINT AS chunk,
  {sql_digest(sql_points())} AS ids_md5"""


@query("pack_stream", f"WITH {SQL_PLACED}, {SQL_STREAM} {SQL_CHUNK_DIGESTS} FROM cut")
def pack_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_digests(streamed_chunks(spark, sf_dir))


@query(
    "split_chunks",
    f"""WITH {SQL_IDS}
    SELECT doc_id, chunk, {sql_digest('ids[chunk * 600 + 1 : chunk * 600 + 600]')} AS ids_md5
    FROM (SELECT doc_id, ids, unnest(range(len(ids) // 600)) AS chunk FROM ids)""",
)
def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = PrepConfig(
        mode="pretrain", seq_length=600, pad_to_max=False, sequence_sample_mode="split"
    )
    rows = prepare.shape_rows(document_ids(spark, sf_dir), cfg, "doc_id")
    return rows.select("doc_id", "chunk", digest("input_ids").alias("ids_md5"))


@query(
    "unshaped_ids",
    f"WITH {SQL_IDS} SELECT doc_id, len(ids)::BIGINT AS n_tokens, {sql_digest('ids')} AS ids_md5 FROM ids",
)
def unshaped_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = PrepConfig(
        mode="pretrain", seq_length=600, pad_to_max=False, sequence_sample_mode="none"
    )
    rows = prepare.shape_rows(document_ids(spark, sf_dir), cfg, "doc_id")
    return rows.select(
        "doc_id", big(F.size("input_ids")).alias("n_tokens"), digest("input_ids").alias("ids_md5")
    )


def padded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = PrepConfig(mode="pretrain", seq_length=ROW_LENGTH)
    docs = documents(spark, sf_dir).select(
        "doc_id", F.length("text").alias("n"), text_points(F.col("text")).alias("input_ids")
    )
    return prepare.shape_rows(docs, cfg, "doc_id").withColumn(
        "mask", S.attention_mask(F.col("n"), ROW_LENGTH)
    )


def document_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in padded rows, with the number of tokens and the mask of each."""
    rows = packing.cut_padded(document_ids(spark, sf_dir), ROW_LENGTH, ids="input_ids")
    used = F.size(F.filter("input_ids", lambda x: x != PAD_ID))
    return rows.withColumn("mask", S.attention_mask(used, ROW_LENGTH))


SQL_MASK = f"list_transform(range({ROW_LENGTH}), lambda i: (i < n)::INT)"


@query(
    "truncate_pad_mask",
    f"""WITH {SQL_PADDED}
    SELECT doc_id, len(ids)::BIGINT AS n_ids, {sql_digest('ids')} AS ids_md5,
           {sql_digest(SQL_MASK)} AS mask_md5 FROM padded""",
)
def truncate_pad_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return padded_documents(spark, sf_dir).select(
        "doc_id", big(F.size("input_ids")).alias("n_ids"),
        digest("input_ids").alias("ids_md5"), digest("mask").alias("mask_md5"),
    )


@query(
    "pretrain_labels",
    f"""WITH {SQL_PIECES}
    SELECT doc_id, chunk, {sql_digest(SQL_LABELS)} AS labels_md5 FROM pieces""",
)
def pretrain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = S.pretrain_labels(F.col("input_ids"))
    return document_pieces(spark, sf_dir).select("doc_id", "chunk", digest(labels).alias("labels_md5"))


@query(
    "shifted_targets",
    f"""WITH {SQL_PIECES}, labels AS (SELECT doc_id, chunk, {SQL_LABELS}[2:] AS targets FROM pieces)
    SELECT doc_id, chunk, {sql_digest('targets')} AS targets_md5,
           len(list_filter(targets, lambda x: x <> {IGNORE_INDEX}))::BIGINT AS n_loss_tokens
    FROM labels""",
)
def shifted_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_pieces(spark, sf_dir).select(
        "doc_id", "chunk", S.shifted_targets(S.pretrain_labels(F.col("input_ids"))).alias("targets")
    )
    return rows.select(
        "doc_id", "chunk", digest("targets").alias("targets_md5"),
        big(S.n_loss_tokens(F.col("targets"))).alias("n_loss_tokens"),
    )


@query(
    "position_ids",
    f"""WITH {SQL_PIECES}
    SELECT doc_id, chunk, {sql_digest(f'list_transform(range({ROW_LENGTH}), lambda i: CASE WHEN i < n THEN i ELSE 1 END)')}
           AS positions_md5 FROM pieces""",
)
def position_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = S.position_ids(F.col("mask"))
    return document_pieces(spark, sf_dir).select("doc_id", "chunk", digest(places).alias("positions_md5"))


@query(
    "last_token",
    f"""WITH {SQL_PIECES}
    SELECT doc_id, chunk, CASE WHEN n >= {ROW_LENGTH} THEN -1 ELSE n - 1 END::BIGINT AS last_index
    FROM pieces""",
)
def last_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_pieces(spark, sf_dir)
    return rows.select("doc_id", "chunk", big(S.last_token_index(F.col("input_ids"))).alias("last_index"))


def _sql_uniform(draw: int) -> str:
    text = "concat('42:u:', doc_id)"
    return f"{sql_word(text, 8 * draw + 1)} / 4294967296.0::DOUBLE"


@query(
    "sample_window",
    f"""WITH {SQL_IDS}, starts AS (
      SELECT doc_id, ids, CASE WHEN len(ids) <= 600 OR {_sql_uniform(0)} < 0.25 THEN 0
             ELSE floor(({_sql_uniform(1)}) * (len(ids) - 600 + 1))::BIGINT END AS start
      FROM (SELECT doc_id, list_resize(ids, greatest(len(ids), 600), {PAD_ID}) AS ids FROM ids)),
    cut AS (SELECT doc_id, start, ids[start + 1 : start + 600] AS ids FROM starts)
    SELECT doc_id, start::BIGINT AS start,
           {sql_digest('list_append(ids[1 : len(ids) - 1], 2)')} AS ids_md5 FROM cut""",
)
def sample_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = PrepConfig(mode="pretrain", seq_length=600, sequence_sample_mode="sample")
    start = S.sample_start(F.greatest(F.length("text"), F.lit(600)), 600, cfg.seed, F.col("doc_id"))
    docs = documents(spark, sf_dir).select(
        "doc_id", big(start).alias("start"), text_points(F.col("text")).alias("input_ids")
    )
    return prepare.shape_rows(docs, cfg, "doc_id").select(
        "doc_id", "start", digest("input_ids").alias("ids_md5")
    )
