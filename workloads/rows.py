"""Queries on sources, shards, order, batches and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from grainmill.config import PrepConfig
from grainmill.functions import sequences as S
from grainmill.functions.text import code_points, source_tag, text_points
from grainmill.operators import dispatch, metrics, order, packing, sharding, templates
from grainmill.plans import prepare
from grainmill.sources import jsonl
from grainmill.sources.tables import read_table
from workloads.base import big, digest, query, sql_digest, sql_order, sql_points, sql_shard
from workloads.shaping import SHARDS, SQL_CHUNK_DIGESTS, SQL_STREAM, chunk_digests, documents

SEED, RANKS, BATCH = 42, 4, 24
LENGTH = 1024

# Historic layouts: the row number picks the layout, the first line is the title.
SQL_UNIFY = """parts AS (
  SELECT doc_id, text, doc_id % 8 AS k, string_split(text, chr(10))[1] AS title,
         substr(text, length(string_split(text, chr(10))[1]) + 2) AS rest FROM documents),
unified AS (
  SELECT doc_id,
    CASE k WHEN 0 THEN 'titled' WHEN 1 THEN 'plain' WHEN 2 THEN 'encyclopedia' WHEN 3 THEN 'news'
           WHEN 4 THEN 'lyrics' WHEN 5 THEN 'poem' WHEN 6 THEN 'couplet' END AS rule,
    CASE WHEN k IN (1, 6) THEN text
         WHEN k IN (0, 4, 5) THEN title || chr(10) || rest
         WHEN k = 2 THEN CASE WHEN rest = '' THEN '百度百科' ELSE chr(10) || rest END
         WHEN k = 3 THEN CASE WHEN title = '' AND rest = '' THEN '新闻'
                              ELSE title || chr(10) || rest END END AS text
  FROM parts)"""


@query(
    "unify_text",
    f"""WITH {SQL_UNIFY}
    SELECT doc_id, rule, md5(text) AS text_md5,
           CASE WHEN rule IS NULL THEN 'unrecognised format' END AS reject_reason FROM unified""",
)
def unify_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 8
    title = F.substring_index("text", "\n", 1)
    rest = F.substr(F.col("text"), F.length(title) + 2)

    def on(*layouts: int, value=F.lit("x")):
        return F.when(k.isin(*layouts), value)

    rows = documents(spark, sf_dir).select(
        "doc_id",
        on(0).alias("uniqueKey"),
        on(0, 3, 4, 5, value=title).alias("title"),
        on(0, value=rest).alias("content"),
        on(1, 6, value=F.col("text")).when(k.isin(3, 4, 5), rest).alias("text"),
        on(1).alias("meta"),
        on(2).alias("basic_info"),
        on(2, value=rest).alias("main_content"),
        on(3).alias("channel"),
        on(3, 6).alias("type"),
        on(4).alias("singer"),
        on(5).alias("author"),
    )
    return templates.unify_text(rows).select(
        "doc_id", "rule", F.md5("text").alias("text_md5"), "reject_reason"
    )


# Documents as JSON lines of numbered part files. Every tenth line is cut short.
ROW_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
)


def part_path(prefix: str = "part"):
    return F.concat(F.lit(f"{prefix}-"), "source", F.lit("-"), "doc_id", F.lit(".jsonl"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.to_json(F.struct("doc_id", "text"))
    cut = F.when(F.col("doc_id") % 10 == 3, F.substr(line, F.lit(1), F.length(line) - 2))
    return documents(spark, sf_dir).select(
        F.coalesce(cut, line).alias("value"), part_path().alias("path")
    )


@query(
    "json_lines",
    """SELECT 'src' || source[4:] AS source, CASE WHEN bad THEN -1 ELSE doc_id END AS doc_id,
              CASE WHEN bad THEN NULL ELSE md5(text) END AS text_md5,
              CASE WHEN bad THEN 'invalid JSON' END AS reject_reason
    FROM (SELECT *, doc_id % 10 = 3 AS bad FROM documents)""",
)
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = document_lines(spark, sf_dir)
    tagged = lines.select("value", source_tag(F.col("path")).alias("source"))
    rows = jsonl.parse_lines(tagged, ROW_SCHEMA)
    good = F.col("reject_reason").isNull()
    return rows.select(
        "source", F.when(good, F.col("doc_id")).otherwise(-1).alias("doc_id"),
        F.when(good, F.md5("text")).alias("text_md5"), "reject_reason",
    )


# Half of the sources get the whole text, a quarter gets its lines as separate sequences, and
# the rest has no transform.
WHOLE = [f"src{i}" for i in range(0, 20, 2)]
BY_LINE = [f"src{i}" for i in range(1, 20, 4)]


def source_transforms():
    whole = F.array(code_points(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda line: line != "")
    by_line = F.transform(lines, code_points)
    return {**{s: whole for s in WHOLE}, **{s: by_line for s in BY_LINE}}


SQL_DISPATCH = f"""sequences AS (
  SELECT doc_id, source, CASE
    WHEN source IN {tuple(WHOLE)} THEN [text]
    WHEN source IN {tuple(BY_LINE)} THEN
      list_filter(string_split(text, chr(10)), lambda s: s <> '') END AS parts
  FROM documents)"""


@query(
    "source_dispatch",
    f"""WITH {SQL_DISPATCH}
    SELECT doc_id, source, {sql_digest(sql_points('part'))} AS ids_md5, NULL::VARCHAR AS reject_reason
    FROM (SELECT doc_id, source, unnest(parts) AS part FROM sequences)
    UNION ALL
    SELECT doc_id, source, NULL, 'unknown source' FROM sequences WHERE parts IS NULL""",
)
def source_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dispatch.apply_by_source(
        documents(spark, sf_dir), source_transforms(), out="input_ids"
    )
    return rows.select("doc_id", "source", digest("input_ids").alias("ids_md5"), "reject_reason")


@query(
    "packed_reader",
    f"""WITH {SQL_DISPATCH}, kept AS (
      SELECT doc_id, {sql_shard(SHARDS)} AS shard, array_to_string(parts, '') AS text
      FROM sequences WHERE len(parts) > 0),
    placed AS (
      SELECT shard, text, row_number() OVER (PARTITION BY shard ORDER BY {sql_order()}, doc_id) AS pos
      FROM kept), {SQL_STREAM}
    {SQL_CHUNK_DIGESTS} FROM cut""",
)
def packed_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = PrepConfig(mode="pretrain", seq_length=600, num_shards=SHARDS)
    chunks = prepare.read_sequences(documents(spark, sf_dir), source_transforms(), cfg)
    return chunk_digests(chunks)


@query(
    "source_union",
    """SELECT 'documents' AS name, doc_id AS row_id, length(text)::BIGINT AS n_chars FROM documents
    UNION ALL SELECT 'benchmark', item_id, length(text) FROM benchmark
    UNION ALL SELECT 'conversations', conv_id * 1000 + turn, length(text) FROM conversations""",
)
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {
        "documents": F.col("doc_id"),
        "benchmark": F.col("item_id"),
        "conversations": F.col("conv_id") * 1000 + F.col("turn"),
    }
    parts = {
        name: read_table(spark, sf_dir, name).select(key.alias("row_id"), "text")
        for name, key in keys.items()
    }
    merged = jsonl.union_sources(parts)
    return merged.select("name", "row_id", big(F.length("text")).alias("n_chars"))


# One part file per document.
SQL_PATHS = f"""paths AS (
  SELECT concat('part-', source, '-', doc_id, '.jsonl') AS path FROM documents),
numbered AS (
  SELECT path, row_number() OVER (ORDER BY {sql_order('path')}, path) - 1 AS shard_idx FROM paths)"""


def numbered_paths(spark: SparkSession, sf_dir: str, repeat: int = 1) -> DataFrame:
    paths = documents(spark, sf_dir).select(part_path().alias("path"))
    return sharding.number_paths(paths, repeat=repeat, seed=SEED)


@query(
    "shard_assign",
    f"""WITH {SQL_PATHS}
    SELECT path, shard_idx, (shard_idx % {RANKS})::BIGINT AS rank FROM numbered""",
)
def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign_rank(numbered_paths(spark, sf_dir), RANKS)
    return rows.select("path", "shard_idx", big("rank").alias("rank"))


@query(
    "shard_trim",
    f"""WITH {SQL_PATHS}
    SELECT path, shard_idx, (shard_idx % 7)::BIGINT AS rank FROM numbered
    WHERE shard_idx < (SELECT count(*) // 7 * 7 FROM numbered)""",
)
def shard_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    trimmed = sharding.trim_shards(numbered_paths(spark, sf_dir), 7)
    rows = sharding.assign_rank(trimmed, 7)
    return rows.select("path", "shard_idx", big("rank").alias("rank"))


@query(
    "shard_repeat",
    f"""WITH {SQL_PATHS}
    SELECT path, shard_idx + r * (SELECT count(*) FROM numbered) AS shard_idx
    FROM numbered, range(3) t(r)""",
)
def shard_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_paths(spark, sf_dir, repeat=3).select("path", "shard_idx")


@query(
    "oversample",
    "SELECT doc_id, source, copy::BIGINT AS copy FROM documents, range(1, 4) t(copy)",
)
def oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.repeat_rows(documents(spark, sf_dir).select("doc_id", "source"), 3)
    return rows.withColumn("copy", big("copy"))


SQL_SHUFFLED = f"""shuffled AS (
  SELECT doc_id, row_number() OVER (ORDER BY {sql_order()}, doc_id) - 1 AS pos FROM documents)"""


@query("shuffle_order", f"WITH {SQL_SHUFFLED} SELECT doc_id, pos FROM shuffled")
def shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.with_shuffled_positions(documents(spark, sf_dir).select("doc_id"), "doc_id", SEED)


@query(
    "peek_rows",
    f"WITH {SQL_SHUFFLED} SELECT doc_id FROM shuffled WHERE pos < 11",
)
def peek_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.peek(order.shuffle_rows(documents(spark, sf_dir).select("doc_id"), "doc_id", SEED))


@query(
    "rank_split",
    f"""WITH {SQL_SHUFFLED}
    SELECT doc_id, (pos % 3)::BIGINT AS by_row, ({sql_shard(SHARDS)} % 2)::BIGINT AS by_shard
    FROM shuffled""",
)
def rank_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = PrepConfig(mode="pretrain", seq_length=600, num_shards=SHARDS)
    rows = prepare.with_shard(shuffle_order(spark, sf_dir), cfg, "doc_id")
    shard, pos = F.col(packing.SHARD), F.col("pos")
    return rows.select(
        "doc_id",
        big(sharding.rank_of_row(shard, pos, SHARDS, 3)).alias("by_row"),
        big(sharding.rank_of_row(shard, pos, SHARDS, 2)).alias("by_shard"),
    )


SQL_BATCHES = f"""{SQL_SHUFFLED}, batches AS (
  SELECT doc_id, (pos % {RANKS})::BIGINT AS rank, (pos // {RANKS}) // {BATCH} AS batch_id
  FROM shuffled)"""


def batched(spark: SparkSession, sf_dir: str, *further: str) -> DataFrame:
    cfg = PrepConfig(
        mode="pretrain", seq_length=LENGTH, world_size=RANKS, train_batch_size=BATCH
    )
    rows = prepare.to_batches(documents(spark, sf_dir).select("doc_id"), cfg, "doc_id")
    return rows.select("doc_id", big("rank").alias("rank"), "batch_id", *further)


@query("batch_assign", f"WITH {SQL_BATCHES} SELECT doc_id, rank, batch_id FROM batches")
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batched(spark, sf_dir)


@query(
    "resume_batches",
    f"WITH {SQL_BATCHES} SELECT doc_id, rank, batch_id FROM batches WHERE batch_id >= 5",
)
def resume_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.skip_batches(batched(spark, sf_dir), 5)


@query(
    "token_budget",
    f"""WITH pieces AS (
      SELECT source, length(text) AS n, (length(text) + {LENGTH} - 1) // {LENGTH} AS n_rows FROM documents)
    SELECT source, sum(n_rows)::BIGINT AS n_rows, sum(n)::BIGINT AS n_tokens,
           sum(n - n_rows)::BIGINT AS n_loss_tokens
    FROM pieces WHERE n > 0 GROUP BY source""",
)
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("source", text_points(F.col("text")).alias("ids"))
    labels = S.pretrain_labels(F.col("ids"))
    rows = packing.cut_padded(docs, LENGTH, ids="ids").select(
        "source", S.n_loss_tokens(labels).alias("n"),
        S.n_loss_tokens(S.shifted_targets(labels)).alias("n_loss"),
    )
    return metrics.token_budget(rows, F.col("n"), F.col("n_loss"))


# Events as a step log: a user is a run, its events in time order are the steps.
TOKENS_PER_STEP = 24 * 600
SQL_STEPS = """steps AS (
  SELECT user_id, event_id, ts, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events)"""


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return metrics.number_steps(events, run="user_id", ts="ts", tie="event_id")


@query(
    "throughput",
    f"""WITH {SQL_STEPS}, marks AS (
      SELECT user_id, step, epoch_us(ts) AS at FROM steps WHERE step % 5 = 0),
    spans AS (
      SELECT m.user_id, m.step, (m.at - e.at) / 1e6::DOUBLE AS seconds
      FROM marks m JOIN marks e ON e.user_id = m.user_id AND e.step = m.step - 5)
    SELECT user_id, step, seconds, {5.0 * TOKENS_PER_STEP}::DOUBLE / nullif(seconds, 0) AS tokens_per_second
    FROM spans""",
)
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.throughput(step_log(spark, sf_dir), 5, TOKENS_PER_STEP, run="user_id")


@query(
    "interval_rows",
    f"""WITH {SQL_STEPS}
    SELECT user_id, step, value AS loss, 'log' AS due FROM steps WHERE step % 5 = 0 AND step > 0
    UNION ALL SELECT user_id, step, value, 'eval' FROM steps WHERE step % 20 = 0""",
)
def interval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = step_log(spark, sf_dir).select("user_id", "step", F.col("value").alias("loss"))
    log = metrics.interval_rows(steps, 5).withColumn("due", F.lit("log"))
    evals = metrics.interval_rows(steps, 20, include_zero=True)
    return log.unionByName(evals.withColumn("due", F.lit("eval")))
