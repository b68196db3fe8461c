"""Queries on real files: JSON lines with faults, batches, rejects, step logs, resumed streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from grainmill.config import PrepConfig
from grainmill.functions.text import text_points
from grainmill.operators import dispatch
from grainmill.plans import prepare
from grainmill.session import scratch_dir
from grainmill.sources import jsonl, sinks
from grainmill.sources.tables import read_table
from grainmill.streaming import carry, packing as stream_packing, run
from workloads import dialogue, rows
from workloads.base import big, digest, query, sql_digest, sql_order, sql_points, sql_shard
from workloads.shaping import PACKED, SQL_CHUNK_DIGESTS, SQL_STREAM, chunk_digests, documents
from workloads.streams import STREAMED

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
SQL_LINES = """SELECT source, CASE WHEN NOT bad THEN doc_id END AS doc_id,
  CASE WHEN NOT bad THEN md5(text) END AS text_md5, CASE WHEN bad THEN 'invalid JSON' END AS reject_reason
FROM (SELECT *, doc_id % 10 = 3 AS bad FROM documents)"""


def jsonl_folder(spark: SparkSession, sf_dir: str) -> str:
    """The documents as JSON-lines files per source; every tenth line is broken off."""
    line = F.to_json(F.struct("doc_id", "text"))
    broken = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("{broken "), F.col("doc_id")))
    folder = scratch_dir(spark, "jsonl")
    lines = documents(spark, sf_dir).select("source", F.coalesce(broken, line).alias("value"))
    sinks.write_jsonl(lines, folder)
    return folder


def line_digests(parsed: DataFrame) -> DataFrame:
    good = F.col("reject_reason").isNull()
    return parsed.select(
        "source", F.when(good, F.col("doc_id")).alias("doc_id"),
        F.when(good, F.md5("text")).alias("text_md5"), "reject_reason",
    )


@query("jsonl_scan", SQL_LINES)
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = jsonl.read_lines(spark, f"{jsonl_folder(spark, sf_dir)}/part-*.jsonl")
    return line_digests(jsonl.parse_lines(lines, SCHEMA))


@query("jsonl_stream", SQL_LINES)
def jsonl_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = jsonl_folder(spark, sf_dir)
    stream = jsonl.stream_jsonl(spark, folder, SCHEMA, max_files=5, strict=False)
    out = scratch_dir(spark, "jsonl-stream")
    return line_digests(run.run_to_table(stream, f"{out}/out", f"{out}/checkpoint"))


SQL_MERGED = f"""merged AS (
  SELECT doc_id, text, {sql_shard(PACKED.num_shards)} AS shard FROM (
    SELECT doc_id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark
    UNION ALL SELECT item_id, text FROM benchmark))"""


@query(
    "pack_merged",
    f"""WITH {SQL_MERGED}
    SELECT shard::BIGINT AS shard, (sum(length(text)) // 600)::BIGINT AS n_chunks,
           (sum(length(text)) // 600 * 600)::BIGINT AS n_tokens, (count(*) // 10)::BIGINT AS n_groups
    FROM merged GROUP BY shard""",
)
def pack_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with the same ids, and rows that occur twice, lose nothing by packing."""
    items = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    merged = documents(spark, sf_dir).select("doc_id", "text").union(items).union(items)
    chunks = prepare.pack_tokens(merged, PACKED, text_points, F.length("text"))
    stream = chunks.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_chunks"), big(F.sum(F.size("input_ids"))).alias("n_tokens")
    )
    groups = prepare.pretrain(merged, PACKED, text_points).groupBy("shard").agg(
        F.countDistinct("grp").alias("n_groups")
    )
    return stream.join(groups, "shard").select(
        big("shard").alias("shard"), "n_chunks", "n_tokens", "n_groups"
    )


@query(
    "batch_files",
    f"""WITH {rows.SQL_BATCHES} SELECT doc_id, rank, batch_id FROM batches""",
)
def batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "batches")
    sinks.write_batches(rows.batched(spark, sf_dir), path)
    return spark.read.parquet(path).select("doc_id", big("rank").alias("rank"), "batch_id")


@query(
    "reject_files",
    f"""WITH {rows.SQL_DISPATCH}
    SELECT doc_id, source, 'unknown source' AS reject_reason FROM sequences WHERE parts IS NULL""",
)
def reject_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dispatch.apply_by_source(
        documents(spark, sf_dir), rows.source_transforms(), out="input_ids"
    )
    path = scratch_dir(spark, "rejects")
    sinks.write_rejects(dispatch.rejects(done).select("doc_id", "source", "reject_reason"), path)
    return spark.read.parquet(path)


@query(
    "log_rows",
    f"""WITH {rows.SQL_STEPS}
    SELECT user_id, step, value AS loss FROM steps WHERE step % 5 = 0 AND step > 0""",
)
def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = rows.interval_rows(spark, sf_dir).where("due = 'log'").drop("due")
    path = scratch_dir(spark, "step-log")
    # Two appends, as a run that goes on after a stop makes them.
    sinks.append_step_log(due.where("step < 50"), path)
    sinks.append_step_log(due.where("step >= 50"), path)
    return spark.read.parquet(path)


@query(
    "log_twice",
    f"""WITH {rows.SQL_STEPS}
    SELECT user_id, step, value AS loss FROM steps WHERE step % 5 = 0 AND step > 0""",
)
def log_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that a run writes, stops, and writes again from an earlier step on."""
    due = rows.interval_rows(spark, sf_dir).where("due = 'log'").drop("due")
    path = scratch_dir(spark, "log-twice")
    parts = {"steps-000-049": due.where("step < 50"), "steps-050-": due.where("step >= 50")}
    for name in ("steps-000-049", "steps-050-", "steps-000-049", "steps-050-"):
        sinks.append_step_log(parts[name], path, name)
    return sinks.read_log(spark, path, due.schema)


@query("stream_rejects", SQL_LINES)
def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and rejects of each micro-batch from one pass; every batch is played twice."""
    folder, out = jsonl_folder(spark, sf_dir), scratch_dir(spark, "stream-rejects")
    stream = jsonl.stream_jsonl(spark, folder, SCHEMA, max_files=5, strict=False)

    def twice(batch: DataFrame, batch_id: int) -> None:
        for _ in range(2):
            sinks.write_sorted_out(batch, f"{out}/lines", carry.write_id(batch_id))

    carry.run_batches(stream, twice, f"{out}/checkpoint")
    schema = "source string, doc_id long, text string, reject_reason string"
    good = sinks.read_sorted_out(spark, f"{out}/lines", schema)
    bad = sinks.read_sorted_out(spark, f"{out}/lines", schema, rejected=True)
    return line_digests(good.unionByName(bad))


@query(
    "stream_resume",
    f"""WITH placed AS (
      SELECT doc_id, text, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id % 2, doc_id) - 1 AS pos
      FROM (SELECT doc_id, text, {sql_shard(STREAMED.num_shards)} AS shard FROM documents)), {SQL_STREAM}
    {SQL_CHUNK_DIGESTS} FROM cut""",
)
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents, a stop, then odd ones from the checkpoint: what was carried over is used."""
    folder = scratch_dir(spark, "resume")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    for half in (0, 1):
        docs.where(F.col("doc_id") % 2 == half).write.mode("append").parquet(f"{folder}/in")
        arrived = spark.readStream.schema(docs.schema).parquet(f"{folder}/in")
        ids = prepare.with_shard(arrived, STREAMED, "doc_id").withColumn(
            "input_ids", text_points(F.col("text"))
        )
        chunks = stream_packing.pack_stream_stateful(ids, STREAMED.seq_length)
        out = run.run_to_table(chunks, f"{folder}/out", f"{folder}/checkpoint")
    return chunk_digests(out)


RECIPE = {
    "data": {
        "mode": "pretrain", "seq_length": 600, "pad_to_max": False, "sequence_sample_mode": "none",
        "num_shards": 8, "world_size": 4,
    },
    "train": {"train_batch_size": 24},
}


def recipe_rows(spark: SparkSession, sf_dir: str, **changes) -> DataFrame:
    """The recipe over the documents as JSON-lines files of two sources."""
    folder = scratch_dir(spark, "recipe")
    line = F.to_json(F.struct("doc_id", "text"))
    side = F.when(F.col("doc_id") % 3 == 0, "books").otherwise("web")
    sinks.write_jsonl(documents(spark, sf_dir).select(side.alias("source"), line.alias("value")), folder)
    files = {s: f"{folder}/part-{s}-*.jsonl" for s in ("books", "web")}
    cfg = PrepConfig.from_dict({**RECIPE, "data": {**RECIPE["data"], "data": files, **changes}})
    made = prepare.run(spark, cfg, text_points, key="doc_id")
    return made.select(
        "doc_id", big("rank").alias("rank"), big("batch_id").alias("batch_id"),
        digest("input_ids").alias("ids_md5"),
    )


@query(
    "recipe_pretrain",
    f"""WITH {rows.SQL_SHUFFLED}
    SELECT doc_id, (pos % 4)::BIGINT AS rank, ((pos // 4) // 24)::BIGINT AS batch_id,
           {sql_digest(sql_points())} AS ids_md5
    FROM shuffled JOIN documents USING (doc_id)""",
)
def recipe_pretrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipe_rows(spark, sf_dir)


@query(
    "recipe_shards",
    f"""WITH ranked AS (
      SELECT doc_id, text, {sql_shard(8)} % 4 AS rank FROM documents)
    SELECT doc_id, rank::BIGINT AS rank,
           ((row_number() OVER (PARTITION BY rank ORDER BY {sql_order()}, doc_id) - 1) // 24)::BIGINT AS batch_id,
           {sql_digest(sql_points())} AS ids_md5 FROM ranked""",
)
def recipe_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipe_rows(spark, sf_dir, split_by_shard=True)


def sql_dealt(table: str, key: str) -> str:
    """``rank`` and ``batch_id`` of the shuffled rows of a table."""
    return f"""dealt AS (
      SELECT *, (pos % 4)::BIGINT AS rank, ((pos // 4) // 24)::BIGINT AS batch_id
      FROM (SELECT *, row_number() OVER (ORDER BY {sql_order(key)}, {key}) - 1 AS pos FROM {table}))"""


@query(
    "recipe_instruct",
    f"""WITH {dialogue.SQL_RECORDS}, samples AS (
      SELECT doc_id, CASE WHEN input <> '' THEN 0 ELSE k END::BIGINT AS turn, o || '</s>' AS answer,
             CASE WHEN input <> '' THEN {dialogue.SQL_WITH_INPUT.format(i='i', n='input', o='o')}
             ELSE {dialogue.SQL_PLAIN.format(i='i', o='o')} END AS text FROM turns WHERE o IS NOT NULL),
    {dialogue.sql_sft('samples')}, {sql_dealt('labelled', "(doc_id || '-' || turn)")}
    SELECT doc_id, turn, rank, batch_id, {dialogue.SQL_SFT_COLUMNS} FROM dealt""",
)
def recipe_instruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instruction recipe from its files to ranks and batches; a record gives a row a turn."""
    folder = scratch_dir(spark, "recipe-instruct")
    records = dialogue.document_records(spark, sf_dir)
    line = F.to_json(F.struct(*records.columns))
    side = F.when(F.col("doc_id") % 3 == 0, "books").otherwise("web")
    sinks.write_jsonl(records.select(side.alias("source"), line.alias("value")), folder)
    files = {s: f"{folder}/part-{s}-*.jsonl" for s in ("books", "web")}
    cfg = PrepConfig.from_dict({
        "data": {"mode": "instruct", "seq_length": 1024, "world_size": 4, "data": files},
        "train": {"train_batch_size": 24},
    })
    made = prepare.run(spark, cfg, text_points, key="doc_id")
    return dialogue.sft_columns(made, "doc_id", "turn", "rank", "batch_id")


PAIR_CHARS = 145
# Three pairs a document, so that the limit of a sanity check cuts some off.
SQL_PREFERENCE_ROWS = """given AS (
  SELECT doc_id * 3 + k AS pair_id, k || ': ' || substr(text, 1, 30) AS question,
         substr(text, 31, 40 + 20 * k) AS response_j, substr(text, 71, 40 + doc_id % 60) AS response_k
  FROM documents CROSS JOIN range(3) t(k)),
limited AS (SELECT * FROM given ORDER BY pair_id LIMIT 1000),
kept AS (
  SELECT pair_id, '### Instruction: ' || question || chr(10) || chr(10) || '### System: ' || chr(10) AS prompt,
         response_j AS chosen, response_k AS rejected FROM limited)"""


@query(
    "recipe_preference",
    f"""WITH {SQL_PREFERENCE_ROWS}, short AS (
      SELECT * FROM kept WHERE length(prompt) + greatest(length(chosen), length(rejected)) <= {PAIR_CHARS}),
    {sql_dealt('short', 'pair_id')}
    SELECT pair_id, prompt, chosen, rejected, rank, batch_id FROM dealt""",
)
def recipe_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preference recipe as a sanity check: the first 1,000 pairs, less those that are too long."""
    folder = scratch_dir(spark, "recipe-preference")
    docs = documents(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    pairs = docs.select(
        (F.col("doc_id") * 3 + F.col("k")).alias("pair_id"),
        F.concat("k", F.lit(": "), F.substring("text", 1, 30)).alias("question"),
        F.substr(F.col("text"), F.lit(31), 40 + 20 * F.col("k")).alias("response_j"),
        F.substr(F.col("text"), F.lit(71), (40 + F.col("doc_id") % 60).cast("int")).alias("response_k"),
    )
    line = F.to_json(F.struct(*pairs.columns))
    sinks.write_jsonl(pairs.select(F.lit("pairs").alias("source"), line.alias("value")), folder)
    cfg = PrepConfig.from_dict({
        "data": {
            "mode": "preference", "sanity_check": True, "max_pair_chars": PAIR_CHARS, "world_size": 4,
            "data": {"pairs": f"{folder}/part-pairs-*.jsonl"},
        },
        "train": {"train_batch_size": 24},
    })
    made = prepare.run(spark, cfg, key="pair_id")
    return made.select(
        "pair_id", "prompt", "chosen", "rejected", big("rank").alias("rank"), big("batch_id").alias("batch_id")
    )
