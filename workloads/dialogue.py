"""Queries on instruction records, preference pairs and chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from grainmill.config import PrepConfig
from grainmill.constants import DEFAULT_SYSTEM_PROMPT, IGNORE_INDEX, PAD_ID
from grainmill.functions.text import text_points
from grainmill.operators import chat, dispatch, templates
from grainmill.plans import prepare
from grainmill.sources.tables import read_table
from workloads.base import big, digest, query, sql_digest, sql_points
from workloads.shaping import documents

SFT = PrepConfig(mode="instruct", seq_length=1024)
SANITY_ROWS = 1000
MAX_PAIR_CHARS = 1024


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations")


SQL_PAIRS = """pairs AS (
  SELECT conv_id, turn, text AS "user", next_text AS reply
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""
SQL_PLAIN = """'### Instruction:' || chr(10) || {i} || chr(10) || chr(10) ||
  '### System:' || chr(10) || {o} || '</s>'"""
SQL_WITH_INPUT = """'### Instruction:' || chr(10) || {i} || chr(10) || chr(10) || '### Input:' ||
  chr(10) || {n} || chr(10) || chr(10) || '### System:' || chr(10) || {o} || '</s>'"""
SQL_SAMPLES = f"""{SQL_PAIRS}, systems AS (
  SELECT conv_id, arg_min(text, turn) AS system FROM conversations
  WHERE role = 'system' GROUP BY conv_id),
flagged AS (
  SELECT p.*, coalesce(system, '') AS system, max(turn) OVER (PARTITION BY p.conv_id) AS last_turn
  FROM pairs p LEFT JOIN systems USING (conv_id)),
samples AS (
  SELECT conv_id, turn, reply || '</s>' AS answer,
         CASE WHEN system = '' THEN {SQL_PLAIN.format(i='"user"', o='reply')}
         ELSE {SQL_WITH_INPUT.format(i='"user"', n='system', o='reply')} END AS text
  FROM flagged WHERE system = '' OR turn = last_turn)"""


@query(
    "instruct_samples",
    f"WITH {SQL_SAMPLES} SELECT conv_id, turn, text, answer FROM samples",
)
def instruct_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.render_conversation_turns(conversations(spark, sf_dir))


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as instruction records: the lines are taken two by two as exchanges.

    The last pair is the current exchange and the earlier ones its history; a third of the
    records has the language as input, and every third one has no output if it has one line.
    """
    lines = F.split("text", "\n")
    n = F.floor(F.size(lines) / 2).cast("int")
    pairs = F.when(
        n > 1,
        F.transform(
            F.sequence(F.lit(0), n - 2),
            lambda i: F.array(lines[2 * i], lines[2 * i + 1]),
        ),
    )
    return documents(spark, sf_dir).select(
        "doc_id",
        F.try_element_at(lines, 2 * n - 1 + (n < 1).cast("int") * 2).alias("instruction"),
        F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("").alias("input"),
        F.when(n > 0, F.try_element_at(lines, F.greatest(2 * n, F.lit(1)))).alias("output"),
        F.coalesce(pairs, F.array().cast("array<array<string>>")).alias("history"),
    )


SQL_RECORDS = f"""records AS (
  SELECT doc_id, lines, len(lines) // 2 AS n, CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS input
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS lines FROM documents)),
turns AS (
  SELECT doc_id, input, n, k, lines[2 * k + 1] AS i, CASE WHEN n > 0 THEN lines[2 * k + 2] END AS o
  FROM (SELECT *, unnest(CASE WHEN input <> '' OR n = 0 THEN [greatest(n, 1) - 1]
                         ELSE range(n) END) AS k FROM records))"""


@query(
    "instruct_records",
    f"""WITH {SQL_RECORDS}
    SELECT doc_id, CASE WHEN input <> '' THEN 0 ELSE k END::BIGINT AS turn,
           md5(CASE WHEN input <> '' THEN {SQL_WITH_INPUT.format(i='i', n='input', o='o')}
               ELSE {SQL_PLAIN.format(i='i', o='o')} END) AS text_md5,
           md5(o || '</s>') AS answer_md5,
           CASE WHEN o IS NULL THEN 'missing part' END AS reject_reason
    FROM turns""",
)
def instruct_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = templates.render_instructions(document_records(spark, sf_dir))
    return rows.select(
        "doc_id", big("turn").alias("turn"), F.md5("text").alias("text_md5"),
        F.md5("answer").alias("answer_md5"), "reject_reason",
    )


def sql_sft(samples: str) -> str:
    return f"""tokenised AS (
  SELECT *, list_resize(ids[1:1024], 1024, {PAD_ID}) AS input_ids, least(len(ids), 1024) AS n_tokens,
         least(n_chars, 1024) AS n_source
  FROM (SELECT *, {sql_points()} AS ids, length(text) - length(answer) AS n_chars FROM {samples})),
labelled AS (
  SELECT *, list_transform(input_ids, lambda x, i: CASE WHEN i <= n_source OR i > n_tokens
           THEN {IGNORE_INDEX} ELSE x END) AS labels FROM tokenised)"""


SQL_SFT_COLUMNS = f"""n_tokens::BIGINT AS n_tokens,
  len(list_filter(labels, lambda x: x <> {IGNORE_INDEX}))::BIGINT AS n_loss_tokens,
  {sql_digest('input_ids')} AS ids_md5, {sql_digest('labels')} AS labels_md5,
  {sql_digest('list_transform(range(1024), lambda i: (i < n_tokens)::INT)')} AS mask_md5"""


def sft_columns(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(
        *[big(k).alias(k) for k in keys], big("n_tokens").alias("n_tokens"),
        big("n_loss_tokens").alias("n_loss_tokens"), digest("input_ids").alias("ids_md5"),
        digest("labels").alias("labels_md5"), digest("attention_mask").alias("mask_md5"),
    )


@query(
    "sft_rows",
    f"""WITH {SQL_SAMPLES}, {sql_sft('samples')}
    SELECT conv_id, turn, {SQL_SFT_COLUMNS} FROM labelled""",
)
def sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = templates.render_conversation_turns(conversations(spark, sf_dir))
    return sft_columns(prepare.answer_rows(samples, SFT, text_points), "conv_id", "turn")


@query(
    "sft_records",
    f"""WITH {SQL_RECORDS}, samples AS (
      SELECT doc_id, CASE WHEN input <> '' THEN 0 ELSE k END AS turn, o || '</s>' AS answer,
             CASE WHEN input <> '' THEN {SQL_WITH_INPUT.format(i='i', n='input', o='o')}
             ELSE {SQL_PLAIN.format(i='i', o='o')} END AS text FROM turns WHERE o IS NOT NULL),
    {sql_sft('samples')}
    SELECT doc_id, turn::BIGINT AS turn, {SQL_SFT_COLUMNS} FROM labelled""",
)
def sft_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare.instruct(document_records(spark, sf_dir), SFT, text_points)
    return sft_columns(rows, "doc_id", "turn")


SQL_PREFERENCE = f"""{SQL_PAIRS}, preferences AS (
  SELECT conv_id, '### Instruction: ' || arg_min("user", turn) || chr(10) || chr(10) ||
         '### System: ' || chr(10) AS prompt,
         arg_min(reply, turn) AS chosen, arg_max(reply, turn) AS rejected
  FROM pairs GROUP BY conv_id HAVING count(*) >= 2)"""


@query(
    "preference_pairs",
    f"WITH {SQL_PREFERENCE} SELECT conv_id, prompt, chosen, rejected FROM preferences",
)
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.preference(templates.preference_records(conversations(spark, sf_dir)))


@query(
    "preference_filtered",
    f"""WITH {SQL_PREFERENCE} SELECT conv_id, prompt, chosen, rejected FROM preferences
    WHERE length(prompt) + length(chosen) <= {MAX_PAIR_CHARS}
      AND length(prompt) + length(rejected) <= {MAX_PAIR_CHARS}""",
)
def preference_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.filter_pair_length(preference_pairs(spark, sf_dir), MAX_PAIR_CHARS)


@query(
    "preference_sanity",
    f"""WITH {SQL_PREFERENCE} SELECT conv_id, prompt, chosen, rejected FROM preferences
    ORDER BY conv_id LIMIT {SANITY_ROWS}""",
)
def preference_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = templates.preference_records(conversations(spark, sf_dir))
    return prepare.preference(records, "conv_id", sanity_check=True)


SQL_STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
SQL_CHAT = f"""led AS (
  SELECT *, first_value(role) OVER w AS lead_role, first_value(text) OVER w AS lead_text,
         row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n_turns,
         max(turn) OVER (PARTITION BY conv_id) AS last
  FROM messages WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
looped AS (
  SELECT conv_id, turn, role, n_turns, last, i - (lead_role = 'system')::INT AS i,
         CASE WHEN lead_role = 'system' AND i = 1
              THEN '<<SYS>>' || chr(10) || lead_text || chr(10) || '<</SYS>>' || chr(10) || chr(10)
              ELSE '' END || text AS text
  FROM led WHERE NOT (lead_role = 'system' AND i = 0)),
chats AS (
  SELECT conv_id, any_value(n_turns) AS n_turns,
         CASE WHEN any_value(last) + 1 <> any_value(n_turns) THEN 'missing turn'
              WHEN bool_or((role = 'user') <> (i % 2 = 0)) THEN 'roles do not alternate' END
         AS reject_reason,
         string_agg(CASE WHEN role = 'user' THEN '<s>[INST] ' || {SQL_STRIP.format('text')} || ' [/INST]'
                         WHEN role = 'assistant' THEN ' ' || {SQL_STRIP.format('text')} || ' </s>'
                         WHEN role = 'system' THEN '<<SYS>>' || chr(10) || {SQL_STRIP.format('text')}
                              || chr(10) || '<</SYS>>' || chr(10) || chr(10)
                         ELSE '' END, '' ORDER BY turn) AS chat
  FROM looped GROUP BY conv_id)"""


@query(
    "chat_render",
    f"""WITH messages AS (SELECT * FROM conversations), {SQL_CHAT}
    SELECT conv_id, n_turns::BIGINT AS n_turns, chat FROM chats WHERE reject_reason IS NULL""",
)
def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch.accepted(chat.render_conversations(conversations(spark, sf_dir)))


# Chats without their system message; every fifth one begins with a marker of its own.
OWN_MARK = "<<SYS>> mine "
SQL_DEFAULT = DEFAULT_SYSTEM_PROMPT.replace("'", "''").replace("\n", "' || chr(10) || '")
SQL_PROMPTED = f"""numbered AS (
  SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, text
  FROM conversations WHERE role <> 'system'),
messages AS (
  SELECT conv_id, role, turn, CASE WHEN turn > 0 THEN text WHEN conv_id % 5 = 0 THEN '{OWN_MARK}' || text
    ELSE '<<SYS>>' || chr(10) || '{SQL_DEFAULT}' || chr(10) || '<</SYS>>' || chr(10) || chr(10) || text END AS text
  FROM numbered)"""


@query(
    "chat_default_prompt",
    f"""WITH {SQL_PROMPTED}, {SQL_CHAT}
    SELECT form, conv_id, md5(chat) AS chat_md5
    FROM chats CROSS JOIN (VALUES ('rows'), ('array')) t(form) WHERE reject_reason IS NULL""",
)
def chat_default_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default system message, from message rows and from arrays of messages."""
    messages = conversations(spark, sf_dir).where("role <> 'system'")
    slab = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    whole = messages.groupBy("conv_id").agg(slab.alias("m"))
    first = F.concat(F.when(F.col("conv_id") % 5 == 0, F.lit(OWN_MARK)).otherwise(F.lit("")), "text")
    rows = whole.select("conv_id", F.posexplode("m").alias("turn", "m")).select(
        "conv_id", "turn", "m.role", "m.text"
    )
    rows = rows.withColumn("text", F.when(F.col("turn") == 0, first).otherwise(F.col("text")))
    by_rows = dispatch.accepted(chat.render_conversations(rows, use_default_system_prompt=True))
    message = F.struct("turn", "role", F.col("text").alias("content"))
    arrays = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"))
    text, reason = chat.render_messages(F.col("m"), use_default_system_prompt=True)
    by_array = arrays.select("conv_id", text.alias("chat"), reason.alias("reason")).where("reason IS NULL")
    return by_rows.select(F.lit("rows").alias("form"), "conv_id", F.md5("chat").alias("chat_md5")).unionByName(
        by_array.select(F.lit("array").alias("form"), "conv_id", F.md5("chat").alias("chat_md5"))
    )


# The given chats are all in order, so faults are put in: a lost turn, and two user turns in a row.
SQL_FAULTY = """messages AS (
  SELECT conv_id, CASE WHEN conv_id % 3 = 1 AND turn >= 2 THEN turn + 1 ELSE turn END AS turn,
         CASE WHEN conv_id % 3 = 0 AND turn = 1 THEN 'user' ELSE role END AS role, text
  FROM conversations)"""


@query(
    "chat_rejects",
    f"""WITH {SQL_FAULTY}, {SQL_CHAT}
    SELECT conv_id, n_turns::BIGINT AS n_turns, reject_reason FROM chats
    WHERE reject_reason IS NOT NULL""",
)
def chat_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    third, turn = F.col("conv_id") % 3, F.col("turn")
    faulty = conversations(spark, sf_dir).select(
        "conv_id",
        F.when((third == 1) & (turn >= 2), turn + 1).otherwise(turn).alias("turn"),
        F.when((third == 0) & (turn == 1), "user").otherwise(F.col("role")).alias("role"),
        "text",
    )
    return dispatch.rejects(chat.render_conversations(faulty)).drop("chat")


# Documents read as message lists: one message per line, users first. In every fifth document
# the first line is the system message, and in every seventh the third line is the user's too.
SQL_MESSAGES = """lines AS (
  SELECT doc_id AS conv_id, i, line, doc_id % 5 = 0 AS has_system, doc_id % 7 = 0 AS faulty
  FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i,
               unnest(string_split(text, chr(10))) AS line FROM documents)),
messages AS (
  SELECT conv_id, i AS turn, line AS text,
         CASE WHEN has_system AND i = 0 THEN 'system'
              WHEN (i - has_system::INT) % 2 = 0 OR (faulty AND i = 3) THEN 'user'
              ELSE 'assistant' END AS role FROM lines)"""


@query(
    "chat_messages",
    f"""WITH {SQL_MESSAGES}, {SQL_CHAT}
    SELECT conv_id AS doc_id, CASE WHEN reject_reason IS NULL THEN md5(chat) END AS chat_md5,
           reject_reason FROM chats
    UNION ALL  -- a system message alone: nothing is left to loop over
    SELECT conv_id, md5(''), NULL FROM messages GROUP BY conv_id
    HAVING count(*) = 1 AND any_value(role) = 'system'""",
)
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    has_system = (F.col("doc_id") % 5 == 0).cast("int")
    faulty = F.col("doc_id") % 7 == 0

    def message(line, i):
        user = ((i - has_system) % 2 == 0) | (faulty & (i == 3))
        role = F.when((has_system == 1) & (i == 0), "system").when(user, "user")
        return F.struct(
            F.coalesce(role, F.lit("assistant")).alias("role"), line.alias("content")
        )

    rows = documents(spark, sf_dir).select(
        "doc_id", F.transform(F.split("text", "\n"), message).alias("messages")
    )
    text, reason = chat.render_messages(F.col("messages"))
    return rows.select("doc_id", F.md5(text).alias("chat_md5"), reason.alias("reject_reason"))
