"""Bring source rows to one text column, and render instruction and preference rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from grainmill.constants import BLANK_ENCYCLOPEDIA_TEXT, BLANK_NEWS_TEXT
from grainmill.functions.text import instruct_input_sample, instruct_sample, preference_prompt

# All columns that any of the historic source layouts has; a row fills some of them.
SOURCE_COLUMNS = [
    "uniqueKey", "title", "content", "text", "meta", "basic_info", "main_content",
    "channel", "type", "singer", "author",
]

INSTRUCTION_SCHEMA = T.StructType(
    [
        T.StructField("instruction", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("history", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)
PREFERENCE_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("question", "response_j", "response_k")]
)


def _titled(body: str) -> Column:
    """Title, line break, body; null when either is missing."""
    return F.concat(F.col("title"), F.lit("\n"), F.col(body))


def _titled_or(body: str, default: str) -> Column:
    """Like ``_titled`` with missing parts left blank; a default when both are blank."""
    title = F.coalesce("title", F.lit(""))
    rest = F.coalesce(body, F.lit(""))
    both_blank = (title == "") & (rest == "")
    return F.when(both_blank, F.lit(default)).otherwise(F.concat(title, F.lit("\n"), rest))


def unify_text(df: DataFrame) -> DataFrame:
    """One ``text`` per row from any of seven source layouts; the first matching rule wins.

    Adds ``rule`` and ``reject_reason`` (null for a good row). A column is missing from a row
    when it is null.
    """
    for name in SOURCE_COLUMNS:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))

    def has(*names: str) -> Column:
        cond = F.lit(True)
        for n in names:
            cond = cond & F.col(n).isNotNull()
        return cond

    rules = [
        ("titled", has("uniqueKey"), _titled("content")),
        ("plain", has("text", "meta"), F.col("text")),
        ("encyclopedia", has("basic_info", "main_content"),
         _titled_or("main_content", BLANK_ENCYCLOPEDIA_TEXT)),
        ("news", has("channel", "type"), _titled_or("text", BLANK_NEWS_TEXT)),
        ("lyrics", has("singer"), _titled("text")),
        ("poem", has("author"), _titled("text")),
        ("couplet", has("text", "type"), F.col("text")),
    ]
    rule = F.lit(None).cast("string")
    text = F.lit(None).cast("string")
    for name, cond, value in reversed(rules):
        rule = F.when(cond, F.lit(name)).otherwise(rule)
        text = F.when(cond, value).otherwise(text)
    reason = F.when(F.col("rule").isNull(), "unrecognised format").when(
        F.col("unified").isNull(), "missing part"
    )
    kept = [c for c in df.columns if c not in SOURCE_COLUMNS]
    return (
        df.select(*kept, rule.alias("rule"), text.alias("unified"))
        .withColumn("reject_reason", reason)
        .withColumnRenamed("unified", "text")
    )


def render_instructions(df: DataFrame) -> DataFrame:
    """One row per exchange of an instruction record: ``turn``, ``text``, ``answer``.

    A record with extra input gives one row and its history is not used; otherwise each past
    exchange and the current one give a row. Rows carry no earlier turns. Records without an
    output give one row with a ``reject_reason``. Other columns are passed through.
    """
    has_input = F.coalesce("input", F.lit("")) != ""
    current = instruct_sample(F.col("instruction"), F.col("output"))
    past = F.transform(
        F.coalesce("history", F.array().cast("array<array<string>>")),
        lambda pair: instruct_sample(pair[0], pair[1]),
    )
    with_input = instruct_input_sample(F.col("instruction"), F.col("input"), F.col("output"))
    samples = F.when(has_input, F.array(with_input)).otherwise(
        F.concat(past, F.array(current))
    )
    kept = [c for c in df.columns if c not in INSTRUCTION_SCHEMA.names]
    return (
        df.select(*kept, F.posexplode(samples).alias("turn", "sample"))
        .select(*kept, "turn", "sample.text", "sample.answer")
        .withColumn("reject_reason", F.when(F.col("text").isNull(), "missing part"))
    )


PAIR_SLAB = 256


def pair_turns(df: DataFrame, slab: int = PAIR_SLAB) -> DataFrame:
    """Each user turn with the assistant turn right after it: ``turn, user, reply``.

    ``turn`` is the index of a message in its conversation. The window runs over slabs of
    ``slab`` turns, so one very long conversation is spread over many tasks; the first turn
    of a slab is also seen, as a look-ahead row, by the slab before it.
    """
    own = F.floor(F.col("turn") / slab)
    looked_at = F.when(
        (F.col("turn") % slab == 0) & (F.col("turn") > 0), F.array(own, own - 1)
    ).otherwise(F.array(own))
    ahead = W.partitionBy("conv_id", "_slab").orderBy("turn")
    return (
        df.select("conv_id", "turn", "role", "text", F.explode(looked_at).alias("_slab"))
        .withColumn("_next", F.lead(F.struct("turn", "role", "text")).over(ahead))
        .filter(
            (own == F.col("_slab"))
            & (F.col("role") == "user")
            & (F.col("_next.role") == "assistant")
            & (F.col("_next.turn") == F.col("turn") + 1)
        )
        .select(
            "conv_id", "turn", F.col("text").alias("user"), F.col("_next.text").alias("reply")
        )
    )


def conversation_summary(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per conversation: the last pair's turn and the system text (null without one).

    Both are aggregates that are combined before the shuffle, so a hot conversation is cheap.
    """
    system = (
        df.filter(F.col("role") == "system")
        .groupBy("conv_id")
        .agg(F.min_by("text", "turn").alias("system"))
    )
    last = pairs.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    return last.join(system, "conv_id", "left")


def render_conversation_turns(df: DataFrame) -> DataFrame:
    """Instruction samples straight from message rows: ``conv_id, turn, text, answer``.

    Same result as ``render_instructions`` on records whose history is the earlier pairs and
    whose input is the system text, without ever building a record's history array.
    """
    pairs = pair_turns(df)
    rows = pairs.join(conversation_summary(df, pairs), "conv_id")
    has_input = F.coalesce("system", F.lit("")) != ""
    sample = F.when(
        has_input, instruct_input_sample(F.col("user"), F.col("system"), F.col("reply"))
    ).otherwise(instruct_sample(F.col("user"), F.col("reply")))
    return (
        rows.filter(~has_input | (F.col("turn") == F.col("last_turn")))
        .select("conv_id", "turn", sample.alias("sample"))
        .select("conv_id", "turn", "sample.text", "sample.answer")
    )


def preference_records(df: DataFrame) -> DataFrame:
    """Preference rows from conversations with at least two pairs: the first reply to the
    first question is taken as better than the last reply. Aggregates only."""
    return (
        pair_turns(df)
        .groupBy("conv_id")
        .agg(
            F.count(F.lit(1)).alias("n_pairs"),
            F.min_by("user", "turn").alias("question"),
            F.min_by("reply", "turn").alias("response_j"),
            F.max_by("reply", "turn").alias("response_k"),
        )
        .filter(F.col("n_pairs") >= 2)
        .drop("n_pairs")
    )


def preference_pairs(df: DataFrame) -> DataFrame:
    """``prompt, chosen, rejected`` in place of the question and its two answers."""
    kept = [c for c in df.columns if c not in PREFERENCE_SCHEMA.names]
    return df.select(
        *kept,
        preference_prompt(F.col("question")).alias("prompt"),
        F.col("response_j").alias("chosen"),
        F.col("response_k").alias("rejected"),
    )


def filter_pair_length(df: DataFrame, max_length: int) -> DataFrame:
    """Keep pairs whose prompt plus either answer has at most ``max_length`` characters."""
    longer = F.greatest(F.length("chosen"), F.length("rejected"))
    return df.filter(F.length("prompt") + longer <= max_length)
