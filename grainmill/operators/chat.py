"""Chat rendering: messages to one marked-up string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.constants import B_INST, B_SYS, BOS, DEFAULT_SYSTEM_PROMPT, E_INST, E_SYS, EOS
from grainmill.functions.text import strip

SLAB = 256


def _system_block(text: Column) -> Column:
    return F.concat(F.lit(B_SYS), text, F.lit(E_SYS))


NO_CONTENT = "missing content"


def render_message(role: Column, content: Column) -> Column:
    """One message with its markers. Roles other than the three known ones render to nothing."""
    body = strip(content)
    return (
        F.when(role == "user", F.concat(F.lit(f"{BOS}{B_INST} "), body, F.lit(f" {E_INST}")))
        .when(role == "system", _system_block(body))
        .when(role == "assistant", F.concat(F.lit(" "), body, F.lit(f" {EOS}")))
        .otherwise(F.lit(""))
    )


def render_messages(
    messages: Column, *, use_default_system_prompt: bool = False
) -> tuple[Column, Column]:
    """(rendered text, reject reason) of an ``array<struct<role,content>>``, row by row.

    A leading system message is put in front of the first user message. After it, user and
    other messages must alternate, starting with the user.
    """
    first = F.try_element_at(messages, F.lit(1))
    has_system = F.coalesce(first["role"] == "system", F.lit(False))
    system = F.when(has_system, first["content"])
    if use_default_system_prompt:
        unmarked = ~F.contains(first["content"], F.lit(B_SYS.strip()))
        system = F.coalesce(system, F.when(unmarked, F.lit(DEFAULT_SYSTEM_PROMPT)))
    loop = F.when(has_system, F.slice(messages, F.lit(2), F.size(messages))).otherwise(messages)
    misplaced = F.exists(
        F.transform(loop, lambda m, i: (m["role"] == "user") != (i % 2 == 0)), lambda bad: bad
    )
    rendered = F.transform(
        loop,
        lambda m, i: render_message(
            m["role"],
            F.when(
                (i == 0) & system.isNotNull(), F.concat(_system_block(system), m["content"])
            ).otherwise(m["content"]),
        ),
    )
    missing = F.exists(messages, lambda m: m["content"].isNull())
    reason = F.when(misplaced, F.lit("roles do not alternate")).when(missing, F.lit(NO_CONTENT))
    return F.when(reason.isNull(), F.array_join(rendered, "")), reason


def render_conversations(
    df: DataFrame, slab: int = SLAB, *, use_default_system_prompt: bool = False
) -> DataFrame:
    """``conv_id, n_turns, chat, reject_reason`` from message rows (conv_id, turn, role, text).

    ``turn`` is the message index, so role alternation is a sum over rows instead of a window,
    and slabs of ``slab`` turns are rendered on their own before a conversation's few slab
    strings are put together. ``slab`` must be at least 2, so that a leading system message
    and the first user message are in the same slab. With ``use_default_system_prompt`` a chat
    without a system message, whose first message does not hold the marker of one, gets the
    default one.
    """
    is_user = F.coalesce(F.col("role") == "user", F.lit(False))
    even = F.col("turn") % 2 == 0
    leads = (F.col("turn") == 0) & (F.col("role") == "system")
    slabs = (
        df.groupBy("conv_id", F.floor(F.col("turn") / slab).alias("slab"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("turn").alias("last"),
            F.max(leads.cast("int")).alias("has_system"),
            F.sum(F.col("text").isNull().cast("int")).alias("no_text"),
            # Misplaced roles if the loop starts at message 0, and if it starts at 1.
            F.sum((is_user != even).cast("int")).alias("bad_plain"),
            F.sum(((is_user == even) & ~leads).cast("int")).alias("bad_system"),
            F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("msgs"),
        )
        .withColumn(
            "part",
            _slab_text(
                F.col("msgs"), F.col("has_system") == 1,
                (F.col("slab") == 0) & F.lit(use_default_system_prompt),
            ),
        )
    )
    joined = slabs.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.max("last").alias("last"),
        F.max("has_system").alias("has_system"),
        F.sum("no_text").alias("no_text"),
        F.sum("bad_plain").alias("bad_plain"),
        F.sum("bad_system").alias("bad_system"),
        F.array_sort(F.collect_list(F.struct("slab", "part"))).alias("parts"),
    )
    misplaced = F.when(F.col("has_system") == 1, F.col("bad_system")).otherwise(
        F.col("bad_plain")
    )
    reason = F.when(F.col("last") + 1 != F.col("n_turns"), "missing turn").when(
        misplaced > 0, "roles do not alternate"
    ).when(F.col("no_text") > 0, NO_CONTENT)
    chat = F.array_join(F.col("parts")["part"], "")
    return joined.select(
        "conv_id",
        "n_turns",
        F.when(reason.isNull(), chat).alias("chat"),
        reason.alias("reject_reason"),
    )


def _slab_text(msgs: Column, has_system: Column, may_default: Column) -> Column:
    """Text of one slab; its first message is the system message if ``has_system``."""
    rest = F.when(has_system, F.slice(msgs, F.lit(2), F.size(msgs))).otherwise(msgs)
    unmarked = ~F.contains(msgs[0]["text"], F.lit(B_SYS.strip()))
    system = F.when(has_system, msgs[0]["text"]).when(may_default & unmarked, F.lit(DEFAULT_SYSTEM_PROMPT))
    texts = F.transform(
        rest,
        lambda m, i: render_message(
            m["role"],
            F.when((i == 0) & system.isNotNull(), F.concat(_system_block(system), m["text"])).otherwise(m["text"]),
        ),
    )
    return F.array_join(texts, "")
