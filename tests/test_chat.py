import pytest
from pyspark.sql import functions as F

from grainmill.constants import DEFAULT_SYSTEM_PROMPT
from grainmill.operators import chat
from tests.test_templates import messages, random_conversations


def loop_chat(msgs, default=False):
    """(chat, reason) of a list of (role, content)."""
    system = None
    if msgs and msgs[0][0] == "system":
        system, msgs = msgs[0][1], msgs[1:]
    elif default and msgs and "<<SYS>>" not in msgs[0][1]:
        system = DEFAULT_SYSTEM_PROMPT
    out = ""
    for i, (role, content) in enumerate(msgs):
        if (role == "user") != (i % 2 == 0):
            return None, "roles do not alternate"
        if i == 0 and system is not None:
            content = f"<<SYS>>\n{system}\n<</SYS>>\n\n{content}"
        content = content.strip()
        if role == "user":
            out += f"<s>[INST] {content} [/INST]"
        elif role == "system":
            out += f"<<SYS>>\n{content}\n<</SYS>>\n\n"
        elif role == "assistant":
            out += f" {content} </s>"
    return out, None


CASES = {
    0: [("system", "s"), ("user", "u"), ("assistant", "a")],
    1: [("user", "u"), ("user", "v")],
    2: [("user", " \n u \t"), ("assistant", "\na ")],
    3: [("assistant", "a")],
    4: [("user", "u"), ("system", "late"), ("user", "v")],
    5: [("system", " s "), ("user", "  u"), ("tool", "t"), ("user", "w ")],
    6: [("system", "s")],
    7: [("system", "s"), ("user", "   ")],
    8: [("user", "<<SYS>> u")],
    9: [(None, "u")],
}


def test_expected_text(spark):
    want = "<s>[INST] <<SYS>>\ns\n<</SYS>>\n\nu [/INST] a </s>"
    assert loop_chat(CASES[0]) == (want, None)


@pytest.mark.parametrize("slab", [2, 3, 256])
def test_message_rows(spark, slab):
    convs = {**CASES, **{100 + c: m for c, m in random_conversations(40, 9).items()}}
    long = [("user", "u"), ("assistant", "a")] * 20
    convs[200] = [("system", "s"), *long]
    convs[201] = long
    got = chat.render_conversations(messages(spark, convs), slab).collect()
    assert {r.conv_id: (r.chat, r.reject_reason) for r in got} == {
        c: loop_chat(m) for c, m in convs.items()
    }


@pytest.mark.parametrize("default", [False, True])
def test_message_arrays(spark, default):
    df = spark.createDataFrame(
        list(CASES.items()), "id int, m array<struct<role string, content string>>"
    )
    text, reason = chat.render_messages(F.col("m"), use_default_system_prompt=default)
    got = df.select("id", text.alias("text"), reason.alias("reason")).collect()
    assert {r.id: (r.text, r.reason) for r in got if r.id != 9} == {
        c: loop_chat(m, default) for c, m in CASES.items() if c != 9
    }


def test_a_lost_turn_is_rejected(spark):
    df = messages(spark, {1: [("user", "u"), ("assistant", "a"), ("user", "v")]})
    row = chat.render_conversations(df.filter("turn <> 1")).first()
    assert row.reject_reason == "missing turn" and row.chat is None


def test_missing_content_is_a_reject(spark):
    rows = [("user", "hi"), ("assistant", None), ("user", "bye")]
    messages = spark.createDataFrame([(1, rows)], "id int, messages array<struct<role: string, content: string>>")
    text, reason = chat.render_messages(F.col("messages"))
    got = messages.select(text.alias("text"), reason.alias("reason")).first()
    assert got.text is None and got.reason == "missing content"
    table = spark.createDataFrame(
        [(1, i, r, c) for i, (r, c) in enumerate(rows)], "conv_id long, turn long, role string, text string"
    )
    got = chat.render_conversations(table).first()
    assert got.chat is None and got.reject_reason == "missing content"
