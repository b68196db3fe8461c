"""Templates, preference pairs and source unification on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from grainmill.operators import templates as T
from grainmill.plans import prepare


def plain(i, o):
    return f"### Instruction:\n{i}\n\n### System:\n{o}</s>"


def records(spark, *rows):
    return spark.createDataFrame(list(rows), T.INSTRUCTION_SCHEMA)


def rendered(df):
    cols = ["turn", "text", "answer", "reject_reason"]
    return [tuple(r) for r in T.render_instructions(df).select(cols).orderBy("turn").collect()]


def test_input_rows_ignore_history(spark):
    got = rendered(records(spark, ("i", "extra", "o", [["u", "r"]])))
    text = "### Instruction:\ni\n\n### Input:\nextra\n\n### System:\no</s>"
    assert got == [(0, text, "o</s>", None)]


def test_history_rows(spark):
    got = rendered(records(spark, ("i", "", "o", [["u1", "r1"], ["u2", "r2"]])))
    assert [(t, x, a) for t, x, a, _ in got] == [
        (0, plain("u1", "r1"), "r1</s>"),
        (1, plain("u2", "r2"), "r2</s>"),
        (2, plain("i", "o"), "o</s>"),
    ]


@pytest.mark.parametrize("history", [None, []])
def test_no_input_no_history(spark, history):
    assert rendered(records(spark, ("i", None, "o", history)))[0][1] == plain("i", "o")


def test_turn_separator_in_the_text_is_just_text(spark):
    got = rendered(records(spark, ("i", "", "a[multiturn_sep]b", [])))
    assert len(got) == 1 and got[0][2] == "a[multiturn_sep]b</s>"


def test_missing_output_is_rejected(spark):
    assert rendered(records(spark, ("i", "", None, [])))[0][3] == "missing part"


def test_preference_pairs(spark):
    df = spark.createDataFrame([("q", "good", "bad", 7)], "question string, response_j string, "
                               "response_k string, other int")
    row = prepare.preference(df).first()
    assert row.asDict() == {
        "other": 7, "prompt": "### Instruction: q\n\n### System: \n", "chosen": "good",
        "rejected": "bad",
    }


@pytest.mark.parametrize(
    "pair, kept", [(("abc", "de", "fgh"), 0), (("abc", "de", "f"), 1), (("abc", "fgh", "d"), 0)]
)
def test_pair_length_filter(spark, pair, kept):
    df = spark.createDataFrame([pair], "prompt string, chosen string, rejected string")
    assert T.filter_pair_length(df, 5).count() == kept


def messages(spark, convs):
    rows = [(c, t, r, x) for c, msgs in convs.items() for t, (r, x) in enumerate(msgs)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def random_conversations(n, longest, seed=3):
    import random

    rng = random.Random(seed)
    roles = ["user", "assistant", "system"]
    return {
        c: [(rng.choice(roles), f"{c}-{t}") for t in range(rng.randint(1, longest))]
        for c in range(n)
    }


@pytest.mark.parametrize("slab", [1, 2, 5, 256])
def test_pairs_do_not_depend_on_slabs(spark, slab):
    convs = random_conversations(30, 20)
    want = sorted(
        (c, t, a[1], b[1])
        for c, m in convs.items()
        for t, (a, b) in enumerate(zip(m, m[1:]))
        if a[0] == "user" and b[0] == "assistant"
    )
    got = T.pair_turns(messages(spark, convs), slab).select("conv_id", "turn", "user", "reply")
    assert sorted(map(tuple, got.collect())) == want


def test_conversation_turns_equal_records(spark):
    """Rendering message rows gives what rendering records with history arrays gives."""
    convs = {
        1: [("user", "u1"), ("assistant", "r1"), ("user", "u2"), ("assistant", "r2")],
        2: [("system", "s"), ("user", "u1"), ("assistant", "r1"), ("user", "u2"),
            ("assistant", "r2")],
        3: [("user", "u1"), ("user", "u2"), ("assistant", "r2"), ("user", "left")],
        4: [("user", "alone")],
    }
    recs = [
        (1, "u2", "", "r2", [["u1", "r1"]]),
        (2, "u2", "s", "r2", [["u1", "r1"]]),
        (3, "u2", "", "r2", []),
    ]
    schema = "conv_id bigint, instruction string, input string, output string, " \
             "history array<array<string>>"
    want = T.render_instructions(spark.createDataFrame(recs, schema)).orderBy("conv_id", "turn")
    got = T.render_conversation_turns(messages(spark, convs)).orderBy("conv_id", "turn")
    cols = ["conv_id", "text", "answer"]
    assert got.select(cols).collect() == want.select(cols).collect()


def test_unify_text(spark):
    n = dict.fromkeys(T.SOURCE_COLUMNS)
    rows = [
        {**n, "uniqueKey": "k", "title": "t", "content": "c", "text": "x", "meta": "m"},
        {**n, "text": "x", "meta": "m"},
        {**n, "basic_info": "b", "title": "t", "main_content": ""},
        {**n, "basic_info": "b", "main_content": ""},
        {**n, "channel": "c", "type": "y", "text": "x"},
        {**n, "channel": "c", "type": "y"},
        {**n, "singer": "s", "title": "t", "text": "x"},
        {**n, "author": "a", "title": "t", "text": "x"},
        {**n, "text": "x", "type": "y"},
        {**n, "text": "x"},
        {**n, "uniqueKey": "k", "title": "t"},
    ]
    schema = "id int, " + ", ".join(f"{c} string" for c in T.SOURCE_COLUMNS)
    data = [(i, *[r[c] for c in T.SOURCE_COLUMNS]) for i, r in enumerate(rows)]
    got = T.unify_text(spark.createDataFrame(data, schema)).orderBy("id").collect()
    assert [(r.rule, r.text, r.reject_reason) for r in got] == [
        ("titled", "t\nc", None),
        ("plain", "x", None),
        ("encyclopedia", "t\n", None),
        ("encyclopedia", "百度百科", None),
        ("news", "\nx", None),
        ("news", "新闻", None),
        ("lyrics", "t\nx", None),
        ("poem", "t\nx", None),
        ("couplet", "x", None),
        (None, None, "unrecognised format"),
        ("titled", None, "missing part"),
    ]


def test_answer_rows(spark):
    from grainmill import PrepConfig
    from grainmill.functions.text import code_points

    cfg = PrepConfig(mode="instruct", seq_length=5)
    df = spark.createDataFrame([("abcd", "cd"), ("abcdefgh", "h")], "text string, answer string")
    a, b = prepare.answer_rows(df, cfg, code_points).orderBy(F.desc("n_loss_tokens")).collect()
    assert a.input_ids == [101, 102, 103, 104, 3] and a.labels == [-100, -100, 103, 104, -100]
    assert a.attention_mask == [1, 1, 1, 1, 0] and a.n_loss_tokens == 2
    assert b.labels == [-100] * 5 and b.attention_mask == [1] * 5 and b.n_loss_tokens == 0
