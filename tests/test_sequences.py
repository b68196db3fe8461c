"""Hand-made rows for the per-row functions."""

import pytest
from pyspark.sql import functions as F

from grainmill.functions import sequences as S
from grainmill.functions.text import code_points, source_tag, strip, text_points, words


def value(spark, column, **cols):
    """The column's value on one row; lists become int arrays."""
    row = spark.range(1)
    for name, v in cols.items():
        lit = F.array(*[F.lit(x) for x in v]).cast("array<int>") if isinstance(v, list) else F.lit(v)
        row = row.withColumn(name, lit)
    return row.select(column).first()[0]


@pytest.mark.parametrize(
    "ids, padded, mask",
    [([5, 6], [5, 6, 3, 3], [1, 1, 0, 0]), ([5, 6, 7, 8, 9], [5, 6, 7, 8], [1, 1, 1, 1])],
)
def test_truncate_pad_mask(spark, ids, padded, mask):
    x = F.col("x")
    assert value(spark, S.pad_to(S.truncate(x, 4), 4), x=ids) == padded
    assert value(spark, S.attention_mask(F.size(x), 4), x=ids) == mask


def test_padding_leaves_long_rows_alone(spark):
    assert value(spark, S.pad_to(F.col("x"), 2), x=[5, 6, 7]) == [5, 6, 7]


@pytest.mark.parametrize(
    "ids, want", [([5, 6], [5, 2]), ([5, 6, 7, 3], [5, 6, 7, 2]), ([5, 6, 7, 2], [5, 6, 7, 2])]
)
def test_sample_window_short(spark, ids, want):
    assert value(spark, S.sample_window(F.col("x"), 4, 42, F.lit(1)), x=ids) == want


def test_sample_window_of_nothing_is_nothing(spark):
    assert value(spark, S.sample_window(F.col("x"), 4, 42, F.lit(1)), x=[]) == []


def test_sample_window_long(spark):
    ids = F.sequence(F.lit(10), F.lit(19))
    rows = spark.range(4000).select(
        S.sample_window(ids, 4, 42, F.col("id")).alias("w"),
        S.sample_start(F.lit(10), 4, 42, F.col("id")).alias("s"),
    )
    got = rows.collect()
    assert all(r.w == [10 + r.s, 11 + r.s, 12 + r.s, 2] for r in got)
    assert {r.s for r in got} == set(range(7))
    at_front = sum(r.s == 0 for r in got) / len(got)
    assert abs(at_front - (1 / 4 + 3 / 4 / 7)) < 0.03
    assert got == rows.repartition(3).sort("s").collect() or sorted(got) == sorted(
        rows.repartition(3).collect()
    )


def test_labels(spark):
    x = F.col("x")
    assert value(spark, S.pretrain_labels(x), x=[5, 6, 3, 3]) == [5, 6, -100, -100]
    assert value(spark, S.pretrain_labels(x), x=[5, 6]) == [5, 6]
    labels = S.answer_labels(x, F.lit(2), F.lit(4))
    assert value(spark, labels, x=[5, 6, 7, 2, 3]) == [-100, -100, 7, 2, -100]
    all_source = S.answer_labels(x, F.lit(3), F.lit(3))
    assert value(spark, all_source, x=[5, 6, 7]) == [-100, -100, -100]


def test_shifted_targets(spark):
    x = F.col("x")
    assert value(spark, S.shifted_targets(x), x=[-100, 6, 7, -100]) == [6, 7, -100]
    assert value(spark, S.n_loss_tokens(S.shifted_targets(x)), x=[-100, 6, 7, -100]) == 2
    assert value(spark, S.shifted_targets(x), x=[]) == []


def test_position_ids(spark):
    x = F.col("x")
    assert value(spark, S.position_ids(x), x=[1, 1, 0, 0]) == [0, 1, 1, 1]
    assert value(spark, S.right_padded_position_ids(x), x=[1, 1, 0, 0]) == [0, 1, 1, 1]
    assert value(spark, S.position_ids(x), x=[0, 0, 1, 1, 0, 1]) == [1, 1, 0, 1, 1, 2]


@pytest.mark.parametrize("ids, want", [([5, 6, 3, 3], 1), ([5, 6, 7], -1), ([3, 3], -1)])
def test_last_token_index(spark, ids, want):
    assert value(spark, S.last_token_index(F.col("x")), x=ids) == want


def test_special_tokens(spark):
    a, b = F.col("a"), F.col("b")
    both = {"a": [5, 6], "b": [7]}
    on = {"bos": True, "eos": True}
    assert value(spark, S.add_special_tokens(a, b, **on), **both) == [1, 5, 6, 2, 1, 7, 2]
    assert value(spark, S.special_tokens_mask(a, b, **on), **both) == [1, 0, 0, 1, 1, 0, 1]
    assert value(spark, S.segment_ids(a, b, **on), **both) == [0, 0, 0, 0, 1, 1, 1]
    assert value(spark, S.add_special_tokens(a, b), **both) == [5, 6, 7]
    assert value(spark, S.special_tokens_mask(a), **both) == [0, 0]
    assert value(spark, S.segment_ids(a), **both) == [0, 0]
    assert value(spark, S.ready_special_tokens_mask(a), a=[1, 5, 2, 3, 0]) == [1, 0, 1, 1, 1]


def test_code_points(spark):
    assert value(spark, code_points(F.col("t")), t="aé😀") == [97 + 4, 0xE9 + 4, 0x1F600 + 4]
    assert value(spark, code_points(F.col("t")), t="") == []


def test_text_points_are_code_points(spark):
    texts = ["aé😀", "", None, "line\nline\x00", "漢" * 3000, " "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    got = rows.select("t", code_points(F.col("t")).alias("a"), text_points(F.col("t")).alias("b")).collect()
    assert len(got) == len(texts) and all(r.a == r.b for r in got)


def test_words_strip_and_source(spark):
    assert value(spark, words(F.col("t")), t=" a\n\nb\tc ") == ["a", "b", "c"]
    text = " \n a b \x1f \n"
    assert value(spark, strip(F.col("t")), t=text) == text.strip()
    assert value(spark, source_tag(F.col("t")), t="d/part-wiki-01.jsonl") == "wiki"
    assert value(spark, source_tag(F.col("t")), t="nothing.jsonl") is None
