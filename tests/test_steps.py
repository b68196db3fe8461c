"""Arrow steps yield what they make part by part, so a task never holds all that a batch gives."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainmill.functions import sequences, steps, text
from grainmill.operators import bpe, vocab
from tests.test_tokens import table

TEXTS = ["the inner and the", None, "", "漢é </s> 😀", "grand " * 40, "a"] * 50


def parts(function, column):
    """What the function yields for one batch, and for the batch in parts of one row."""
    many = list(function(iter([column])))
    alone = list(function(iter([column[i : i + 1] for i in range(len(column))])))
    assert pa.concat_arrays(many).to_pylist() == pa.concat_arrays(alone).to_pylist()
    return many


@pytest.fixture
def small(monkeypatch):
    for step, limit in ((steps.text_steps, 500), (steps.list_steps, 500)):
        monkeypatch.setattr(step, "__defaults__", (limit,))


def test_code_points_by_steps(small):
    made = parts(text.points_by_steps, pa.array(TEXTS))
    assert len(made) > 5 and max(len(p.flatten()) for p in made) < 1000
    want = [[ord(c) + 4 for c in t or ""] for t in TEXTS]
    assert pa.concat_arrays(made).to_pylist() == want


def test_positions_by_steps(small):
    masks = [[1, 1, 0], None, [], [0, 1, 1]] * 300
    made = parts(sequences.positions_by_steps, pa.array(masks, pa.list_(pa.int32())))
    assert len(made) > 3
    assert pa.concat_arrays(made).to_pylist() == [[0, 1, 1], None, [], [1, 0, 1]] * 300


def test_subwords_by_steps(spark, small):
    made = parts(bpe.bpe_encoder(spark, table()).func, pa.array(TEXTS))
    assert len(made) > 5
    back = parts(bpe.bpe_decoder(spark, table()).func, pa.concat_arrays(made))
    assert len(back) > 5 and pa.concat_arrays(back).to_pylist() == TEXTS


def test_lookup_by_steps(spark, small):
    pieces = pa.array([None if t is None else t.split() for t in TEXTS])
    ids = parts(vocab.piece_ids(spark, table()).func, pieces)
    assert len(ids) > 3
    found = parts(vocab.id_pieces(spark, table()).func, pa.concat_arrays(ids))
    assert len(found) > 3
    known = {p for _, p, _ in table()}
    want = [None if t is None else [w if w in known else "<unk>" for w in t.split()] for t in TEXTS]
    assert pa.concat_arrays(found).to_pylist() == want


def test_no_rows_and_a_batch_without_any(spark):
    made = spark.createDataFrame([], "t string").select(text.text_points(F.col("t")).alias("x"))
    assert made.collect() == []
    assert list(text.points_by_steps(iter([pa.array([], pa.string())]))) == []
