"""The language model learns from all training documents, not from the first sample alone."""

import numpy as np
import pytest

from grainmill.llm import attention, lm
from tests.llm import odd


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(["alpha beta"] * 20) if i < 60 else " ".join(["Zürich river"] * 20)) for i in range(120)]
    rows = [(i, t, "en", "a", len(t), 1, "k", 2, 3, 4, 5, 0.5) for i, t in rows]
    return spark.createDataFrame(rows, odd.SCHEMA).repartition(3).cache()


def test_words_outside_the_sample_have_vectors_and_classes(spark, docs, monkeypatch):
    seen = {}
    build = attention.Model.__init__

    def keep(self, vocabulary, prior, weights):
        seen.update(vocabulary=vocabulary, weights=weights)
        build(self, vocabulary, prior, weights)

    monkeypatch.setattr(attention.Model, "__init__", keep)
    assert lm.score_texts(docs, sample_docs=1, steps=3).count() == 120
    for word in ("alpha", "beta", "Zürich", "river"):
        ids = lm.subwords(lm.tokenizer_path(lm.TOKENIZER)).encoder.encode(" " + word.replace("Z", "z"))
        assert np.abs(seen["vocabulary"].vectors[ids]).max(axis=1).min() > 0


def test_neighbours():
    before, after = attention.neighbours(np.array([0, 2, 2, 3]), np.array([5, 6, 7]), 8, 9)
    assert before.tolist() == [9, 5, 6, 9, 9, 7] and after.tolist() == [5, 6, 8, 8, 7, 8]
