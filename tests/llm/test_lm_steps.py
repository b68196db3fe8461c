"""Steps of the language model that must not depend on how its input is cut."""

import numpy as np
import pyarrow as pa
import pytest

from grainmill.llm import lm

WORDS = [["the", "river", "zürich"], ["river", "x" * 40, "the"], [], ["a\u00a0b", "the", "été"], ["river", "a\u00a0b"]]


@pytest.mark.parametrize("at_once", [7, 1 << 20])
def test_cells_are_counted_with_what_is_there(monkeypatch, at_once):
    monkeypatch.setattr(lm, "COUNT_CELLS", at_once)
    cells = np.random.default_rng(1).integers(0, 50, 1000)
    table = np.ones(50, dtype=np.int32)
    lm.add_cells(table, cells)
    lm.add_cells(table, cells[:0])
    assert table.tolist() == (np.bincount(cells, minlength=50) + 1).tolist()


@pytest.mark.parametrize("limit", [0, 4, 100])
def test_words_are_remembered_with_their_ids(monkeypatch, limit):
    monkeypatch.setattr(lm, "REMEMBERED", limit)
    known = lm.Subwords(lm.tokenizer_path(lm.TOKENIZER))
    encode, asked = known.of, []
    known.of = lambda words: asked.extend(words.to_pylist()) or encode(words)
    for words in WORDS:
        ends, ids = known.remembered(pa.array(words, pa.string()))
        each = [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
        assert each == [known.encoder.encode_ordinary(" " + w) for w in words]
        assert len(known.words) <= limit and known.ends[-1] == len(known.ids)
    if limit == 100:
        assert len(asked) == len(set(asked))
