"""Ids of words: encoded many in one text, and kept while the step at hand needs them."""

import pyarrow as pa
from tokenizers import Tokenizer

from grainmill.llm import packing

TEXTS = [
    "The end. the end, it's ÉCOLE's 12 <|endoftext|> x<|startoftext|>y", "<| <<| |> a<b #$% ...",
    "", None, "naïve İstanbul 漢字 😀😀 don't ́̂ ­ ​⁠ x", "école\tÅ̊\r\n",
]


def want(texts):
    library = Tokenizer.from_file(packing.tokenizer_path())
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def got(known, texts):
    ends, ids = known.of(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_words_encoded_together_are_those_of_the_library():
    for joined in (1, 3, 64):
        packing.JOINED_WORDS, before = joined, packing.JOINED_WORDS
        try:
            known = packing.WordIds(packing.tokenizer_path())
            assert got(known, TEXTS) == want(TEXTS)
            known.border = None
            known.forget()
            assert got(known, TEXTS) == want(TEXTS)
        finally:
            packing.JOINED_WORDS = before


def test_a_full_memory_keeps_the_words_of_the_step(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_WORDS", 6)
    known, learnt = packing.WordIds(packing.tokenizer_path()), []
    store = known._encode
    monkeypatch.setattr(known, "_encode", lambda names: learnt.extend(names) or store(names))
    steps = [["red blue green"], ["red blue amber teal"], ["red blue olive ochre"], ["red ochre"]]
    for texts in steps:
        assert got(known, texts) == want(texts)
    assert sorted(learnt) == sorted(set(learnt)) and len(known.slots) <= 6
