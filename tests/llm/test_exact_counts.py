"""Token ids against the tokenizer itself, and window counts of texts with very many words."""

import random

import pyarrow as pa
from tokenizers import Tokenizer

from grainmill.llm import docstats, packing

RUN = random.Random(4)
# Letters that the normaliser turns into a letter and a mark are among these.
LETTERS = "İ.,!?*$%&#:;()-ab ééक़אשׁ̇ßΣσς'sAZÜ<|>×ʰ漢가가 İÅ\nﬁǅ"


def different(texts):
    path = packing.tokenizer_path()
    ends, ids = packing.WordIds(path).of(pa.array(texts))
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    return [x for x, w, a, b in zip(texts, want, ends, ends[1:]) if w.ids != ids[a:b].tolist()]


def test_ids_of_random_strings():
    assert different(["".join(RUN.choices(LETTERS, k=RUN.randint(1, 14))) for _ in range(20000)]) == []


def test_every_character_before_a_mark():
    chars = [chr(c) for c in range(0x20, 0x20000) if not 0xD800 <= c < 0xE000]
    assert different([c + "!?x" for c in chars] + ["a" + c + ".!" for c in chars]) == []


def test_repeats_among_more_than_two_million_different_words():
    many = " ".join(map(str, range(2_200_000)))
    counts = docstats.text_counts(pa.array([many + " 5 6 7", "a b c x a b c"]))
    assert counts["n_repeat_words"].tolist() == [6, 6]
