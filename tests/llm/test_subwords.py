"""Subword ids, spans, normalised texts and decoded texts against the library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from grainmill.llm import subwords
from tests.llm import odd

RUN = random.Random(2)
LETTERS = "  ▁abethinorsg\n\t漢é𝄞\x00<>sunk.,0İß \xa0"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=subwords.model_path())


def some_texts(n):
    texts = ["".join(RUN.choices(LETTERS, k=RUN.randint(0, 60))) for _ in range(n)]
    return texts + ["", None, " ", "   ", "▁", "▁▁ x", "<s>", "</s> <unk> <0x41>", "a" * 500, "the " * 400]


def test_ids_and_spans(library):
    texts = some_texts(3000)
    upto, ids, begins, ends = subwords.codec(subwords.model_path()).encode(pa.array(texts))
    for k, text in enumerate(texts):
        pieces = library.encode(text or "", return_type="proto").pieces
        raw = (text or "").encode()
        here = slice(upto[k], upto[k + 1])
        got = [(i, raw[a:b]) for i, a, b in zip(ids[here].tolist(), begins[here], ends[here])]
        assert got == [(p.id, p.surface.encode()) for p in pieces], text
        assert b"".join(piece for _, piece in got) == raw


def test_decoded_texts(library):
    codec = subwords.codec(subwords.model_path())
    odd_ids = [0, 1, 2, 35, 233, 191, 165, 258, 259, 260, 29871, 450]
    rows = [
        [RUN.choice([*odd_ids, 3 + RUN.randrange(256), RUN.randrange(32000)]) for _ in range(RUN.randint(0, 8))]
        for _ in range(4000)
    ]
    upto = np.cumsum([0] + [len(r) for r in rows])
    got = codec.decode(upto, np.array([i for r in rows for i in r]))
    assert got.to_pylist() == [library.decode(r) for r in rows]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("fewer", [True, False])
@pytest.mark.parametrize("dummy", [True, False])
def test_character_maps_and_origins(rule, fewer, dummy):
    """Longest prefixes, several characters to one and one to several, and characters that go."""
    library = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=dummy, remove_extra_whitespaces=fewer, escape_whitespaces=True
    )
    normaliser = subwords.Normaliser(subwords.read_model(library.serialized_model_proto()))
    letters = "  ▁abＡＢｶﾞ¨̈é​\xad　ﬁ①㍿\x01\x7f漢ÅÅİßﷺ\ttA"
    texts = ["".join(RUN.choices(letters, k=RUN.randint(0, 12))) for _ in range(1500)]
    texts += ["", " ", "  ", "​", "▁", " ▁ ", "　\x7f"]
    flat, ends = subwords.flat_texts(pa.array(texts))
    normal = normaliser.normalise(flat, ends)
    for k, text in enumerate(texts):
        got = bytes(normal.flat[normal.ends[k] : normal.ends[k + 1]]).decode()
        origin = normal.origin[normal.origin_at[k] :]
        places = np.cumsum([0] + [len(c.encode()) for c in got])
        at = np.cumsum([0] + [len(c.encode()) for c in text]).tolist()
        mine = [at.index(origin[p]) for p in places]
        assert (got, mine) == tuple(library.normalize(text, with_offsets=True)), text


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        # One piece; the kind of model is not stated, so it is not one of merged pairs.
        subwords.read_model(b"\x0a\x03\x0a\x01a")


def test_round_trip_of_odd_documents(spark, library):
    rows = odd.documents() + [(90, t, "en", "a", 1, 1, "k", 2, 3, 4, 5, 0.5) for t in some_texts(200)]
    docs = spark.createDataFrame(rows, odd.SCHEMA).repartition(4)

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = []
    for doc, text, *_ in rows:
        ids = library.encode(text or "")
        size = len((text or "").encode())
        want.append((doc, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else ""), size))
    got = [tuple(r) for r in subwords.round_trip(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert subwords.round_trip(docs.limit(0)).collect() == []


def test_null_ids_decode_to_null(spark, library):
    rows = spark.createDataFrame([([450, 259],), (None,), ([],)], "ids array<int>")
    got = [r[0] for r in rows.select(subwords.decoder()("ids")).collect()]
    assert got == [library.decode([450, 259]), None, ""]
