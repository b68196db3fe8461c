"""Vocabularies and subwords, against a plain merge loop."""

import pickle
import random
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from grainmill.constants import META_SPACE
from grainmill.operators import bpe, vocab

PIECES = [
    "th", "he", "the", "▁t", "▁the", "in", "ing", "er", "▁a", "an", "and", "aa", "▁▁", "aaaa",
    "▁", "t", "h", "e", "i", "n", "g", "r", "a", "d", "é",
]


def table(pieces=PIECES):
    rows = [(i, p, 0.0) for i, p in enumerate(["<unk>", "<s>", "</s>", "<pad>"])]
    rows += [(4 + b, f"<0x{b:02X}>", 0.0) for b in range(256)]
    return rows + [(260 + r, p, float(-r)) for r, p in enumerate(pieces)]


def loop_merge(word, rank):
    parts = list(word)
    while True:
        best = min(
            ((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank),
            default=None,
        )
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [x for p in parts for x in ([260 + rank[p]] if p in rank else [4 + b for b in p.encode()])]


def test_merging_equals_a_loop():
    rng = random.Random(5)
    rank = {p: r for r, p in enumerate(PIECES)}
    pieces = bpe.text_pieces(table())
    for _ in range(3000):
        word = "".join(rng.choice("▁thenigrada漢é") for _ in range(rng.randint(1, 14)))
        assert bpe.encode_word(word, *pieces) == loop_merge(word, rank), word
    assert bpe.encode_word("a" * 9, *pieces) == loop_merge("a" * 9, rank)


def test_long_words():
    rank = {p: r for r, p in enumerate(PIECES)}
    word = "".join(random.Random(8).choices("thenigra", k=900))
    assert bpe.encode_word(word, *bpe.text_pieces(table())) == loop_merge(word, rank)


def test_words_of_a_text_are_encoded_as_the_whole_text():
    """Cutting before each run of word marks does not change the result."""
    rng = random.Random(6)
    rank = {p: r for r, p in enumerate(PIECES)}
    pieces = bpe.text_pieces(table())
    for _ in range(500):
        text = "".join(rng.choice("  theingra\n漢") for _ in range(rng.randint(1, 40)))
        whole = (META_SPACE + text).replace(" ", META_SPACE)
        assert bpe.encode_text(text, lambda w: bpe.encode_word(w, *pieces)) == loop_merge(whole, rank), text


def test_pieces_over_word_borders_are_refused():
    with pytest.raises(ValueError):
        bpe.text_pieces(table(["a▁b"]))


def encoded(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    encode = bpe.bpe_encoder(spark, table())
    return rows.select("id", "text", encode(F.col("text")).alias("ids"))


def test_special_tokens_in_the_text(spark):
    got = [r.ids for r in encoded(spark, "the</s>", "<s>the", "", "a▁the", None, "</s>").orderBy("id").collect()]
    i = {p: 260 + r for r, p in enumerate(PIECES)}
    assert got == [
        [i["▁the"], 2],
        [1, i["the"]],  # the lone mark in front of a special token is dropped
        [],
        [i["▁a"], i["▁the"]],
        None,
        [2],
    ]


def test_decoding_gives_the_text_back(spark):
    texts = ["the and  ing", " lead", "漢字 é\n\nend ", "x</s>y", "a▁b", "😀", ""]
    rows = encoded(spark, *texts)
    decode = bpe.bpe_decoder(spark, table())
    out = rows.withColumn("decoded", decode(F.col("ids"))).orderBy("id").collect()
    assert [r.decoded for r in out] == [t.replace(META_SPACE, " ") for t in texts]
    failed = rows.withColumn("decoded", decode(F.col("ids"))).filter(
        bpe.is_roundtrip_failure(F.col("text"), F.col("decoded"))
    )
    assert failed.count() == 0
    bare = bpe.bpe_decoder(spark, table(), skip_special_tokens=True)
    row = encoded(spark, "the</s>").select(bare(F.col("ids")).alias("t")).first()
    assert row.t == "the"


def test_read_vocab(spark, tmp_path):
    path = tmp_path / "small.vocab"
    path.write_text("".join(f"{p}\t{s:g}\n" for _, p, s in table()), encoding="utf-8")
    rows = vocab.read_vocab(spark, str(path))
    assert vocab.collect_vocab(rows) == table()
    kinds = {r.kind: r.n for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"special": 4, "byte": 256, "piece": len(PIECES)}


def test_gaps_in_ids_are_refused(spark):
    rows = spark.createDataFrame([(0, "a", 0.0), (2, "b", 0.0)], "id int, piece string, score double")
    with pytest.raises(ValueError):
        vocab.collect_vocab(rows)


def test_piece_lookup(spark):
    words = ["<unk>", "<s>", "</s>", "<pad>", "b", "a"]
    table_ = [(i, w, 0.0) for i, w in enumerate(words)]
    df = spark.createDataFrame(
        [(1, ["a", "b", "zzz", None]), (2, []), (3, None)], "id int, p array<string>"
    )
    ids = vocab.piece_ids(spark, table_)(F.col("p"))
    back = vocab.id_pieces(spark, table_)
    got = df.select("id", ids.alias("ids")).withColumn("p", back(F.col("ids"))).orderBy("id")
    assert [(r.ids, r.p) for r in got.collect()] == [
        ([5, 4, 0, 0], ["a", "b", "<unk>", "<unk>"]), ([], []), (None, None)
    ]


def test_word_vocab(spark):
    df = spark.createDataFrame([("b a b c",), ("c b d",)], "text string")
    got = vocab.collect_vocab(vocab.word_vocab(df, 7))
    assert [(i, p) for i, p, _ in got[4:]] == [(4, "b"), (5, "c"), (6, "a")]


def test_executors_need_not_have_the_package(tmp_path):
    work = cloudpickle.dumps((bpe.encode_word, ("the", *bpe.text_pieces(table()))))
    code = "import pickle, sys; f, a = pickle.load(sys.stdin.buffer); print(f(*a))"
    done = subprocess.run(
        [sys.executable, "-I", "-c", code], input=work, capture_output=True, cwd=tmp_path
    )
    fn, args = pickle.loads(work)
    assert done.stdout.decode().strip() == str(fn(*args))
