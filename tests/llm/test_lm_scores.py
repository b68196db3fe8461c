"""Scores of the attention model against plain loops, gradients against differences, and sums."""

import math
import pickle
import subprocess
import sys

import numpy as np
import pytest

from grainmill.llm import attention as A, lm

SIZE = 30


@pytest.fixture(scope="module")
def model():
    r = np.random.default_rng(5)
    vectors = (0.4 * r.standard_normal((SIZE + 1, A.WIDTH))).astype(np.float32)
    contexts = r.integers(0, A.CONTEXTS, SIZE + 1)
    classes = np.concatenate([np.arange(A.CLASSES) % 8, np.zeros(SIZE, int)])[:SIZE] % 8
    vocabulary = A.Vocabulary(SIZE, vectors, contexts, classes)
    prior = A.Prior.of(r.integers(0, 9, (A.CONTEXTS, SIZE)).astype(np.float32), vocabulary)
    weights = A.fresh_weights(2)
    for p in weights.all():
        p += (0.3 * r.standard_normal(p.shape)).astype(np.float32)
    return A.Model(vocabulary, prior, weights)


def chances(model, tokens, t):
    """The chance of each token at place t of a text, position by position."""
    v, w = model.vocabulary, model.weights
    inputs = [SIZE, *tokens]  # what is known at each place: the start, then the token before
    block = t // A.SPAN
    seen = list(range(max(0, (block - 1) * A.SPAN), t + 1))
    x = {i: v.vectors[inputs[i]].astype(float) for i in seen}
    query = x[t] @ w.query
    score = [min(30.0, float(query @ (x[i] @ w.key)) + float(w.place[t - i])) for i in seen]
    top = [math.exp(s) for s in score]
    mixed = sum(e / sum(top) * (x[i] @ w.value) for e, i in zip(top, seen))
    hidden = np.maximum(mixed @ w.mix + x[t] @ w.own + w.bias, 0)
    context = v.contexts[inputs[t]]
    logits = hidden @ w.out + w.shift + model.prior.classes[context]
    p = np.exp(logits - logits.max())
    p /= p.sum()
    return p[v.classes] * np.exp(model.prior.tokens[context])


def test_each_token_once_by_plain_loops(model):
    r = np.random.default_rng(1)
    texts = [r.integers(0, SIZE - 1, n).tolist() for n in (0, 1, 7, 8, 9, 15, 16, 40)]
    ends = np.cumsum([0] + [len(t) for t in texts])
    got = model.log10(ends, np.array([i for t in texts for i in t], np.uint16))
    for text, score in zip(texts, got):
        want = 0.0
        for t, token in enumerate([*text, SIZE - 1]):
            p = chances(model, text, t)
            assert abs(p.sum() - 1) < 1e-4
            want += math.log10(p[token])
        assert score == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_a_text_is_scored_alike_in_any_batch(model):
    r = np.random.default_rng(2)
    texts = [r.integers(0, SIZE - 1, n) for n in (300, 5, 2200, 0, 40)]
    alone = [model.log10(np.array([0, len(t)]), t)[0] for t in texts]
    ends = np.cumsum([0] + [len(t) for t in texts])
    assert model.log10(ends, np.concatenate(texts)) == pytest.approx(alone, rel=1e-5)


def test_gradients(model):
    r = np.random.default_rng(3)
    texts = [r.integers(0, SIZE - 1, n) for n in (30, 3, 50)]
    b = A.Blocks(np.cumsum([0, 30, 3, 50]), np.concatenate(texts), SIZE - 1, SIZE)
    weights = A.Weights(*(p.copy() for p in model.weights.all()))
    trainer = A.Trainer(model.vocabulary, model.prior.classes, weights)
    starts = np.array([1, 5])
    _, gradients = trainer.gradients(b, starts, 4)
    for p, g in zip(weights.all(), gradients):
        assert g.shape == p.shape
        for _ in range(3):
            i = tuple(r.integers(0, n) for n in p.shape)
            old = p[i]
            p[i] = old + 2e-3
            up = trainer.gradients(b, starts, 4)[0]
            p[i] = old - 2e-3
            down = trainer.gradients(b, starts, 4)[0]
            p[i] = old
            assert float(g[i]) == pytest.approx((up - down) / 4e-3, rel=0.1, abs=5e-3)


def test_training_goes_over_every_window_and_helps(model):
    r = np.random.default_rng(4)
    text = np.tile(r.integers(0, SIZE - 1, 12), 400)
    trainer = A.Trainer(model.vocabulary, model.prior.classes, A.fresh_weights(3))
    ends = np.array([0, len(text)])
    assert A.train_on(trainer, ends, text) == -(-(len(text) + 1) // A.SPAN)
    for _ in range(20):
        A.train_on(trainer, ends, text)
    fresh = A.Model(model.vocabulary, model.prior, A.fresh_weights(3)).log10(ends, text)[0]
    assert A.Model(model.vocabulary, model.prior, trainer.weights).log10(ends, text)[0] > 0.9 * fresh


def test_what_tasks_are_sent_needs_no_package(model):
    """Broadcasts are pickled by reference, so they hold nothing but arrays and numbers."""
    sent = pickle.dumps((model.arrays(), model.vocabulary.arrays(), tuple(model.weights.all())))
    code = "import pickle, sys; pickle.load(sys.stdin.buffer); assert 'grainmill' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], input=sent, check=True, cwd="/")
    again = A.Model.of(model.arrays())
    ends, ids = np.array([0, 20]), np.arange(20) % (SIZE - 1)
    assert again.log10(ends, ids) == model.log10(ends, ids)


def test_token_counts(spark):
    rows = [(1, "one two one"), (2, "two"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = lm.tokenizer_path(lm.TOKENIZER)
    size = lm.subwords(path).size + 1
    from pyspark.sql import functions as F

    keyed = docs.withColumn("text_key", F.lit(0).cast("long")).withColumn("held_out", F.col("doc_id") == 2)
    scan = keyed.select("doc_id", "text", "text_key", "held_out").mapInArrow(lm._scan(path, size), lm.SCAN)
    counts = lm.token_counts(scan, size)
    encode = lm.subwords(path).encoder.encode_ordinary
    want = np.bincount(encode(" one two one"), minlength=size)
    want[-1] = 2
    assert counts.tolist() == want.tolist()
