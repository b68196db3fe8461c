"""A training step works on some blocks at a time, in arrays that it uses again."""

import tracemalloc

import numpy as np
import pytest

from grainmill.llm import attention as A

SIZE = 400


@pytest.fixture(scope="module")
def parts():
    r = np.random.default_rng(7)
    vectors = (0.4 * r.standard_normal((SIZE + 1, A.WIDTH))).astype(np.float32)
    classes = r.integers(0, A.CLASSES, SIZE)
    vocabulary = A.Vocabulary(SIZE, vectors, r.integers(0, A.CONTEXTS, SIZE + 1), classes)
    prior = A.Prior.of(r.integers(0, 9, (A.CONTEXTS, SIZE)).astype(np.float32), vocabulary)
    weights = A.fresh_weights(2)
    for p in weights.all():
        p += (0.2 * r.standard_normal(p.shape)).astype(np.float32)
    sizes = [9000, 3, 0, 700, 15]
    b = A.Blocks(np.cumsum([0, *sizes]), r.integers(0, SIZE - 1, sum(sizes)), SIZE - 1, SIZE)
    return vocabulary, prior, weights, b


def trainer(parts):
    vocabulary, prior, weights, _ = parts
    return A.Trainer(vocabulary, prior.classes, A.Weights(*(p.copy() for p in weights.all())))


def test_a_step_holds_few_blocks_at_once(parts):
    """A step of 8,192 tokens held 18 MB of arrays, which leave the caches."""
    starts, t = np.arange(1, 1 + A.RUNS * A.RUN, A.RUN), trainer(parts)
    tracemalloc.start()
    t.step(parts[3], starts, A.RUN, 1e-3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6


@pytest.mark.parametrize("length", [1, 5, 64])
def test_runs_of_a_step_do_not_see_each_other(parts, length):
    b = parts[3]
    starts = np.array([1, 900, b.total - length, 40, 1])
    t = trainer(parts)
    loss, got = t.gradients(b, starts, length)
    counts = [np.count_nonzero(b.counts[s * A.SPAN : (s + length) * A.SPAN]) for s in starts]
    each = [trainer(parts).gradients(b, np.array([s]), length) for s in starts]
    assert loss == pytest.approx(sum(n * l for n, (l, _) in zip(counts, each)) / sum(counts), rel=1e-4)
    for i, g in enumerate(got):
        want = sum(n * np.asarray(x[i], dtype=np.float64) for n, (_, x) in zip(counts, each)) / sum(counts)
        assert np.allclose(g, want, rtol=1e-3, atol=1e-5)
    # The arrays of a longer step are used for a shorter one.
    t.gradients(b, np.array([1, 300]), 100)
    again, same = t.gradients(b, starts, length)
    assert again == loss and all(np.array_equal(x, y) for x, y in zip(got, same))


def test_what_is_below_zero_becomes_zero():
    x = np.array([[-1.5, 0.0, 2.0], [-0.0, 1e-30, -1e30]], dtype=np.float32)
    assert A._positive(x).tolist() == [[0, -1, -1], [0, -1, 0]]
    assert x.tolist() == [[0, 0, 2], [0, np.float32(1e-30), 0]]
