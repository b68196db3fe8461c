"""A small causal self-attention model in numpy, over token ids of a public tokenizer.

The next token's chance is ``p(class | context) * p(token | class, context class)``. Counts over
the whole corpus give, for each class of the last token, the chances of all tokens, and so of
their classes. Attention over the tokens before corrects the chances of the classes: a masked
head with relative positions, a hidden layer, and a softmax that starts from the counted ones.

Documents are laid out in blocks of ``SPAN`` positions behind one empty block. A window is a
block and the one before it; its second half is scored, so windows overlap and every token is
scored once. All windows of a step are one batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPAN = 8
WIDTH, HEAD, HIDDEN = 40, 16, 32
CONTEXTS, CLASSES = 256, 32
FEATURES = 128
SMOOTH = 100.0
# Windows that are attended to at once; their arrays stay in the caches.
STEP = 256
# Consecutive blocks that are trained on together, and how many such runs make a step.
RUN, RUNS = 128, 8
# Blocks of a step whose arrays are made at once.
AT_ONCE = 2 * (RUN + 1)
LOG10 = float(np.log(10))


@dataclass
class Vocabulary:
    """Vectors of tokens as context, and their classes as context and as outcome.

    ``size`` is the number of outcomes (tokens and the end); the start symbol is id ``size``.
    """

    size: int
    vectors: np.ndarray
    contexts: np.ndarray
    classes: np.ndarray

    def arrays(self) -> tuple:
        """What tasks are sent; they need not know this class."""
        return self.size, self.vectors, self.contexts, self.classes


def most_met(often: np.ndarray) -> np.ndarray:
    """The column of each of the most frequent tokens in a profile; -1 for all others."""
    top = np.argsort(-often, kind="stable")[:FEATURES]
    column = np.full(len(often), -1)
    column[top] = np.arange(len(top))
    return column


def _profile(counts: np.ndarray, often: np.ndarray, width: int) -> np.ndarray:
    """Vectors of tokens by how often they go with the most frequent others."""
    matrix = np.sqrt(counts / np.maximum(often, 1).astype(np.float32)[:, None], dtype=np.float32)
    heavy = matrix * np.sqrt(often, dtype=np.float32)[:, None]
    _, axes = np.linalg.eigh(heavy.T @ heavy)
    return matrix @ axes[:, -width:].astype(np.float32)


def _cluster(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k-means from the heaviest rows; weights decide, as rare rows say little."""
    centres = x[np.argsort(-weight, kind="stable")[:k]].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        mass = np.bincount(near, weight, k)
        for j in range(x.shape[1]):
            total = np.bincount(near, weight * x[:, j], k)
            centres[:, j] = np.where(mass > 0, total / np.maximum(mass, 1e-9), centres[:, j])
    return near


def learn_vocabulary(
    forward: np.ndarray, often: np.ndarray, backward: np.ndarray, seen: np.ndarray, size: int
) -> Vocabulary:
    """From the neighbours of tokens in all training texts.

    ``often``, ``seen``: how often each is a context (the start symbol too) and an outcome;
    ``forward``, ``backward``: how often each of the most frequent comes after, before it.
    """
    vectors = _profile(forward, often, WIDTH)
    contexts = _cluster(vectors, often, CONTEXTS)
    classes = _cluster(_profile(backward, seen, WIDTH)[:size], seen[:size], CLASSES)
    scale = np.sqrt((vectors**2 * often[:, None]).sum(axis=0) / max(1.0, often.sum())) + 1e-6
    return Vocabulary(size, (vectors / scale).astype(np.float32), contexts, classes)


@dataclass
class Prior:
    """Counted chances: of each token, and of each class, after each context class (as logs)."""

    tokens: np.ndarray
    classes: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, vocabulary: Vocabulary) -> Prior:
        """``counts``: (contexts, tokens) over the whole training corpus."""
        each = counts.sum(axis=0, dtype=np.float64) + 0.1
        each /= each.sum()
        by_class = np.empty((len(counts), CLASSES), dtype=np.float32)
        tokens = np.empty(counts.shape, dtype=np.float32)
        for a, row in enumerate(counts):
            p = (row + SMOOTH * each) / (row.sum(dtype=np.float64) + SMOOTH)
            mass = np.bincount(vocabulary.classes, p, CLASSES)
            by_class[a] = np.log(np.maximum(mass, 1e-30))
            tokens[a] = np.log(p) - by_class[a][vocabulary.classes]
        return cls(tokens, by_class)


def neighbours(ends: np.ndarray, ids: np.ndarray, end_id: int, start_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token of the texts, and their ends, behind the token or start symbol before it."""
    n = len(ends) - 1
    before, after = np.empty(len(ids) + n, dtype=np.int64), np.empty(len(ids) + n, dtype=np.int64)
    for out, edge, symbol in ((before, ends[:-1], start_id), (after, ends[1:], end_id)):
        inner = np.ones(len(out), dtype=bool)
        inner[edge + np.arange(n)] = False
        out[inner] = ids
        out[~inner] = symbol
    return before, after


class Blocks:
    """Documents laid out in blocks: inputs, targets, and which positions count."""

    def __init__(self, ends: np.ndarray, ids: np.ndarray, end_id: int, start_id: int):
        sizes = np.diff(ends) + 1  # every text is followed by the end
        blocks = -(-sizes // SPAN)
        first = np.concatenate(([0], np.cumsum(blocks + 1)))  # in blocks; one empty block each
        self.total = int(first[-1])
        n = self.total * SPAN
        self.doc = np.repeat(np.arange(len(sizes)), blocks + 1)
        self.inputs = np.full(n, start_id, dtype=np.int32)
        self.targets = np.full(n, end_id, dtype=np.int32)
        self.counts = np.zeros(n, dtype=bool)
        base = (first[:-1] + 1) * SPAN
        at = np.repeat(base - ends[:-1], np.diff(ends))
        at += np.arange(len(ids))
        self.targets[at] = ids
        self.inputs[at + 1] = ids  # the last one goes to the end's place
        self.counts[at] = True
        self.counts[base + sizes - 1] = True
        empty = np.zeros(self.total, dtype=bool)
        empty[first[:-1]] = True
        self.empty = empty


@dataclass
class Weights:
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    place: np.ndarray
    mix: np.ndarray
    own: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray

    def all(self) -> list[np.ndarray]:
        return list(vars(self).values())


def fresh_weights(seed: int) -> Weights:
    r = np.random.default_rng(seed)

    def draw(a: int, b: int) -> np.ndarray:
        return (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)

    zeros = lambda *s: np.zeros(s, dtype=np.float32)
    return Weights(
        0.5 * draw(WIDTH, HEAD), 0.5 * draw(WIDTH, HEAD), draw(WIDTH, HEAD), zeros(2 * SPAN),
        draw(HEAD, HIDDEN), draw(WIDTH, HIDDEN), zeros(HIDDEN), zeros(HIDDEN, CLASSES), zeros(CLASSES),
    )


# Place of each key before each query of a window; later keys are masked.
_BACK = (SPAN + np.arange(SPAN))[:, None] - np.arange(2 * SPAN)[None, :]
_MASK = np.where(_BACK < 0, -1e9, 0.0).astype(np.float32)
_BACK = np.maximum(_BACK, 0)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, which a product with ones gives fastest."""
    return x @ np.ones(x.shape[-1], dtype=x.dtype)


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    """Sums over the last axis, n times beside each other; rows of them are used faster than one a row."""
    return x @ np.ones((x.shape[-1], n), dtype=x.dtype)


def _positive(x: np.ndarray) -> np.ndarray:
    """Set what is below 0 to 0, by the sign bit, which is faster than a comparison; returns the mask of bits kept."""
    bits = x.view(np.int32)
    kept = np.right_shift(bits, 31)
    np.invert(kept, out=kept)
    bits &= kept
    return kept


def _at_most(x: np.ndarray, limit: float) -> None:
    if x.max() > limit:
        np.minimum(x, limit, out=x)


# Columns of what is made of each token for attention.
_QUERY, _KEY, _VALUE = slice(0, HEAD), slice(HEAD, 2 * HEAD), slice(2 * HEAD, 3 * HEAD)


def _windows(x: np.ndarray) -> np.ndarray:
    """Each block of the rows behind the one before it, without a copy."""
    row, column = x.strides
    shape = (len(x) // SPAN - 1, 2 * SPAN, x.shape[1])
    return np.lib.stride_tricks.as_strided(x, shape, (SPAN * row, row, column))


def _attend(made: np.ndarray, place: np.ndarray, empty: np.ndarray, att: np.ndarray, seen: np.ndarray) -> None:
    """Attention of all windows of consecutive blocks, the first of which is only context.

    ``empty``: the block before has no tokens. ``att`` gets the weights and ``seen`` the outputs.
    """
    query = made[SPAN:, _QUERY].reshape(-1, SPAN, HEAD)
    np.matmul(query, _windows(made[:, _KEY]).transpose(0, 2, 1), out=att)
    att += place[_BACK] + _MASK
    att[np.flatnonzero(empty), :, :SPAN] = -1e9
    _at_most(att, 30)
    np.exp(att, out=att)
    rows = att.reshape(-1, 2 * SPAN)
    rows /= _spread(rows, 2 * SPAN)
    np.matmul(att, _windows(made[:, _VALUE]), out=seen)


class Room:
    """Arrays of rows for up to ``blocks`` blocks and their context, used again so that they stay in the caches."""

    def __init__(self, blocks: int, **widths: int):
        self.blocks, self.widths = blocks, widths
        self.arrays = {k: np.zeros((blocks + 1) * SPAN * n, dtype=np.float32) for k, n in widths.items()}

    def rows(self, name: str, n: int) -> np.ndarray:
        width = self.widths[name]
        return self.arrays[name][: n * width].reshape(n, width)

    def blocks_of(self, name: str, n: int) -> np.ndarray:
        """The first rows by block."""
        return self.rows(name, n).reshape(n // SPAN, SPAN, -1)


def _took(table: np.ndarray, at: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Rows of a table; ``clip`` spares the copy that is made against places out of range."""
    return np.take(table, at, axis=0, out=out, mode="clip")


class Model:
    """Weights folded into one table row per token, so that a step only gathers and attends."""

    def __init__(self, vocabulary: Vocabulary, prior: Prior, weights: Weights):
        x, w = vocabulary.vectors, weights
        self.vocabulary, self.prior, self.weights = vocabulary, prior, weights
        self.made = x @ np.concatenate((w.query, w.key, w.value), axis=1)
        self.own = x @ w.own + w.bias

    def arrays(self) -> tuple:
        prior = (self.prior.tokens, self.prior.classes)
        return self.vocabulary.arrays(), prior, tuple(self.weights.all())

    @classmethod
    def of(cls, arrays: tuple) -> Model:
        vocabulary, prior, weights = arrays
        return cls(Vocabulary(*vocabulary), Prior(*prior), Weights(*weights))

    def log10(self, ends: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log10 of the probability of each document and its end."""
        vocabulary, w = self.vocabulary, self.weights
        b = Blocks(ends, ids, vocabulary.size - 1, vocabulary.size)
        out = np.zeros(len(ends) - 1)
        classes = self.prior.classes + w.shift
        room = Room(STEP, made=3 * HEAD, att=2 * SPAN, seen=HEAD, hidden=HIDDEN, more=HIDDEN, logits=CLASSES, prior=CLASSES)
        for a in range(0, b.total - 1, STEP):
            z = min(a + STEP, b.total - 1) + 1  # one block of context, then scored ones
            token, target = b.inputs[a * SPAN : z * SPAN], b.targets[(a + 1) * SPAN : z * SPAN]
            n = len(target)
            made, seen = _took(self.made, token, room.rows("made", len(token))), room.rows("seen", n)
            _attend(made, w.place, b.empty[a : z - 1], room.blocks_of("att", n), room.blocks_of("seen", n))
            hidden = _took(self.own, token[SPAN:], room.rows("hidden", n))
            hidden += np.matmul(seen, w.mix, out=room.rows("more", n))
            _positive(hidden)
            logits = np.matmul(hidden, w.out, out=room.rows("logits", n))
            context = vocabulary.contexts[token[SPAN:]]
            logits += _took(classes, context, room.rows("prior", n))
            chosen = logits.ravel()[np.arange(0, n * CLASSES, CLASSES) + vocabulary.classes[target]]
            np.exp(logits, out=logits)
            score = chosen - np.log(_sums(logits)) + self.prior.tokens[context, target]
            score = np.where(b.counts[(a + 1) * SPAN : z * SPAN], score, 0).reshape(-1, SPAN).sum(axis=1, dtype=np.float64)
            doc = b.doc[a + 1 : z]
            out[doc[0] : doc[-1] + 1] += np.bincount(doc - doc[0], score)
        return out / LOG10


class Trainer:
    """Adam, gradients written out by hand."""

    def __init__(self, vocabulary: Vocabulary, classes: np.ndarray, weights: Weights):
        self.vocabulary, self.classes, self.weights = vocabulary, classes, weights
        self.moments = np.zeros((2, sum(p.size for p in weights.all())), dtype=np.float32)
        self.steps = 0
        self.room, self.place = Room(0), np.zeros(len(vocabulary.vectors), dtype=np.intp)

    def gradients(self, b: Blocks, starts: np.ndarray, length: int) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the tokens of runs of ``length`` blocks, and its gradients.

        A run begins at a block of ``starts``; the block before it is context. Tokens repeat, so what a
        token gives in every place is made once a step.
        """
        w, vocabulary = self.weights, self.vocabulary
        blocks = (starts[:, None] - 1) + np.arange(length + 1)
        token = b.inputs.reshape(-1, SPAN)[blocks]
        counts = b.counts.reshape(-1, SPAN)[blocks]
        counts[:, 0] = False
        counted = max(1, np.count_nonzero(counts))
        here = np.zeros(len(vocabulary.vectors), dtype=bool)
        here[token] = True
        met = np.flatnonzero(here)
        self.place[met] = np.arange(len(met))
        x, to_made = vocabulary.vectors[met], np.concatenate((w.query, w.key, w.value), axis=1)
        tables = x, x @ to_made, x @ w.own + w.bias, (self.classes + w.shift)[vocabulary.contexts[met]]
        sums = [np.zeros_like(p) for p in (to_made, w.own, w.mix, w.bias, w.out, w.shift)]
        sums.append(np.zeros(2 * SPAN * SPAN, dtype=np.float32))
        # Runs are laid one behind the other; what the context of one sees in the run before is not counted.
        loss, some = 0.0, max(1, AT_ONCE // (length + 1))
        for a in range(0, len(starts), some):
            share = counts[a : a + some].reshape(-1)[SPAN:] * np.float32(1 / counted)
            loss += self._run(b, blocks[a : a + some].ravel(), self.place[token[a : a + some].ravel()], share, tables, sums)
        made, own, mix, bias, out, shift, score = sums
        place = np.bincount(_BACK.ravel(), score, 2 * SPAN)
        return loss, [made[:, _QUERY], made[:, _KEY], made[:, _VALUE], place, mix, own, bias, out, shift]

    def _run(
        self, b: Blocks, blocks: np.ndarray, token: np.ndarray, share: np.ndarray, tables: tuple, sums: list
    ) -> float:
        """Loss of blocks behind a first one that is context; its gradients are added to ``sums``.

        ``share``: how much each position counts; ``token``: rows of the ``tables`` of vectors, and of
        what is made of them.
        """
        w, length = self.weights, len(blocks) - 1
        n, whole = length * SPAN, (length + 1) * SPAN
        if self.room.blocks < length:
            self.room = Room(
                length, x=WIDTH, made=3 * HEAD, att=2 * SPAN, seen=HEAD, hidden=HIDDEN, more=HIDDEN, d=CLASSES,
                prior=CLASSES, d_seen=HEAD, d_score=2 * SPAN, both=6 * HEAD, back=3 * HEAD,
            )
        rows, blocks_of = self.room.rows, self.room.blocks_of
        x, made = (_took(t, token, rows(k, whole)) for t, k in zip(tables, ("x", "made")))
        hidden, prior = (_took(t, token[SPAN:], rows(k, n)) for t, k in zip(tables[2:], ("hidden", "prior")))
        att, seen = blocks_of("att", n), rows("seen", n)
        _attend(made, w.place, b.empty[blocks[:-1]], att, blocks_of("seen", n))
        hidden += np.matmul(seen, w.mix, out=rows("more", n))
        kept = _positive(hidden)
        d = np.matmul(hidden, w.out, out=rows("d", n))
        d += prior
        _at_most(d, 80)
        np.exp(d, out=d)
        flat, total = d.reshape(-1), _sums(d)
        chosen = self.vocabulary.classes[b.targets.reshape(-1, SPAN)[blocks[1:]].reshape(-1)]
        chosen += np.arange(0, n * CLASSES, CLASSES)
        chance = flat[chosen] / total
        loss = -float(np.log(np.maximum(chance, 1e-30)) @ share)
        d *= (share / total)[:, None]
        flat[chosen] = share * (chance - 1)
        d_hidden = np.matmul(d, w.out.T, out=rows("more", n))
        np.bitwise_and(d_hidden.view(np.int32), kept, out=d_hidden.view(np.int32))
        d_seen = np.matmul(d_hidden, w.mix.T, out=rows("d_seen", n))
        d_score = blocks_of("d_score", n)
        np.matmul(blocks_of("d_seen", n), _windows(made[:, _VALUE]).transpose(0, 2, 1), out=d_score)
        d_score *= att
        mean = _spread(rows("d_score", n), 2 * SPAN)
        mean *= rows("att", n)
        d_score -= mean.reshape(d_score.shape)
        # Back to the blocks: each is the later half of one window and the earlier one of the next.
        # Nothing is written to the queries of an earlier half, which stay 0.
        both = self.room.arrays["both"][: n * 6 * HEAD].reshape(length, 2 * SPAN, 3 * HEAD)
        np.matmul(d_score, _windows(made[:, _KEY]), out=both[:, SPAN:, _QUERY])
        np.matmul(d_score.transpose(0, 2, 1), made[SPAN:, _QUERY].reshape(length, SPAN, HEAD), out=both[:, :, _KEY])
        np.matmul(att.transpose(0, 2, 1), blocks_of("d_seen", n), out=both[:, :, _VALUE])
        back = blocks_of("back", whole)
        np.add(both[:-1, SPAN:], both[1:, :SPAN], out=back[1:-1])
        back[0], back[-1] = both[0, :SPAN], both[-1, SPAN:]
        ones = np.ones(n, dtype=np.float32)
        for total, part in zip(sums, (
            x.T @ rows("back", whole), x[SPAN:].T @ d_hidden, seen.T @ d_hidden, ones @ d_hidden, hidden.T @ d,
            ones @ d, ones[:length] @ d_score.reshape(length, -1),
        )):
            total += part
        return loss

    def step(self, b: Blocks, starts: np.ndarray, length: int, rate: float) -> float:
        """One step on runs of blocks, each block behind the one before it; returns the loss."""
        loss, gradients = self.gradients(b, starts, length)
        self.steps += 1
        fix = np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        m, s = self.moments
        g = np.concatenate([g.ravel() for g in gradients])
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        change, at = (rate * fix * m / (np.sqrt(s) + 1e-8)).astype(np.float32), 0
        for param in self.weights.all():
            param -= change[at : at + param.size].reshape(param.shape)
            at += param.size
        return loss


def first_weights(
    vocabulary: Vocabulary, prior: Prior, ends: np.ndarray, ids: np.ndarray, *,
    steps: int = 1500, rate: float = 4e-3, seed: int = 3,
) -> Weights:
    """Where the training on all texts begins: Adam on runs drawn from some of them."""
    w = fresh_weights(seed)
    b = Blocks(ends, ids, vocabulary.size - 1, vocabulary.size)
    length = min(RUN // 4, b.total - 1)
    if length < 1:
        return w
    r = np.random.default_rng(seed)
    trainer = Trainer(vocabulary, prior.classes, w)
    for step in range(1, steps + 1):
        starts = r.integers(1, b.total - length + 1, RUNS)
        trainer.step(b, starts, length, rate * min(1.0, step / 50) * (1 - step / (steps + 1)) ** 0.5)
    return w


def train_on(trainer: Trainer, ends: np.ndarray, ids: np.ndarray, *, rate: float = 2e-3, seed: int = 3) -> int:
    """Train on every window of the texts once, runs in random order; returns their number."""
    vocabulary = trainer.vocabulary
    b = Blocks(ends, ids, vocabulary.size - 1, vocabulary.size)
    starts = np.random.default_rng(seed).permutation(np.arange(1, b.total - RUN + 1, RUN))
    steps = [(starts[a : a + RUNS], RUN) for a in range(0, len(starts), RUNS)]
    # What no whole run covers is a shorter one.
    done = 1 + RUN * len(starts)
    if done < b.total:
        steps.append((np.array([done]), b.total - done))
    for some, length in steps:
        trainer.step(b, some, length, rate * min(1.0, (trainer.steps + 1) / 50))
    return int((~b.empty).sum())
