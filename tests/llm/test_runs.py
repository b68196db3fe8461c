"""Periodic runs against a plain search over all periods."""

import hashlib
import random

import numpy as np
import pytest

from grainmill.llm import runs
from tests.llm import odd

RUN = random.Random(3)


def plain_runs(words, least=6, exponent=4):
    """(start, period, length) of all runs, by start and period."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, q, n) for (s, n), q in found.items())


def some_words(size):
    words = [RUN.choice("abcd"[: RUN.randint(1, 4)]) for _ in range(RUN.randint(0, size))]
    if len(words) > 3 and RUN.random() < 0.5:
        a, p = RUN.randrange(len(words)), RUN.randint(1, 9)
        words = [w if i < a else words[a + (i - a) % p] if a + p <= len(words) else w for i, w in enumerate(words)]
    return words


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (4, 3)])
def test_runs_of_many_texts_equal_a_plain_search(least, exponent):
    for _ in range(150):
        texts = [some_words(70) for _ in range(RUN.randint(1, 8))]
        offsets = np.cumsum([0] + [len(t) for t in texts])
        code = np.array([ord(w) for t in texts for w in t], dtype=np.int64)
        got = runs.find_runs(code, offsets, least=least, exponent=exponent)
        want = [
            (s + offsets[k], n, q)
            for k, t in enumerate(texts)
            for s, q, n in plain_runs(t, least, exponent)
        ]
        assert list(zip(*(v.tolist() for v in got))) == want, texts


def test_long_texts_of_one_word_and_of_nested_periods():
    n = 200_000
    for code, want in [
        (np.zeros(n, np.int64), (0, n, 1)),
        (np.arange(n) % 777, (0, n, 777)),
        (np.concatenate([[9], np.arange(n) % 3, [9]]), (1, n, 3)),
    ]:
        got = runs.find_runs(code, np.array([0, len(code)]))
        assert [tuple(int(v[k]) for v in got) for k in range(len(got[0]))] == [want]


def planted(doc, words):
    n = len(words)
    h = odd.crc(doc)
    if doc is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def report(doc, words):
    found = plain_runs(words)
    gone = {i for s, q, n in found for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, q, n in found)
    best = min(found, key=lambda r: (-r[2], r[0], r[1]), default=None)
    shape = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, kept)]
    return (doc, len(found), *shape, *sha)


def test_report_on_odd_documents(spark):
    rows = odd.documents() + [
        (d, t, "en", "a", 1, 1, "k", 2, 3, 4, 5, 0.5)
        for d, t in [(200, "a b " * 9), (201, "x x x x x x"), (202, "x x x x x"), (203, "p q r s t u v " * 30)]
    ]
    # Some that have a periodic tail, and texts of one word among them.
    tenth = [d for d in range(300, 900) if odd.crc(d) % 10 == 0][:40]
    rows += [(d, " ".join(some_words(90)) or None, "de", "b", 1, 1, "k", 2, 3, 4, 5, 0.5) for d in tenth]
    docs = spark.createDataFrame(rows, odd.SCHEMA).repartition(5)
    got = sorted(map(tuple, runs.run_report(runs.with_periodic_tails(docs)).collect()), key=repr)
    want = sorted((report(r[0], planted(r[0], odd.words(r[1]))) for r in rows), key=repr)
    assert got == want
    empty = docs.limit(0)
    assert runs.run_report(runs.with_periodic_tails(empty)).collect() == []


def test_collapsed_text_keeps_the_first_period(spark):
    docs = spark.createDataFrame([(1, "go on and on and on and on and on. stop")], "doc_id long, text string")
    row = runs.periodic_runs(docs).first()
    assert row.collapsed == "go on and on. stop" and row.n_words == 11
    assert [tuple(r) for r in row.runs] == [(1, 8, 2)]
