"""A third of all rows equal in all: nothing is lost, and no task gets them all."""

import pytest
from pyspark.sql import functions as F

from grainmill.llm import jaccard, mixing, packing, quality_model, substrings, words
from tests.llm import odd

N = 1200
SAME = "the very same text " * 4


@pytest.fixture(scope="module")
def docs(spark):
    def row(doc, text, source):
        return (doc, text, "en", source, len(text), 1, "k", 2, 3, 4, 5, 0.5)

    rows = [row(i, f"text {i} has its own words {i * 7} and {i % 5} more " * (1 + i % 3), "ab"[i % 2]) for i in range(N)]
    rows += [row(5000, SAME, "a")] * (N // 2) + [row(5001, SAME, "a"), row(5001, SAME, "b")]
    return spark.createDataFrame(rows, odd.SCHEMA).repartition(9)


def test_numbers_of_copies(spark, docs):
    rows = docs.select("doc_id", words.text_key().alias("text_key"), "source")
    keys = ["doc_id", "text_key"]
    many = words.many_copies(rows, keys)
    assert [r.doc_id for r in many.collect()] == [5000]
    got = words.copy_numbers(rows, keys, many, "nth", F.col("source")).collect()
    assert sorted(r.nth for r in got if r.doc_id == 5000) == list(range(1, N // 2 + 1))
    assert {(r.source, r.nth) for r in got if r.doc_id == 5001} == {("a", 1), ("b", 2)}
    assert all(r.nth == 1 for r in got if r.doc_id < 5000) and len(got) == docs.count()
    assert words.many_copies(rows.where("doc_id < 5000"), keys) is None


def test_mixing(spark, docs):
    options = {"block_units": 200}
    mixed = mixing.mix_sources(docs, **options)
    assert mixed.count() == docs.count()
    rows = mixed.collect()
    assert sorted(rows) == sorted(mixing.mix_sources(docs, **options).collect())
    for source in "ab":
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target
    taken = mixing.mixed_rows(docs, **options)
    want = {}
    for r in rows:
        want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.copies
    got = {(r.doc_id, r.source): r["count"] for r in taken.groupBy("doc_id", "source").count().collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_packing(spark, docs):
    packed = packing.pack_documents(docs, capacity=64, block_sequences=16)
    rows = packed.collect()
    assert sum(r.doc_id == 5000 for r in rows) == N // 2
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    blocks = {}
    for r in rows:
        blocks[r.sequence_id >> 32] = blocks.get(r.sequence_id >> 32, 0) + 1
    assert max(blocks.values()) <= 2 * len(rows) / len(blocks)


def test_substrings(spark, docs):
    rows = odd_rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = odd.removed(odd_rows, 20)
    got = substrings.repeat_report(docs).collect()
    assert len(got) == len(rows)
    by_text = {(d, t): v for (d, t), v in want.items()}
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(
        (d, *by_text[d, t]) for d, t in rows
    )


def test_one_of_each(spark, docs):
    kept = jaccard.one_of_each(docs, n=5, percent=80).collect()
    assert sum(r.text == SAME for r in kept) == 1 and sum(r.doc_id == 5000 for r in kept) == 1


def test_a_null_id_stays_only_without_others(spark):
    rows = [(None, SAME), (3, SAME), (None, "another text that only the row without an id has got")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccard.one_of_each(docs, n=5, percent=80).collect()
    assert sorted((r.doc_id or -1, r.text[:7]) for r in kept) == [(-1, "another"), (3, "the ver")]


def test_labels_bound_the_sample(spark, docs):
    labels = spark.createDataFrame([(5000, 1), (5000, 1), (3, 0), (7, 0)], "doc_id long, quality int")
    seen = []
    fit = quality_model.fit

    def keep(x, y):
        seen.append(len(x))
        return fit(x, y)

    quality_model.fit = keep
    try:
        assert quality_model.score_documents(docs, labels).count() == docs.count()
    finally:
        quality_model.fit = fit
    assert seen[0] <= 3
