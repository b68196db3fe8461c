"""The corpus pipeline on a table with every odd case: each stage on its own input, and all of it."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from grainmill.llm import jaccard, mixing, packing, quality_model, substrings
from tests.llm import odd


def key(row):
    return repr(tuple(row))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Odd documents twice over in columns that clash, and labels for some, repeated and null too."""
    path = str(tmp_path_factory.mktemp("tables"))
    rows = odd.documents()
    spark.createDataFrame(rows, odd.SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    good = [(i, 1, 0) for i in [*range(0, 40), 43, 70, 71, 72]]
    bad = [(i, 0, 0) for i in (73, 74, 75, 76, 77, 41, 42)]
    labels = good + bad + [(3, 1, 0), (None, 1, 0), (5, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def steps(spark, folder):
    """Input and output of each stage, written and read back as run() does."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, folder)
        made = pipeline.bounded_rows(made, f"test-{name}")
        out.append((docs, made))
        docs = made
    return out


def test_columns_and_order(steps):
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["quality_classifier", "ngram_jaccard", "substring_dedup", "mix_sources", "best_fit_packing"]
    for docs, made in steps[:-1]:
        assert made.columns == docs.columns


def test_quality_classifier(spark, folder, steps):
    docs, made = steps[0]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    passed = quality_model.score_documents(docs, labels).where("predicted = 1")
    # Rows with one doc_id may have several texts; the number of rows that pass tells them.
    want = {r.doc_id: r["count"] for r in passed.groupBy("doc_id").count().collect()}
    assert {r.doc_id: r["count"] for r in made.groupBy("doc_id").count().collect()} == want
    assert set(rows_of(made)) <= set(rows_of(docs)) and 0 < made.count() < docs.count()


def test_near_copies(steps):
    docs, made = steps[1]
    rows = docs.collect()

    def grams(text):
        w = odd.words(text, lower=True)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    own, group = [grams(r.text) for r in rows], list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(own[i] & own[j])
            if own[i] and own[j] and 100 * shared >= 80 * (len(own[i]) + len(own[j]) - shared):
                group[find(i)] = find(j)
    members = {}
    for i, r in enumerate(rows):
        members.setdefault(find(i) if own[i] else ("alone", i), []).append(r)
    assert made.count() == len(members)
    kept = [key(r) for r in made.collect()]
    for group_rows in members.values():
        some = [r for r in group_rows if key(r) in kept]
        assert some and min((r.doc_id is None, r.doc_id or 0) for r in group_rows) == min(
            (r.doc_id is None, r.doc_id or 0) for r in some
        )


def test_repeated_passages(steps):
    docs, made = steps[2]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = odd.removed(rows, 20)
    assert made.count() == len(rows)
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    assert rows_of(made.select(others)) == rows_of(docs.select(others))
    got = sorted(
        (repr(r.doc_id), len(odd.words(r.text)), hashlib.sha256(" ".join(odd.words(r.text)).encode()).hexdigest())
        for r in made.collect()
    )
    assert got == sorted((repr(d), want[d, t][0] - want[d, t][1], want[d, t][2]) for d, t in rows)
    for r in made.collect():
        assert r.n_chars == (None if r.text is None else len(r.text))


def test_mix_of_sources(steps):
    docs, made = steps[3]
    mixed = mixing.mix_sources(docs)
    want = {}
    for r in mixed.collect():
        want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.copies
    got = {(r.doc_id, r.source): r["count"] for r in made.groupBy("doc_id", "source").count().collect()}
    assert got == {k: n for k, n in want.items() if n}
    assert set(rows_of(made)) <= set(rows_of(docs))


def pieces_of(docs):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    out = []
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [packing.END_ID]
        for n, a in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = np.array(ids[a : a + packing.CAPACITY], "<u4")
            out.append((r.doc_id, n, a, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def check_packed(rows, docs):
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == pieces_of(docs)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    tokens = sum(r.length for r in rows)
    assert len(bins) <= -(-tokens // packing.CAPACITY) + 1


def test_packing(steps):
    docs, made = steps[4]
    check_packed(made.collect(), docs)


def test_the_whole_run(spark, folder, steps):
    check_packed(pipeline.run(spark, folder).collect(), steps[4][0])


def test_an_empty_table(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        table = spark.read.parquet(f"{folder}/{name}.parquet")
        table.limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []
