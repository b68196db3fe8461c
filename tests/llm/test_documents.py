"""Operators over documents against plain versions, on a table with every odd case."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.llm import jaccard, lm, mixing, packing, quality_model, quality_rules, substrings
from tests.llm import odd

ROWS = odd.documents()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, odd.SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], odd.SCHEMA)


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = Counter()
    for row in ROWS:
        own = tokenizer.encode(row[1] or "", add_special_tokens=False).ids + [1]
        for i, a in enumerate(range(0, len(own), 4096)):
            part = np.array(own[a : a + 4096], dtype="<u4").tobytes()
            ids[(row[0], i, a, len(part) // 4, __import__("zlib").crc32(part))] += 1
    got = packing.pack_documents(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == ids
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(bins) <= math.ceil(total / 4096) + 1


def test_packing_takes_two_for_one():
    # Greedy leaves 60 + 30 with a gap of 10; 20 + 20 fill it exactly.
    bins, _ = packing.best_two_fit(np.array([60, 30, 20, 20]), 100)
    assert sorted(np.bincount(bins, weights=[60, 30, 20, 20])) == [30, 100]


@pytest.mark.parametrize("block", [4096, 7])
def test_mixing(docs, block):
    got = mixing.mix_sources(docs, block_units=block).collect()
    assert len(got) == len(ROWS)
    size = defaultdict(int)
    for row in ROWS:
        size[row[3]] += len(odd.words(row[1]))
    sources = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), float(sum(size.values()))
    while True:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if rate * weight[s] > 3 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= full
    target |= {s: rate * weight[s] for s in open_}
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r.size and r.copies <= 3
        taken[r.source] += r.taken
    for s in sources:
        # With blocks of 7, the text of 6,000 words meets too few others to make up for it.
        assert abs(taken[s] - target[s]) <= (max(60, 0.26 * target[s]) if block > 7 else 6000)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs, block_units=block).collect()))


def test_mixed_rows_keep_columns(docs):
    decided = mixing.mix_sources(docs).groupBy("doc_id", "text_key").agg(F.sum("copies").alias("c"))
    want = {(r.doc_id, r.text_key): r.c for r in decided.collect() if r.c}
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    from grainmill.llm.words import text_key

    got = rows.groupBy("doc_id", text_key().alias("k")).count().collect()
    assert {(r["doc_id"], r["k"]): r["count"] for r in got} == want


def test_flight_keeps_totals():
    r = np.random.default_rng(1)
    sizes = np.sort(r.integers(0, 5000, 500))[::-1]
    chances = r.random(500)
    end = mixing.fly(sizes, chances, r)
    assert ((end > 0) & (end < 1)).sum() <= 2
    assert end.sum() == pytest.approx(chances.sum(), abs=1e-6)
    assert end @ sizes == pytest.approx(chances @ sizes, rel=1e-9)


@pytest.mark.parametrize("bits", [12, 26])
def test_substrings(docs, bits):
    # Doc 5 has two texts, ordered by hash; their windows do not meet, so the order is free.
    want = odd.removed([(r[0], r[1]) for r in ROWS], 20)
    got = substrings.repeat_report(docs, bits=bits).collect()
    expected = Counter((r[0], *want[(r[0], r[1])]) for r in ROWS)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == expected


def test_without_repeats_keeps_columns(docs):
    rows = substrings.without_repeats(docs)
    assert rows.columns == docs.columns and rows.count() == len(ROWS)
    untouched = {r.doc_id: r.text for r in rows.collect()}
    assert untouched[42] == " \t\n\x0b " and untouched[40] is None


@pytest.mark.parametrize("options", [{}, {"bits": 10, "tile_sets": 3}])
def test_jaccard(docs, options):
    want = Counter(
        (r[0], len(odd.sets(r[1])), c) for r, c in zip(ROWS, odd.components([(r[0], r[1]) for r in ROWS]))
    )
    got = jaccard.near_copies(docs, **options).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_one_of_each(docs):
    rows = jaccard.one_of_each(docs)
    assert rows.columns == docs.columns
    component = odd.components([(r[0], r[1]) for r in ROWS])
    full = [bool(odd.sets(r[1])) for r in ROWS]
    groups = {c for c, f in zip(component, full) if f}
    got = rows.collect()
    # Doc 5 stands for two groups, one for each of its texts.
    assert len(got) == len(groups) + 1 + full.count(False)
    assert sum(r.text is None or not odd.words(r.text) for r in got) == full.count(False)


def test_bitmap_bound_is_above_the_overlap():
    r = np.random.default_rng(2)
    for n, m in ((5, 6), (300, 350), (20_000, 23_000)):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], r.integers(0, 2**63, m - n // 2, dtype=np.uint64))))
        bound = jaccard.most_shared(jaccard.bitmap(a), len(a), jaccard.bitmap(b), len(b))
        assert len(np.intersect1d(a, b)) <= bound <= min(len(a), len(b))


def test_rules(docs):
    got = quality_rules.judge_documents(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r.doc_id, *(r[c] for c in names)) for r in got) == Counter(
        (r[0], *odd.counts(r[1])) for r in ROWS
    )
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.broken)


def test_rules_reject_symbols_and_keep_plain_text(spark):
    plain = [(i, " ".join("word%d" % ((i * 7 + j) % 97) for j in range(90)), "en", "s") for i in range(60)]
    junk = [(100 + i, t.replace(" ", "*** "), "en", "s") for i, t, *_ in plain[:6]]
    rows = spark.createDataFrame(plain + junk, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.judge_documents(rows).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[100 + i] for i in range(6))


def test_classifier_on_held_out_documents(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality_model.score_documents(docs, labels)
    assert got.count() == docs.count()
    held = got.where("held_out").join(labels, "doc_id").toPandas()
    assert (held.predicted == held.quality).mean() > 0.95
    kept = quality_model.good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == got.where("predicted = 1").count()


def test_classifier_odd_rows(spark, docs):
    labels = spark.createDataFrame(
        [(1, 1, None), (1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (43, 1, 0), (77, 0, 0)],
        "doc_id long, quality int, toxic int",
    )
    got = quality_model.score_documents(docs, labels).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (odd.crc(r.doc_id) % 4 == 2) for r in got)
    none = quality_model.score_documents(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}


@pytest.mark.parametrize("frequent", [5, 200_000])
def test_word_scores(docs, frequent):
    held = {r[0]: odd.crc(r[0]) % 10 == 0 for r in ROWS}
    tokens = [odd.words(r[1], lower=True) + [None] for r in ROWS]
    count = Counter(w for r, own in zip(ROWS, tokens) if not held[r[0]] for w in own)
    n, v = sum(count.values()), len(count)
    want = Counter()
    for r, own in zip(ROWS, tokens):
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want[(r[0], held[r[0]], len(own), sum(count[w] > 0 for w in own), n, round(base, 6))] += 1
    rows = lm.score_texts(docs, frequent=frequent, steps=20).collect()
    got = Counter(
        (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows
    )
    assert got == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert packing.pack_documents(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    assert substrings.repeat_report(empty).count() == 0 and substrings.without_repeats(empty).count() == 0
    assert jaccard.near_copies(empty).count() == 0 and jaccard.one_of_each(empty).count() == 0
    assert quality_rules.judge_documents(empty).count() == 0
    assert quality_model.score_documents(empty, labels).count() == 0
    assert quality_model.good_documents(empty, labels).count() == 0
    assert lm.score_texts(empty, steps=2).count() == 0
