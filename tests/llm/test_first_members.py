"""First members of sets are found without anything of a fixed size."""

from collections import Counter

import numpy as np
import pytest

from grainmill.llm import jaccard, words
from tests.llm import odd

ROWS = odd.documents()


def test_packed_columns_come_back():
    r = np.random.default_rng(0)
    for k in (0, 1, 5, 1000):
        a, b = r.integers(0, 2**32, k, dtype=np.uint64), r.integers(0, 300, k)
        x, y = jaccard._unpacked(jaccard._packed(a, b))
        assert (x == a).all() and (y == b).all()


@pytest.mark.parametrize("bits", [32, 6])
def test_many_parts_and_steps_lose_no_member(spark, monkeypatch, bits):
    """Of any two sets that link, one member is a first one of both."""
    monkeypatch.setattr(jaccard, "SENT_MEMBERS", 500)
    monkeypatch.setattr(jaccard, "PART_MEMBERS", 64)
    r = np.random.default_rng(1)
    texts = []
    for size in (1, 3, 5, 8, 40, 200):
        own = [f"w{x}" for x in r.integers(0, 10_000, size)]
        texts += [" ".join(own), " ".join(own + ["end"]), " ".join(["w", *own[1:]])]
    texts += [t for t in texts[::2]] + [None, "", " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ends, grams = jaccard.gram_sets(words.pa.array(texts), 4)
    ids = jaccard._set_ids(ends, grams)
    sets = {i: set(grams[a:b].tolist()) for i, a, b in zip(ids, ends[:-1], ends[1:]) if i is not None}
    rows = jaccard.first_rows(docs, int(ends[-1]), bits=bits).collect()
    first = {i: {x.gram for x in rows if x.set_id == i} for i in sets}
    assert all(x.n == len(sets[x.set_id]) for x in rows)
    linked = 0
    for a in sets:
        for b in sets:
            if a < b and jaccard.enough(len(sets[a] & sets[b]), len(sets[a]) + len(sets[b]), 85):
                linked += 1
                assert first[a] & first[b]
    assert linked >= 4


def test_unlike_texts_have_no_first_members(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert jaccard.first_rows(docs, 57 * 300).count() == 0


def test_no_table_of_one_size_finds_first_members(spark, monkeypatch):
    """Counters of one size for any corpus are full at some size, and then all sets meet."""
    def refused(*args):
        raise AssertionError("broadcast")

    docs = spark.createDataFrame(ROWS, odd.SCHEMA).repartition(5)
    with monkeypatch.context() as m:
        m.setattr(type(spark.sparkContext), "broadcast", refused)
        assert jaccard.first_rows(docs, 5_000).count() > 0


def test_small_parts_and_steps_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SENT_MEMBERS", 500)
    monkeypatch.setattr(jaccard, "PART_MEMBERS", 64)
    docs = spark.createDataFrame(ROWS, odd.SCHEMA).repartition(5)
    want = Counter(zip((r[0] for r in ROWS), odd.components([(r[0], r[1]) for r in ROWS])))
    assert Counter((r.doc_id, r.component_id) for r in jaccard.near_copies(docs).collect()) == want


def test_only_texts_of_the_keys_are_sent(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(50)] + [(99, None), (98, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keys = docs.where("doc_id % 10 = 3").select(words.text_key().alias("text_key"))
    got = jaccard.set_texts(docs.union(docs), keys, 4).collect()
    assert sorted(r.text for r in got) == sorted(t for i, t in rows if i % 10 == 3)
    assert all(r.n_shingles == 27 and len(r.bits) >= 8 for r in got)
