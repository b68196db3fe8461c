"""Top-k search with one row repeated more often than a block has places, and with large numbers."""

import random

import pytest

from grainmill.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def ranked(got):
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()}


def test_many_copies_of_one_row(spark):
    r = random.Random(8)
    few = [(i, [r.randint(-512, 512) / 256 for _ in range(4)]) for i in range(300)]
    few.append((300, few[0][1]))
    hot = spark.range(70_000).selectExpr("7000L AS vec_id", "cast(array(0.25, -0.5, 0.125, 1) AS array<float>) AS embedding")
    table = spark.createDataFrame(few, SCHEMA).union(hot)
    asked = [i for i, _ in few if i % 50 == 0]
    want = set()
    for q in asked:
        own = few[q][1]
        rows = [(i, v) for i, v in few if i != q] + [(7000, [0.25, -0.5, 0.125, 1])] * 5
        best = sorted((-int(sum(65536 * a * b for a, b in zip(own, v))), i) for i, v in rows)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert ranked(topk.top_k(table, table.where("vec_id % 50 = 0 and vec_id < 7000"))) == want


def test_index_has_one_row_for_copies(spark):
    table = spark.createDataFrame([(1, [0.5, 1.0])] * 40 + [(1, [0.25, 1.0]), (2, [0.5, 1.0])], SCHEMA)
    got = topk.top_k(table, table.where("vec_id = 2"), k=50)
    assert [(r["rank"], r.score) for r in got.orderBy("rank").collect()] == [
        (i + 1, 81920) for i in range(40)
    ] + [(41, 73728)]


def test_large_components_are_exact(spark):
    rows = [(0, [2.0**22, 1.0]), (1, [2.0**23, 0.0]), (2, [2.0**22, 1.0]), (3, [2.0**22, -1.0]), (4, [-(2.0**23), 3.0])]
    table = spark.createDataFrame(rows, SCHEMA)
    want = sorted(((-(2**16) * int(rows[0][1][0] * v[0] + rows[0][1][1] * v[1]), i) for i, v in rows[1:]))
    got = ranked(topk.top_k(table, table.where("vec_id = 0")))
    assert got == {(0, n + 1, i, -s) for n, (s, i) in enumerate(want)}


def test_component_beyond_long_is_refused(spark):
    table = spark.createDataFrame([(0, [1e30]), (1, [1.0])], SCHEMA)
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(table, table).count()
