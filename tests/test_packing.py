"""Packing and ordering against plain loops, for different slicings and skews."""

import random

import pytest
from pyspark.sql import functions as F

from grainmill import PrepConfig
from grainmill.constants import PAD_ID
from grainmill.functions.hashing import shard_of, shuffle_key
from grainmill.functions.text import code_points
from grainmill.operators import order, packing
from grainmill.plans import prepare


def loop_groups(docs, length, n, pad=3):
    out = []
    for g in range(len(docs) // n):
        ids = [t for d in docs[g * n : (g + 1) * n] for t in d]
        ids += [pad] * (-len(ids) % length)
        out += [(g, i // length, ids[i : i + length]) for i in range(0, len(ids), length)]
    return out


def loop_stream(docs, length):
    """A reader with a token cache."""
    cache, out = [], []
    for d in docs:
        cache = cache + d
        while len(cache) >= length:
            out.append(cache[:length])
            cache = cache[length:]
    return out


def packed(rows):
    return sorted((r.grp, r.chunk, r.input_ids) for r in rows.collect())


def test_split_sequences(spark):
    rows = spark.createDataFrame(
        [(1, [5, 6, 7, 8, 9, 10, 11]), (2, [5, 6]), (3, [5, 6, 7]), (4, [])],
        "doc_id int, input_ids array<int>",
    )
    got = packing.split_sequences(rows, 3).orderBy("doc_id", "chunk").collect()
    assert [(r.doc_id, r.chunk, r.input_ids) for r in got] == [
        (1, 0, [5, 6, 7]), (1, 1, [8, 9, 10]), (3, 0, [5, 6, 7])
    ]


@pytest.mark.parametrize(
    "docs, length, want",
    [
        ([[5, 6, 7], [8, 9], [10]], 4, [(0, 0, [5, 6, 7, 8]), (0, 1, [9, 3, 3, 3])]),
        ([[5, 6], [7, 8]], 4, [(0, 0, [5, 6, 7, 8])]),
        ([[], []], 4, []),
    ],
)
def test_pack_groups(spark, docs, length, want):
    rows = [(0, 0, i, d) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "shard int, cell int, before bigint, input_ids array<int>")
    df = df.withColumn("first_span", F.lit(0)).withColumn("end_span", F.lit(99))
    assert packed(packing.pack_groups(df, length, 2)) == want


def test_pack_stream_fixture(spark):
    docs = [[5, 6, 7, 8, 9, 10, 11], [12], [13]]
    df = spark.createDataFrame(
        [(0, 0, i, b, 0, 3, d) for i, (d, b) in enumerate(zip(docs, [0, 7, 8]))],
        "shard int, cell int, pos bigint, before bigint, first_span bigint, end_span bigint, "
        "input_ids array<int>",
    )
    chunks = packing.pack_stream(df, 3)
    ids = [r.input_ids for r in chunks.orderBy("chunk").collect()]
    assert ids == [[5, 6, 7], [8, 9, 10], [11, 12, 13]]


def random_docs(n, longest, seed=1):
    rng = random.Random(seed)
    return {k: [rng.randint(4, 99) for _ in range(rng.randint(0, longest))] for k in range(n)}


def shuffled_docs(spark, docs, num_shards, seed=42):
    """Documents of each shard in the order that the engine gives them."""
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, input_ids array<int>")
    df = df.withColumn("shard", shard_of(seed, F.col("doc_id"), num_shards))
    keyed = df.withColumn("k", shuffle_key(seed, F.col("doc_id"))).orderBy("k").collect()
    by_shard = {}
    for r in keyed:
        by_shard.setdefault(r.shard, []).append(r.input_ids)
    return df, by_shard


@pytest.mark.parametrize(
    "n_slices, n_docs, longest, length",
    [(1, 200, 30, 7), (3, 200, 30, 7), (64, 200, 30, 7), (9, 60, 3, 50), (40, 9, 90, 4)],
)
def test_stream_packing_equals_a_loop(spark, n_slices, n_docs, longest, length):
    df, by_shard = shuffled_docs(spark, random_docs(n_docs, longest), 3)
    cfg = PrepConfig(mode="pretrain", seq_length=length, num_shards=3)
    chunks = prepare.pack_tokens(
        df, cfg, lambda ids: ids, F.size("input_ids"), text="input_ids", n_slices=n_slices
    )
    got = {}
    for r in chunks.orderBy("shard", "chunk").collect():
        got.setdefault(r.shard, []).append(r.input_ids)
    want = {s: loop_stream(d, length) for s, d in by_shard.items()}
    assert got == {s: w for s, w in want.items() if w}


@pytest.mark.parametrize("n_slices", [1, 8, 64])
def test_repeated_keys_lose_nothing(spark, n_slices):
    """Each key on several rows, equal and different ones: every token is packed once."""
    docs = random_docs(60, 30)
    rows = [(k, d) for k, d in docs.items()] + [(k, d) for k, d in docs.items()]
    rows += [(k, [200 + k] * (k % 5 + 1)) for k in docs]
    df = spark.createDataFrame(rows, "doc_id bigint, input_ids array<int>")
    cfg = PrepConfig(mode="pretrain", seq_length=1, num_shards=1)
    chunks = prepare.pack_tokens(
        df, cfg, lambda ids: ids, F.size("input_ids"), text="input_ids", n_slices=n_slices
    )
    got = sorted(r.input_ids[0] for r in chunks.collect())
    assert got == sorted(i for _, d in rows for i in d)
    cfg = PrepConfig(
        mode="pretrain", seq_length=10, pad_to_max=False, sequence_sample_mode="none",
        concat_multiple_sequence=True, num_sequences=4, num_shards=1,
    )
    texts = df.select("doc_id", F.col("input_ids").alias("text"))
    packed_rows = prepare.pretrain(texts, cfg, lambda ids: ids, n_slices=n_slices)
    tokens = sorted(i for r in packed_rows.collect() for i in r.input_ids if i != PAD_ID)
    assert tokens == sorted(i for _, d in rows for i in d)


@pytest.mark.parametrize(
    "num_shards, num_sequences, n_slices",
    [(1, 4, 1), (1, 4, 7), (3, 10, 200), (3, 10, None), (5, 1, 7), (2, 500, 7)],
)
def test_pretrain_packing_equals_a_loop(spark, num_shards, num_sequences, n_slices):
    texts = {k: "".join(map(chr, ids)) for k, ids in random_docs(150, 40).items()}
    docs = {k: [ord(c) + 4 for c in t] for k, t in texts.items()}
    _, by_shard = shuffled_docs(spark, docs, num_shards)
    cfg = PrepConfig(
        mode="pretrain", seq_length=16, pad_to_max=False, sequence_sample_mode="none",
        concat_multiple_sequence=True, num_sequences=num_sequences, num_shards=num_shards,
    )
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = prepare.pretrain(df, cfg, code_points, n_slices=n_slices)
    got = sorted((r.shard, r.grp, r.chunk, r.input_ids, r.labels) for r in rows.collect())
    want = sorted(
        (s, g, c, ids, [-100 if t == 3 else t for t in ids])
        for s, d in by_shard.items()
        for g, c, ids in loop_groups(d, 16, num_sequences)
    )
    assert got == want


def test_sampled_rows_are_packed(spark):
    """Each row is cut to a window that ends in the end token, then groups are packed."""
    texts = {k: "x" * k for k in range(1, 41)}
    cfg = PrepConfig(
        mode="pretrain", seq_length=8, pad_to_max=False, sequence_sample_mode="sample",
        concat_multiple_sequence=True, num_sequences=5,
    )
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = prepare.pretrain(df, cfg, code_points).collect()
    ids = [t for r in rows for t in r.input_ids if t != 3]
    assert len(ids) == sum(min(k, 8) for k in texts) and ids.count(2) == len(texts)
    assert {r.grp for r in rows} == set(range(8))


def test_positions_with_one_hot_group(spark):
    """A third of all rows in one group: every row is numbered, for any number of slices."""
    df = spark.range(3000).withColumn(
        "grp", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
    )
    got = order.with_shuffled_positions(df, "id", 7, group=["grp"], n_slices=50)
    hot = [r.pos for r in got.filter("grp = 'hot'").orderBy("pos").collect()]
    assert hot == list(range(1000))
    assert got.filter("grp <> 'hot' and pos = 0").count() == 2000


def test_positions_agree_with_the_shuffle(spark):
    df = spark.range(500)
    in_order = [r.id for r in order.shuffle_rows(df, "id", 42).collect()]
    placed = order.with_shuffled_positions(df, "id", 42, n_slices=13)
    assert [r.id for r in placed.orderBy("pos").collect()] == in_order
    assert in_order != sorted(in_order)
    again = order.shuffle_rows(df.repartition(1), "id", 42)
    assert [r.id for r in again.collect()] == in_order


def test_limits(spark):
    df = spark.range(5000)
    assert [r.id for r in order.sanity_limit(df, "id").collect()] == list(range(1000))
    assert order.sanity_limit(spark.range(5), "id").count() == 5
    assert order.peek(df).count() == 11


def test_rows_are_ranked_within_slices(spark):
    """Only the small table of counts per slice may be gathered in one task."""
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    placed = order.with_shuffled_positions(df, "doc_id", 42)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    ranking = [line for line in plan.splitlines() if "row_number()" in line and "Window" in line]
    assert ranking and all("windowspecdefinition(_slice" in line for line in ranking)


def test_packing_moves_wide_rows_once(spark):
    cfg = PrepConfig(
        mode="pretrain", seq_length=16, pad_to_max=False, sequence_sample_mode="none",
        concat_multiple_sequence=True, num_sequences=2, num_shards=3,
    )
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = prepare.pretrain(df, cfg, lambda c: F.transform(F.split(c, ""), F.ascii))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.split("BroadcastExchange")[0].count("Exchange hashpartitioning") == 1
    stream = prepare.pack_tokens(df, cfg, lambda c: F.array(F.ascii(c)), F.lit(1))
    plan = stream._jdf.queryExecution().executedPlan().toString()
    assert plan.split("BroadcastExchange")[0].count("Exchange hashpartitioning") == 1


def hot_rows(spark):
    """A third of all rows has one key, half of those are equal in all."""
    rng = random.Random(4)
    rows = [(k, 0, [100 + k] * rng.randint(0, 6)) for k in range(4000)]
    rows += [(7, 0, [5] * (1 + i % 3) if i % 2 else [6, 6]) for i in range(1700)]
    rows += [(None, 0, [9, 9, 9])] * 300
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k long, shard int, input_ids array<int>").repartition(6)


@pytest.mark.parametrize("slices", [1, 16])
def test_a_key_with_a_third_of_all_rows(spark, slices):
    rows, df = hot_rows(spark)
    placed = order.with_shuffled_spans(
        df.withColumn("n", F.size("input_ids")), "k", 3, 10, shard="shard", num_shards=1, weight="n", n_slices=slices
    )
    chunks = packing.pack_stream(placed, 10, keep_tail=True)
    got = sorted(t for r in chunks.collect() for t in r.input_ids)
    assert got == sorted(t for _, _, ids in rows for t in ids)
    assert sorted(r.chunk for r in chunks.collect()) == list(range(-(-len(got) // 10)))
    groups = order.with_shuffled_spans(df, "k", 3, 8, shard="shard", num_shards=1, n_slices=slices)
    packed_groups = packing.pack_groups(groups, 4, 8)
    whole = [r.input_ids for r in packed_groups.collect()]
    assert sum(t != PAD_ID for ids in whole for t in ids) == len(got)  # 6,000 rows are whole groups


def test_no_cell_holds_a_hot_key(spark):
    rows, df = hot_rows(spark)
    placed = order.with_shuffled_spans(df, "k", 3, 8, shard="shard", num_shards=1, n_slices=6)
    sizes = [r["count"] for r in placed.groupBy("cell").count().collect()]
    assert len(sizes) == 6 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_the_place_of_copies_does_not_depend_on_slices(spark):
    _, df = hot_rows(spark)

    def chunks(slices):
        placed = order.with_shuffled_spans(
            df.withColumn("n", F.size("input_ids")), "k", 3, 10, shard="shard", num_shards=1, weight="n",
            n_slices=slices,
        )
        return {r.chunk: r.input_ids for r in packing.pack_stream(placed, 10).collect()}

    assert chunks(2) == chunks(23)
