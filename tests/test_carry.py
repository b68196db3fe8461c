"""Writes that take effect once, and streams whose leftovers are a table."""

import random

import pytest
from pyspark.sql import functions as F

from grainmill.constants import PAD_ID
from grainmill.functions.hashing import shuffle_key
from grainmill.operators import order
from grainmill.sources import sinks
from grainmill.sources.commits import WriteLog, read_writes, write_once
from grainmill.streaming import carry
from tests.test_packing import loop_groups, loop_stream, random_docs

SCHEMA = "doc_id bigint, shard int, input_ids array<int>"
N_FILES, N_SHARDS = 8, 3


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n int")


def read(spark, root, **options):
    return sorted(r.n for r in read_writes(spark, root, "t", "n int", **options).collect())


def test_a_write_takes_effect_once(spark, tmp_path):
    root = str(tmp_path)
    assert read(spark, root) == []
    assert write_once({"t": numbers(spark, 1, 2), "u": numbers(spark, 9)}, root, "a")
    assert not write_once({"t": numbers(spark, 3)}, root, "a")
    assert write_once({"t": numbers(spark, 1, 1)}, root, "b")
    assert read(spark, root) == [1, 1, 1, 2] and read(spark, root, only=["b"]) == [1, 1]
    assert read_writes(spark, root, "u", "n int").collect() == [(9,)]
    log = WriteLog(spark, root)
    assert log.ids() == ["a", "b"] and log.last_before("b") == "a" and log.last_before("a") is None
    with pytest.raises(ValueError):
        log.has("../a")


def test_a_write_that_did_not_end_is_not_seen(spark, tmp_path):
    root = str(tmp_path)
    numbers(spark, 7).write.parquet(f"{root}/t/a-lost")  # as a write that was stopped leaves it
    assert read(spark, root) == []
    assert write_once({"t": numbers(spark, 1)}, root, "a") and read(spark, root) == [1]


def test_of_two_attempts_one_counts(spark, tmp_path):
    root = str(tmp_path)
    log = WriteLog(spark, root)
    numbers(spark, 1).write.parquet(f"{root}/t/first")
    numbers(spark, 2).write.parquet(f"{root}/t/second")
    assert log.commit("a", {"t": "t/first"}) and not log.commit("a", {"t": "t/second"})
    assert read(spark, root) == [1]


def test_rows_and_rejects_in_one_write(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "bad"), (3, None)], "id int, reject_reason string")
    for _ in range(2):
        sinks.write_sorted_out(df, str(tmp_path), "b")
    schema = "id int, reject_reason string"
    assert sorted(r.id for r in sinks.read_sorted_out(spark, str(tmp_path), schema).collect()) == [1, 3]
    assert [r.id for r in sinks.read_sorted_out(spark, str(tmp_path), schema, rejected=True).collect()] == [2]
    sinks.write_sorted_out(df.where("id = 1"), str(tmp_path / "none"), "b")
    assert sinks.read_sorted_out(spark, str(tmp_path / "none"), schema, rejected=True).count() == 0


@pytest.fixture(scope="module")
def docs():
    """Lengths from 0 on; one shard has few rows, so some batches bring it nothing."""
    made = random_docs(90, 25, seed=9)
    return {k: (0 if k % 17 == 0 else 1 + k % 2, [] if k % 11 == 0 else ids) for k, ids in made.items()}


def file_of(k):
    return k * N_FILES // 90


@pytest.fixture
def stream(spark, docs, tmp_path):
    folder = str(tmp_path / "in")
    for f in range(N_FILES):
        rows = [(k, *v) for k, v in docs.items() if file_of(k) == f]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def played_twice(step, seen=None):
    def run(batch, n):
        step(batch, n)
        step(batch, n)
        if seen is not None:
            seen.append(n)

    return run


def lines(spark, docs):
    """Rows of each shard in the order of a stream: by file, then shuffled by key."""
    keys = spark.createDataFrame([(k,) for k in docs], "k bigint").select("k", shuffle_key(42, F.col("k")))
    place = {k: (file_of(k), h) for k, h in keys.collect()}
    out = {}
    for k in sorted(docs, key=place.__getitem__):
        out.setdefault(docs[k][0], []).append(docs[k][1])
    return out


def test_eight_files_of_tokens(spark, docs, stream, tmp_path):
    root, seen = str(tmp_path / "out"), []
    step = carry.pack_stream_step(root, 7)
    carry.run_batches(stream, played_twice(step, seen), str(tmp_path / "c"))
    assert seen == list(range(N_FILES))
    got = {}
    for r in carry.finished_rows(spark, root, carry.chunk_schema()).orderBy("shard", "chunk").collect():
        assert r.chunk == len(got.setdefault(r.shard, []))
        got[r.shard].append(r.input_ids)
    want = {s: loop_stream(d, 7) for s, d in lines(spark, docs).items()}
    assert got == {s: c for s, c in want.items() if c}
    left = carry.left_over(spark, root, carry.chunk_schema()).collect()
    tokens = {s: sum(map(len, d)) for s, d in lines(spark, docs).items()}
    assert {r.shard: (r.chunk, len(r.input_ids)) for r in left} == {s: divmod(n, 7) for s, n in tokens.items()}


def test_eight_files_of_groups(spark, docs, stream, tmp_path):
    root = str(tmp_path / "out")
    carry.run_batches(stream, played_twice(carry.pack_groups_step(root, 16, 4)), str(tmp_path / "c"))
    got = {}
    for r in carry.finished_rows(spark, root, carry.group_schema()).orderBy("shard", "grp", "chunk").collect():
        got.setdefault(r.shard, []).append((r.grp, r.chunk, r.input_ids))
    want = {s: loop_groups(d, 16, 4) for s, d in lines(spark, docs).items()}
    assert got == {s: c for s, c in want.items() if c}


def play_buffer(rows, size, slot):
    """Fill a buffer; then each row takes the place of another one, which goes out."""
    held, out = [], []
    for m, row in enumerate(rows):
        if m < size:
            held.append(row)
        else:
            out.append(held[slot[m]])
            held[slot[m]] = row
    return out, held


def test_a_shuffle_buffer(spark, docs, stream, tmp_path):
    root, size = str(tmp_path / "out"), 6
    columns = "doc_id bigint, input_ids array<int>"
    step, most = carry.shuffle_step(root, size, columns, by=["doc_id"]), []

    def checked(batch, n):
        step(batch, n)
        step(batch, n)
        most.append(carry.left_over(spark, root, carry.shuffle_schema(columns)).groupBy("shard").count().collect())

    carry.run_batches(stream, checked, str(tmp_path / "c"))
    assert len(most) == N_FILES and max(r["count"] for b in most for r in b) <= size
    place = spark.range(100).select(
        "id", F.explode(F.array(*map(F.lit, range(N_SHARDS)))).alias("shard")
    ).select("id", "shard", order.buffer_slot(42, F.col("shard"), F.col("id"), size).alias("slot"))
    slots = {(r.shard, r.id): r.slot for r in place.collect()}
    rows = carry.flush_shuffle(spark, root, size, columns).orderBy("shard", "turn").collect()
    for shard in range(N_SHARDS):
        mine = [k for k in sorted(docs) if docs[k][0] == shard]
        out, held = play_buffer(mine, size, {m: slots[shard, m] for m in range(len(mine))})
        got = [r.doc_id for r in rows if r.shard == shard]
        assert got[: len(out)] == out and sorted(got[len(out) :]) == sorted(held)
        assert [r.turn for r in rows if r.shard == shard] == list(range(len(mine)))
        assert [r.input_ids for r in rows if r.shard == shard] == [docs[k][1] for k in got]


def test_a_shuffled_table(spark):
    """Without a stream: positions by any order, then turns; each row has one turn."""
    rng = random.Random(3)
    rows = [(rng.randrange(2), rng.randrange(30), i) for i in range(300)]
    df = spark.createDataFrame(rows, "shard int, place int, id int").repartition(6)
    placed = order.with_sorted_positions(df, ["place", "id"], group=["shard"], position="position")
    want = {}
    for shard, place, i in sorted(rows):
        want[i] = sum(1 for s, p, j in rows if s == shard and (p, j) < (place, i))
    assert {r.id: r.position for r in placed.collect()} == want
    turns = order.with_buffer_turns(placed, 1, 25, shard="shard", position="position")
    rest = turns.where("turn is null")
    assert {r["count"] for r in rest.groupBy("shard").count().collect()} == {25}
    out = turns.where("turn is not null").unionByName(
        order.with_flushed_turns(rest, 1, 25, shard="shard", position="position")
    )
    for shard in (0, 1):
        n = sum(r[0] == shard for r in rows)
        got = sorted(r.turn for r in out.where(F.col("shard") == shard).collect())
        assert got == list(range(n))


def test_padding_of_groups_is_the_pad_id(spark, stream, tmp_path):
    root = str(tmp_path / "out")
    carry.run_batches(stream, carry.pack_groups_step(root, 64, 2), str(tmp_path / "c"))
    rows = carry.finished_rows(spark, root, carry.group_schema()).collect()
    assert {len(r.input_ids) for r in rows} == {64} and any(r.input_ids[-1] == PAD_ID for r in rows)
