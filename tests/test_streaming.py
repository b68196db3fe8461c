"""Streams give what batches give, over several micro-batches and restarts."""

import weakref

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grainmill import PrepConfig
from grainmill.functions.text import code_points
from grainmill.operators.dispatch import accepted, rejects
from grainmill.plans import prepare
from grainmill.sources import jsonl
from grainmill.streaming import packing, run
from tests.test_packing import loop_groups, loop_stream, random_docs

SCHEMA = "doc_id bigint, shard int, input_ids array<int>"
N_SHARDS = 3


@pytest.fixture(scope="module")
def docs():
    return {k: (k % N_SHARDS, ids) for k, ids in random_docs(60, 25, seed=9).items()}


def write(spark, docs, folder, keys):
    rows = [(k, *docs[k]) for k in keys]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def by_shard(docs):
    out = {}
    for k in sorted(docs):
        out.setdefault(docs[k][0], []).append(docs[k][1])
    return out


def test_carry_over_packing(spark, docs, tmp_path):
    """Rows arrive in three files, the last one after a restart from the checkpoint."""
    args = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    write(spark, docs, tmp_path / "in", range(0, 20))
    write(spark, docs, tmp_path / "in", range(20, 40))
    first = run.run_to_table(packing.pack_stream_stateful(stream(spark, tmp_path / "in"), 7), *args)
    n_first = first.count()
    write(spark, docs, tmp_path / "in", range(40, 60))
    rows = run.run_to_table(packing.pack_stream_stateful(stream(spark, tmp_path / "in"), 7), *args)
    got = {}
    for r in rows.orderBy("shard", "chunk").collect():
        assert r.chunk == len(got.setdefault(r.shard, []))
        got[r.shard].append(r.input_ids)
    assert got == {s: loop_stream(d, 7) for s, d in by_shard(docs).items()}
    assert 0 < n_first < rows.count()


def test_group_packing(spark, docs, tmp_path):
    for part in (range(0, 25), range(25, 60)):
        write(spark, docs, tmp_path / "in", part)
    rows = run.run_to_table(
        packing.pack_groups_stateful(stream(spark, tmp_path / "in"), 16, 4),
        str(tmp_path / "out"), str(tmp_path / "checkpoint"),
    )
    got = sorted((r.shard, r.grp, r.chunk, r.input_ids) for r in rows.collect())
    want = sorted(
        (s, *g) for s, d in by_shard(docs).items() for g in loop_groups(d, 16, 4)
    )
    assert got == want


@pytest.mark.parametrize(
    "changes",
    [
        {},
        {"sequence_sample_mode": "sample"},
        {"sequence_sample_mode": "split"},
        {"sequence_sample_mode": "none", "pad_to_max": False},
    ],
)
def test_row_wise_preparation(spark, tmp_path, changes):
    rows = [(k, "".join(map(chr, ids))) for k, ids in random_docs(30, 40).items() if ids]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df.write.json(str(tmp_path / "json"))
    for i, f in enumerate(sorted((tmp_path / "json").glob("*.json"))):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"part-web-{i}.jsonl").write_bytes(f.read_bytes())
    source = jsonl.stream_jsonl(spark, str(tmp_path / "in"), df.schema, max_files=3)
    assert "source" in source.columns
    cfg = PrepConfig(mode="pretrain", seq_length=16, **changes)
    streamed = run.run_to_table(
        prepare.pretrain(source, cfg, code_points), str(tmp_path / "out"), str(tmp_path / "cp")
    )
    batch = prepare.pretrain(df, cfg, code_points)
    cols = [F.col(c) for c in batch.columns]
    assert sorted(map(tuple, streamed.select(cols).collect())) == sorted(map(tuple, batch.collect()))
    assert streamed.count() > 0


def test_a_bad_line_of_a_stream_is_a_reject(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "part-web-0.jsonl").write_text('{"doc_id": 1, "text": "good"}\n{"doc_id": 2, "te\n')
    schema = spark.createDataFrame([(1, "x")], "doc_id bigint, text string").schema
    lenient = jsonl.stream_jsonl(spark, str(tmp_path / "in"), schema, strict=False)
    rows = run.run_to_table(lenient, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [r.doc_id for r in accepted(rows).collect()] == [1]
    assert [r.reject_reason for r in rejects(rows).collect()] == ["invalid JSON"]
    strict = jsonl.stream_jsonl(spark, str(tmp_path / "in"), schema)
    with pytest.raises(Exception):
        run.run_to_table(strict, str(tmp_path / "out2"), str(tmp_path / "cp2"))


class Frames:
    """Frames of one row each, and how many of them are still held when the next one is asked for."""

    def __init__(self, sizes):
        self.sizes, self.live, self.most = sizes, [], 0

    def __iter__(self):
        for k, n in self.sizes:
            tokens = np.full(n, k, np.int32)
            self.live.append(weakref.ref(tokens))
            frame = pd.DataFrame({"doc_id": [k], "input_ids": [tokens]})
            del tokens
            yield frame
            del frame
            self.most = max(self.most, sum(r() is not None for r in self.live))


def test_rows_of_a_micro_batch_are_not_held():
    frames = Frames([(k, 1000) for k in (5, 3, 9, 1, 7, 8, 2, 6, 4, 0)])
    rows = [r[0] for r in packing._in_key_order(iter(frames), "doc_id", "input_ids") if len(r) == 1000]
    assert rows == list(range(10))
    assert frames.most <= 3


def test_equal_keys_and_empty_rows_stay_in_turn():
    ids = [np.array(x, np.int32) for x in ([4], [], [2, 2], [1])]
    frames = [pd.DataFrame({"doc_id": [2, 1, 2, 1], "input_ids": ids})]
    got = [r.tolist() for r in packing._in_key_order(iter(frames), "doc_id", "input_ids")]
    assert got == [[], [1], [4], [2, 2]]
