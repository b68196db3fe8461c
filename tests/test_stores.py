"""Lines with offsets, and stores of batches."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from grainmill.sources import batch_store, lines
from grainmill.streaming import carry


def plain_lines(body):
    out, at = [], 0
    for line in body.split(b"\n")[:-1]:
        out.append((at, line.removesuffix(b"\r").decode("utf-8", "replace")))
        at += len(line) + 1
    rest = body[at:]
    return out + ([(at, rest.decode("utf-8", "replace"))] if rest else [])


def test_ranges_of_any_size_give_each_line_once(tmp_path):
    rng = random.Random(1)
    for n in range(120):
        parts = [
            bytes(rng.choice(b"ab\xc3\xa9") for _ in range(rng.choice([0, 1, 3, 20]))) + rng.choice([b"\n", b"\r\n"])
            for _ in range(rng.randint(0, 12))
        ]
        body = b"".join(parts) + rng.choice([b"", b"tail"])
        path = tmp_path / f"{n}.jsonl"
        path.write_bytes(body)
        for split in (1, 2, 7, 1000):
            for read in (1, 5, 1000):
                got = [
                    row
                    for r in lines.byte_ranges(str(path), 0, len(body), split)
                    for b in lines.read_range(r, read)
                    for row in zip(b.column("offset").to_pylist(), b.column("value").to_pylist())
                ]
                assert got == plain_lines(body), (body, split, read)


def write_lines(folder, name, numbers, mode="w"):
    folder.mkdir(exist_ok=True)
    with open(folder / name, mode) as file:
        file.writelines(json.dumps({"n": n, "text": "é" * n}) + "\n" for n in numbers)


@pytest.mark.parametrize("split", [10, 97, 1 << 20])
def test_a_folder_of_lines(spark, tmp_path, split):
    write_lines(tmp_path / "in", "part-a-00.jsonl", range(30))
    write_lines(tmp_path / "in", "part-b-00.jsonl", range(30, 40))
    (tmp_path / "in" / "part-c-00.jsonl").write_bytes(b"")
    read = lines.read_lines(spark, str(tmp_path / "in" / "*.jsonl"), split_bytes=split)
    rows = read.collect()
    assert sorted(json.loads(r.value)["n"] for r in rows) == list(range(40))
    assert len({(r.path, r.offset) for r in rows}) == 40
    assert {r.source for r in rows} == {"a", "b"}
    for r in rows:
        assert open(r.path, "rb").read()[r.offset :].startswith(r.value.encode())
    if split == 10:
        assert read.rdd.getNumPartitions() > 40


def test_folders_without_files(spark, tmp_path):
    with pytest.raises(ValueError):
        lines.read_named(spark, {"a": str(tmp_path / "none-*.jsonl")})
    with pytest.raises(ValueError):
        lines.read_lines(spark, str(tmp_path / "x.csv"))
    (tmp_path / "empty.jsonl").write_bytes(b"")
    assert lines.read_lines(spark, str(tmp_path / "empty.jsonl")).collect() == []


def test_a_stream_takes_new_files_and_new_lines(spark, tmp_path):
    folder, seen = tmp_path / "in", []

    def step(batch, n):
        seen.append(sorted(json.loads(r.value)["n"] for r in batch.collect()))

    def run():
        stream = lines.stream_lines(spark, str(folder / "*.jsonl"), split_bytes=50)
        carry.run_batches(stream, step, str(tmp_path / "c"))

    write_lines(folder, "part-a-00.jsonl", range(5))
    run()
    write_lines(folder, "part-a-00.jsonl", range(5, 8), "a")
    write_lines(folder, "part-b-00.jsonl", range(8, 10))
    with open(folder / "part-b-00.jsonl", "a") as file:
        file.write('{"n": 10, ')  # the end of this line comes later
    run()
    with open(folder / "part-b-00.jsonl", "a") as file:
        file.write('"text": ""}\n')
    run()
    assert [s for s in seen if s] == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [10]]


def batches(spark, n, first=0):
    rows = [(i, i % 3, first + i // 3 // 4, i // 3, "t%d" % i) for i in range(n)]
    return spark.createDataFrame(rows, "id long, rank int, batch_id long, pos long, text string").repartition(4)


def test_a_store_gives_batches_back_in_order(spark, tmp_path):
    path = str(tmp_path / "store")
    batch_store.write_batch_store(batches(spark, 200), path, file_bytes=300)
    batch_store.write_batch_store(batches(spark, 20, first=100), path)
    got = batch_store.read_batch_store(spark, path)
    want = sorted(map(tuple, batches(spark, 200).collect() + batches(spark, 20, first=100).collect()))
    assert sorted(map(tuple, got.collect())) == want
    files = batch_store.read_manifests(path)[1]
    assert sum(f.rows for f in files) == 220 and len(files) > 6
    # A batch is in one file, and its rows are in order there.
    owners = [(f.rank, b) for f in files for b in range(f.first_batch, f.last_batch + 1)]
    assert len(owners) == len(set(owners))
    for f in files:
        rows = spark.read.parquet(f"{path}/{f.name}").collect()
        assert [(r.batch_id, r.pos) for r in rows] == sorted((r.batch_id, r.pos) for r in rows)


@pytest.mark.parametrize(
    "condition", ["batch_id >= 9 AND rank = 1", "batch_id > 9", "batch_id < 2", "batch_id <= 2 AND rank IN (0, 2)",
                  "batch_id = 4", "rank = 7", "text = 't5'"],
)
def test_files_that_cannot_match_are_not_opened(spark, tmp_path, condition):
    path = str(tmp_path / "store")
    df = batches(spark, 200)
    batch_store.write_batch_store(df, path, file_bytes=300)
    files = batch_store.read_manifests(path)[1]
    want = sorted(map(tuple, df.where(condition).collect()))
    may = [f for f in files if any(f.rank == r[1] and f.first_batch <= r[2] <= f.last_batch for r in want)]
    if "text" not in condition:
        for f in files:  # whoever opens one of the others will know
            if f not in may:
                (tmp_path / "store" / f.name).write_bytes(b"not a file of batches")
    got = batch_store.read_batch_store(spark, path).where(condition)
    assert sorted(map(tuple, got.collect())) == want


def test_which_files_filters_plan(spark, tmp_path):
    path = str(tmp_path / "store")
    batch_store.write_batch_store(batches(spark, 200), path, file_bytes=300)

    def planned(*filters):
        reader = batch_store.BatchReader({"path": path})
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return {(f.rank, f.first_batch) for f in reader.planned()}

    rank, batch = ("rank",), ("batch_id",)
    every = planned()
    assert {r for r, _ in planned(EqualTo(rank, 1))} == {1} and planned(EqualTo(rank, 5)) == set()
    assert {r for r, _ in planned(In(rank, (0, 2)))} == {0, 2}
    last = {f.first_batch: f.last_batch for f in batch_store.read_manifests(path)[1]}
    assert planned(GreaterThanOrEqual(batch, 9)) == {(r, a) for r, a in every if last[a] >= 9}
    assert planned(GreaterThan(batch, 9)) == {(r, a) for r, a in every if last[a] > 9}
    assert planned(LessThan(batch, 3)) == {(r, a) for r, a in every if a < 3}
    assert planned(LessThanOrEqual(batch, 3)) == {(r, a) for r, a in every if a <= 3}
    assert planned(EqualTo(("text",), "t5")) == every


def test_a_changed_file_and_an_unfinished_write_are_noticed(spark, tmp_path):
    path = str(tmp_path / "store")
    batch_store.write_batch_store(batches(spark, 30), path)
    before = batch_store.read_manifests(path)
    writer = batch_store.BatchWriter({"path": path}, batches(spark, 1).schema)
    done = writer.write(iter(batches(spark, 30).sort("rank", "batch_id").toArrow().to_batches()))
    assert batch_store.read_manifests(path) == before  # without a commit there is nothing new
    writer.abort([done, None])
    assert not (tmp_path / "store" / done.files[0].name).exists()
    file = tmp_path / "store" / before[1][0].name
    file.write_bytes(file.read_bytes()[:-1] + b"?")
    with pytest.raises(Exception, match="not as it was written"):
        batch_store.read_batch_store(spark, path).collect()


def test_stores_refuse_what_they_cannot_keep(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(Exception, match="no store of batches"):
        batch_store.read_batch_store(spark, str(tmp_path / "none")).collect()
    bad = batches(spark, 5).withColumn("rank", F.when(F.col("id") > 2, F.col("rank")))
    with pytest.raises(Exception, match="must not be null"):
        batch_store.write_batch_store(bad, path)
    writer = batch_store.BatchWriter({"path": path}, bad.schema)
    with pytest.raises(ValueError, match="sorted"):
        writer.write(iter(batches(spark, 30).sort("rank", F.desc("batch_id")).toArrow().to_batches()))
    batch_store.write_batch_store(batches(spark, 5).limit(0), path)
    assert batch_store.read_batch_store(spark, path).collect() == []
