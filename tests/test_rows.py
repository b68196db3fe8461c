"""Sources, sinks, shards, dispatch and metrics."""

import datetime as dt

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from grainmill.operators import dispatch, metrics, order, sharding
from grainmill.sources import jsonl, sinks, tables

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "part-wiki-01.jsonl").write_text('{"id": 1, "text": "a"}\n{"id": 2, "text": "b"}\n')
    (tmp_path / "part-news-01.jsonl").write_text('{"id": 3, "text": "c"}\n')
    return tmp_path


def test_named_patterns(spark, folder):
    got = jsonl.read_jsonl(
        spark, {"w": f"{folder}/*wiki*.jsonl", "n": f"{folder}/*news*.jsonl"}, ROW
    )
    assert sorted(map(tuple, got.select("name", "id").collect())) == [("n", 3), ("w", 1), ("w", 2)]
    with pytest.raises(ValueError, match="no file matches"):
        jsonl.read_jsonl(spark, {"x": f"{folder}/*none*.jsonl"}, ROW)
    with pytest.raises(ValueError):
        jsonl.read_jsonl(spark, {}, ROW)
    with pytest.raises(ValueError):
        jsonl.read_jsonl(spark, {"x": f"{folder}/*.json"}, ROW)


def test_lines_and_rejects(spark, folder, tmp_path):
    (folder / "part-bad-01.jsonl").write_text('{"id": 9, "text"\n{"id": 4, "text": "d"}\n')
    lines = jsonl.read_lines(spark, f"{folder}/*.jsonl")
    rows = jsonl.parse_lines(lines, ROW)
    good, bad = dispatch.accepted(rows), dispatch.rejects(rows)
    assert sorted((r.id, r.source) for r in good.collect()) == [
        (1, "wiki"), (2, "wiki"), (3, "news"), (4, "bad")
    ]
    row = bad.first()
    assert row[jsonl.CORRUPT] == '{"id": 9, "text"' and row.reject_reason == "invalid JSON"
    sinks.write_rejects(bad, str(tmp_path / "rejects"))
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 1
    with pytest.raises((PySparkException, Py4JJavaError)):
        jsonl.parse_lines(lines, ROW, strict=True).collect()
    with pytest.raises((PySparkException, Py4JJavaError)):
        jsonl.read_jsonl(spark, {"x": f"{folder}/*.jsonl"}, ROW).collect()


def test_listed_files(spark, folder):
    files = tables.list_files(spark, f"{folder}/*.jsonl").select("path")
    got = sharding.number_paths(files, repeat=2).orderBy("shard_idx").collect()
    names = [r.path.rsplit("-", 2)[1] for r in got]
    assert names == ["news", "wiki", "news", "wiki"]
    assert [r.shard_idx for r in got] == [0, 1, 2, 3]


def test_round_robin_and_trim(spark):
    files = spark.range(7).withColumnRenamed("id", "shard_idx")
    ranks = sharding.assign_rank(files, 3).orderBy("shard_idx").collect()
    assert [r["rank"] for r in ranks] == [0, 1, 2, 0, 1, 2, 0]
    assert sharding.trim_shards(files, 3).count() == 6


def test_shuffled_paths_are_numbered_once_each(spark):
    paths = spark.range(50).select(F.concat(F.lit("p"), "id").alias("path"))
    got = sharding.number_paths(paths, seed=42, repeat=2)
    assert sorted(r.shard_idx for r in got.collect()) == list(range(100))
    again = sharding.number_paths(paths.repartition(5), seed=42, repeat=2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_ranks_are_disjoint_and_complete(spark, tmp_path):
    rows = sharding.assign_batches(spark.range(103).withColumnRenamed("id", "pos"), 4, 5)
    sizes = [(r["rank"], r.batch_id, r["count"]) for r in
             rows.groupBy("rank", "batch_id").count().collect()]
    assert sum(n for *_, n in sizes) == 103 and max(n for *_, n in sizes) == 5
    assert {r for r, *_ in sizes} == {0, 1, 2, 3}
    assert order.skip_batches(rows, 2).count() == 103 - 4 * 2 * 5
    sinks.write_batches(rows, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    cols = ["pos", "rank", "batch_id"]
    assert sorted(map(tuple, back.select(cols).collect())) == sorted(
        map(tuple, rows.select(cols).collect())
    )


def test_rank_of_row(spark):
    df = spark.range(12).select(F.col("id").alias("pos"), (F.col("id") % 4).alias("shard"))
    whole = df.select(sharding.rank_of_row(F.col("shard"), F.col("pos"), 4, 2).alias("r"), "shard")
    assert whole.distinct().count() == 4
    rows = df.select(sharding.rank_of_row(F.col("shard"), F.col("pos"), 4, 3).alias("r"))
    assert [r.n for r in rows.groupBy("r").agg(F.count("*").alias("n")).collect()] == [4, 4, 4]


def test_dispatch(spark):
    df = spark.createDataFrame(
        [("a", "x y"), ("b", "x"), ("a", None), (None, "x"), ("a", "")], "source string, text string"
    )
    lists = F.transform(F.filter(F.split("text", " "), lambda w: w != ""), lambda w: F.array(F.ascii(w)))
    got = dispatch.apply_by_source(df, {"a": lists}, out="ids")
    rows = [(r.source, r.text, r.ids, r.reject_reason) for r in got.collect()]
    assert rows == [
        ("a", "x y", [120], None),
        ("a", "x y", [121], None),
        ("b", "x", None, "unknown source"),
        ("a", None, None, "transform gave nothing"),
        (None, "x", None, "unknown source"),
    ]
    one = dispatch.apply_by_source(df, {"a": F.col("text")}, out="t")
    assert dispatch.accepted(one).count() == 2
    with pytest.raises(TypeError):
        dispatch.apply_by_source(df, {"a": F.length("text")}, out="n")


def test_interval_rows(spark):
    steps = spark.range(11).withColumnRenamed("id", "step")
    assert [r.step for r in metrics.interval_rows(steps, 5).collect()] == [5, 10]
    assert [r.step for r in metrics.interval_rows(steps, 5, include_zero=True).collect()] == [0, 5, 10]


def test_throughput_with_one_hot_run(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("hot", i, start + dt.timedelta(seconds=30 * i)) for i in range(1000)]
    rows += [(f"r{i}", i, start) for i in range(50)]
    log = spark.createDataFrame(rows, "run string, event bigint, ts timestamp")
    steps = metrics.number_steps(log, run="run", ts="ts", tie="event", slice_seconds=600)
    assert [r.step for r in steps.filter("run = 'hot'").orderBy("ts").collect()] == list(range(1000))
    got = metrics.throughput(steps, 10, 600).orderBy("step").collect()
    assert [r.step for r in got] == list(range(10, 1000, 10))
    assert {(r.seconds, r.tokens_per_second) for r in got} == {(300.0, 20.0)}


def test_timestamps_without_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-01 10:20:30.123456' AS ts")
    want = int(dt.datetime(2024, 3, 1, 10, 20, 30, tzinfo=dt.timezone.utc).timestamp()) * 10**6 + 123456
    assert df.select(metrics.micros(df, "ts")).first()[0] == want


def test_token_budget(spark):
    df = spark.createDataFrame([("a", 3, 2), ("a", 4, 0), ("b", 1, 1)], "source string, n int, l int")
    got = metrics.token_budget(df, F.col("n"), F.col("l")).orderBy("source").collect()
    assert [tuple(r) for r in got] == [("a", 2, 7, 2), ("b", 1, 1, 1)]


def test_small_sources_and_logs(spark, tmp_path):
    assert tables.prompt_set(spark, ["p", "q"]).count() == 2
    path = str(tmp_path / "log")
    for step in (1, 2):
        log = spark.createDataFrame([("r", step, 0.5)], "run string, data_step int, loss double")
        sinks.append_step_log(log, path)
    assert spark.read.parquet(path).count() == 2
    assert tables.via_table(spark.range(5), "t").count() == 5
