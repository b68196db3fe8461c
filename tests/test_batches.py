"""User functions over exact batches of consecutive rows."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainmill.functions.hashing import shuffle_key
from grainmill.operators import batches

SCHEMA = "k long, shard int, v int"


def table(spark, n=210):
    """Two shards, one of them with two thirds of the rows."""
    return spark.createDataFrame([(i, int(i % 3 == 0), i * 7 % 11) for i in range(n)], SCHEMA).repartition(5)


def running(batch, shard, number):
    """N rows to as many as have a new largest value so far: it keeps something from row to row."""
    best, rows = -1, []
    for k, v in zip(batch.column("k").to_pylist(), batch.column("v").to_pylist()):
        if v > best:
            best = v
            rows.append((k, best, batch.num_rows))
    columns = list(zip(*rows))
    return pa.table({"k": columns[0], "best": columns[1], "size": columns[2]})


OUT = "k long, best int, size int"


def expected(spark, df, n, drop):
    out = []
    rows = df.withColumn("h", shuffle_key(7, F.col("k"))).collect()
    for shard in (0, 1):
        line = sorted((r for r in rows if r.shard == shard), key=lambda r: (r.h, r.k))
        for number in range(-(-len(line) // n)):
            part = line[number * n : (number + 1) * n]
            if len(part) < n and drop:
                continue
            best = -1
            for r in part:
                if r.v > best:
                    best = r.v
                    out.append((r.k, best, len(part), shard, number))
    return sorted(out)


@pytest.mark.parametrize("slices", [1, 8, 64])
@pytest.mark.parametrize("drop", [True, False])
def test_batches_of_any_number_of_slices(spark, slices, drop):
    df = table(spark)
    made = batches.map_batches(df, running, 16, OUT, key="k", seed=7, drop_last=drop, n_slices=slices)
    assert made.columns == ["k", "best", "size", "shard", "batch"]
    assert sorted(map(tuple, made.collect())) == expected(spark, df, 16, drop)


@pytest.mark.parametrize("n", [1, 500])
def test_single_rows_and_whole_shards(spark, n):
    df = table(spark)
    made = batches.map_batches(df, running, n, OUT, key="k", seed=7)
    assert sorted(map(tuple, made.collect())) == expected(spark, df, n, False)


def test_rows_that_share_a_key_are_all_given(spark):
    df = spark.createDataFrame([(1, 0, i) for i in range(100)] + [(2, 0, 5)] * 30, SCHEMA).repartition(3)

    def whole(batch, shard, number):
        return batch.select(["k", "v"])

    made = batches.map_batches(df, whole, 7, "k long, v int", key="k", seed=7, n_slices=9)
    assert sorted((r.k, r.v) for r in made.collect()) == sorted([(1, i) for i in range(100)] + [(2, 5)] * 30)
    assert sorted({r["count"] for r in made.groupBy("batch").count().collect()}) == [4, 7]


def test_empty_tables_and_functions_that_give_nothing(spark):
    df = table(spark)
    assert batches.map_batches(df.limit(0), running, 4, OUT, key="k", seed=7).collect() == []

    def nothing(batch, shard, number):
        return pa.table({"k": pa.array([], pa.int64())})

    assert batches.map_batches(df, nothing, 4, "k long", key="k", seed=7).collect() == []
    with pytest.raises(ValueError):
        batches.map_batches(df, running, 0, OUT, key="k", seed=7)
    with pytest.raises(ValueError):
        batches.map_batches(df, running, 4, "shard int", key="k", seed=7)


def test_batches_are_made_where_their_rows_are(spark):
    """After the exchange by (shard, cell) of the placing there is no other one."""
    made = batches.map_batches(table(spark), running, 4, OUT, key="k", seed=7)
    plan = made._jdf.queryExecution().executedPlan().toString()
    top = plan[plan.index("MapInArrow") :]
    assert "Exchange" not in top[: top.index("Window")]
