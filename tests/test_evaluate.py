"""User transforms: rows that fail alone, and results of several types in one column."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from grainmill.operators import evaluate
from grainmill.operators.dispatch import accepted, rejects

SCHEMA = "id int, source string, text string"


def batch_of(n):
    return pa.record_batch([pa.array(range(n), pa.int32())], names=["id"])


def test_failing_rows_are_found_alone():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(0, 60)
        bad = set(rng.sample(range(n), rng.randint(0, min(n, 5))))
        calls = 0

        def fn(batch):
            nonlocal calls
            calls += 1
            for i in batch.column("id").to_pylist():
                if i in bad:
                    raise KeyError(f"row {i}")
            return [str(i) for i in batch.column("id").to_pylist()]

        got = evaluate.isolate(fn, batch_of(n))
        want = [(None, f"transform failed: KeyError: 'row {i}'") if i in bad else (str(i), None) for i in range(n)]
        assert got == want
        assert calls <= 1 + 2 * len(bad) * (max(n, 1).bit_length() + 1)


def test_a_wrong_number_of_results_is_a_failure():
    assert evaluate.isolate(lambda b: ["one"], batch_of(1)) == [("one", None)]
    got = evaluate.isolate(lambda b: ["one", "two"], batch_of(2))
    assert got == [("one", None), ("two", None)]
    got = evaluate.isolate(lambda b: [], batch_of(2))
    assert [e for _, e in got] == ["transform failed: ValueError: 0 results for 1 rows"] * 2


@pytest.mark.parametrize(
    "result,want",
    [
        ("x", [("text", "x", None, None)]),
        ("", [("text", "", None, None)]),
        (None, [(None, None, None, "transform gave nothing")]),
        ([], [(None, None, None, "unsupported result: an empty list")]),
        (3, [(None, None, None, "unsupported result: int")]),
        ({"a": 1}, [(None, None, None, "unsupported result: dict")]),
        (["a"], [(None, None, None, "unsupported result: list")]),
        ([[1, "a"]], [(None, None, None, "unsupported result: a list that does not hold ids")]),
        ([[1, None]], [(None, None, None, "unsupported result: a list that does not hold ids")]),
        ([[1 << 40]], [(None, None, None, "unsupported result: a list that does not hold ids")]),
    ],
)
def test_results(result, want):
    assert evaluate.entries(result, None) == want


def test_lists_of_ids():
    got = evaluate.entries([[1, 2], [], np.array([3]), (4,)], None)
    assert [(k, list(ids)) for k, _, ids, _ in got] == [("ids", [1, 2]), ("ids", []), ("ids", [3]), ("ids", [4])]


def upper(batch):
    if pc.any(pc.equal(batch.column("text"), "bad")).as_py():
        raise ValueError("bad text")
    return pc.utf8_upper(batch.column("text"))


@evaluate.each_row
def letters(row):
    return [[ord(c) for c in word] for word in row["text"].split()]


def transforms():
    return {"up": upper, "let": letters, "raw": None, "col": F.concat("text", F.lit("!"))}


ROWS = [
    (1, "up", "a"), (2, "up", "bad"), (3, "up", None), (4, "let", "ab c"), (5, "let", ""), (6, "let", None),
    (7, "raw", "as it is"), (8, "col", "x"), (9, "col", None), (10, "else", "x"), (11, None, "x"), (2, "up", "bad"),
]


def expected():
    failed = "transform failed: "
    return [
        (1, "text", "A", None, None), (2, None, None, None, failed + "ValueError: bad text"),
        (2, None, None, None, failed + "ValueError: bad text"), (3, None, None, None, "transform gave nothing"),
        (4, "ids", None, [97, 98], None), (4, "ids", None, [99], None),
        (5, None, None, None, "unsupported result: an empty list"),
        (6, None, None, None, failed + "AttributeError: 'NoneType' object has no attribute 'split'"),
        (7, "row", None, None, None), (8, "text", "x!", None, None), (9, None, None, None, "transform gave nothing"),
        (10, None, None, None, "unknown source"), (11, None, None, None, "unknown source"),
    ]


def flat(df):
    rows = df.select("id", "result.*", "reject_reason").collect()
    return sorted(map(tuple, rows), key=lambda r: (r[0], r[3] or []))


def test_all_kinds_in_one_pass(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    done = evaluate.apply_transforms(df, transforms())
    assert flat(done) == expected()
    assert accepted(done).count() == 5 and rejects(done).count() == 8
    assert evaluate.apply_transforms(df.limit(0), transforms()).collect() == []


def test_without_transforms_every_row_goes_through(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    done = evaluate.apply_transforms(df, {})
    assert {r["result"]["kind"] for r in done.collect()} == {"row"} and rejects(done).count() == 0


def test_names_that_clash(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns(
        {"result": F.lit("old"), "kind": F.lit(1), "a.b": F.lit(2), "ids": F.lit(3)}
    )
    done = evaluate.apply_transforms(df, transforms())
    assert flat(done) == expected() and {"kind", "a.b", "ids"} <= set(done.columns)


def test_functions_see_the_rows_of_their_sources_only(spark):
    @evaluate.each_row
    def check(row):
        assert row["source"] == "up"
        return "fine"

    df = spark.createDataFrame(ROWS, SCHEMA)
    done = evaluate.apply_transforms(df, {"up": check, "let": None, "raw": None, "col": None, "else": None})
    assert rejects(done).select("id").collect() == [(11,)]


def test_a_wrong_column_is_an_error_when_the_query_is_built(spark):
    with pytest.raises(TypeError):
        evaluate.apply_transforms(spark.createDataFrame(ROWS, SCHEMA), {"up": F.length("text")})


def test_variants(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    done = evaluate.apply_transforms(df, transforms()).withColumn(
        "v", evaluate.as_variant("result", df.columns)
    )
    got = {r.id: r.s for r in done.where("id in (1, 2, 7, 8)").select("id", F.to_json("v").alias("s")).collect()}
    assert got == {1: '"A"', 2: None, 7: '{"id":7,"source":"raw","text":"as it is"}', 8: '"x!"'}


def test_on_a_stream(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    done = evaluate.apply_transforms(stream, transforms())
    query = (
        done.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert flat(spark.read.parquet(str(tmp_path / "out"))) == expected()
