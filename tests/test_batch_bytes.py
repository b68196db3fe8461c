"""Python workers get few rows at once, and make a small part of the result at a time."""

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from grainmill.functions import steps
from grainmill.sources.tables import read_table

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_of_a_table_are_small(spark, tmp_path):
    def bytes_of_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([pc.sum(pc.binary_length(batch)).as_py()] * len(batch), pa.int64())

    spark.conf.unset(KEY)
    rows = spark.range(3000, numPartitions=1).select(F.repeat(F.col("id").cast("string"), 3000).alias("text"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    table = read_table(spark, str(tmp_path), "t")
    seen = table.select(F.arrow_udf(bytes_of_batches, "long")("text").alias("n"))
    assert seen.agg(F.max("n")).first()[0] < 5 << 20


def test_a_smaller_setting_stays(spark, tmp_path):
    spark.conf.set(KEY, str(1 << 20))
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    assert read_table(spark, str(tmp_path), "t").count() == 3
    assert spark.conf.get(KEY) == str(1 << 20)
    spark.conf.unset(KEY)


def test_parts_of_a_batch_are_small():
    texts = pa.array(["x" * 1000] * 4000)
    assert max(pc.sum(pc.binary_length(p)).as_py() for p in steps.text_steps(texts)) < 5 << 18
    lists = pa.array([[1] * 1000] * 1000)
    assert max(len(p.flatten()) for p in steps.list_steps(lists)) < 5 << 16
