"""User functions over exact batches of n consecutive rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from grainmill.operators.order import with_shuffled_spans

# A batch and its number in the shard -> any number of rows.
BatchFunction = Callable[[pa.Table, int, int], pa.Table | pa.RecordBatch]

SHARD, NUMBER = "shard", "batch"


def _in_batches(columns: list[str], n: int, drop_last: bool, fn: BatchFunction, schema: pa.Schema):
    """Rows come sorted by shard and place; a task holds the rows of one batch."""

    def finish(rows: list[pa.RecordBatch], shard: int, number: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).select(columns)
        if table.num_rows < n and drop_last:
            return
        made = fn(table, shard, number)
        made = pa.Table.from_batches([made]) if isinstance(made, pa.RecordBatch) else made
        extra = [pa.array([v] * made.num_rows, t) for v, t in ((shard, pa.int32()), (number, pa.int64()))]
        whole = made.select(schema.names).cast(schema)
        for name, column in zip((SHARD, NUMBER), extra):
            whole = whole.append_column(name, column)
        yield from whole.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        now: tuple[int, int] | None = None
        for batch in batches:
            shards = batch.column("_shard").to_pylist()
            numbers = batch.column("_batch").to_pylist()
            a = 0
            for b in range(1, batch.num_rows + 1):
                here = shards[a], numbers[a]
                if b < batch.num_rows and (shards[b], numbers[b]) == here:
                    continue
                if now is not None and here != now:
                    yield from finish(rows, *now)
                    rows = []
                now = here
                rows.append(batch.slice(a, b - a))
                a = b
        if now is not None:
            yield from finish(rows, *now)

    return run


def map_batches(
    df: DataFrame,
    fn: BatchFunction,
    n: int,
    schema: str | StructType,
    *,
    key: str,
    seed: int,
    shard: str = SHARD,
    num_shards: int = 1,
    drop_last: bool = False,
    n_slices: int | None = None,
) -> DataFrame:
    """Rows that ``fn`` makes of every ``n`` consecutive rows of each shard's shuffled order.

    ``fn`` gets a ``pyarrow.Table`` with the columns of ``df``, its shard, and its number in the
    shard; it gives a table with the columns of ``schema``. What it keeps from row to row must
    begin anew with each batch, for batches run in any order and anywhere; the number may seed it.
    The last, shorter batch of a shard is left out with ``drop_last``. Output: ``schema``, then
    ``shard`` and ``batch``.

    Batches are spans of ``with_shuffled_spans``, so their rows are in one partition already; they
    are sorted there and handed over in place. The result does not depend on ``n_slices``.
    """
    if n < 1:
        raise ValueError("a batch has one row at least")
    spark = df.sparkSession
    wanted = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    if {SHARD, NUMBER} & set(wanted.names):
        raise ValueError(f"{SHARD} and {NUMBER} are added to the result")
    placed = with_shuffled_spans(df, key, seed, n, shard=shard, num_shards=num_shards, n_slices=n_slices)
    number = F.floor(F.col("before") / n)
    rows = (
        placed.withColumn("_batch", number)
        .where((F.col("_batch") >= F.col("first_span")) & (F.col("_batch") < F.col("end_span")))
        .select(
            *[F.col(f"`{c}`") for c in df.columns], F.col(shard).cast("int").alias("_shard"), "_batch", "before"
        )
        .sortWithinPartitions("_shard", "_batch", "before")
    )
    out = StructType([*wanted.fields, StructField(SHARD, IntegerType()), StructField(NUMBER, LongType())])
    run = _in_batches(df.columns, n, drop_last, fn, to_arrow_schema(wanted))
    return rows.mapInArrow(run, out)
