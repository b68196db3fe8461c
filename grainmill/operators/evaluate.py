"""User transforms of rows, with failing rows set aside and results of several types in one column.

A transform is a Column expression, a Python function of a batch of rows, or None, which lets the
row through as it is. A function gets a ``pyarrow.RecordBatch`` and gives one result a row: a
string, a list of lists of ids, or None. If it raises, the batch is halved until the failing rows
are alone; these become rejects with the text of the error, and all others go on. A function is
therefore called more than once on some rows, and has to treat each row by itself.

Functions run once, in one Arrow step, on the rows of their sources only. Everything else is
Column work, so streams and tables are treated alike.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from grainmill.operators.dispatch import REASON

BatchFunction = Callable[[pa.RecordBatch], Sequence]
Transform = Column | BatchFunction | None

TEXT, IDS, ROW = "text", "ids", "row"
NOTHING, UNKNOWN = "transform gave nothing", "unknown source"
RESULT = f"struct<kind: string, text: string, ids: array<int>, {REASON}: string>"
_RESULT = pa.struct(
    [("kind", pa.string()), ("text", pa.string()), ("ids", pa.list_(pa.int32())), (REASON, pa.string())]
)
Entry = tuple[str | None, str | None, Sequence[int] | None, str | None]


def each_row(fn: Callable[[dict], object]) -> BatchFunction:
    """A function of a batch from one of a single row."""

    def rows(batch: pa.RecordBatch) -> list:
        return [fn(row) for row in batch.to_pylist()]

    return rows


def isolate(fn: BatchFunction, batch: pa.RecordBatch) -> list[tuple[object, str | None]]:
    """(result, error) of each row; rows that fail do so alone.

    f failing rows of n cost some f * log2(n) calls more.
    """
    out: list[tuple[object, str | None]] = [(None, None)] * batch.num_rows
    todo = [(0, batch.num_rows)] if batch.num_rows else []
    while todo:
        a, b = todo.pop()
        try:
            made = fn(batch.slice(a, b - a))
            made = made.to_pylist() if isinstance(made, pa.Array | pa.ChunkedArray) else list(made)
            if len(made) != b - a:
                raise ValueError(f"{len(made)} results for {b - a} rows")
        except Exception as e:  # whatever user code raises
            if b - a == 1:
                out[a] = None, f"transform failed: {type(e).__name__}: {e}"
            else:
                middle = (a + b) // 2
                todo += [(middle, b), (a, middle)]
        else:
            out[a:b] = [(m, None) for m in made]
    return out


def entries(result: object, error: str | None) -> list[Entry]:
    """The rows that one result stands for: one for a string, one for each inner list."""

    def reject(reason: str) -> list[Entry]:
        return [(None, None, None, reason)]

    if error is not None:
        return reject(error)
    if result is None:
        return reject(NOTHING)
    if isinstance(result, str):
        return [(TEXT, result, None, None)]
    lists = (list, tuple, np.ndarray)
    if isinstance(result, lists) and not len(result):
        return reject("unsupported result: an empty list")
    if not (isinstance(result, lists) and all(isinstance(x, lists) for x in result)):
        return reject(f"unsupported result: {type(result).__name__}")
    try:
        parts = [pa.array(x, pa.int32()) for x in result]
    except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError, TypeError):
        return reject("unsupported result: a list that does not hold ids")
    if any(p.null_count for p in parts):
        return reject("unsupported result: a list that does not hold ids")
    return [(IDS, None, p.to_numpy(), None) for p in parts]


def _packed(rows: list[list[Entry] | None]) -> pa.ListArray:
    flat = [e for row in rows for e in row or ()]
    upto = np.cumsum([0] + [len(r or ()) for r in rows])
    kinds, texts, ids, reasons = zip(*flat) if flat else ((), (), (), ())
    sizes = np.cumsum([0] + [0 if x is None else len(x) for x in ids])
    held = [x for x in ids if x is not None]
    lists = pa.ListArray.from_arrays(
        pa.array(sizes, pa.int32()),
        pa.array(np.concatenate(held) if held else np.empty(0, np.int32), pa.int32()),
        mask=pa.array([x is None for x in ids], pa.bool_()),
    )
    values = pa.StructArray.from_arrays(
        [pa.array(kinds, pa.string()), pa.array(texts, pa.string()), lists, pa.array(reasons, pa.string())],
        fields=list(_RESULT),
    )
    return pa.ListArray.from_arrays(
        pa.array(upto, pa.int32()), values, mask=pa.array([r is None for r in rows], pa.bool_())
    )


def _evaluator(functions: Mapping[str, BatchFunction], source: str):
    @F.arrow_udf(f"array<{RESULT}>")
    def run(rows: pa.Array) -> pa.Array:
        out: list[list[Entry] | None] = [None] * len(rows)
        own = np.flatnonzero(rows.is_valid().to_numpy(zero_copy_only=False))
        batch = pa.RecordBatch.from_struct_array(rows.take(pa.array(own)))
        names = np.array(batch.column(source).to_pylist(), dtype=object)
        for name, fn in functions.items():
            mine = np.flatnonzero(names == name)
            part = batch.take(pa.array(mine))
            for place, (result, error) in zip(own[mine].tolist(), isolate(fn, part)):
                out[place] = entries(result, error)
        return _packed(out)

    return run


def _column_entries(made: Column, kind: T.DataType) -> Column:
    """What a Column transform of the given type gives, as entries."""
    none, ids = F.lit(None), F.lit(None).cast("array<int>")

    def entry(name: str | None, text: Column, values: Column, reason: Column) -> Column:
        return F.struct(
            F.lit(name).cast("string").alias("kind"), text.cast("string").alias("text"),
            values.cast("array<int>").alias("ids"), reason.cast("string").alias(REASON),
        )

    if isinstance(kind, T.StringType):
        good = F.array(entry(TEXT, made, ids, none))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        good = F.transform(made, lambda x: entry(IDS, none, x, none))
        empty = F.array(entry(None, none, ids, F.lit("unsupported result: an empty list")))
        good = F.when(F.size(made) > 0, good).otherwise(empty)
    else:
        raise TypeError(f"a transform must give a string or a list of lists, not {kind.simpleString()}")
    return F.when(made.isNull(), F.array(entry(None, none, ids, F.lit(NOTHING)))).otherwise(good)


def apply_transforms(
    df: DataFrame, transforms: Mapping[str, Transform], *, source: str = "source", out: str = "result"
) -> DataFrame:
    """Each row's results by the transform of its source, as ``out`` and ``reject_reason``.

    ``out`` has a ``kind``: ``text`` with a ``text``, ``ids`` with one list of ``ids`` (a row for
    each inner list), or ``row`` for a row let through. A row whose source has no transform, or
    a null source, whose transform raises or gives nothing, or a type that is none of these, has a
    null ``out`` and a reason.
    """
    if not transforms:  # without any transform every row goes through
        return df.withColumn(out, _row_result()).withColumn(REASON, F.lit(None).cast("string"))
    name = F.col(source)
    functions = {k: v for k, v in transforms.items() if v is not None and not isinstance(v, Column)}
    chosen, mixed = None, df
    if functions:
        # Rows of other sources are null to the step, so hardly anything of them is sent.
        row = F.when(name.isin(list(functions)), F.struct(*[F.col(f"`{c}`") for c in df.columns]))
        mixed = df.withColumn("_made", _evaluator(functions, source)(row))
        chosen = F.when(name.isin(list(functions)), F.col("_made"))
    for key, transform in transforms.items():
        if key in functions:
            continue
        if transform is None:
            value = F.array(
                F.struct(
                    F.lit(ROW).alias("kind"), F.lit(None).cast("string").alias("text"),
                    F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("string").alias(REASON),
                )
            )
        else:
            value = _column_entries(transform, df.select(transform.alias("_x")).schema["_x"].dataType)
        chosen = F.when(name == key, value) if chosen is None else chosen.when(name == key, value)
    lost = F.array(
        F.struct(
            F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("text"),
            F.lit(None).cast("array<int>").alias("ids"), F.lit(UNKNOWN).alias(REASON),
        )
    )
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (out, REASON)]
    made = mixed.select(*kept, F.explode(chosen.otherwise(lost)).alias("_entry"))
    result = F.struct("_entry.kind", "_entry.text", "_entry.ids")
    good = F.col("_entry.kind").isNotNull()
    return made.select(*kept, F.when(good, result).alias(out), F.col(f"_entry.{REASON}").alias(REASON))


def _row_result() -> Column:
    return F.struct(
        F.lit(ROW).alias("kind"), F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("array<int>").alias("ids"),
    )


def as_variant(result: Column | str, row: Sequence[str]) -> Column:
    """A result as one VARIANT: a string, an array of ids, or an object of the ``row`` columns."""
    value = F.col(result) if isinstance(result, str) else result
    whole = F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in row]))
    return (
        F.when(value["kind"] == TEXT, value["text"].cast("variant"))
        .when(value["kind"] == IDS, value["ids"].cast("variant"))
        .when(value["kind"] == ROW, whole)
    )
