"""Per-source transforms, and rows set aside with a reason."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

REASON = "reject_reason"


def apply_by_source(
    df: DataFrame,
    transforms: Mapping[str, Column],
    *,
    source: str = "source",
    out: str,
    split_rows: bool = True,
) -> DataFrame:
    """Column ``out`` made by the transform registered for the row's source.

    A row whose source has no transform, or whose transform gives null, keeps a null ``out``
    and gets a ``reject_reason``. A string result stays one row; a list of lists becomes one
    row per inner list (unless ``split_rows`` is off); any other type is an error when the
    query is built.
    """
    name = F.col(source)
    known = name.isin(list(transforms))
    chosen = None
    for key, column in transforms.items():
        chosen = F.when(name == key, column) if chosen is None else chosen.when(name == key, column)
    if chosen is None:
        raise ValueError("no transforms given")
    done = df.withColumn(out, chosen)
    kind = done.schema[out].dataType
    nested = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)
    if not (nested or isinstance(kind, T.StringType)):
        raise TypeError(f"a transform must give a string or a list of lists, not {kind}")
    problem = F.when(~F.coalesce(known, F.lit(False)), "unknown source").when(
        F.col(out).isNull(), "transform gave nothing"
    )
    # One entry per row to be. A later filter on the reason then looks at the entry; on a plain
    # column it would be pushed below the transform and run it a second time.
    entry_type = kind.elementType if nested and split_rows else kind
    rejected = F.struct(F.lit(None).cast(entry_type).alias(out), F.col(REASON))
    none = F.lit(None).cast("string").alias(REASON)
    if nested and split_rows:
        good = F.transform(out, lambda seq: F.struct(seq.alias(out), none))
    else:
        good = F.array(F.struct(F.col(out), none))
    entries = F.when(F.col(REASON).isNotNull(), F.array(rejected)).otherwise(good)
    kept = [c for c in df.columns if c != out]
    return (
        done.withColumn(REASON, problem)
        .select(*kept, F.explode(entries).alias("_entry"))
        .select(*kept, f"_entry.{out}", f"_entry.{REASON}")
    )


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col(REASON).isNull()).drop(REASON)


def rejects(df: DataFrame) -> DataFrame:
    return df.filter(F.col(REASON).isNotNull())
