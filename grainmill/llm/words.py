"""Words of whole texts inside Arrow batches, and small helpers that several operators share.

A word is ``[^\\x20\\x09-\\x0D]+``. ``bytes.split()`` and ``bytes.lower()`` of Python, and the
``ascii_*`` kernels of Arrow, use exactly these six white-space characters and A-Z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from grainmill.operators.order import with_sorted_positions
from grainmill.session import scratch_dir

# Bytes of text that one step of a task turns into arrays; a longer text is a step of its own.
STEP_BYTES = 8 << 20

BATCH_BYTES = 16 << 20
# Row groups of written tables; a task holds one of them while it writes.
ROW_GROUP_BYTES = 32 << 20

SPACE = "[\\x20\\x09-\\x0D]+"


def text_key() -> Column:
    """Tells rows with one doc_id apart by their text; copies of a whole row stay alike."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``_row`` with all columns of each row, whatever their names, and ``_id, _key`` beside it."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("_row"), F.col("doc_id").alias("_id"), text_key().alias("_key"))


def steps(
    batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES
) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each, so that memory stays bounded."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def lower_ascii(texts: pa.Array) -> pa.Array:
    """A-Z in lower case, all else unchanged."""
    return pc.ascii_lower(texts)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets (rows + 1) into the words of all rows, and these words; null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten()
    ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        before = np.concatenate(([0], np.cumsum(full)))
        return before[ends], words.filter(pa.array(full))
    return ends, words


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets, a code for each word, and the distinct words by code."""
    offsets, words = split_words(texts)
    coded = words.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def word_hashes(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each distinct word."""
    import xxhash

    whole = b"".join(xxhash.xxh3_128_digest(w) for w in distinct.cast(pa.binary()).to_pylist())
    pair = np.frombuffer(whole, dtype="<u8").reshape(-1, 2)
    return pair[:, 0].copy(), pair[:, 1].copy()


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words; the order of words counts."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
        for i in range(n):
            out = out * _MULTIPLIER + hashes[i : len(hashes) - n + 1 + i]
        return mixed(out)


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand rows to Python in batches of BATCH_BYTES at most, if it does not already.

    Texts may be long, and a batch is held by the JVM and by the worker at once.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(BATCH_BYTES))


def bounded_rows(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written once to the shared folder and read back.

    Later steps do not compute them again, and a lost executor costs only its own tasks.
    """
    small_batches(df.sparkSession)
    path = scratch_dir(df.sparkSession, purpose)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.parquet(path)


def hashed_sample(df: DataFrame, order: Column, limit: int) -> DataFrame:
    """The ``limit`` rows with the smallest hash ``order``, or all if there are fewer.

    The hash range is narrowed by the number of rows first, so the tasks together send the driver
    little more than ``limit`` rows, however many tasks there are.
    """
    n, wide = df.count(), 1 << 30
    share = (limit + 8 * limit**0.5 + 8) / max(1, n)
    if share < 1:
        df = df.where(F.pmod(order, F.lit(wide)) < int(share * wide) + 1)
    keyed = df.withColumn("_order", F.pmod(order, F.lit(wide))).withColumn("_tie", order)
    others = [F.col(f"`{c}`").asc() for c in df.columns]
    return keyed.orderBy("_order", "_tie", *others).limit(limit).drop("_order", "_tie")


def most_frequent(counts: DataFrame, column: str, limit: int) -> DataFrame:
    """At most ``limit`` rows with the largest ``column``; ties at the border are left out.

    A table of how many rows have each value gives the border, so nothing is sorted as a whole.
    """
    table = counts.groupBy(column).agg(F.count(F.lit(1)).alias("_rows")).orderBy(F.desc(column))
    border, rows = None, 0
    for row in table.limit(limit).collect():  # distinct counts; each has one row or more
        if rows + row["_rows"] > limit:
            return counts.where(F.col(column) > row[column])
        border, rows = row[column], rows + row["_rows"]
    return counts if border is None else counts.where(F.col(column) >= border)


# Equal rows up to this number are numbered in one place.
COPIES = 256


def many_copies(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys that more than COPIES rows share, written once; None if there are none."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies")).where(F.col("_copies") > COPIES)
    found = bounded_rows(counts.select(*keys), "many-copies")
    return None if found.isEmpty() else found


def copy_numbers(
    rows: DataFrame, keys: list[str], many: DataFrame | None, name: str, order: Column | None = None
) -> DataFrame:
    """Add a running number from 1 to rows that share their ``keys``, by ``order`` if it is given.

    Rows of the keys in ``many`` are numbered over a range sort, so that such a key fills many
    tasks. Rows that are alike in keys and order may get each other's numbers.
    """
    order = F.lit(0) if order is None else order
    window = Window.partitionBy(*keys).orderBy(order)
    if many is None:
        return rows.withColumn(name, F.row_number().over(window))
    names = [F.col(f"r.`{c}`") for c in rows.columns]
    same = [F.col(f"r.`{k}`").eqNullSafe(F.col(f"m.`{k}`")) for k in keys]
    both = same[0]
    for one in same[1:]:
        both &= one
    few = rows.alias("r").join(many.alias("m"), both, "left_anti").select(names)
    own = rows.alias("r").join(many.alias("m"), both, "left_semi").select(names)
    # The salt lets equal rows fall into different parts of the sort.
    salted = own.withColumn("_by", order).withColumn("_salt", F.monotonically_increasing_id() % 4096)
    numbered = with_sorted_positions(salted, ["_by", "_salt"], group=keys, position=name).drop("_by", "_salt")
    return few.withColumn(name, F.row_number().over(window).cast("long")).unionByName(
        numbered.withColumn(name, F.col(name) + 1)
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")
