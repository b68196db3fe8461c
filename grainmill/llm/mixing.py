"""Mixing sources to target weights by balanced sampling (the cube method).

A source is taken ``target / size`` times: the whole part by copies of every document, the
rest by inclusion probabilities. These move through the null space of the constraints (number
of documents, number of words), so both totals stay as they are while ever more probabilities
reach 0 or 1. Every source is cut into blocks by a hash, so a source with a third of all rows
is many small tasks; a block leaves at most two open documents. The open ones of all blocks
meet in the next round, until one block a source is left and its last two are rounded so that
the words come nearest to the target; where one long document spoils that, single decisions are
changed.

Nulls and odd cases: a null or empty text has size 0. A null source is a source of its own,
the last one. Rows that repeat a doc_id or a whole row are units of their own. A source without
words has target 0. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from grainmill.llm import words as W

WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
BLOCK_UNITS = 4096
SEED = 7
NEAR = 0.005

UNIT = "doc_id long, text_key long, nth long, size long, source_no long, copies long, chance double"


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in W.steps(whole):
            offsets, _ = W.split_words(batch.column("text"))
            yield pa.record_batch(
                [batch.column(c) for c in ("doc_id", "source", "text_key")]
                + [pa.array(np.diff(offsets))],
                names=["doc_id", "source", "text_key", "size"],
            )


def document_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, text_key, size``, size in words."""
    return docs.select("doc_id", "source", "text", W.text_key().alias("text_key")).mapInArrow(
        _sizes, "doc_id long, source string, text_key long, size long"
    )


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_times: int = MOST_TIMES
) -> DataFrame:
    """``source, source_no, source_size, n_docs, target``: one row per source.

    The targets are ``rate * weight``, but at most ``most_times`` the size of the source. In
    rising order of size / weight, the sources at that limit come first; the rate is what is
    left for all others divided by their weights.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    cycle = F.array(*[F.lit(w) for w in weights])
    table = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("source_no", F.row_number().over(by_name).cast("long") - 1)
        .withColumn("_weight", F.element_at(cycle, (F.col("source_no") % len(weights) + 1).cast("int")))
        .withColumn("_most", most_times * F.col("source_size"))
        .withColumn("_bound", F.col("_most") / F.col("_weight"))
    )
    before = everything.orderBy("_bound", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    rate = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_most").over(before), zero)) / (
        F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), zero)
    )
    table = table.withColumn("_rate", rate)
    fits = F.when(F.col("_rate") <= F.col("_bound"), F.struct("_bound", "source_no", "_rate"))
    table = table.withColumn("_rate", F.min(fits).over(everything)["_rate"])
    target = F.least(F.col("_rate") * F.col("_weight"), F.col("_most").cast("double"))
    return table.withColumn("target", F.coalesce(target, F.lit(0.0))).select(
        "source", "source_no", "source_size", "n_docs", "target"
    )


def _way(sizes: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """A direction that raises the first chance and keeps the totals of documents and words.

    The others give way in proportion to the room they have. If their sizes are all alike, one
    constraint follows from the other or cannot be met, and words alone are kept.
    """
    room, rest = (chances * (1 - chances))[1:], sizes[1:]
    n, z, zz = room.sum(), (room * rest).sum(), (room * rest * rest).sum()
    det = n * zz - z * z
    if det > 1e-9 * n * zz:
        give = ((zz - z * sizes[0]) + (n * sizes[0] - z) * rest) / det
    elif zz > 0:
        give = rest * (sizes[0] / zz)
    else:
        give = np.full(len(rest), 1 / n)
    return np.concatenate(([1.0], -room * give))


def fly(sizes: np.ndarray, chances: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Chances after the flight: at most two are left between 0 and 1.

    The longest open document moves first, the shorter ones make up for it; each step settles
    one or more. As ``up`` and ``down`` are drawn against their lengths, no chance drifts.
    """
    out = np.array(chances, dtype=np.float64)
    scaled = np.asarray(sizes, dtype=np.float64) / max(1, max(sizes, default=1))
    left = np.flatnonzero((out > 0) & (out < 1))
    while len(left) > 2:
        now = out[left]
        way = _way(scaled[left], now)
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(way > 0, (1 - now) / way, np.where(way < 0, now / -way, np.inf)).min()
            down = np.where(way > 0, now / way, np.where(way < 0, (1 - now) / -way, np.inf)).min()
        now = now + way * (up if random.random() * (up + down) < down else -down)
        now = np.where(now < 1e-9, 0.0, np.where(now > 1 - 1e-9, 1.0, now))
        out[left] = now
        left = left[(now > 0) & (now < 1)]
    return out


def land(sizes: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Round the open chances (two at most) so that the words, then the documents, come nearest."""
    open_at = np.flatnonzero((chances > 0) & (chances < 1))
    best = None
    for code in range(1 << len(open_at)):
        bits = np.array([(code >> k) & 1 for k in range(len(open_at))], dtype=np.float64)
        off = bits - chances[open_at]
        miss = (abs(float(np.dot(off, sizes[open_at]))), abs(float(off.sum())), code)
        if best is None or miss < best[0]:
            best = (miss, bits)
    out = chances.copy()
    out[open_at] = best[1]
    return out


def mend(sizes: np.ndarray, wanted: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Change single decisions while the words miss what was wanted by more than NEAR.

    This happens where one document holds much of a source: then no flight can keep the total.
    """
    out, free = taken.copy(), np.flatnonzero((wanted > 0) & (wanted < 1) & (sizes > 0))
    goal = float(wanted @ sizes)
    miss = float(out @ sizes) - goal
    while len(free) and abs(miss) > NEAR * goal:
        after = np.abs(miss + np.where(out[free] > 0, -sizes[free], sizes[free]))
        best = free[after.argmin()]
        if after.min() >= abs(miss):
            break
        miss += -sizes[best] if out[best] > 0 else sizes[best]
        out[best] = 1 - out[best]
    return out


def _round(number: int, last: bool, seed: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        # Long documents are settled first, so that those left open to the end are short.
        table = table.sort_by(
            [("size", "descending")] + [(c, "ascending") for c in ("_order", "doc_id", "text_key", "nth")]
        )
        random = np.random.default_rng([seed, number, key[0].as_py(), key[1].as_py()])
        sizes = table.column("size").to_numpy()
        chances = fly(sizes, table.column("chance").to_numpy(), random)
        if last:
            chances = mend(sizes, table.column("chance").to_numpy(), land(sizes, chances))
        copies = table.column("copies").to_numpy() + (chances == 1)
        chances = np.where(chances == 1, 0.0, chances)
        out = table.select(["doc_id", "text_key", "nth", "size", "source_no"])
        return out.append_column("copies", pa.array(copies)).append_column(
            "chance", pa.array(chances)
        )

    return run


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[int] = WEIGHTS,
    most_times: int = MOST_TIMES,
    block_units: int = BLOCK_UNITS,
    seed: int = SEED,
) -> DataFrame:
    """Each document with how often the mix takes it.

    ``doc_id, text_key, nth, source, size, source_size, target, copies, taken``; ``taken`` is
    ``copies * size``, and ``nth`` tells rows with one doc_id and text apart. They go to blocks by
    it as well, so many of them are no large block.
    """
    sizes, _ = numbered_sizes(docs)
    return _mixed(sizes, weights, most_times, block_units, seed)


def numbered_sizes(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``document_sizes`` with ``nth``, and the keys that very many rows share."""
    sizes, keys = W.bounded_rows(document_sizes(docs), "mix-sizes"), ["doc_id", "text_key"]
    many = W.many_copies(sizes, keys)
    return W.copy_numbers(sizes, keys, many, "nth", F.col("source")), many


def _mixed(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_times: int = MOST_TIMES,
    block_units: int = BLOCK_UNITS, seed: int = SEED,
) -> DataFrame:
    targets = W.bounded_rows(source_targets(sizes, weights, most_times), "mix-targets")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = (
        sizes.withColumnRenamed("source", "_source")
        .join(targets, F.col("_source").eqNullSafe(F.col("source")))
        .withColumn("copies", F.floor(times))
        .withColumn("chance", times - F.col("copies"))
        .select(
            "doc_id", "text_key", F.col("nth").cast("long").alias("nth"), "size", "source_no", "copies", "chance",
            "n_docs",
        )
    )
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    done, number, width = [], 0, F.col("n_docs")
    while True:
        blocks = F.greatest(F.lit(1), F.ceil(width / block_units))
        last = most <= block_units
        # The first of equal rows goes where a row without equals would.
        copy = F.when(F.col("nth") > 1, F.col("nth"))
        order = F.xxhash64(F.lit(seed + number), "doc_id", "text_key", copy)
        settled = W.bounded_rows(
            units.withColumn("_order", order)
            .withColumn("_block", F.pmod("_order", blocks))
            .drop("n_docs")
            .groupBy("source_no", "_block")
            .applyInArrow(_round(number, last, seed), UNIT),
            "mix-round",
        )
        done.append(settled if last else settled.where("chance = 0"))
        if last:
            break
        units = settled.where("chance > 0").join(targets.select("source_no", "n_docs"), "source_no")
        # No more than two open units are left of each block.
        most, width, number = 2 * -(-most // block_units), 2 * blocks, number + 1
    decided = done[0]
    for part in done[1:]:
        decided = decided.unionByName(part)
    return decided.join(targets, "source_no").select(
        "doc_id", "text_key", "nth", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; all columns are kept.

    Equal rows are told apart by a running number on both sides of the join.
    """
    sizes, many = numbered_sizes(docs)
    decided = _mixed(sizes, **options).where("copies > 0").select(
        F.col("doc_id").alias("_doc"), F.col("text_key").alias("_text"), F.col("nth").alias("_taken"),
        "copies",
    )
    if many is not None:
        many = many.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    return (
        W.copy_numbers(W.keyed_rows(docs), ["_id", "_key"], many, "_nth", F.col("_row.source"))
        .join(
            decided,
            F.col("_id").eqNullSafe(F.col("_doc"))
            & (F.col("_key") == F.col("_text"))
            & (F.col("_nth") == F.col("_taken")),
        )
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("_row.*")
    )
