"""Row order: exact positions without a single-task window, shuffles, limits and resume.

A window function over a whole table, or over one hot group, runs in one task. Here rows are
first cut into slices whose order agrees with the wanted order; a small table of row counts
per slice gives each slice its offset, and the window only ranks rows inside a slice. The
result does not depend on the number of slices.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from grainmill.functions.hashing import shuffle_bucket, shuffle_key, uniform
from grainmill.session import shuffle_partitions
from grainmill.sources.tables import via_table

ORDER = "_order"
SLICE = "_slice"
SLICES_PER_PARTITION = 4
# Rows that share a key go together up to this number.
COPIES = 256


def default_slices(df: DataFrame) -> int:
    """More slices than shuffle partitions, so that hashing slices to tasks evens out."""
    return SLICES_PER_PARTITION * shuffle_partitions(df.sparkSession)


def with_positions(
    df: DataFrame,
    order: Sequence[Column | str],
    slice_no: Column,
    *,
    group: Sequence[str] = (),
    weight: str | None = None,
    position: str = "pos",
    weight_before: str = "weight_before",
    keep_offsets: bool = False,
) -> DataFrame:
    """Add each row's 0-based position in its group, and the weight of all rows before it.

    ``slice_no`` must not fall when ``order`` rises; ``group`` columns must not be null. The
    wide rows are exchanged once, by (group, slice): the ranking window and the join with the
    offsets use the same partitioning. The counting side reads only the key columns.
    """
    keys = [*group, SLICE]
    sliced = df.withColumn(SLICE, slice_no)
    totals = [F.count(F.lit(1)).alias("_rows")]
    if weight:
        totals.append(F.sum(weight).alias("_weight"))
    earlier = W.partitionBy(*group).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys)
        .agg(*totals)
        .withColumn("_rows_off", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    )
    if weight:
        offsets = offsets.withColumn(
            "_weight_off", F.coalesce(F.sum("_weight").over(earlier), F.lit(0))
        )
    offsets = offsets.drop("_rows", "_weight")
    # The rows of a slice are ranked where the exchange by (group, slice) puts them.
    inside = W.partitionBy(*keys).orderBy(*order)
    ranked = sliced.withColumn("_rank", F.row_number().over(inside) - 1)
    if weight:
        before = inside.rowsBetween(W.unboundedPreceding, -1)
        ranked = ranked.withColumn(
            "_weight_in", F.coalesce(F.sum(weight).over(before), F.lit(0))
        )
    out = ranked.join(offsets, keys).withColumn(position, F.col("_rows_off") + F.col("_rank"))
    if weight:
        out = out.withColumn(weight_before, F.col("_weight_off") + F.col("_weight_in"))
    out = out.drop("_rank", "_rows_off", "_weight_in")
    return out if keep_offsets else out.drop(SLICE, "_weight_off")


def with_shuffled_positions(
    df: DataFrame,
    key: str,
    seed: int,
    *,
    group: Sequence[str] = (),
    weight: str | None = None,
    n_slices: int | None = None,
    position: str = "pos",
    weight_before: str = "weight_before",
) -> DataFrame:
    """Positions in a seeded shuffle of the rows (within each group). ``key`` must be unique.

    Shuffle keys are uniform, so equal cuts of their range give equal slices for any data.
    """
    n = n_slices or default_slices(df)
    keyed = df.withColumn(ORDER, shuffle_key(seed, F.col(key)))
    return with_positions(
        keyed,
        [ORDER, key],
        shuffle_bucket(F.col(ORDER), n),
        group=group,
        weight=weight,
        position=position,
        weight_before=weight_before,
    ).drop(ORDER)


def with_sorted_positions(
    df: DataFrame, order: Sequence[Column | str], *, group: Sequence[str] = (), position: str = "pos"
) -> DataFrame:
    """Add each row's 0-based position in its group by any order, by a range sort of all rows.

    The sorted rows are written once with the number of their part and of the row in it; a table
    of one row for each part that a group reaches into gives the offsets. A group may fill many
    parts. Rows that are equal in ``order`` are numbered as they come.
    """
    columns = [*group, *order]
    rows = via_table(
        df.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .withColumn("_sort_part", F.spark_partition_id())
        .withColumn("_sort_row", F.monotonically_increasing_id()),
        "sorted",
    )
    keys = [*group, "_sort_part"]
    earlier = W.partitionBy(*group).orderBy("_sort_part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*keys)
        .agg(F.min("_sort_row").alias("_sort_first"), F.count(F.lit(1)).alias("_sort_rows"))
        .withColumn("_sort_before", F.coalesce(F.sum("_sort_rows").over(earlier), F.lit(0)))
    )
    same = [F.col(f"r.`{c}`").eqNullSafe(F.col(f"s.`{c}`")) for c in keys]
    at = F.col("s._sort_before") + F.col("r._sort_row") - F.col("s._sort_first")
    return rows.alias("r").join(starts.alias("s"), reduce(and_, same)).select(
        *[F.col(f"r.`{c}`") for c in df.columns], at.alias(position)
    )


def with_shuffled_spans(
    df: DataFrame,
    key: str,
    seed: int,
    size: int,
    *,
    shard: str,
    num_shards: int,
    weight: str | None = None,
    n_slices: int | None = None,
    first: str | None = None,
) -> DataFrame:
    """Lay each shard's shuffled rows end to end and cut the line every ``size``.

    A row covers ``weight`` units of the line (1 by default); a span is ``size`` units. Adds
    ``before``, the units before the row, and ``cell``: the result is partitioned by (shard,
    cell), and a cell has every row of the spans ``first_span .. end_span - 1``, so a following
    aggregation per span needs no exchange and wide rows move only once.

    For that, slice borders are shifted to span borders. The keys and weights alone tell, per
    slice, which row starts the first span; rows before it go to the cell where their span
    started, and a row that lies across is sent to both. Rows that share a key are one entry
    of the keys, so a border never falls between them: all of them go to both sides, and are
    ordered by a hash of their content on either. Of a key with more than ``COPIES`` rows, every
    further ``COPIES`` of them are an entry with a place of its own, so no cell holds them all.

    Rows with a true ``first`` column come before all others, by key. They are few: what was left
    over from an earlier part of the line.
    """
    n = n_slices or default_slices(df)
    units = F.col(weight) if weight else F.lit(1)
    place = F.struct(ORDER, key)
    tie = F.xxhash64(*[c for c in df.columns if c not in (shard, key)])
    shuffled = shuffle_key(seed, F.col(key))
    if first:
        shuffled = F.when(F.col(first), F.lit("")).otherwise(shuffled)

    def entries_of(rows: DataFrame) -> DataFrame:
        # Written, so that wide rows are read once for their units and once to be placed.
        return via_table(
            rows.groupBy(shard, ORDER, key).agg(F.sum(units).alias("_units"), F.count(F.lit(1)).alias("_rows")),
            "span-keys",
        )

    keyed = df.withColumn(ORDER, shuffled)
    entries = entries_of(keyed)
    many = entries.where((F.col("_rows") > COPIES) & (F.col(ORDER) != ""))
    if not many.isEmpty():
        keyed = _spread_copies(keyed, many.select(shard, key), shard, key, tie, seed)
        entries = entries_of(keyed)

    def sliced(rows: DataFrame) -> DataFrame:
        return rows.withColumn(SLICE, shuffle_bucket(F.col(ORDER), n))

    # Written, so that its size is known when the join is chosen.
    cells = via_table(_span_cells(sliced(entries), key, shard, size), "span-cells")
    in_own = place >= F.col("_own_from")
    in_home = F.coalesce(place < F.col("_home_until"), F.lit(True))
    targets = F.array_compact(
        F.array(F.when(in_own, F.col("_own")), F.when(in_home, F.col("_home")))
    )
    earlier = (
        W.partitionBy(shard, "cell").orderBy(ORDER, key, tie).rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        sliced(keyed)
        .join(cells, [shard, SLICE])
        .withColumn("_to", F.explode(targets))
        .select(*df.columns, ORDER, "_to.cell", "_to.start", "_to.first_span", "_to.end_span")
        .withColumn("before", F.col("start") + F.coalesce(F.sum(units).over(earlier), F.lit(0)))
        .drop(ORDER, "start")
    )


def _spread_copies(
    rows: DataFrame, many: DataFrame, shard: str, key: str, tie: Column, seed: int
) -> DataFrame:
    """Rows of the keys in ``many`` by copies: after the first ``COPIES`` ones, every further ones
    are placed as if they had another key.

    Copies are numbered by a hash of their content; rows that are equal in all may take each
    other's numbers. The salt lets them fall into different parts of the sort that numbers them.
    """
    names = [F.col(f"`{c}`") for c in rows.columns]
    same = [F.col(f"r.`{c}`").eqNullSafe(F.col(f"m.`{c}`")) for c in (shard, key)]
    hit = same[0] & same[1] & (F.col(f"r.{ORDER}") != "")
    others = rows.alias("r").join(many.alias("m"), hit, "left_anti").select(names)
    own = rows.alias("r").join(many.alias("m"), hit, "left_semi").select(names)
    own = own.withColumn("_tie", tie).withColumn("_salt", F.monotonically_increasing_id() % 1024)
    numbered = with_sorted_positions(own, ["_tie", "_salt"], group=[shard, key], position="_copy")
    block = F.floor(F.col("_copy") / COPIES)
    apart = shuffle_key(seed, F.concat_ws("+", F.col(key).cast("string"), block))
    spread = numbered.withColumn(ORDER, F.when(block == 0, F.col(ORDER)).otherwise(apart))
    return others.unionByName(spread.select(names))


def _span_cells(keys: DataFrame, key: str, shard: str, size: int) -> DataFrame:
    """Per shard and slice: where its own spans begin, and the cell of the span before them."""
    placed = with_positions(
        keys, [ORDER, key], F.col(SLICE), group=[shard], weight="_units",
        weight_before="_before", keep_offsets=True,
    )
    place = F.struct(ORDER, key)
    # First span border at or after the start of the slice.
    border = F.ceil(F.col("_weight_off") / size) * size
    after_border = F.col("_before") + F.col("_units") > border
    slices = placed.groupBy(shard, SLICE).agg(
        F.max("_weight_off").alias("_from"),
        F.sum("_units").alias("_units"),
        F.min(F.when(after_border, place)).alias("_own_from"),
        F.min(F.when(after_border, F.col("_before"))).alias("_start"),
        F.min(F.when(F.col("_before") >= border, place)).alias("_home_until"),
    )
    own = F.struct(
        F.col(SLICE).alias("cell"),
        F.col("_start").alias("start"),
        F.ceil(F.col("_from") / size).alias("first_span"),
        F.ceil((F.col("_from") + F.col("_units")) / size).alias("end_span"),
    )
    earlier = W.partitionBy(shard).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    starts_span = F.when(F.col("_own_from").isNotNull(), own)
    return slices.select(
        shard, SLICE, "_own_from", "_home_until",
        own.alias("_own"),
        F.last(starts_span, ignorenulls=True).over(earlier).alias("_home"),
    )


def shuffle_rows(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """The rows in a full, repeatable random order (a range exchange on the shuffle key)."""
    return (
        df.withColumn(ORDER, shuffle_key(seed, F.col(key))).orderBy(ORDER, key).drop(ORDER)
    )


def buffer_slot(seed: int, shard: Column, position: Column, size: int) -> Column:
    """Where the row at a position of its shard goes in a buffer of ``size`` rows.

    The first ``size`` rows fill the buffer; each later one takes the place of a random row.
    """
    drawn = uniform(seed, F.concat_ws(":", F.lit("buffer"), shard, position), 0)
    return F.when(position < size, position).otherwise(F.floor(drawn * size)).cast("bigint")


def with_buffer_turns(
    df: DataFrame, seed: int, size: int, *, shard: str, position: str, turn: str = "turn"
) -> DataFrame:
    """Add ``slot``, and the ``turn`` at which a row leaves a shuffle buffer of ``size`` rows.

    A row leaves when a later row of its shard is drawn to its slot, so its turn is the position
    of the next row with that slot, less the size: no buffer has to be played through, and a
    shard is spread over its slots. Rows that no other replaces have a null turn; they are the
    buffer at the end, ``size`` rows of a shard at most.
    """
    slotted = df.withColumn("slot", buffer_slot(seed, F.col(shard), F.col(position), size))
    after = F.lead(position).over(W.partitionBy(shard, "slot").orderBy(position))
    return slotted.withColumn(turn, after - size)


def with_flushed_turns(
    df: DataFrame, seed: int, size: int, *, shard: str, position: str, turn: str = "turn"
) -> DataFrame:
    """Turns of the rows left in the buffer when no more come, in a seeded random order.

    ``df`` has what ``with_buffer_turns`` left over, ``size`` rows of a shard at most; their turns
    go on after those of all rows that have left.
    """
    drawn = shuffle_key(seed, F.concat_ws(":", F.lit("flush"), shard, position))
    rank = F.row_number().over(W.partitionBy(shard).orderBy(drawn, position)) - 1
    last = F.max(position).over(W.partitionBy(shard))
    return df.withColumn(turn, F.greatest(last + 1 - size, F.lit(0)) + rank)


def sanity_limit(df: DataFrame, *order: str, n: int = 1000) -> DataFrame:
    """The first ``n`` rows: each task keeps its own ``n`` best before they are merged."""
    return df.orderBy(*order).limit(n)


def peek(df: DataFrame, n: int = 11) -> DataFrame:
    return df.limit(n)


def skip_batches(df: DataFrame, n_batches: int, batch: str = "batch_id") -> DataFrame:
    """Resume a run: leave out the batches it has already used."""
    return df.filter(F.col(batch) >= n_batches)
