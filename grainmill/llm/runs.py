"""Periodic runs in whole texts, by an enhanced suffix array of the words.

The texts of a step share one suffix array, in which a suffix is compared within its own text
only, so that texts do not meet. It is made by doubling: level k ranks all stretches of 2^k words,
and only suffixes that are not told apart yet are ranked again. Each place of the LCP array splits
its LCP interval in two; every suffix i of the smaller side looks with the depth d of the interval
whether i + d or i - d lies on the other side, by the inverse suffix array. Then the stretch of 2d
words from the first of them is a square that cannot be moved to the right. Squares are rotated to
the left as far as words agree, all at once by the levels, and equal stretches are one run with
its smallest period. No tree node is ever made.

A run is a stretch with smallest period q and at least ``max(least, exponent * q)`` words that no
neighbouring word extends. Collapsing a text drops the words that a run holds after its first q.

Nulls and odd cases: a null or empty text has no words and no runs. Each row is searched on its
own, so repeated rows and null ids stay as they are. A text longer than a step is a step of its
own; memory is some 4 * log2(longest repeat) bytes for each of its words. An empty table gives no
rows. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from grainmill.llm import words as W

LEAST, EXPONENT = 6, 4
STEP_BYTES = 4 << 20
# Suffixes of smaller sides that are looked at together.
LOOKS = 1 << 20
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def rank_levels(code: np.ndarray, row: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Level k: equal numbers for equal stretches of 2^k words of one text; the last is the ISA.

    A number is the place of the first suffix of its group in the suffix array. ``ends`` has the
    end of the own text for each word. A stretch over the end of a text equals no other.
    """
    n = len(code)
    key = (row.astype(np.int64) << 32) | code
    order = np.argsort(key, kind="stable")
    levels = [_group_starts(key[order], np.arange(n), order, np.empty(n, np.int32))]
    active, width = np.arange(n), 1
    while True:
        rank = levels[-1]
        size = np.bincount(rank, minlength=n)
        active = active[size[rank[active]] > 1]
        if not len(active):
            return levels
        beyond = active + width
        second = np.where(beyond < ends[active], rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = rank[active].astype(np.int64) * (n + 1) + second
        order = np.argsort(key)
        places, key = active[order], key[order]
        group = rank[places]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        base = group + np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        levels.append(_group_starts(key, base, places, rank.copy()))
        width *= 2


def _group_starts(
    key: np.ndarray, base: np.ndarray, places: np.ndarray, out: np.ndarray
) -> np.ndarray:
    """Write the ``base`` of the first of equal sorted keys to all their ``places``."""
    if len(key):
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        out[places] = np.repeat(base[first], np.diff(np.append(first, len(key))))
    return out


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of equal words from a and from b on; a and b are different words of one text."""
    top = np.full(len(a), -1, dtype=np.int64)
    todo = np.arange(len(a))
    for k, rank in enumerate(levels):
        todo = todo[rank[a[todo]] == rank[b[todo]]]
        if not len(todo):
            break
        top[todo] = k
    length = np.where(top >= 0, np.int64(1) << np.maximum(top, 0), 0)
    for k in range(int(top.max(initial=-1)) - 1, -1, -1):
        todo = np.flatnonzero(top > k)
        p, q = a[todo] + length[todo], b[todo] + length[todo]
        inside = (p < ends[a[todo]]) & (q < ends[b[todo]])
        todo, p, q = todo[inside], p[inside], q[inside]
        length[todo[levels[k][p] == levels[k][q]]] += 1 << k
    return length


def common_suffixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of equal words before a and before b (a < b, words of one text)."""
    length = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        p, q = a - length - (1 << k), b - length - (1 << k)
        todo = np.flatnonzero(p >= starts[a])
        todo = todo[levels[k][p[todo]] == levels[k][q[todo]]]
        length[todo] += 1 << k
    return length


def interval_borders(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place p of the LCP array the widest [left, right) around it with no smaller value.

    Of equal values the first one splits, so ``left`` stops after a value that is not larger. The
    least values of blocks of 2^k places are made level by level, for as long as an interval
    may need them.
    """
    n = len(lcp)
    mins = [lcp]
    # An interval is never longer than the longest stretch without a 0.
    zeros = np.flatnonzero(lcp == 0)
    longest = int(np.diff(zeros, prepend=-1, append=n).max(initial=1))
    while (1 << len(mins)) <= longest:
        half = 1 << (len(mins) - 1)
        last = mins[-1]
        mins.append(np.minimum(last[:-half], last[half:]) if len(last) > half else last[:0])
    left, right = np.arange(n), np.arange(1, n + 1)
    todo = np.flatnonzero(lcp > 0)
    depth, at, up = lcp[todo], todo.copy(), todo + 1
    for k in range(len(mins) - 1, -1, -1):
        least, step = mins[k], 1 << k
        if not len(least):
            continue
        back = at - step
        good = (back >= 0) & (least[np.maximum(back, 0)] > depth)
        at[good] = back[good]
        good = up < len(least)
        good &= least[np.minimum(up, len(least) - 1)] >= depth
        up[good] += step
    left[todo], right[todo] = at, up
    return left, right


def branching_squares(
    lcp: np.ndarray, order: np.ndarray, place: np.ndarray, room: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(first word, half length) of the squares that cannot be moved to the right.

    ``lcp[p]`` is between the suffixes ``order[p - 1]`` and ``order[p]``; ``place`` is the inverse
    of ``order``. Intervals deeper than their ``room`` are left out.
    """
    n = len(order)
    left, right = interval_borders(lcp)
    split = np.flatnonzero((lcp > 0) & (lcp <= room))
    # Suffixes order[low:mid] and order[mid:high] are the two sides.
    low, mid, high, depth = left[split] - 1, split, right[split], lcp[split]
    smaller_left = mid - low <= high - mid
    first = np.where(smaller_left, low, mid)
    count = np.where(smaller_left, mid - low, high - mid)
    other, stop = np.where(smaller_left, mid, low), np.where(smaller_left, high, mid)
    starts, halves = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    group = np.cumsum(count) // LOOKS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(split)]
    for a, b in zip(cuts, cuts[1:]):
        which = np.repeat(np.arange(a, b), count[a:b])
        upto = np.cumsum(count[a:b])
        inner = np.arange(len(which)) - np.repeat(upto - count[a:b], count[a:b])
        i, d = order[first[which] + inner], depth[which]
        for to, begin in ((i + d, i), (i - d, i - d)):
            inside = (to >= 0) & (to < n)
            at = place[np.where(inside, to, 0)]
            hit = inside & (at >= other[which]) & (at < stop[which])
            starts.append(begin[hit])
            halves.append(d[hit])
    return np.concatenate(starts), np.concatenate(halves)


def find_runs(
    code: np.ndarray, offsets: np.ndarray, *, least: int = LEAST, exponent: int = EXPONENT
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, smallest period) of all runs, by first word and period.

    ``code`` numbers the words of all texts, end to end; ``offsets`` (texts + 1) cuts them.
    """
    none = np.empty(0, np.int64)
    sizes = np.diff(offsets)
    if exponent < 2:
        raise ValueError("a run repeats its period twice at least")
    # Texts too short for any run, and empty ones, need no ranks.
    if not (sizes >= max(least, exponent)).any():
        return none, none, none
    row = np.repeat(np.arange(len(sizes)), sizes)
    start_of, end_of = offsets[:-1][row], offsets[1:][row]
    levels = rank_levels(code, row, end_of)
    place = levels[-1].astype(np.int64)
    order = np.empty_like(place)
    order[place] = np.arange(len(place))
    lcp = np.zeros(len(order), dtype=np.int64)
    near = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    lcp[near] = common_prefixes(levels, order[near - 1], order[near], end_of)
    room = sizes[row][order] // exponent
    begin, half = branching_squares(lcp, order, place, room)
    back = common_suffixes(levels, begin, begin + half, start_of)
    length = back + 2 * half
    long = (length >= exponent * half) & (length >= least)
    begin, length, half = (begin - back)[long], length[long], half[long]
    order = np.lexsort((half, length, begin))
    begin, length, half = begin[order], length[order], half[order]
    # One stretch is one run, with the smallest of its periods.
    new = np.ones(len(begin), dtype=bool)
    new[1:] = (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])
    begin, length, half = begin[new], length[new], half[new]
    order = np.lexsort((half, begin))
    return begin[order], length[order], half[order]


def kept_words(n: int, begin: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, begin + period, 1)
    np.add.at(change, begin + length, -1)
    return np.cumsum(change[:-1]) == 0


def _joined(words: pa.Array, kept: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    upto = np.concatenate(([0], np.cumsum(kept)))[offsets]
    lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), words.filter(pa.array(kept)))
    return pc.binary_join(lists, " ")


def _search(least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.steps(whole, limit=STEP_BYTES):
                offsets, words = W.split_words(batch.column("text"))
                code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                found = find_runs(code.astype(np.int64), offsets, least=least, exponent=exponent)
                kept = kept_words(len(words), *found)
                row = np.searchsorted(offsets, found[0], side="right") - 1
                upto = np.searchsorted(row, np.arange(batch.num_rows + 1))
                fields = [found[0] - offsets[row], found[1], found[2]]
                runs = pa.StructArray.from_arrays(
                    [pa.array(f, pa.int64()) for f in fields], names=["start", "length", "period"]
                )
                yield pa.record_batch(
                    [
                        batch.column("doc_id"),
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(upto, pa.int32()), runs),
                        _joined(words, kept, offsets),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, *, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``doc_id, n_words``, the ``runs`` by start and period, and the ``collapsed`` text."""
    W.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_search(least, exponent), RUNS)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where the words of every tenth document repeat from some place on.

    With the CRC-32 of the decimal doc_id, h, and g = h div 10: if h is divisible by 10, word
    i >= a becomes word a + (i - a) mod p, with a = g mod n and p = 1 + (n - a) div (3 + g mod 8).
    A null doc_id has no number, so its text stays.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(F.col("text"), W.SPACE), lambda w: w != "")
    n = F.size("_words").cast("long")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
    tail = F.transform(
        F.sequence(F.col("_a"), n - 1),
        lambda i: F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")),
    )
    planted = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a").cast("int")), tail), " ")
    some = (h % 10 == 0) & F.col("text").isNotNull()
    return (
        docs.select("doc_id", "text", F.when(some, words).alias("_words"))
        .withColumn("_a", F.when(F.size("_words") > 0, a))
        .withColumn("_p", F.when(F.size("_words") > 0, p))
        .select("doc_id", F.coalesce(planted, "text").alias("text"))
    )


def _longest(runs: Column) -> Column:
    """The run with the greatest length; of equals the first by start, then period."""
    key = F.transform(
        runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))
    )
    return F.array_min(key)


def run_report(docs: DataFrame) -> DataFrame:
    """Digests of the runs of every text, and its longest run; see ``periodic_runs``."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    best = F.col("_best")
    return (
        periodic_runs(docs)
        .withColumn("_best", _longest(F.col("runs")))
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            best["s"].alias("start"),
            (-best["l"]).alias("length"),
            best["p"].alias("period"),
            F.floor(-best["l"] * 1000 / best["p"]).cast("long").alias("exponent_milli"),
            F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
            F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        )
    )
