"""A count-min sketch of 64-bit hashes that tells "once" from "twice or more".

Each task sketches its own rows with counters that stop at 2; the sketches are merged by parts
of the counter range. Its size is fixed (``ROWS * 2 ** bits`` counters), so what is broadcast
does not grow with the data: a fuller sketch lets more through, but never loses a repeat.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from grainmill.llm import words as W

# Two rows of 2 ** 26 counters; only the bit "2 or more" of each is broadcast: 16 MB.
ROWS = 2
BITS = 26
# Each row is cut into this many parts for merging.
PARTS = 64

PARTIAL = "part int, once binary, twice binary"

Hashes = Callable[[pa.RecordBatch], Iterator[np.ndarray]]


def _slots(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of each hash in one row of the sketch."""
    with np.errstate(over="ignore"):
        return (W.mixed(hashes + np.uint64(row + 1)) >> np.uint64(64 - bits)).astype(np.int64)


def _bits_of(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a bit plane that sorted, distinct slots lie in, and their bits."""
    byte = slots >> 3
    bit = (1 << (7 - (slots & 7))).astype(np.uint8)
    start = np.flatnonzero(np.diff(byte, prepend=-1))
    return byte[start], np.bitwise_or.reduceat(bit, start) if len(start) else bit


def _partial(hashes: Hashes, bits: int):
    """Counters of a whole task, held and sent as two bit planes: once, and twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = np.zeros((ROWS, (1 << bits) // 8), dtype=np.uint8)
        twice = np.zeros_like(once)
        for batch in batches:
            for found in hashes(batch):
                for r in range(ROWS):
                    slots, counts = np.unique(_slots(found, r, bits), return_counts=True)
                    byte, bit = _bits_of(slots)
                    twice[r, byte] |= once[r, byte] & bit
                    once[r, byte] |= bit
                    byte, bit = _bits_of(slots[counts > 1])
                    twice[r, byte] |= bit
        size = (1 << bits) // PARTS // 8
        for r in range(ROWS):
            for p in range(PARTS):
                part = slice(p * size, (p + 1) * size)
                if once[r, part].any():
                    planes = [zlib.compress(x[r, part].tobytes(), 1) for x in (once, twice)]
                    columns = [pa.array([r * PARTS + p], pa.int32())]
                    columns += [pa.array([x], pa.binary()) for x in planes]
                    yield pa.record_batch(columns, names=["part", "once", "twice"])

    return run


def _merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the sketches of all tasks for one part of the counters; one is held at a time."""
    once = twice = None
    for batch in batches:
        for a, b in zip(batch.column("once"), batch.column("twice")):
            one = np.frombuffer(zlib.decompress(a.as_py()), np.uint8)
            two = np.frombuffer(zlib.decompress(b.as_py()), np.uint8)
            if once is None:
                once, twice = one.copy(), two.copy()
            else:
                twice |= two | (once & one)
                once |= one
    packed = zlib.compress(twice.tobytes(), 1)
    yield pa.record_batch(
        [pa.array([key[0].as_py()], pa.int32()), pa.array([packed], pa.binary())],
        names=["part", "twice"],
    )


class Repeated:
    """Which hashes the corpus may hold twice or more."""

    def __init__(self, planes: list[bytes], bits: int):
        self.planes, self.bits = [np.frombuffer(p, np.uint8) for p in planes], bits

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for r, plane in enumerate(self.planes):
            at = np.flatnonzero(out)
            slots = _slots(hashes[at], r, self.bits)
            out[at] = (plane[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1
        return out


def repeated(rows: DataFrame, hashes: Hashes, bits: int = BITS):
    """Sketch the hashes of all batches of ``rows``; the planes as a broadcast variable."""
    W.small_batches(rows.sparkSession)
    size = (1 << bits) // PARTS // 8
    planes = [np.zeros((1 << bits) // 8, dtype=np.uint8) for _ in range(ROWS)]
    partial = rows.mapInArrow(_partial(hashes, bits), PARTIAL)
    merged = partial.groupBy("part").applyInArrow(_merge, "part int, twice binary")
    for row in merged.collect():  # ROWS * PARTS rows, whatever the data is
        r, p = divmod(row["part"], PARTS)
        planes[r][p * size : (p + 1) * size] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return rows.sparkSession.sparkContext.broadcast([p.tobytes() for p in planes])
