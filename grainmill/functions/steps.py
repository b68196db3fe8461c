"""Parts of Arrow columns that a task works on one after another.

Spark hands a function up to 10,000 rows at once, and what is made of them may be many times as
large. A function that works part by part and yields each result holds one part's worth of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text, or entries of lists, that one step turns into something else; a longer row is a
# step of its own.
STEP_BYTES = 1 << 20
STEP_ENTRIES = 1 << 18


def _steps(column: pa.Array, sizes: pa.Array, limit: int) -> Iterator[pa.Array]:
    if not len(column):
        return
    group = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)]
    for a, b in zip(cuts, cuts[1:]):
        yield column[a:b]


def text_steps(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[pa.Array]:
    """Parts of a text column with about ``limit`` bytes each."""
    return _steps(texts, pc.binary_length(texts), limit)


def list_steps(lists: pa.Array, limit: int = STEP_ENTRIES) -> Iterator[pa.Array]:
    """Parts of a list column with about ``limit`` entries each."""
    return _steps(lists, pc.list_value_length(lists), limit)
