"""Packing over streams: what is left over between rows is kept as state per shard.

Rows should be dealt to shards with ``shard_of``, so that shards are even whatever the
sources are. A micro-batch's rows of a shard are taken in key order, so results do not depend
on the order in which tasks deliver them. Until they are in order their tokens lie in a temporary
file of the task, so a worker holds one chunk, one group or one row, however large a micro-batch is;
``maxFilesPerTrigger`` bounds the file.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from grainmill.constants import PAD_ID
from grainmill.operators.packing import SHARD

ROWS_PER_FRAME = 1000


def _in_key_order(frames: Iterator[pd.DataFrame], key: str, ids: str) -> Iterator[np.ndarray]:
    """Tokens of each row by key; only keys and places are held, the tokens are in a file."""
    keys, ends = [], [0]
    with tempfile.TemporaryFile() as file:
        for f in frames:
            keys += f[key].tolist()
            for row in f[ids]:
                tokens = np.asarray(row, np.int32)
                file.write(tokens.tobytes())
                ends.append(ends[-1] + len(tokens))
        for i in sorted(range(len(keys)), key=keys.__getitem__):
            file.seek(4 * ends[i])
            yield np.frombuffer(file.read(4 * (ends[i + 1] - ends[i])), np.int32)


def _frames(shard: int, rows: list[dict]) -> Iterator[pd.DataFrame]:
    for i in range(0, len(rows), ROWS_PER_FRAME):
        yield pd.DataFrame(rows[i : i + ROWS_PER_FRAME]).assign(**{SHARD: shard})


def pack_stream_stateful(
    df: DataFrame, seq_length: int, *, key: str = "doc_id", ids: str = "input_ids"
) -> DataFrame:
    """Carry-over packing of a stream; the state is the next chunk number and fewer than
    ``seq_length`` tokens."""

    def pack(group, frames, state) -> Iterator[pd.DataFrame]:
        chunk, cache = state.get if state.exists else (0, [])
        left, rows = np.asarray(cache, np.int32), []
        for tokens in _in_key_order(frames, key, ids):
            left = np.concatenate([left, tokens])
            whole = len(left) // seq_length * seq_length
            for i in range(0, whole, seq_length):
                rows.append({"chunk": chunk, ids: left[i : i + seq_length]})
                chunk += 1
            left = left[whole:]
            if len(rows) >= ROWS_PER_FRAME:
                yield from _frames(group[0], rows)
                rows = []
        state.update((chunk, left.tolist()))
        yield from _frames(group[0], rows)

    return (
        df.select(SHARD, key, ids)
        .groupBy(SHARD)
        .applyInPandasWithState(
            pack,
            f"{SHARD} int, chunk bigint, {ids} array<int>",
            "chunk bigint, cache array<int>",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )


def pack_groups_stateful(
    df: DataFrame,
    seq_length: int,
    num_sequences: int,
    *,
    key: str = "doc_id",
    ids: str = "input_ids",
    pad_id: int = PAD_ID,
) -> DataFrame:
    """Group packing of a stream; the state is the next group number and the tokens of fewer
    than ``num_sequences`` rows. A group that never fills up is never emitted."""

    def pack(group, frames, state) -> Iterator[pd.DataFrame]:
        grp, held, cache = state.get if state.exists else (0, 0, [])
        waiting, rows = [np.asarray(cache, np.int32)], []
        for tokens in _in_key_order(frames, key, ids):
            waiting.append(tokens)
            held += 1
            if held == num_sequences:
                whole = np.concatenate(waiting)
                whole = np.pad(whole, (0, -len(whole) % seq_length), constant_values=pad_id)
                chunks = whole.reshape(-1, seq_length)
                rows += [{"grp": grp, "chunk": i, ids: c} for i, c in enumerate(chunks)]
                grp, held, waiting = grp + 1, 0, []
                if len(rows) >= ROWS_PER_FRAME:
                    yield from _frames(group[0], rows)
                    rows = []
        left = np.concatenate(waiting).tolist() if waiting else []
        state.update((grp, held, left))
        yield from _frames(group[0], rows)

    return (
        df.select(SHARD, key, ids)
        .groupBy(SHARD)
        .applyInPandasWithState(
            pack,
            f"{SHARD} int, grp bigint, chunk bigint, {ids} array<int>",
            "grp bigint, held int, cache array<int>",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )
