"""Per-row work on token arrays, as Column functions. None of them needs a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from grainmill.constants import BOS_ID, EOS_ID, IGNORE_INDEX, PAD_ID, SPECIAL_TOKENS
from grainmill.functions.hashing import uniform
from grainmill.functions.steps import list_steps


def _zero_if_negative(n: Column) -> Column:
    return F.greatest(n, F.lit(0))


def truncate(ids: Column, seq_length: int) -> Column:
    return F.slice(ids, 1, seq_length)


def pad_to(ids: Column, seq_length: int, value: int = PAD_ID) -> Column:
    """Right-pad; arrays that are already long enough stay as they are."""
    missing = _zero_if_negative(F.lit(seq_length) - F.size(ids))
    return F.concat(ids, F.array_repeat(F.lit(value), missing))


def attention_mask(n_tokens: Column, seq_length: int) -> Column:
    """Ones for real tokens, zeros for padding, from the token count before padding."""
    real = F.least(n_tokens, F.lit(seq_length))
    return F.concat(
        F.array_repeat(F.lit(1), real),
        F.array_repeat(F.lit(0), F.lit(seq_length) - real),
    )


def sample_start(
    n_tokens: Column, seq_length: int, seed: int, key: Column
) -> Column:
    """First index of a training window: the front one time in four, else uniform."""
    span = n_tokens - F.lit(seq_length) + F.lit(1)
    anywhere = F.floor(uniform(seed, key, 1) * span).cast("int")
    stay = (n_tokens <= seq_length) | (uniform(seed, key, 0) < F.lit(0.25))
    return F.when(stay, F.lit(0)).otherwise(anywhere)


def end_with_eos(ids: Column) -> Column:
    """Overwrite the last token with the end token; an empty array has none and stays empty."""
    kept = F.slice(ids, F.lit(1), _zero_if_negative(F.size(ids) - 1))
    return F.concat(kept, F.slice(F.array(F.lit(EOS_ID)), F.lit(1), F.size(ids)))


def sample_window(ids: Column, seq_length: int, seed: int, key: Column) -> Column:
    """A window of at most ``seq_length`` tokens that ends in the end token."""
    start = sample_start(F.size(ids), seq_length, seed, key)
    window = F.slice(ids, start + 1, F.lit(seq_length))
    return F.transform(F.array(window), end_with_eos)[0]


def pretrain_labels(ids: Column) -> Column:
    """The ids themselves, padding ignored. Most packed rows have no padding to replace."""
    replaced = F.transform(ids, lambda x: F.when(x == PAD_ID, IGNORE_INDEX).otherwise(x))
    return F.when(F.array_contains(ids, F.lit(PAD_ID)), replaced).otherwise(ids)


def answer_labels(ids: Column, n_source: Column, n_tokens: Column) -> Column:
    """Labels of the answer part only: the source part and the padding are ignored."""
    return F.transform(
        ids,
        lambda x, i: F.when((i < n_source) | (i >= n_tokens) | (x == PAD_ID), IGNORE_INDEX)
        .otherwise(x),
    )


def shifted_targets(labels: Column) -> Column:
    """Target of position t is the label of position t+1."""
    return F.slice(labels, F.lit(2), _zero_if_negative(F.size(labels) - 1))


def n_loss_tokens(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != IGNORE_INDEX))


def _positions(masks: pa.Array) -> pa.ListArray:
    sizes = pc.fill_null(pc.list_value_length(masks), 0).to_numpy(zero_copy_only=False)
    ones = masks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    seen = np.cumsum(ones)
    before = np.concatenate(([0], seen))[ends[:-1]]
    places = np.where(ones == 0, 1, seen - np.repeat(before, sizes) - 1).astype(np.int32)
    offsets = pa.array(ends.astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(places), mask=masks.is_null())


def positions_by_steps(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield from map(_positions, list_steps(batch))


def position_ids(mask: Column) -> Column:
    """Running count of ones minus 1; 1 where the mask is 0. Works for any mask layout."""
    return F.arrow_udf(positions_by_steps, "array<int>")(mask)


def right_padded_position_ids(mask: Column) -> Column:
    """``position_ids`` for masks whose ones all come first: linear in the length."""
    return F.transform(mask, lambda m, i: F.when(m == 0, F.lit(1)).otherwise(i))


def last_token_index(ids: Column) -> Column:
    """Index before the first padding; -1 (the last element) if there is no padding."""
    first_pad = F.array_position(ids, F.lit(PAD_ID))
    return F.when(first_pad == 0, F.lit(-1)).otherwise(first_pad - 2).cast("int")


def _flags(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


def add_special_tokens(
    a: Column, b: Column | None = None, *, bos: bool = False, eos: bool = False
) -> Column:
    """Wrap one or two sequences in begin and end tokens."""
    begin, end = _flags([BOS_ID] * bos), _flags([EOS_ID] * eos)
    parts = [begin, a, end] + ([] if b is None else [begin, b, end])
    return F.concat(*parts)


def special_tokens_mask(
    a: Column, b: Column | None = None, *, bos: bool = False, eos: bool = False
) -> Column:
    """1 on the tokens that ``add_special_tokens`` adds, 0 on the rest."""
    begin, end = _flags([1] * bos), _flags([1] * eos)
    parts = []
    for ids in [a] if b is None else [a, b]:
        parts += [begin, F.array_repeat(F.lit(0), F.size(ids)), end]
    return F.concat(*parts)


def ready_special_tokens_mask(ids: Column) -> Column:
    """1 on every special token of a sequence that already holds them."""
    last_special = len(SPECIAL_TOKENS) - 1
    return F.transform(ids, lambda x: x.between(0, last_special).cast("int"))


def segment_ids(
    a: Column, b: Column | None = None, *, bos: bool = False, eos: bool = False
) -> Column:
    """0 for the first sequence and 1 for the second, added tokens included."""
    added = int(bos) + int(eos)
    first = F.array_repeat(F.lit(0), F.size(a) + added)
    return first if b is None else F.concat(first, F.array_repeat(F.lit(1), F.size(b) + added))
