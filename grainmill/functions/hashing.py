"""Repeatable pseudo-random values: each is an md5 of the seed and the row's own key.

They depend on neither partitioning nor evaluation order, so a lost executor recomputes the
same values, and any SQL engine with md5 gives the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD = 2**32


def _digest(seed: int, key: Column, salt: str = "") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}{salt}:"), key.cast("string")))


def _word(digest: Column, start: int = 1) -> Column:
    """Eight hex digits of a digest as a number below 2^32."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")


def shuffle_key(seed: int, key: Column) -> Column:
    """Sort key of a seeded shuffle; ties need the row key as second sort column."""
    return _digest(seed, key)


def shuffle_bucket(shuffled: Column, n_buckets: int) -> Column:
    """Slice number 0..n_buckets-1 of a shuffle key: even-sized, and rising with the key."""
    return F.coalesce(F.shiftright(_word(shuffled) * F.lit(n_buckets), 32), F.lit(0))


def uniform(seed: int, key: Column, draw: int) -> Column:
    """One of four independent uniforms in [0, 1) for this seed and key."""
    return _word(_digest(seed, key, ":u"), 8 * draw + 1) / F.lit(float(WORD))


def shard_of(seed: int, key: Column, num_shards: int) -> Column:
    """Deal rows evenly to readers, whatever their source or size of source."""
    dealt = (_word(_digest(seed, key, ":shard")) % F.lit(num_shards)).cast("int")
    return F.coalesce(dealt, F.lit(0))
