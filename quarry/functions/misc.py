"""Random numbers and the clock."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rand_double(seed: int | None = None) -> Column:
    return F.rand(seed)


def rand_int(bound: int, seed: int | None = None) -> Column:
    """A number from 0 to bound - 1."""
    return F.floor(F.rand(seed) * bound).cast("bigint")


def tick_count() -> Column:
    """Milliseconds since midnight, UTC."""
    return F.unix_millis(F.current_timestamp()) % 86_400_000
