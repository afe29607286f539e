"""Seeded random columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def random_int(low: int, high: int, seed: int) -> Column:
    """A long drawn uniformly from low to high, both included."""
    if low > high:
        raise ValueError("low is above high")
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("long")


def next_int32(seed: int) -> Column:
    """A signed 32-bit integer."""
    return random_int(-(2**31), 2**31 - 1, seed).cast("int")
