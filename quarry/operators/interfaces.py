"""What sketches have in common, as protocols."""

from __future__ import annotations

from dataclasses import replace
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class Membership(Protocol):
    """Filters that say "perhaps in" or "certainly not"."""

    state: DataFrame

    def probe(self, df: DataFrame, column: str, out: str = "has") -> DataFrame: ...

    def equals(self, other) -> bool: ...

    def to_json(self) -> str: ...


@runtime_checkable
class Removable(Membership, Protocol):
    """Filters from which elements can be taken away again."""

    def remove(self, df: DataFrame, column: str): ...


@runtime_checkable
class Counting(Protocol):
    """Sketches that estimate the weight of an element."""

    def update(self, df: DataFrame, column: str, weight: str | None = None): ...

    def estimate(self, keys: DataFrame, column: str, out: str = "estimate") -> DataFrame: ...


def with_seed(params, seed: int):
    """The same parameters with another seed; sketches of different seeds don't merge."""
    return replace(params, seed=seed)
