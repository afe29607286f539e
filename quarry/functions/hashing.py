"""Hashing as column expressions: seeded, pluggable, and never a Python function a row.

A hash value is a long that stands for an unsigned 64-bit number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.params import DEFAULT_SEED

_M = (1 << 64) - 1
#: The primes of the published XXH64 algorithm.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & _M


def xxh64_long(value: int, seed: int = 42) -> int:
    """XXH64 of one 64-bit integer, as the engine's xxhash64 computes it."""
    h = (seed + _P5 + 8) & _M
    h ^= _rotl((value & _M) * _P2 & _M, 31) * _P1 & _M
    h = (_rotl(h, 27) * _P1 + _P4) & _M
    h = (h ^ (h >> 33)) * _P2 & _M
    h = (h ^ (h >> 29)) * _P3 & _M
    return h ^ (h >> 32)


def seed_literal(seed: int) -> int:
    """The long L for which xxhash64(L) is seed, so that xxhash64(L, x) hashes x with that seed.

    xxhash64 of several columns seeds each with the hash of those before; for one long the hash is
    a bijection, which is turned round here step by step.
    """
    inv = lambda p: pow(p, -1, 1 << 64)
    h = seed & _M
    h ^= h >> 32
    h = h * inv(_P3) & _M
    h ^= (h >> 29) ^ (h >> 58)
    h = h * inv(_P2) & _M
    h ^= h >> 33
    h = _rotl((h - _P4) * inv(_P1) & _M, 64 - 27)
    h ^= (42 + _P5 + 8) & _M
    h = _rotl(h * inv(_P1) & _M, 64 - 31) * inv(_P2) & _M
    return h - (1 << 64) if h >> 63 else h


def _xxh64_bytes(x: bytes, seed: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(x, seed & _M)


@dataclass(frozen=True)
class HashSpec:
    """A named way to hash a string or binary column with a seed. Any such function of columns will do."""

    name: str
    of: Callable[[Column, int], Column]
    signed: bool = True
    #: The same hash of bytes in Python, for the few operators that end in one small task.
    py: Callable[[bytes, int], int] | None = field(default=None, compare=False)

    def mod(self, h: Column, m: int) -> Column:
        """The unsigned value of h modulo m."""
        r = F.pmod(h, F.lit(m).cast("long"))
        return F.pmod(r + F.when(h < 0, F.lit((1 << 64) % m).cast("long")).otherwise(F.lit(0).cast("long")), F.lit(m).cast("long")) if self.signed else r


#: The default: XXH64 with any seed, inside Spark's own expressions.
XXH64 = HashSpec("xxh64", lambda c, seed: F.xxhash64(F.lit(seed_literal(seed)).cast("long"), c), py=lambda x, seed: _xxh64_bytes(x, seed))
#: 60 bits of MD5 of "<seed>:<element>"; any SQL engine computes the same.
PORTABLE = HashSpec("md5", lambda c, seed: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), c)), 1, 15), 16, 10).cast("long"), signed=False, py=lambda x, seed: int(hashlib.md5(f"{seed}:".encode() + x).hexdigest()[:15], 16))
SPECS = {s.name: s for s in (XXH64, PORTABLE)}


def element(c: Column | str, kind: str | None = None) -> Column:
    """A column as an element: strings and binaries as they are, anything else as its string."""
    c = F.col(c) if isinstance(c, str) else c
    return c if kind in ("string", "binary") else c.cast("string")


def hash_twice(c: Column, seed: int = DEFAULT_SEED, spec: HashSpec = XXH64) -> tuple[Column, Column]:
    """The hashes for seed + 1 and seed + 2."""
    return spec.of(c, seed + 1), spec.of(c, seed + 2)


def hash_hex(h: Column) -> Column:
    """Lower-case hex without leading zeros."""
    return F.lower(F.hex(h))


def hash_twice_struct(c: Column, seed: int = DEFAULT_SEED, spec: HashSpec = XXH64) -> Column:
    """struct(first, second, first_hex, second_hex)."""
    a, b = hash_twice(c, seed, spec)
    return F.struct(a.alias("first"), b.alias("second"), hash_hex(a).alias("first_hex"), hash_hex(b).alias("second_hex"))


def pair(c: Column, m: int, seed: int = DEFAULT_SEED, spec: HashSpec = XXH64) -> tuple[Column, Column]:
    """Both hashes modulo m. Put them into columns of their own before from_pair() reads them k times."""
    a, b = hash_twice(c, seed, spec)
    return spec.mod(a, m), spec.mod(b, m)


def from_pair(a: Column, b: Column, m: int, k: int) -> list[Column]:
    """(a + i b + i^3 - i div 6) mod m for i below k: k indexes in [0, m), perhaps with repeats.

    The operands are reduced, so nothing overflows.
    """
    return [(a + F.lit(i).cast("long") * b + F.lit((i**3 - i // 6) % m).cast("long")) % F.lit(m).cast("long") for i in range(k)]


def indexes(c: Column, m: int, k: int, seed: int = DEFAULT_SEED, spec: HashSpec = XXH64) -> list[Column]:
    """k indexes of an element in [0, m)."""
    return from_pair(*pair(c, m, seed, spec), m, k)
