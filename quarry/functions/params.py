"""Sizing formulas and other numbers that a plan needs before it is built. Nothing here touches data."""

from __future__ import annotations

import math
import random

DEFAULT_SEED = 0x1234567890


def optimal_size(n: int, rate: float) -> int:
    """Bits of a Bloom filter for n items at a false positive rate."""
    return math.ceil(-(n * math.log(rate)) / math.log(2) ** 2)


def optimal_hashes(size: int, n: int) -> int:
    return math.ceil(size / n * math.log(2))


def check_rate(rate: float) -> float:
    if not 0 < rate < 1:
        raise ValueError("the rate must lie between 0 and 1")
    return rate


def xor_slots(n: int) -> int:
    """1.23 n + 32 slots, rounded down to a multiple of three."""
    slots = math.floor(1.23 * n + 32)
    return slots - slots % 3


def fingerprint_bits(bucket_size: int, rate: float) -> int:
    """Bits of a cuckoo fingerprint for a rate: log2(1 / rate) + log2(2 * bucket size)."""
    return math.ceil(math.log2(1 / rate) + math.log2(2 * bucket_size))


def power_of_two(n: int) -> int:
    return 1 << max(0, math.ceil(n) - 1).bit_length()


def hll_alpha(m: int) -> float:
    for below, value in ((16, 1.0), (32, 0.673), (64, 0.697), (128, 0.709)):
        if m < below:
            return value
    return 0.7213 / (1 + 1.079 / m)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, math.isqrt(n) + 1))


def next_prime(n: int) -> int:
    """The least prime that is n or more."""
    while not is_prime(n):
        n += 1
    return n


def hash_family(count: int, max_value: int, seed: int = DEFAULT_SEED) -> list[tuple[int, int, int]]:
    """count functions (a, b, c) for (a x + b) mod c, c the next prime; a is 1 at least."""
    if max_value * max_value + max_value >= 1 << 63:
        raise ValueError("a * x + b wouldn't fit 64 bits")
    draw, c = random.Random(seed), next_prime(max_value)
    return [(draw.randint(1, max_value), draw.randint(0, max_value), c) for _ in range(count)]


def generation_plan(n: int, rate: float, ratio: float, count: int) -> list[dict]:
    """Size, slices and capacity of each generation of a scalable filter.

    A later generation takes as its number of items the first one's slice bits times 2^i, its rate
    is the last one's times ratio, and it has log2(1 / ratio) more slices a generation.
    """
    out: list[dict] = []
    for i in range(count):
        if i == 0:
            items, p, k = n, rate, max(math.ceil(math.log2(1 / rate)), 2)
        else:
            items, p = out[0]["slice_bits"] * 2**i, out[-1]["rate"] * ratio
            k = max(math.ceil(out[0]["slices"] + i * math.log2(1 / ratio)), 2)
        bits = items * abs(math.log(p)) / math.log(2) ** 2
        m = math.ceil(bits / k)
        out.append({"generation": i, "items": items, "rate": p, "slices": k, "bits": bits, "slice_bits": m, "capacity": math.floor(k * m * math.log(2) ** 2 / abs(math.log(p)))})
    return out


def iblt_cells(differences: int, alpha: float, hashes: int) -> int:
    """alpha cells a difference, and one to `hashes` more up to a multiple of `hashes`."""
    cells = math.ceil(differences * alpha)
    return cells + hashes - cells % hashes
