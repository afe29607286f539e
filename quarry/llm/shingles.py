"""Shingles of words as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of consecutive words, A-Z lower-cased; of all words if there are fewer; none without words."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, U64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    n = min(words, len(found))
    starts = [0, *(ends[: len(found) - n] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)], U64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The different shingles of a text, in order."""
    return np.unique(shingle_hashes(text, words))
