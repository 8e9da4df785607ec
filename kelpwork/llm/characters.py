"""Texts as arrays of code points, and hashes of stretches of them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Characters that are looked at at once; longer texts are cut at a line end, else at white space.
CHUNK = 1 << 20

# odd numbers have an inverse modulo 2**64, so a hash of any stretch comes from running sums
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, x, np.uint64)]) for x in (_BASE, _INVERSE))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch of code points, the same wherever it stands."""
    power, inverse = _powers(1 << max(12, len(codes).bit_length()))
    with np.errstate(over="ignore"):
        up_to = np.r_[np.uint64(0), np.cumsum(codes.astype(np.uint64) * power[: len(codes)])]
        return (up_to[end] - up_to[start]) * inverse[start]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes (a bijection)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def pieces(text: str, size: int | None = None) -> Iterator[str]:
    """Parts of at most ``size`` characters, which end after a line end or blank where there is one."""
    at, size = 0, size or CHUNK
    while len(text) - at > size:
        end = text.rfind("\n", at + 1, at + size) + 1 or text.rfind(" ", at + 1, at + size) + 1 or at + size
        yield text[at:end]
        at = end
    yield text[at:]
