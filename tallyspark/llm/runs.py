"""Texts as arrays of code units: runs of characters get hashes without a Python object for each."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Code units looked at together.
BLOCK = 1 << 18
_MULTIPLIER = 0xD6E8FEB86659FD93


def units(text: str) -> bytes:
    """Two bytes a code unit; what lies beyond the basic plane has two of them."""
    return text.encode("utf-16-le", "surrogatepass")


def cut(text: str) -> Iterator[str]:
    """The text in parts of at most BLOCK characters that end at blanks; without one, a part is longer."""
    at = 0
    while len(text) - at > BLOCK:
        end = text.rfind(" ", at, at + BLOCK)
        if end <= at:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def _powers(n: int, base: int) -> np.ndarray:
    found = np.full(n, base, dtype=np.uint64)
    found[0] = 1
    return np.cumprod(found, dtype=np.uint64)


@cache
def _tables(log2: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << log2, _MULTIPLIER), _powers(1 << log2, pow(_MULTIPLIER, -1, 1 << 64))


class RunHashes:
    """64-bit hashes of runs of code units, equal for equal runs wherever they stand."""

    def __init__(self) -> None:
        self.values = np.random.default_rng(5).integers(1, 2**63, 1 << 16, dtype=np.uint64)

    def __call__(self, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        # Sums of value times power up to each unit; a run's is the difference, moved back to where powers begin.
        up, down = _tables(max(19, int(len(codes)).bit_length()))
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(self.values[codes] * up[: len(codes)], out=sums[1:])
        found = (sums[ends] - sums[begins]) * down[begins]
        found ^= found >> np.uint64(31)
        found *= np.uint64(0x9E3779B97F4A7C15)
        return found
