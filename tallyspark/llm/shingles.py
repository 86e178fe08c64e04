"""Word shingles as 64-bit hashes, and their MinHash signatures."""

from __future__ import annotations

import re
from functools import cache

import numpy as np

from tallyspark.llm.runs import BLOCK, RunHashes, cut, units

WORD = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def _in_words() -> np.ndarray:
    """Which code units stand in words; those of pairs don't by themselves."""
    found = np.zeros(1 << 16, dtype=bool)
    for m in WORD.finditer("".join(map(chr, range(1 << 16)))):
        found[m.start() : m.end()] = True
    return found


class WordHashes:
    """Hashes of the words of texts: runs of letters, digits and underscores, in lower case."""

    def __init__(self) -> None:
        self.hashes, self.inside = RunHashes(), _in_words()

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        found: list[list[np.ndarray]] = [[] for _ in texts]
        group, owners, size = [], [], 0
        for i, text in enumerate(texts):
            for part in cut(text.lower()):
                group.append(part)
                owners.append(i)
                size += len(part)
                if size > BLOCK:
                    self._add(group, owners, found)
                    group, owners, size = [], [], 0
        self._add(group, owners, found)
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in found]

    def _add(self, parts: list[str], owners: list[int], found: list[list[np.ndarray]]) -> None:
        if not parts:
            return
        raw = [units(p + "\n") for p in parts]
        first = np.cumsum([0, *(len(r) // 2 for r in raw)])
        codes = np.frombuffer(b"".join(raw), dtype="<u2")
        inside = self.inside[codes]
        for i, part in enumerate(parts):
            if first[i + 1] - first[i] > len(part) + 1:
                inside[first[i] : first[i + 1]] = _marked(part)
        steps = np.diff(inside.view(np.int8), prepend=np.int8(0))
        begins, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        hashes = self.hashes(codes, begins, ends)
        edges = np.searchsorted(begins, first)
        for k, i in enumerate(owners):
            found[i].append(hashes[edges[k] : edges[k + 1]])


def _marked(part: str) -> np.ndarray:
    """Which code units stand in words, where some characters have two."""
    found = np.zeros(len(units(part)) // 2 + 1, dtype=bool)
    at = last = 0
    for m in WORD.finditer(part):
        begin = at + len(units(part[last : m.start()])) // 2
        last, at = m.end(), begin + len(units(m[0])) // 2
        found[begin:at] = True
    return found


def hashed_words(text: str, known: WordHashes) -> np.ndarray:
    return known.texts([text])[0]


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; for a shorter text one of all its words, for an empty one none."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    found = np.full(n, len(words) if len(words) < size else size, dtype=np.uint64)
    for k in range(min(size, len(words))):
        found = (found ^ words[k : k + n]) * MIX
        found ^= found >> np.uint64(29)
    return found


def shingle_set(text: str, size: int, known: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    return shingle_sets([text], size, known)[0]


def shingle_sets(texts: list[str], size: int, known: WordHashes) -> list[np.ndarray]:
    return [np.unique(rolled(words, size)) for words in known.texts(texts)]


class MinHash:
    """``n`` minimum hash values of a set; the signature of the empty set is all ones.

    A shingle's 32 high bits are permuted by odd factors: multiplying 32 bits is several times as fast as 64.
    """

    def __init__(self, n: int, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.a = (draw.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = draw.integers(0, 2**32, n, dtype=np.uint32)[:, None]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        high = (hashes >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(high), 2048):
            np.minimum(least, (self.a * high[None, at : at + 2048] + self.b).min(1), out=least)
        return least
