"""Dense numbers that describe a whole text: rates of character classes, words, lines and repeats."""

from __future__ import annotations

import math
import re

import numpy as np

WORD = re.compile(r"\w+")
UPPER, LOWER, DIGIT = (np.array([getattr(chr(i), f)() and i < 128 for i in range(256)]) for f in ("isupper", "islower", "isdigit"))
PUNCT = np.array([33 <= i < 127 and not chr(i).isalnum() for i in range(256)])

TEXT_STATS = ("log_chars", "upper", "digit", "punct", "exclaim", "question", "bar", "symbol", "wide", "word_len", "distinct_words", "distinct_trigrams", "distinct_lines", "line_len", "stops", "short_words")


def counts(text: str) -> np.ndarray:
    """Bytes of the text by value."""
    return np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)


def text_stats(text: str) -> list[float]:
    """The values of TEXT_STATS; all zero for the empty text."""
    n = len(text)
    if not n:
        return [0.0] * len(TEXT_STATS)
    by = counts(text)
    words = WORD.findall(text.lower())
    lines = [x for x in text.split("\n") if x]
    m = max(1, len(words))
    return [
        math.log1p(n),
        by[UPPER].sum() / n,
        by[DIGIT].sum() / n,
        by[PUNCT].sum() / n,
        by[33] / n,
        by[63] / n,
        by[124] / n,
        by[[35, 36, 37, 38, 42, 60, 61, 62, 64, 94, 95, 126]].sum() / n,
        by[128:].sum() / n,
        sum(map(len, words)) / m,
        len(set(words)) / m,
        len(set(zip(words, words[1:], words[2:]))) / max(1, m - 2),  # noqa: B905
        len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
        (by[46] + by[33] + by[63]) / m,
        sum(len(w) < 4 for w in words) / m,
    ]
