"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

The n-grams are pairs of neighbouring words. An alignment at the threshold holds at least ``least_pairs`` of an item's
pairs, so it holds one of any selection that leaves out fewer: an item's seeds are its rarest pairs among the test items,
all but ``least_pairs`` - 1 of them. Texts without a seed are left at once; in others all pairs are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark import scratch
from tallyspark.llm.batches import sliced, small_batches
from tallyspark.llm.shingles import MIX, WordHashes, hashed_words

#: The fewest words of an item; the share of an item's score at which a document counts as contaminated.
LEAST_WORDS, LEAST_SCORE = 3, 0.45
MATCH, MISMATCH, GAP = 1.0, -0.5, 0.5
#: The most words of an alignment at the threshold, as a multiple of the item's words. With m matches, x mismatches and
#: g words of the document in gaps, m + x <= n and m - x / 2 - g / 2 >= 0.45 n, so m + x + g <= 3 m - 0.9 n <= 2.1 n.
REACH = 1 + (1 - LEAST_SCORE) / GAP
#: Words of test items that a task holds at once; a larger benchmark is searched for in blocks.
BLOCK_WORDS = 4_000_000


def _best_end(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """The best local score, and how many words of ``b`` stand up to its end."""
    row, slope, best, at = np.zeros(len(b) + 1), GAP * np.arange(len(b) + 1), 0.0, 0
    for w in a:
        reached = np.zeros(len(b) + 1)
        reached[1:] = np.maximum(row[:-1] + np.where(b == w, MATCH, MISMATCH), row[1:] - GAP)
        np.maximum(reached, 0, out=reached)
        # A gap in the item: the best cell to the left, less what the way from it costs.
        row = np.maximum.accumulate(reached + slope) - slope
        if (top := row.max()) > best:
            best, at = float(top), int(row.argmax())
    return best, at


def align(item: np.ndarray, words: np.ndarray, least: float = 0.0) -> tuple[float, int, int]:
    """The best local alignment: its score as a share of the item's words, its first and last position in ``words``.

    Positions are 0 for scores of nothing and below ``least``.
    """
    best, last = _best_end(item, words)
    score = best / (MATCH * len(item))
    if not best or score < least:
        return score, 0, 0
    _, back = _best_end(item[::-1], words[:last][::-1])
    return score, last - back, last - 1


def pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash for each pair of words."""
    found = (first ^ np.uint64(2)) * MIX
    found ^= found >> np.uint64(29)
    found ^= second
    found *= MIX
    found ^= found >> np.uint64(29)
    return found


def least_pairs(n: int) -> int:
    """How many pairs of neighbours of an item of ``n`` words stand in an alignment at the threshold, side by side or
    with one word between them.

    Take the matches of an alignment in turn. From one to the next, h steps are such pairs; p go to the next word of
    the item over two or more words of the document and cost 1 or more; q skip words of the item and cost 1/2 or more.
    n >= 1 + h + p + 2 q, so the score is at most 1 + h + q / 2 <= 3/4 (1 + h) + n / 4.
    """
    return max(1, int(np.ceil(((LEAST_SCORE - 0.25) * n - 0.75) / 0.75 - 1e-9)))


#: Bits of a hash that say whether it may be one of the test items'.
_BITS = 18


class _Lookup:
    """Positions of hashes that are in a sorted array; most others are told by a few of their bits."""

    def __init__(self, known: np.ndarray):
        self.known, self.maybe = known, np.zeros(1 << _BITS, dtype=bool)
        self.maybe[(known >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and their places in ``known``."""
        where = np.flatnonzero(self.maybe[(hashes >> np.uint64(64 - _BITS)).astype(np.int32)])
        at = np.minimum(np.searchsorted(self.known, hashes[where]), max(0, len(self.known) - 1))
        sure = self.known[at] == hashes[where] if len(self.known) else at > 0
        return where[sure], at[sure]


class Items:
    """Test items as hashed words, the pairs of neighbours in them, and the seeds among these."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        hashed = WordHashes().texts([t for _, t in rows])
        self.items = [(i, w) for (i, _), w in zip(rows, hashed, strict=True) if len(w) >= LEAST_WORDS]
        self.distinct = [np.unique(w, return_counts=True) for _, w in self.items]
        self.sizes = np.array([len(w) for _, w in self.items], dtype=np.int64)
        self.reach = (REACH * self.sizes + 1e-9).astype(np.int64)
        self.least = np.array([least_pairs(n) for n in self.sizes.tolist()], dtype=np.int64)
        # Of three words the outer two reach the threshold, too.
        own = [np.unique(np.concatenate([pairs(w[:-1], w[1:]), pairs(w[:1], w[2:]) if len(w) == 3 else w[:0]])) for _, w in self.items]
        every = np.concatenate(own) if own else np.zeros(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(own)), [len(g) for g in own])
        order = np.lexsort((owner, every))
        grams, first = np.unique(every[order], return_index=True)
        self.owners = owner[order]
        self.bounds = np.append(first, len(every))
        self.grams = _Lookup(grams)
        often = np.diff(self.bounds)
        self.seeds = np.zeros(len(grams), dtype=bool)
        for k, g in enumerate(own):
            at = np.searchsorted(grams, g)
            self.seeds[at[np.argsort(often[at], kind="stable")][: self._seeds(k, len(g))]] = True

    def _seeds(self, k: int, distinct: int) -> int:
        """How many pairs of an item seed. A pair that stands in the item more than once can be met as often in an
        alignment, so those that are left out count with their repeats."""
        repeats = int(self.sizes[k]) - 1 - distinct
        return distinct - max(0, int(self.least[k]) - 1 - max(0, repeats))

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and the positions at which a pair of them begins, each once, in order."""
        met = [self.grams(pairs(words[:-step], words[step:])) for step in (1, 2)]
        if not any(self.seeds[at].any() for _, at in met):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        owners, places = [], []
        for where, at in met:
            begin, n = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
            owners.append(self.owners[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())])
            places.append(np.repeat(where, n))
        every = np.unique(np.concatenate(owners) * len(words) + np.concatenate(places))
        return every // len(words), every % len(words)

    def passages(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Item, begin and end of the passages that hold every alignment at the threshold."""
        if len(words) < 2 or not self.items:
            return
        owners, places = self.hits(words)
        last = np.arange(len(owners)) + self.least[owners] - 1
        whole = np.minimum(last, len(owners) - 1)
        dense = np.nonzero((last < len(owners)) & (owners[whole] == owners) & (places[whole] - places < self.reach[owners]))[0]
        at, n = 0, len(dense)
        while at < n:
            k = int(owners[dense[at]])
            reach = int(self.reach[k])
            begin, end = max(0, int(places[last[dense[at]]]) + 2 - reach), int(places[dense[at]]) + reach
            at += 1
            while at < n and owners[dense[at]] == k and places[last[dense[at]]] + 2 - reach <= end:
                end = int(places[dense[at]]) + reach
                at += 1
            end = min(end, len(words))
            # No alignment scores more than the words in common, each as often as both have it.
            distinct, counts = self.distinct[k]
            at_word = np.minimum(np.searchsorted(distinct, words[begin:end]), len(distinct) - 1)
            shared = np.bincount(at_word[distinct[at_word] == words[begin:end]], minlength=len(distinct))
            if np.minimum(shared, counts).sum() >= LEAST_SCORE * self.sizes[k]:
                yield k, begin, end


_LEAKS = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]


def _alignments(items: Items, words: np.ndarray) -> Iterator[tuple[int | None, float, int, int]]:
    """item_id, score, first and last word of alignments at the threshold."""
    for k, first, end in items.passages(words):
        item_id, item = items.items[k]
        score, begin, last = align(item, words[first:end], LEAST_SCORE)
        if score >= LEAST_SCORE:
            yield item_id, score, first + begin, first + last


def _leaks(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known = Items(sent.value), WordHashes()
        for batch in sliced(batches):
            texts = known.texts([t or "" for t in batch["text"].to_pylist()])
            rows = [(doc_id, *x) for doc_id, words in zip(batch["doc_id"].to_pylist(), texts, strict=True) for x in _alignments(items, words)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_LEAKS)], [c for c, _ in _LEAKS])

    return run


def _clean(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known = Items(sent.value), WordHashes()
        for batch in sliced(batches):
            texts = known.texts([t or "" for t in batch["text"].to_pylist()])
            yield batch.filter(pa.array([next(_alignments(items, words), None) is None for words in texts], pa.bool_()))

    return run


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[Broadcast]:
    """Distinct test items in blocks of about so many words, one sent to tasks at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows])


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word: the best alignment of each document and test item above LEAST_SCORE.

    Passages without a seed, or that hold too few of an item's word pairs or words to reach the threshold, are left out
    before alignment, which can't lose a result: every alignment at the threshold is found, however rare or frequent
    its words are. Words are runs of letters, digits and underscores in lower case. Null and empty texts match nothing,
    nor do items without an id or of fewer than three words; rows that repeat a doc_id or item_id count as one, the best
    score standing; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    found = None
    for sent in _blocks(benchmark.where("item_id is not null"), block_words):
        part = scratch.stage(docs.select("doc_id", "text").mapInArrow(_leaks(sent), "doc_id long, item_id long, score double, first_word long, last_word long"), "leaks")
        found = part if found is None else found.union(part)
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("score"), "first_word")
    return found.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def without_leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text no test item aligns with at the threshold.

    Each row is judged by its own text, whatever its id; items without an id count.
    """
    small_batches(docs.sparkSession)
    for sent in _blocks(benchmark, block_words):
        docs = docs.mapInArrow(_clean(sent), docs.schema)
    return docs
