"""Spelling variants: bit-sliced position indexes over blocks of the vocabulary find all words one edit away.

Two words one edit apart agree in their first letters or in their last ones, so each word is filed under both parts. A
bucket's words are dealt into blocks; a task gets one or two blocks, keeps a bitset of words for each (position, letter),
and runs every word of one block through the bitsets of the other: four sets, updated once a letter, hold the words
that match without an error so far, or with one letter replaced, added or left out. No row is made per pair.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Words of a block, and letters, which bound its index.
BLOCK, BLOCK_LETTERS = 4096, 1 << 16


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, change: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """word, n: maximal runs of Latin letters of all whole texts, A to Z in lower case.

    ``change(doc_id, run)`` may replace each run. Words of fewer code points than ``min_length`` or fewer occurrences than
    ``min_count`` are left out. Null texts have no words; repeated rows count each for itself.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    word = change(F.col("doc_id"), F.col("run")) if change else F.col("run")
    return runs.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


class Slices:
    """Bitsets of words by position and letter; bit i is the i-th word of a list."""

    def __init__(self, words: list[str]):
        self.all = (1 << len(words)) - 1
        at: dict[tuple[int, str], int] = defaultdict(int)
        ends: dict[int, int] = defaultdict(int)
        for i, word in enumerate(words):
            ends[len(word)] |= 1 << i
            for place in enumerate(word):
                at[place] |= 1 << i
        self.at, self.ends = dict(at), dict(ends)

    def near(self, word: str, part: int = 0) -> int:
        """The words one edit away from ``word``; those that also share its first ``part`` letters are left out if part > 0."""
        at, ends = self.at, self.ends
        same, replaced, longer, shorter, begun = self.all, 0, 0, 0, 0
        for i, letter in enumerate(word):
            here = at.get((i, letter), 0)
            # Words with a letter more match a place later from their extra letter on, words with one less a place earlier.
            replaced = replaced & here | same & ~here
            longer = (longer | same) & at.get((i + 1, letter), 0)
            shorter = shorter & at.get((i - 1, letter), 0) | same
            same &= here
            if i + 1 == part:
                begun = same
            if not same | replaced | longer | shorter:
                return 0
        n = len(word)
        return (replaced & ends.get(n, 0) | (longer | same) & ends.get(n + 1, 0) | shorter & ends.get(n - 1, 0)) & ~begun


def _compared(part: int) -> Callable[[pa.Table], pa.Table]:
    """Two blocks of a bucket, or one with itself: how many near words each word has there, and the first of them."""

    def run(cell: pa.Table) -> pa.Table:
        rows = sorted(zip(*(cell[c].to_pylist() for c in ("block", "n", "word")), strict=True), key=lambda r: (-r[1], r[2]))
        cut = part if cell["last"][0].as_py() else 0
        alone = cell["p"][0].as_py() == cell["q"][0].as_py()
        blocks: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for block, n, word in rows:
            blocks[block].append((n, word))
        # Bits stand in order of count and letters: the lowest one is the best near word.
        slices = {b: Slices([w for _, w in words]) for b, words in blocks.items()}
        found = []
        for asking, words in blocks.items():
            for told in blocks:
                if asking == told and not alone:
                    continue
                for _, word in words:
                    near = slices[told].near(word, cut)
                    if near:
                        n, best = blocks[told][(near & -near).bit_length() - 1]
                        found.append((word, near.bit_count(), n, best))
        columns = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "n", "near"])

    return run


def near_words(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """word, n_near, best (minus n, near): of ``words`` (word, n) those that have near words, each of ``min_length`` letters or more.

    ``best`` is the near word with the largest n, the smallest in code-point order among equals.
    """
    part = min_length // 2
    sides = [F.struct(F.lit(False).alias("last"), F.expr(f"left(word, {part})").alias("letters")), F.struct(F.lit(True).alias("last"), F.expr(f"right(word, {part})").alias("letters"))]
    filed = words.select("word", "n", F.inline(F.array(*sides[: 1 + (part > 0)])))
    sizes = filed.groupBy("last", "letters").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("word")) / BLOCK_LETTERS)).alias("blocks"))
    dealt = filed.join(sizes, ["last", "letters"]).withColumn("block", F.pmod(F.xxhash64("word"), "blocks"))
    # A block meets itself and each other block of its bucket; a bucket of several blocks has a cell for each block alone, too.
    cells = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    cells = cells.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
    found = cells.groupBy("last", "letters", "p", "q").applyInArrow(_compared(part), "word string, n_near long, n long, near string")
    best = F.min(F.struct((-F.col("n")).alias("minus"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)


def variants(words: DataFrame, ratio: int = RATIO, min_length: int = MIN_LENGTH) -> DataFrame:
    """word, n, n_near, form, form_n, root for every row of ``words`` (word, n), whose words are distinct.

    ``n_near`` counts the words one inserted, deleted or replaced code point away. ``form`` is the one with the largest n
    (ties: the smallest in code-point order) if that is at least ``ratio`` times the word's own n, else null. ``root`` is
    where following forms ends, the word itself without one. An empty table gives an empty result.
    """
    words = scratch.stage(words, "words")
    told = words.join(near_words(words, min_length), "word", "left")
    fits = -F.col("best.minus") >= ratio * F.col("n")
    told = told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n"))
    told = scratch.stage(told, "forms")
    # A form has several times its word's occurrences, so chains are short; each round doubles the steps that are taken.
    links = scratch.stage(told.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        up = links.select(F.col("word").alias("root"), F.col("root").alias("above"))
        after = scratch.stage(links.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        scratch.drop(links)
        links = after
        if not links.where("moved").limit(1).count():
            break
    scratch.drop(words)
    return told.join(links.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
