"""Packing by lexical retrieval: a sharded BM25 index returns unused neighbours that fill each seed's window.

Documents become token ids once. Whole windows of long documents stand as they are; what is left of each document is
a fragment. Fragments are ranged by a MinHash of their documents' bigrams, so that near texts meet in a shard, and every
shard of bounded size has an inverted index of the fragments' whole documents with corpus-wide document frequencies. A
seed asks for all its document's terms, within its shard. Its best unused neighbours fill its
window to the last token, the last of them cut where the window ends. What a partition has left at its end, less than
a window, is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark import scratch
from tallyspark.llm.batches import sliced, small_batches
from tallyspark.llm.wordids import WordIds, vocabulary

WINDOW, END_ID = 4096, 2
#: Fragments in a shard's index.
SHARD = 2048
K1, B = 1.2, 0.75
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_KINDS = f"kind string, {_PIECES}, near long, ids binary, terms array<int>, counts array<long>"


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def terms_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order, and how often each stands there."""
    ids = np.sort(ids, kind="stable")
    first = np.concatenate(([0], (ids[1:] != ids[:-1]).nonzero()[0] + 1))
    return ids[first], np.diff(first, append=len(ids))


def near_key(ids: np.ndarray) -> int:
    """The least hash of two neighbouring ids."""
    x = ids.astype(np.uint64)
    return int(((x[:-1] * np.uint64(0xD6E8FEB86659FD93) ^ (x[1:] if len(x) > 1 else x)) * np.uint64(0x9E3779B97F4A7C15)).min(initial=np.uint64(2**64 - 1)) >> np.uint64(1))


def _tokenised(path: str, window: int):
    names = [c.split()[0] for c in _KINDS.split(", ")]
    types = [pa.string(), *[pa.int64()] * 6, pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        seen = np.zeros(max(words.size, END_ID + 1), dtype=np.int64)
        end = np.array([END_ID], dtype=words.dtype)
        for batch in sliced(batches):
            rows, size = [], 0
            texts = words.texts([t or "" for t in batch["text"].to_pylist()])
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), texts, strict=True):
                ids = np.concatenate((ids, end))
                terms, counts = terms_of(ids)
                seen[terms] += 1
                whole = len(ids) // window * window
                rows += [("window", doc_id, at, window, crc(ids[at : at + window]), len(ids), None, None, None, None) for at in range(0, whole, window)]
                if whole < len(ids):
                    rest = ids[whole:]
                    # A shorter document's terms are those of its fragment.
                    told = (terms.tolist(), counts.tolist()) if whole else (None, None)
                    rows.append(("fragment", doc_id, whole, len(rest), None, len(ids), near_key(ids), rest.tobytes(), *told))
                    size += rest.nbytes + whole // 4
                if size > 8 << 20:
                    yield batch_of(rows)
                    rows, size = [], 0
            yield batch_of(rows)
        terms = np.nonzero(seen)[0]
        yield batch_of([("terms", None, None, None, None, None, None, None, terms.tolist(), seen[terms].tolist())])

    return run


class Shard:
    """Fragments with an inverted index; ``take`` removes tokens of one for a window.

    A fragment is (doc_id, start, ids, doc_tokens), and what its document holds beyond ``ids`` counts if its terms and
    their counts follow as a fifth.
    """

    def __init__(self, fragments: list[tuple], idf: np.ndarray, mean_length: float):
        self.fragments = fragments
        n = len(fragments)
        self.taken = np.zeros(n, dtype=np.int64)
        self.lengths = np.array([len(f[2]) for f in fragments], dtype=np.int64)
        # What a document holds beyond its fragment is told with it; else the fragment is the document.
        self.documents = [f[4] if len(f) > 4 else None for f in fragments]
        own = np.array([d is None for d in self.documents])
        postings = np.concatenate([f[2] for f, d in zip(fragments, self.documents, strict=True) if d is None] or [self.taken[:0]]).astype(np.int64)
        postings *= n
        postings += np.repeat(np.flatnonzero(own), self.lengths[own])
        postings.sort()
        first = np.concatenate(([0], np.flatnonzero(np.diff(postings)) + 1))[: len(postings)]
        postings, counts = postings[first], np.diff(first, append=len(postings))
        if told := [(i, *d) for i, d in enumerate(self.documents) if d is not None]:
            more = np.concatenate([np.asarray(t, dtype=np.int64) * n + i for i, t, _ in told])
            order = np.argsort(more)
            at = np.searchsorted(postings, more[order])
            postings, counts = np.insert(postings, at, more[order]), np.insert(counts, at, np.concatenate([c for _, _, c in told])[order])
        sizes = self.lengths.astype(float)
        sizes[~own] = [c.sum() for _, _, c in told]
        every, self.owners = np.divmod(postings, n)
        self.weights = idf[every] * counts * (K1 + 1) / (counts + (K1 * (1 - B) + K1 * B / mean_length * sizes)[self.owners])
        self.terms, first = np.unique(every, return_index=True)
        self.bounds = np.append(first, len(every))
        # Terms of many fragments have a row of weights, so that a query adds rows instead of postings.
        often = np.flatnonzero(np.diff(self.bounds) * 8 > n)
        self.row = np.full(len(self.terms), -1, dtype=np.int64)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), n))
        for k, i in enumerate(often):
            part = slice(self.bounds[i], self.bounds[i + 1])
            self.rows[k, self.owners[part]] = self.weights[part]

    def left(self) -> np.ndarray:
        return self.lengths - self.taken

    def query(self, i: int) -> np.ndarray:
        document = self.documents[i]
        return terms_of(self.fragments[i][2])[0] if document is None else document[0]

    @property
    def queries(self) -> list[np.ndarray]:
        """The terms of each fragment's document."""
        return [self.query(i) for i in range(len(self.fragments))]

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused fragments that share a term with the seed, best first, ties in order."""
        return np.array(list(self.best(seed)), dtype=np.int64)

    def best(self, seed: int) -> Iterator[int]:
        at = np.searchsorted(self.terms, self.query(seed))
        rows, scores = self.row[at], np.zeros(len(self.fragments))
        for i in rows[rows >= 0].tolist():
            scores += self.rows[i]
        if spans := [slice(self.bounds[i], self.bounds[i + 1]) for i in at[rows < 0].tolist()]:
            scores += np.bincount(np.concatenate([self.owners[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), len(scores))
        scores[self.taken == self.lengths] = 0
        scores[seed] = 0
        # A window seldom takes more than the best few: the others are sorted only when asked for.
        least = np.partition(scores, -64)[-64] if len(scores) > 64 else 0.0
        for found in (np.flatnonzero((scores >= least) & (scores > 0)), np.flatnonzero((scores < least) & (scores > 0))):
            yield from found[np.lexsort((found, -scores[found]))].tolist()

    def take(self, i: int, most: int) -> tuple:
        """A piece of up to ``most`` tokens: doc_id, start, ids, doc_tokens."""
        doc_id, start, ids, doc_tokens = self.fragments[i][:4]
        at = int(self.taken[i])
        part = ids[at : at + most]
        self.taken[i] += len(part)
        return doc_id, start + at, part, doc_tokens

    def windows(self, window: int) -> Iterator[list[tuple]]:
        """Full windows, as long as there are tokens for one."""
        total, seed = int(self.left().sum()), 0
        while total >= window:
            while self.taken[seed] == self.lengths[seed]:
                seed += 1
            room = window
            pieces = [self.take(seed, room)]
            room -= len(pieces[0][2])
            # Beyond the fragments with any word in common come the others in order.
            for i in chain(self.best(seed), range(seed, len(self.fragments))) if room else ():
                if self.taken[i] < self.lengths[i]:
                    pieces.append(self.take(i, room))
                    room -= len(pieces[-1][2])
                    if not room:
                        break
            total -= window
            yield pieces

    def rest(self) -> list[tuple]:
        """Fragments that still have tokens, as they then are."""
        found = []
        for f, t, d in zip(self.fragments, self.taken.tolist(), self.documents, strict=True):
            if t < len(f[2]):
                found.append((f[0], f[1] + t, f[2][t:], f[3], terms_of(f[2]) if d is None and t else d))
        return found


def powers(fragments: list[tuple]) -> Iterator[list[tuple]]:
    """Fewer tokens than a window, cut into sequences whose lengths are powers of two."""
    left, at = sum(len(f[2]) for f in fragments), 0
    queue = [list(f[:4]) for f in fragments]
    while left:
        room, pieces = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            doc_id, start, ids, doc_tokens = queue[at]
            part = ids[:room]
            pieces.append((doc_id, start, part, doc_tokens))
            room -= len(part)
            queue[at] = [doc_id, start + len(part), ids[len(part) :], doc_tokens]
            at += len(part) == len(ids)
        yield pieces


def _packed(sent, window: int, shard: int):
    names = [c.split()[0] for c in _PIECES.split(", ")] + ["sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean_length, kind = sent.value
        first, number = TaskContext.get().partitionId() << 32, 0

        def rows_of(sequences: Iterator[list[tuple]]) -> pa.RecordBatch:
            nonlocal number
            rows = []
            for pieces in sequences:
                offset = 0
                for doc_id, start, ids, doc_tokens in pieces:
                    rows.append((doc_id, start, len(ids), crc(ids), doc_tokens, (first + number) * 2, offset))
                    offset += len(ids)
                number += 1
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)

        waiting: list[tuple] = []
        for batch in batches:
            for doc_id, start, ids, doc_tokens, terms, counts in zip(batch["doc_id"].to_pylist(), batch["start"].to_pylist(), batch["ids"], batch["doc_tokens"].to_pylist(), batch["terms"], batch["counts"], strict=True):
                document = (terms.values.to_numpy(), counts.values.to_numpy()) if terms.is_valid else None
                waiting.append((doc_id, start, np.frombuffer(ids.as_py(), dtype=kind), doc_tokens, document))
                if len(waiting) >= shard:
                    index = Shard(waiting, idf, mean_length)
                    yield rows_of(index.windows(window))
                    waiting = index.rest()
        if waiting:
            index = Shard(waiting, idf, mean_length)
            yield rows_of(index.windows(window))
            yield rows_of(powers(index.rest()))

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty and has the end id alone. Repeated rows are packed each for itself, null ids included; other
    columns are ignored; an empty table gives no piece. ``window`` must be a power of two. Every sequence is full or
    has a power of two of tokens. Rows are sorted within ranges of a written table, so a task that runs again makes
    the same sequences.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = scratch.stage(docs.select("doc_id", "text").mapInArrow(_tokenised(tokenizer, window), _KINDS), "token-ids")
    fragments = rows.where("kind = 'fragment'")
    n = fragments.count()
    # Each document once, by its last piece.
    n_docs, mean_length = rows.where("start + length = doc_tokens").agg(F.count("*"), F.avg("doc_tokens")).first()
    # One count per term of the vocabulary.
    counts = rows.where("kind = 'terms'").select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
    size, kind = vocabulary(tokenizer)
    df = np.zeros(max(size, END_ID + 1))
    for term, found in counts.collect():
        df[term] = found
    sent = spark.sparkContext.broadcast((np.log1p((n_docs - df + 0.5) / (df + 0.5)), mean_length or 1.0, kind))
    whole = rows.where("kind = 'window'").select(*[c.split()[0] for c in _PIECES.split(", ")], (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    salt = F.xxhash64("doc_id", "start")
    ranged = fragments.select("near", salt.alias("salt"), "doc_id", "start", "ids", "doc_tokens", "terms", "counts").repartitionByRange(max(1, -(-n // (2 * shard))), "near", "salt")
    packed = ranged.sortWithinPartitions("near", "salt", "doc_id", "start").mapInArrow(_packed(sent, window, shard), f"{_PIECES}, sequence_id long, offset long")
    return whole.union(packed)
