"""Substring dedup: blocks at fixed places are indexed, every rolling window probes them, hits grow to maximal repeats.

A window of w words holds a whole block of b = (w + 1) / 2 words wherever it begins, so of two equal windows each holds a
block of the other's document, at the same place in both. Blocks are indexed in buckets of their hashes; rolling runs of
b words probe them, packed per task and bucket. A run at a block's own place hits only what a second block has. Windows
that hold a hit are then compared as a whole in the same way, and those that occur twice unite to the longest repeats.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark import scratch
from tallyspark.llm.batches import give_back, sliced, small_batches
from tallyspark.llm.runs import BLOCK, RunHashes, cut

WINDOW = 35
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Keys that a task packs together, bytes of text whose keys share a bucket, and keys of a bucket that are probed together.
CHUNK, BUCKET_BYTES, BUCKET_KEYS, LEAST_BUCKETS = 1 << 20, 32 << 20, 8 << 20, 32
#: Documents whose keys may be sent to every task; beyond it texts are shuffled to meet them.
MAX_BROADCAST_ROWS = 1_000_000
INSIDE = np.ones(256, dtype=bool)
INSIDE[[0x20, *range(0x09, 0x0E)]] = False
_LOW = np.uint64(1)

#: Per text: bucket and value of each key, and whether the key is one of those that are indexed.
Keys = tuple[np.ndarray, np.ndarray, np.ndarray]


class Words:
    """64-bit hashes of the words of texts: runs of anything but blanks, unchanged."""

    def __init__(self) -> None:
        self.hashes = RunHashes()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        found: list[list[np.ndarray]] = [[] for _ in texts]
        group, size = [], 0
        for i, text in enumerate(texts):
            for part in cut(text):
                group.append((i, part.encode("utf-8", "surrogatepass") + b"\n"))
                size += len(part)
                if size > BLOCK:
                    self._add(group, found)
                    group, size = [], 0
        self._add(group, found)
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in found]

    def _add(self, group: list[tuple[int, bytes]], found: list[list[np.ndarray]]) -> None:
        if not group:
            return
        codes = np.frombuffer(b"".join(p for _, p in group), dtype=np.uint8)
        steps = np.diff(INSIDE[codes].view(np.int8), prepend=np.int8(0))
        begins, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        hashes = self.hashes(codes, begins, ends)
        edges = np.searchsorted(begins, np.cumsum([0, *(len(p) for _, p in group)]))
        for (i, _), a, b in zip(group, edges, edges[1:], strict=False):
            found[i].append(hashes[a:b])


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    found = a * np.uint64(0x9E3779B97F4A7C15)
    found ^= found >> np.uint64(32)
    found += b
    found *= np.uint64(0xD6E8FEB86659FD93)
    found ^= found >> np.uint64(29)
    return found


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words, put together from runs whose lengths are powers of two."""
    n, whole, done, power, width = len(words) - size + 1, None, 0, words, 1
    if n <= 0:
        return words[:0]
    while True:
        if size & width:
            part = power[done : done + n]
            whole, done = part if whole is None else _mix(whole, part), done + width
        if 2 * width > size:
            return whole
        power, width = _mix(power[:-width], power[width:]), 2 * width


class Anchors:
    """Runs of block length: their buckets are high bits, their values the bucket and 31 low bits; blocks are indexed."""

    wire = np.uint32

    def __init__(self, window: int, bits: int):
        self.block, self.bits, self.words = (window + 1) // 2, np.uint64(bits), Words()

    def __call__(self, batch: pa.RecordBatch) -> Iterator[Keys]:
        for words in self.words([t or "" for t in batch["text"].to_pylist()]):
            yield self.of(words)

    def of(self, words: np.ndarray) -> Keys:
        runs = run_hashes(words, self.block)
        buckets = runs >> (np.uint64(64) - self.bits)
        own = np.zeros(len(runs), dtype=bool)
        own[:: self.block] = True
        return buckets, buckets << np.uint64(32) | runs & np.uint64(0xFFFFFFFE), own


class Windows:
    """Windows that hold a hit: buckets are of one hash, values of another, so that both tell windows apart. All are indexed."""

    wire = np.uint64

    def __init__(self, window: int, bits: int):
        self.window, self.bits, self.anchors = window, np.uint64(bits), Anchors(window, bits)

    def __call__(self, batch: pa.RecordBatch) -> Iterator[Keys]:
        texts, hits = batch["text"].to_pylist(), batch["hits"].to_pylist()
        for words, found in zip(self.anchors.words([t or "" for t in texts]), hits, strict=True):
            values = run_hashes(words, self.window) & ~_LOW
            held = np.zeros(len(values) + self.window, dtype=np.int64)
            hit = _member(self.anchors.of(words)[1], _values(found))
            held[1 : len(hit) + 1] = np.cumsum(hit)
            held[len(hit) + 1 :] = held[len(hit)]
            near = np.flatnonzero(held[self.anchors.block : self.anchors.block + len(values)] > held[: len(values)]) if len(values) else values.astype(np.int64)
            buckets = (run_hashes(words ^ np.uint64(0xA0761D6478BD642F), self.window) >> (np.uint64(64) - self.bits))[near]
            yield buckets, values[near], np.ones(len(near), dtype=bool)


def _values(parts: list[bytes]) -> np.ndarray:
    """The sorted distinct values that buckets have told of."""
    return np.unique(np.frombuffer(b"".join(parts), dtype=np.uint64))


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _edges(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.append(np.flatnonzero(np.diff(ordered, prepend=ordered[:1] - 1)) if len(ordered) else [], len(ordered)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], keys: Callable[[pa.RecordBatch], Iterator[Keys]]) -> Iterator[tuple[list[int], list[Keys]]]:
    """Documents and their keys, about CHUNK of them at a time."""
    names, found, size = [], [], 0
    for batch in sliced(batches):
        for name, each in zip(batch["d"].to_pylist(), keys(batch), strict=True):
            if len(each[0]):
                names.append(name)
                found.append(each)
                size += len(each[0])
            if size >= CHUNK:
                yield names, found
                names, found, size = [], [], 0
    if size:
        yield names, found
    give_back()


def _indexed(keys: Callable[[pa.RecordBatch], Iterator[Keys]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per chunk and bucket the distinct indexed values, those that occur twice with their low bit set, and how many keys probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _chunks(batches, keys):
            buckets, values, own = (np.concatenate(x) for x in zip(*found, strict=True))
            asked = np.unique(buckets, return_counts=True)
            buckets, values = buckets[own], values[own]
            order = np.argsort(buckets, kind="stable")
            buckets, values = buckets[order], values[order]
            edges = np.searchsorted(buckets, asked[0]), np.searchsorted(buckets, asked[0], side="right")
            packed = []
            for a, b in zip(*edges, strict=True):
                distinct, n = np.unique(values[a:b], return_counts=True)
                packed.append((distinct | (n > 1)).astype(keys.wire).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(asked[0].astype(np.int32)), pa.array(packed, pa.binary()), pa.array(asked[1])], ["bucket", "known", "n"])

    return run


def _merged(wire: type, twice_only: bool) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        values = np.frombuffer(b"".join(group["known"].to_pylist()), dtype=wire)
        distinct, at, n = np.unique(values & ~wire(1), return_inverse=True, return_counts=True)
        twice = n > 1
        twice[at[(values & wire(1)) == 1]] = True
        known = distinct[twice] | wire(1) if twice_only else distinct | twice.astype(wire)
        salts = -(-sum(group["n"].to_pylist()) // BUCKET_KEYS)
        return pa.table({"bucket": group["bucket"][:1], "known": pa.array([known.tobytes()], pa.binary()), "salts": pa.array([salts], pa.int32())})

    return run


def _probes(keys: Callable[[pa.RecordBatch], Iterator[Keys]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per chunk and bucket the documents that probe it, how many keys each has, and the keys; an own one has its low bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, found in _chunks(batches, keys):
            docs = np.repeat(np.arange(len(names)), [len(f[0]) for f in found])
            buckets, values, own = (np.concatenate(x) for x in zip(*found, strict=True))
            sent = (values | own).astype(keys.wire)
            order = np.argsort(buckets, kind="stable")
            buckets, docs, sent, names = buckets[order], docs[order], sent[order], np.array(names, dtype=np.int64)
            edges, rows = _edges(buckets), []
            for a, b in zip(edges, edges[1:], strict=False):
                own_edges = _edges(docs[a:b])
                rows.append((int(buckets[a]), names[docs[a:b][own_edges[:-1]]].tobytes(), np.diff(own_edges).astype(np.uint32).tobytes(), sent[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "docs", "counts", "sent"])

    return run


def _hits(wire: type) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The probes of a bucket that its index knows, per document."""

    def run(index: pa.Table, probes: pa.Table) -> pa.Table:
        names, found, bucket = [], [], None
        if index.num_rows and probes.num_rows:
            known = np.frombuffer(index["known"][0].as_py(), dtype=wire)
            bucket = index["bucket"][0].as_py()
            plain, twice = known & ~wire(1), (known & wire(1)) == 1
            for docs, counts, sent in zip(*(probes[c].to_pylist() for c in ("docs", "counts", "sent")), strict=True):
                values = np.frombuffer(sent, dtype=wire)
                place = np.minimum(np.searchsorted(plain, values & ~wire(1)), max(0, len(plain) - 1))
                hit = (plain[place] == values & ~wire(1)) & (twice[place] | (values & wire(1) == 0)) if len(plain) else np.zeros(len(values), dtype=bool)
                at = np.flatnonzero(hit)
                owner = np.repeat(np.arange(len(docs) // 8), np.frombuffer(counts, dtype=np.uint32))[at]
                told = (values[at] & ~wire(1)).astype(np.uint64)
                if wire is np.uint32:
                    told |= np.uint64(bucket) << np.uint64(32)
                edges, ids = _edges(owner), np.frombuffer(docs, dtype=np.int64)
                for a, b in zip(edges, edges[1:], strict=False):
                    names.append(int(ids[owner[a]]))
                    found.append(np.unique(told[a:b]).tobytes())
        return pa.table({"d": pa.array(names, pa.int64()), "bucket": pa.array([bucket] * len(names), pa.int32()), "hits": pa.array(found, pa.binary())})

    return run


def _found(rows: DataFrame, keys: Anchors | Windows, twice_only: bool) -> DataFrame:
    """d, hits: the keys of each text that the index of all of them knows.

    An index row is of a chunk's distinct keys, so a key of a third of all documents is sent once a chunk; the probes of a
    bucket that many documents ask are dealt by salts, whose number follows from how many there are.
    """
    packed = rows.mapInArrow(_indexed(keys), "bucket int, known binary, n long")
    index = scratch.stage(packed.groupBy("bucket").applyInArrow(_merged(keys.wire, twice_only), "bucket int, known binary, salts int"), "index")
    crowded = index.where("salts > 1").select("bucket", "salts")
    crowded = F.broadcast(crowded) if crowded.count() <= MAX_BROADCAST_ROWS else crowded
    asked = rows.mapInArrow(_probes(keys), "bucket int, docs binary, counts binary, sent binary").join(crowded, "bucket", "left")
    asked = asked.select("bucket", F.expr("coalesce(pmod(xxhash64(docs, sent), salts), 0L)").alias("salt"), "docs", "counts", "sent")
    dealt = index.select("bucket", F.explode(F.expr("sequence(0L, cast(greatest(salts, 1) as long) - 1)")).alias("salt"), "known")
    hits = dealt.groupBy("bucket", "salt").cogroup(asked.groupBy("bucket", "salt")).applyInArrow(_hits(keys.wire), "d long, bucket int, hits binary")
    # Copies of a text hit alike: one of them is enough.
    each = hits.groupBy("d", "bucket").agg(F.first("hits").alias("hits"))
    return scratch.stage(each.groupBy("d").agg(F.collect_list("hits").alias("hits")), "hits")


def _kept(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts without the words that repeated windows cover, and the spans of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words()
        for batch in sliced(batches):
            texts = [t or "" for t in batch["text"].to_pylist()]
            told = batch["found"].to_pylist()
            hashes = iter(hashed([t for t, f in zip(texts, told, strict=True) if f]))
            n_words, n_removed, spans, kept = [], [], [], []
            for text, found in zip(texts, told, strict=True):
                words = WORD.findall(text.encode("utf-8", "surrogatepass"))
                gone = []
                if found:
                    begins = np.flatnonzero(_member(run_hashes(next(hashes), window) & ~_LOW, _values(found)))
                    step = np.zeros(len(words) + 1, dtype=np.int64)
                    step[begins] += 1
                    np.subtract.at(step, begins + window, 1)
                    inside = np.diff((np.cumsum(step) > 0).view(np.int8), prepend=np.int8(0))
                    gone = list(zip(np.flatnonzero(inside == 1).tolist(), np.flatnonzero(inside == -1).tolist(), strict=True))
                n_words.append(len(words))
                n_removed.append(sum(b - a for a, b in gone))
                spans.append([{"begin": a, "end": b} for a, b in gone])
                for a, b in reversed(gone):
                    del words[a:b]
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "repeats", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, repeats (begin, end in words), kept for every row of ``docs`` (doc_id, text).

    Words are runs of anything but ASCII blanks, unchanged. A word goes if a run of ``window`` words that covers it begins
    anywhere else in ``docs``, too, the same text included; runs are judged on the input, so that no copy stays.
    ``kept`` has the others, joined by single spaces. Null and empty texts have no words, shorter ones than a window keep
    all; repeated rows are copies of each other. Other columns are ignored, and an empty table gives an empty result.
    Words are told apart by 64-bit hashes, windows by 64 bits besides those of their bucket.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("d", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = (max(LEAST_BUCKETS, size // BUCKET_BYTES) - 1).bit_length()
    hits = _found(keyed.select("d", "text"), Anchors(window, bits), twice_only=False)
    named = F.broadcast(hits.select("d")) if hits.count() <= MAX_BROADCAST_ROWS else hits.select("d")
    near = scratch.stage(keyed.join(named, "d", "left_semi").join(hits, "d"), "near")
    found = _found(near.select("d", "text", "hits"), Windows(window, bits), twice_only=True)
    none = F.lit(None).cast("array<binary>").alias("found")
    told = near.select("doc_id", "text", "d").join(found.select("d", F.col("hits").alias("found")), "d", "left").select("doc_id", "text", "found")
    told = told.union(keyed.join(named, "d", "left_anti").select("doc_id", "text", none))
    return told.mapInArrow(_kept(window), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, repeats array<struct<begin: bigint, end: bigint>>, kept string")
