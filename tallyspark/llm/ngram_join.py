"""N-gram Jaccard join: MinHash bands propose pairs, a posterior drops them step by step, the rest is counted exactly.

Texts with equal shingle sets are one class from the start, so copies never meet each other. Distinct sets that share
a band are candidates. Pairs in small buckets are joined; members of large buckets are dealt into chunks, and a task
compares two chunks as blocks and returns sums and a spanning forest, so a group of thousands of near copies makes no
row per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import scratch
from tallyspark.llm.batches import sliced, small_batches, whole_row
from tallyspark.llm.shingles import MinHash, WordHashes, shingle_sets

SIZE = 5
#: The threshold as a fraction, so that it is compared in whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
#: A pair at the threshold shares no band with probability (1 - 0.8**5)**40 = 1.3e-7.
BANDS, ROWS = 40, 5
#: Hash values compared at a time, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 10, 1e-6
#: Buckets up to so many sets are joined pair by pair; larger ones go into chunks of so many sets or shingles.
BIG, CHUNK, CHUNK_SHINGLES = 24, 2048, 400_000
#: Sets of a chunk that are compared with sets of another at a time.
BLOCK = 256
#: Ids that a task may be sent: beyond it texts are shuffled to meet them.
MAX_BROADCAST_ROWS = 1_000_000
_NO_ID = -(2**63)


def least_matches(step: int = STEP, tolerance: float = TOLERANCE) -> list[int]:
    """For each number of compared values, the matches that keep a pair.

    With a uniform prior on the similarity s, m matches of n give P(s >= t) = P(Bin(n + 1, t) <= m).
    """
    t, found = NUMERATOR / DENOMINATOR, []
    for n in range(step, BANDS * ROWS + 1, step):
        total, m = 0.0, 0
        while (total := total + comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < tolerance:
            m += 1
        found.append(m)
    return found


def survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the paired signatures stay when values are compared step by step."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int32)
    for i, least in enumerate(least_matches()):
        part = slice(i * STEP, (i + 1) * STEP)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
        if not len(alive):
            break
    return alive


def bands_of(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit value per band of each signature."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    found = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), parts.shape[:2]).copy()
    for k in range(ROWS):
        found = (found ^ parts[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(32)
    return found.astype(np.int64)


def _similar(both: int, a: int, b: int) -> bool:
    return DENOMINATOR * both >= NUMERATOR * (a + b - both)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, sign = WordHashes(), MinHash(BANDS * ROWS)
    for batch in sliced(batches):
        digests, sizes, signs = [], [], []
        for found in shingle_sets([t or "" for t in batch["text"].to_pylist()], SIZE, known):
            digests.append(xxhash.xxh3_128_digest(found.tobytes()))
            sizes.append(len(found))
            signs.append(sign(found).tobytes())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["content"], pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signs, pa.binary())], ["doc_id", "content", "digest", "n", "sig"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            found = bands_of(np.frombuffer(b"".join(part["sig"].to_pylist()), dtype=np.uint32).reshape(part.num_rows, -1))
            yield pa.RecordBatch.from_arrays([part["key"].take(pa.array(np.repeat(np.arange(part.num_rows), BANDS))), pa.array(found.ravel())], ["key", "band"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in sliced(batches):
        sets = [found.tobytes() for found in shingle_sets([t or "" for t in batch["text"].to_pylist()], SIZE, known)]
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["digest", "hashes"])


def _pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), dtype=np.uint32).reshape(n, -1) for c in ("sig_a", "sig_b"))
        kept = pa.array(survivors(a, b))
        yield pa.RecordBatch.from_arrays([batch["a"].take(kept), batch["b"].take(kept)], ["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, links, others = [], [], []
        for a, b, x, y, copies_a, copies_b in zip(*(batch[c].to_pylist() for c in ("a", "b", "hashes_a", "hashes_b", "copies_a", "copies_b")), strict=True):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            if _similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                keys += [a, b]
                links += [copies_b, copies_a]
                others += [b, a]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(links, pa.int64()), pa.array(others, pa.int64())], ["key", "links", "other"])


class _Chunk:
    def __init__(self, members: list[dict]):
        self.keys = [m["key"] for m in members]
        self.copies = np.array([m["copies"] for m in members], dtype=np.int64)
        self.sigs = np.frombuffer(b"".join(m["sig"] for m in members), dtype=np.uint32).reshape(len(members), -1)
        self.bands = bands_of(self.sigs)
        self.sets = [np.frombuffer(m["hashes"], dtype=np.uint64) for m in members]
        self.sizes = np.array([len(s) for s in self.sets], dtype=np.int64)


def _common(x: list[np.ndarray], y: list[np.ndarray], ii: np.ndarray, jj: np.ndarray) -> np.ndarray:
    """Shared shingles of the pairs: one by one where they are few, else by products of incidence slabs."""
    if len(ii) < 400:
        return np.array([len(np.intersect1d(x[i], y[j], assume_unique=True)) for i, j in zip(ii, jj, strict=True)], dtype=np.int64)
    rows, cols = np.unique(ii), np.unique(jj)
    shared = np.intersect1d(np.unique(np.concatenate([x[i] for i in rows])), np.unique(np.concatenate([y[j] for j in cols])), assume_unique=True)
    counts = np.zeros((len(x), len(y)), dtype=np.float32)
    for at in range(0, len(shared), 4096):
        slab = shared[at : at + 4096]
        left, right = (np.zeros((len(c), len(slab)), dtype=np.float32) for c in (x, y))
        for side, sets, used in ((left, x, rows), (right, y, cols)):
            for i in used:
                where = np.searchsorted(slab, sets[i])
                inside = where < len(slab)
                inside[inside] = slab[where[inside]] == sets[i][inside]
                side[i, where[inside]] = 1
        counts += left @ right.T
    return counts[ii, jj].astype(np.int64)


def _linked(x: _Chunk, y: _Chunk, p: slice, q: slice, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of two blocks of members, by their places in the chunks."""
    candidates = np.zeros((len(x.sizes[p]), len(y.sizes[q])), dtype=bool)
    for k in range(BANDS):
        candidates |= x.bands[p, k][:, None] == y.bands[q, k][None, :]
    ii, jj = np.nonzero(np.triu(candidates, 1) if same else candidates)
    kept = survivors(x.sigs[p][ii], y.sigs[q][jj]) if len(ii) else ii
    ii, jj = ii[kept], jj[kept]
    if not len(ii):
        return ii, jj
    both = _common(x.sets[p], y.sets[q], ii, jj)
    linked = DENOMINATOR * both >= NUMERATOR * (x.sizes[p][ii] + y.sizes[q][jj] - both)
    return ii[linked] + p.start, jj[linked] + q.start


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The roots after the links a - b: the higher root of each link points to the lower one, then all jump to the end."""
    while True:
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        if not len(a):
            return root
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two chunks at a time: per member the links it gains and a member that it is connected with."""
    for batch in batches:
        for left, right, same in zip(batch["left"], batch["right"], batch["same"].to_pylist(), strict=True):
            x = _Chunk(left.as_py())
            y = x if same else _Chunk(right.as_py())
            shift = 0 if same else len(x.keys)
            keys = x.keys if same else x.keys + y.keys
            links, root = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys))
            for i in range(0, len(x.keys), BLOCK):
                for j in range(i if same else 0, len(y.keys), BLOCK):
                    ii, jj = _linked(x, y, slice(i, i + BLOCK), slice(j, j + BLOCK), same and i == j)
                    np.add.at(links, ii, y.copies[jj])
                    np.add.at(links, jj + shift, x.copies[ii])
                    root = _united(root, ii, jj + shift)
            hit = np.nonzero(links)[0].tolist()
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in hit], pa.int64()), pa.array(links[hit], pa.int64()), pa.array([keys[root[i]] for i in hit], pa.int64())], ["key", "links", "other"])


def _components(edges: DataFrame) -> DataFrame:
    """key, root (the least key of its component) by least labels and pointer jumping, each round written out."""
    both = scratch.stage(edges.select("key", "other").where("key <> other").union(edges.select("other", "key").where("key <> other")).distinct(), "edges")
    labels = scratch.stage(both.groupBy("key").agg(F.least(F.min("other"), F.first("key")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("key").alias("other"), "root"), "other").groupBy("key").agg(F.min("root").alias("near"))
        lower = scratch.stage(labels.join(near, "key").select("key", F.least("root", "near").alias("root"), F.col("root").alias("was")), "labels")
        up = lower.select(F.col("key").alias("root"), F.col("root").alias("up"))
        following = scratch.stage(lower.join(up, "root", "left").select("key", F.least("root", F.coalesce("up", "root")).alias("root"), (F.least("root", F.coalesce("up", "root")) < F.col("was")).alias("moved")), "labels")
        scratch.drop(labels, lower)
        labels = following
        if not following.where("moved").limit(1).count():
            scratch.drop(both)
            return labels


def size_class(n: Column) -> Column:
    """Sets of n and m members can be similar at the threshold only if their classes differ by one at most."""
    # Classes are wider than the threshold by far more than the logarithm's error, which could part two sets right at it.
    return F.floor(F.log(n.cast("double")) / (math.log(DENOMINATOR / NUMERATOR) * (1 + 1e-9))).cast("int")


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, content, digest) of each row, and (key, digest, root, least, copies, links) of each distinct set: the key of
    its component, the least id among its copies, how many there are and how many rows of other sets they are linked with.
    """
    small_batches(docs.sparkSession)
    rows = scratch.stage(docs.select("doc_id", F.xxhash64("text").alias("content"), "text").mapInArrow(_sets, "doc_id long, content long, digest binary, n int, sig binary"), "signatures")
    ids = F.coalesce("doc_id", F.lit(_NO_ID))
    reps = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min(ids).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # Sets get numbers: half as many bytes in what is shuffled from here on.
    reps = scratch.stage(reps.withColumn("key", F.monotonically_increasing_id()), "sets")
    members = reps.where("n > 0").select("key", "sig").mapInArrow(_banded, "key long, band long")
    buckets = members.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    shared = scratch.stage(members.join(buckets, "band"), "buckets")
    # A set in large buckets is at home in its largest, and there in one of as many chunks as the bucket's sets fill.
    at_home = shared.where(F.col("m") > BIG).groupBy("key").agg(F.max(F.struct("m", "band")).alias("top")).select("key", F.col("top.band").alias("home"))
    at_home = scratch.stage(at_home.join(reps.select("key", "n"), "key"), "at-home")
    # Sets whose sizes differ by more than the threshold can't be linked, so chunks keep to a class of sizes, and meet
    # those of their own class and of its neighbours only.
    at_home = at_home.withColumn("size", size_class(F.col("n")))
    slots = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_SHINGLES))
    slots = at_home.groupBy("home", "size").agg(slots.alias("slots"))
    homes = scratch.stage(at_home.join(slots, ["home", "size"]).select("key", "home", "size", F.pmod(F.xxhash64("key"), "slots").alias("slot")), "homes")
    placed = scratch.stage(shared.join(homes, "key", "left"), "placed")
    scratch.drop(shared, at_home)

    few = placed.where(F.col("m") <= BIG).select("key", "band", F.col("home").isNotNull().alias("homed"))
    left, right = few.select("band", F.col("key").alias("a"), F.col("homed").alias("h")), few.select("band", F.col("key").alias("b"), F.col("homed").alias("g"))
    pairs = left.join(right, (left.band == right.band) & (left.a < right.b) & ~(left.h & right.g)).select("a", "b").distinct()
    signed = reps.select(F.col("key").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a")), reps.select(F.col("key").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
    sized = pairs.join(signed[0], "a").join(signed[1], "b").where(f"{DENOMINATOR} * least(n_a, n_b) >= {NUMERATOR} * greatest(n_a, n_b)")
    likely = scratch.stage(sized.select("a", "b", "sig_a", "sig_b").mapInArrow(_pruned, "a long, b long"), "likely")

    # Only the texts of sets that a comparison needs are read again.
    keys = homes.select("key").union(likely.select("a")).union(likely.select("b")).distinct()
    need = scratch.stage(reps.join(keys, "key").select("key", "digest", "rep", "copies", "sig"), "needed")
    wanted = need.select(F.col("rep").alias("wanted")).distinct()
    wanted = F.broadcast(wanted) if need.count() <= MAX_BROADCAST_ROWS else wanted
    again = docs.select("doc_id", "text").join(wanted, ids == F.col("wanted"), "left_semi").select("text").mapInArrow(_hashes, "digest binary, hashes binary")
    sets = scratch.stage(need.join(again, "digest").groupBy("key").agg(F.first("copies").alias("copies"), F.first("sig").alias("sig"), F.first("hashes").alias("hashes")), "shingles")

    def side(name: str) -> DataFrame:
        return sets.select(F.col("key").alias(name), F.col("hashes").alias(f"hashes_{name}"), F.col("copies").alias(f"copies_{name}"))

    links = likely.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verified, "key long, links long, other long")

    chunk = F.struct("home", "size", "slot").alias("chunk")
    blocks = scratch.stage(sets.join(homes, "key").groupBy(chunk).agg(F.collect_list(F.struct("key", "copies", "sig", "hashes")).alias("members")), "chunks")
    met = placed.where("home is not null").select("band", chunk).distinct()
    duos = met.select("band", F.col("chunk").alias("p")).join(met.select("band", F.col("chunk").alias("q")), "band").where("p <= q and abs(p.size - q.size) <= 1").select("p", "q").distinct()
    duos = duos.join(blocks.select(F.col("chunk").alias("p"), F.col("members").alias("left")), "p").join(blocks.select(F.col("chunk").alias("q"), F.col("members").alias("right")), "q")
    duos = duos.select("left", F.when(F.expr("p < q"), F.col("right")).alias("right"), F.expr("p = q").alias("same"))
    links = scratch.stage(links.union(duos.mapInArrow(_compared, "key long, links long, other long")), "links")

    scratch.drop(homes, placed, likely, need, sets, blocks)
    # What is left to be told needs no signatures.
    told = scratch.stage(rows.select("doc_id", "content", "digest"), "rows")
    joined = reps.select("key", "digest", "least", "copies").join(_components(links), "key", "left").join(links.groupBy("key").agg(F.sum("links").alias("links")), "key", "left")
    joined = scratch.stage(joined.withColumn("root", F.coalesce("root", "key")), "components")
    scratch.drop(rows, reps, links)
    return told, joined


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links of every row of ``docs`` (doc_id, text), repeated rows included.

    Two rows are linked if the Jaccard similarity of their sets of five-word shingles is at least 0.8 (words are runs
    of letters, digits and underscores in lower case); copies are linked too, and so are texts without any word, null
    among them. A text of fewer than five words is one shingle. ``n_links`` counts the other rows that a row is
    linked with, ``class_id`` is the least doc_id among all that links connect (null if none has an id). Other
    columns are ignored; an empty table gives an empty result.
    """
    rows, joined = _grouped(docs)
    # Written, so that the join has shuffles of its own and a class of very many sets can be split.
    named = scratch.stage(joined.groupBy("root").agg(F.min("least").alias("class_id")), "classes")
    told = joined.join(named, "root").select("digest", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return rows.select("doc_id", "digest").join(told, "digest").select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each class one row of ``docs``, with all its columns: one with the least doc_id (rows without an id come last).

    Rows are told apart by id and text, so two different texts under one id, or without one, are judged each for
    itself; of rows equal in both one stays. An empty table gives an empty result.
    """
    rows, joined = _grouped(docs)
    each = rows.groupBy(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "content", "digest").agg(F.count("*").alias("n"))
    each = each.join(joined.select("digest", "root"), "digest").select("id", "content", "n", "root", F.struct((F.col("id") == _NO_ID).alias("last"), "id", "content").alias("rank"))
    each = scratch.stage(each, "each")
    # Written, so that the join has shuffles of its own and a class of very many rows can be split.
    first = scratch.stage(each.groupBy("root").agg(F.min("rank").alias("first")), "first")
    told = each.join(first, "root").withColumn("stays", F.col("rank") == F.col("first"))
    # Rows that this doesn't name are the only ones of their classes.
    told = scratch.stage(told.where("not stays or n > 1").select("id", "content", "stays"), "told")
    scratch.drop(rows, joined, each, first)
    sent = F.broadcast(told) if told.count() <= MAX_BROADCAST_ROWS else told
    keyed = docs.select(whole_row(docs)).withColumn("id", F.coalesce("row.doc_id", F.lit(_NO_ID))).withColumn("content", F.xxhash64("row.text"))
    alone = keyed.join(sent, ["id", "content"], "left_anti")
    repeated = keyed.join(sent.where("stays"), ["id", "content"], "left_semi").dropDuplicates(["id", "content"])
    return alone.union(repeated).select("row.*")
