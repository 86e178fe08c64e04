"""Exact top-k inner products by dual-tree search over cover trees of queries and data."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark import scratch
from tallyspark.llm.batches import small_batches

#: Vectors in one tree, and in one leaf.
BLOCK, LEAF = 4096, 48
#: Pivots, and the blocks of data that a block of queries meets before any other is judged.
PIVOTS, FIRST = 64, 2
#: The covering radius shrinks by this factor from level to level.
BASE = 2.0


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as long; null for vectors that are null or hold null, NaN or infinity."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


_NONE = np.iinfo(np.int64).min


class CoverTree:
    """A cover tree over rows of an integer matrix, laid out so that a node's points are contiguous.

    Children of a node with radius r are centres more than r / BASE apart that cover its points within r / BASE; the
    points that end as centres of their own are kept in one bucket per parent, in place of one leaf each.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.order: list[int] = []
        self.nodes: list[list[Any]] = []  # begin, end, centre, radius, children
        self._points = points.astype(np.float64)
        self._build(np.arange(len(ids)))
        order = np.array(self.order, dtype=np.int64)
        self.ids, self.points = ids[order], _narrow(points[order])
        self.centres = np.array([n[2] for n in self.nodes])
        self.radii = np.array([n[3] for n in self.nodes])
        self.norms = np.sqrt((self.centres**2).sum(1))
        self.spans = np.array([n[:2] for n in self.nodes], dtype=np.int64)
        self.children = [n[4] for n in self.nodes]
        del self.order, self.nodes, self._points

    def _build(self, members: np.ndarray) -> int:
        points = self._points[members]
        centre = points[0]
        away = np.sqrt(((points - centre) ** 2).sum(1))
        at, begin, radius = len(self.nodes), len(self.order), float(away.max())
        node: list[Any] = [begin, begin + len(members), centre, radius, []]
        self.nodes.append(node)
        if len(members) <= LEAF or radius == 0:
            self.order += members.tolist()
            return at
        reach, left, alone = radius / BASE, np.ones(len(members), dtype=bool), []
        for i in range(len(members)):
            if not left[i]:
                continue
            near = left & (((points - points[i]) ** 2).sum(1) <= reach**2)
            left &= ~near
            if near.sum() <= LEAF // 4:
                alone += members[near].tolist()
            else:
                group = members[near]
                node[4].append(self._build(np.concatenate([[members[i]], group[group != members[i]]])))
        for k in range(0, len(alone), LEAF):
            bucket = np.array(alone[k : k + LEAF])
            spread = self._points[bucket]
            middle = spread.mean(0)
            node[4].append(len(self.nodes))
            self.nodes.append([len(self.order), len(self.order) + len(bucket), middle, float(np.sqrt(((spread - middle) ** 2).sum(1)).max()), []])
            self.order += bucket.tolist()
        return at


def _narrow(points: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as hold them."""
    most = int(np.abs(points).max(initial=0))
    return points.astype(np.int16 if 0 <= most < 1 << 15 else np.int32 if 0 <= most < 1 << 31 else np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floating point where every sum stays below 2**53."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Search:
    """The k best candidates so far for each query of a tree, over any number of data trees."""

    def __init__(self, queries: CoverTree, k: int, floors: dict[int, int] | None = None):
        """``floors`` has scores that k candidates of a query reach elsewhere: lower ones are of no use."""
        self.q, self.k = queries, k
        n = len(queries.ids)
        # One below, so that a candidate that equals the floor takes a place: its id may be smaller.
        self.least = np.array([(floors or {}).get(i, _NONE + 1) - 1 for i in queries.ids.tolist()], dtype=np.int64)
        self.scores = np.repeat(self.least[:, None], k, axis=1)
        self.found = np.full((n, k), np.iinfo(np.int64).max)

    def worst(self, node: int) -> float:
        """The lowest kth score in a query node: data that can't exceed or equal it is of no use to any of its queries."""
        begin, end = self.q.spans[node]
        return float(self.scores[begin:end, -1].min())

    def run(self, data: CoverTree) -> None:
        todo = [(0, 0)]
        while todo:
            a, b = todo.pop()
            if self.bound(data, a, b) < self.worst(a):
                continue
            below_a, below_b = self.q.children[a], data.children[b]
            if not below_a and not below_b:
                self.base(data, a, b)
            elif below_b and (not below_a or data.radii[b] >= self.q.radii[a]):
                # The most promising pair is popped first and raises the kth scores for the rest.
                todo += [(a, c) for c in sorted(below_b, key=lambda c: self.bound(data, a, c))]
            else:
                todo += [(c, b) for c in below_a]

    def bound(self, data: CoverTree, a: int, b: int) -> float:
        """No query of node a and point of node b have a larger inner product, rounding included."""
        q = self.q
        most = float(q.centres[a] @ data.centres[b]) + q.radii[a] * data.norms[b] + data.radii[b] * q.norms[a] + q.radii[a] * data.radii[b]
        return most + 1e-9 * (abs(most) + (q.norms[a] + q.radii[a]) * (data.norms[b] + data.radii[b])) + 1e-6

    def base(self, data: CoverTree, a: int, b: int) -> None:
        (qa, qb), (da, db) = self.q.spans[a], data.spans[b]
        scores = _products(self.q.points[qa:qb], data.points[da:db])
        ids = np.broadcast_to(data.ids[da:db], scores.shape)
        # A query is no candidate of its own; taken places hold the largest id, which no tie lets in.
        scores = np.where(ids == self.q.ids[qa:qb, None], np.iinfo(np.int64).min, scores)
        ids = np.where(ids == self.q.ids[qa:qb, None], np.iinfo(np.int64).max, ids)
        scores, ids = np.concatenate([self.scores[qa:qb], scores], 1), np.concatenate([self.found[qa:qb], ids], 1)
        order = np.lexsort((ids, ~scores), axis=1)[:, : self.k]
        self.scores[qa:qb], self.found[qa:qb] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        real = self.scores > self.least[:, None]
        return np.repeat(self.q.ids, self.k)[real.ravel()], self.found[real], self.scores[real]


def pair_bound(a: tuple, b: tuple) -> float:
    """No vectors within radius of two centres have a larger inner product, rounding included. Each side is
    (centre, radius)."""
    (x, r), (y, s) = (np.asarray(a[0]), a[1]), (np.asarray(b[0]), b[1])
    p, q = float(np.sqrt(x @ x)), float(np.sqrt(y @ y))
    most = float(x @ y) + r * q + s * p + r * s
    return most + 1e-9 * (abs(most) + (p + r) * (q + s)) + 1e-6


def _placed(sent):
    """The nearest pivot of each vector of the pivots' dimension, and how far it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = {d: np.array(p, dtype=np.float64) for d, p in sent.value.items()}
        for batch in batches:
            cells, away = [], []
            for v in batch["v"].to_pylist():
                near = np.sqrt(((pivots[len(v)] - np.array(v, dtype=np.float64)) ** 2).sum(1)) if len(v) in pivots else np.zeros(1)
                cells.append(int(near.argmin()))
                away.append(float(near.min()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32()), pa.array(away, pa.float64())], [*batch.schema.names, "cell", "away"])

    return run


def _trees(block: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by dimension and place: a tree for each block of vectors of one dimension and pivot."""
        ids: list[int] = []
        rows: list[list[int]] = []
        now = None

        def out() -> pa.RecordBatch:
            tree = CoverTree(np.array(ids, dtype=np.int64), np.array(rows, dtype=np.int64).reshape(len(rows), -1))
            dim = len(rows[0])
            ids.clear()
            rows.clear()
            columns = [pa.array([dim], pa.int32()), pa.array([tree.centres[0].tolist()], pa.list_(pa.float64())), pa.array([float(tree.radii[0])], pa.float64()), pa.array([pickle.dumps(tree)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["dim", "centre", "radius", "tree"])

        for batch in batches:
            for i, v, cell in zip(batch["vec_id"].to_pylist(), batch["v"].to_pylist(), batch["cell"].to_pylist(), strict=True):
                if rows and (len(rows) >= block or (len(v), cell) != now):
                    yield out()
                now = (len(v), cell)
                ids.append(i)
                rows.append(v)
        if rows:
            yield out()

    return build


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bounds = [pair_bound((a, r), (b, s)) for a, r, b, s in zip(*(batch[c].to_pylist() for c in ("centre", "radius", "centre_b", "radius_b")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["query_block"], batch["data_block"], pa.array(bounds, pa.float64())], ["query_block", "data_block", "bound"])


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: a block of queries with its floors, then the data blocks that it meets, the most promising
        first, so that the scores found in one prune the next."""
        state = None
        for batch in batches:
            for is_data, tree, ids, floors in zip(batch["is_data"].to_pylist(), batch["tree"], batch["ids"].to_pylist(), batch["floors"].to_pylist(), strict=True):
                if is_data:
                    state.run(pickle.loads(tree.as_py()))
                    continue
                if state:
                    yield _found(state)
                state = Search(pickle.loads(tree.as_py()), k, dict(zip(ids or [], floors or [], strict=True)))
        if state:
            yield _found(state)

    return search


def _found(state: Search) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in state.rows()], ["query_id", "vec_id", "score"])


def _blocks(rows: DataFrame, block: int, name: str) -> DataFrame:
    """(block, dim, centre, radius, tree) of vectors (vec_id, v, dim), near ones in a block.

    Vectors go to the nearest of up to PIVOTS vectors, those of their dimension, then by distance: a block is a part of a
    ring around a pivot.
    """
    n = rows.count()
    blocks = max(1, -(-n // block))
    picked = rows.select("dim", "v", F.xxhash64("vec_id").alias("h")).orderBy("h", "v").limit(min(PIVOTS, blocks))
    pivots: dict[int, list] = {}
    for r in picked.collect():
        pivots.setdefault(r["dim"], []).append(r["v"])
    sent = rows.sparkSession.sparkContext.broadcast(pivots)
    placed = rows.select("vec_id", "v", "dim").mapInArrow(_placed(sent), "vec_id long, v array<long>, dim int, cell int, away double")
    order = ["dim", "cell", "away", "vec_id"]
    dealt = placed.repartitionByRange(blocks, *order).sortWithinPartitions(*order).select("vec_id", "v", "cell")
    trees = dealt.mapInArrow(_trees(block), "dim int, centre array<double>, radius double, tree binary")
    return scratch.stage(trees.select(F.monotonically_increasing_id().alias("block"), "*"), name)


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block: int = BLOCK) -> DataFrame:
    """The k largest integer inner products of each query row with every other row: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding. Ties go to the smaller vec_id. Rows with a null id, or with a null vector
    or one that is empty or holds null or non-finite components, take no part. Of rows that repeat a vec_id the one
    with the smallest vector counts. Vectors are compared with those of equal dimension; fewer than k candidates are
    all returned, and an empty table returns nothing. Inner products must stay below 2**63. Other columns are ignored.

    Trees of bounded blocks are built once, in parallel. Pairs of blocks are first judged by centres and radii alone:
    each block of queries meets its FIRST most promising blocks of data, and then those whose bound reaches the worst
    kth score found so far. Only these pairs' trees are sent.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select("vec_id", quantised(F.col("embedding"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = scratch.stage(rows.groupBy("vec_id").agg(F.min(F.struct("v", "q")).alias("x")).select("vec_id", "x.v", "x.q", F.size("x.v").alias("dim")), "vectors")
    data, queries = _blocks(rows, block, "data-trees"), _blocks(rows.where("q"), block, "query-trees")

    # Blocks without their trees are small rows; shares spread the pairs of one dimension over tasks.
    shares = max(2, 2 * spark.sparkContext.defaultParallelism)
    told = data.select(F.col("block").alias("data_block"), "dim", F.col("centre").alias("centre_b"), F.col("radius").alias("radius_b"), F.pmod(F.xxhash64("block"), F.lit(shares)).alias("share"))
    asked = queries.select(F.col("block").alias("query_block"), "dim", "centre", "radius", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    pairs = scratch.stage(asked.withColumn("share", F.col("share").cast("long")).join(told, ["dim", "share"]).mapInArrow(_bounded, "query_block long, data_block long, bound double"), "pairs")

    def met(chosen: DataFrame, floors: DataFrame) -> DataFrame:
        """The candidates of chosen pairs (query_block, data_block, bound, share)."""
        trees = chosen.join(data.select(F.col("block").alias("data_block"), "tree"), "data_block").select("query_block", "share", F.lit(True).alias("is_data"), "bound", "tree", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("floors"))
        each = chosen.select("query_block", "share").distinct().join(queries.select(F.col("block").alias("query_block"), "tree"), "query_block").join(floors, "query_block", "left")
        each = each.select("query_block", "share", F.lit(False).alias("is_data"), F.lit(None).cast("double").alias("bound"), "tree", "ids", "floors")
        both = each.union(trees).repartition(shares, "query_block", "share").sortWithinPartitions("query_block", "share", "is_data", F.desc("bound"))
        return both.select("is_data", "tree", "ids", "floors").mapInArrow(_search(k), "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_block").orderBy(F.desc("bound"), "data_block")
    ranked = scratch.stage(pairs.withColumn("place", F.row_number().over(order)), "ranked-pairs")
    none = spark.createDataFrame([], "query_block long, ids array<long>, floors array<long>")
    early = scratch.stage(met(ranked.where(F.col("place") <= FIRST).withColumn("share", F.lit(0)), none), "early")
    kth = early.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k)
    floors = queries.select(F.col("block").alias("query_block"), "tree").mapInArrow(_members, "query_block long, query_id long").join(kth, "query_id", "left")
    floors = floors.groupBy("query_block").agg(
        F.min(F.coalesce("floor", F.lit(int(_NONE)))).alias("worst"),
        F.collect_list(F.when(F.col("floor").isNotNull(), F.col("query_id"))).alias("ids"),
        F.collect_list("floor").alias("floors"),
    )
    floors = scratch.stage(floors, "floors")
    late = ranked.where(F.col("place") > FIRST).join(floors.select("query_block", "worst"), "query_block").where("bound >= worst")
    late = scratch.stage(late.withColumn("share", F.pmod(F.xxhash64("data_block"), F.lit(shares)).cast("int")), "late-pairs")
    found = early.union(met(late.drop("worst"), floors.select("query_block", "ids", "floors")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, tree in zip(batch["query_block"].to_pylist(), batch["tree"], strict=True):
            ids = pickle.loads(tree.as_py()).ids
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), name), pa.int64()), pa.array(ids, pa.int64())], ["query_block", "query_id"])
