"""Vector functions and exact similarity joins of blocks; cones around blocks show which of them can't hold a pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark import scratch

#: Vectors in a block: two blocks and their products fit a task many times over.
BLOCK = 1024
#: Bounds are raised by this much, so that rounding never drops a pair.
SLACK = 1e-9


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision; the cosine of normalised vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _matrix(rows: list[list[float]]) -> np.ndarray:
    return np.array(rows, dtype=np.float64)


def _units(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _angles(units: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centre, -1, 1))


def _assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of each pack with the number of the pivot whose direction is nearest."""
    for batch in batches:
        for k, pivots in enumerate(batch["pivots"].to_pylist()):
            rows = batch["rows"][k].values
            cells = np.zeros(len(rows), dtype=np.int32)
            if pivots:
                cells = np.argmax(_units(_matrix(rows.field("v").to_pylist())) @ _units(_matrix(pivots)).T, axis=1).astype(np.int32)
            group = batch["grp"].take(pa.array(np.full(len(rows), k)))
            yield pa.RecordBatch.from_arrays([group, rows.field("id"), rows.field("v"), pa.array(cells)], ["grp", "id", "v", "cell"])


def _cones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block with its mean direction, the widest angle from it, and the largest norm."""
    for batch in batches:
        centres, radii, norms = [], [], []
        for rows in batch["rows"]:
            vectors = _matrix(rows.values.field("v").to_pylist())
            units = _units(vectors)
            centre = _units(units.mean(0, keepdims=True))[0]
            here = np.linalg.norm(vectors, axis=1)
            centres.append(centre.tolist())
            radii.append(float(_angles(units[here > 0], centre).max(initial=0.0)))
            norms.append(float(here.max()))
        told = [pa.array(centres, pa.list_(pa.float64())), pa.array(radii, pa.float64()), pa.array(norms, pa.float64())]
        yield pa.RecordBatch.from_arrays([batch["no"], batch["grp"], batch["cell"], *told], ["no", "grp", "cell", "centre", "radius", "norm"])


def _around(cell: pa.Table) -> pa.Table:
    """The cone around all cones of a cell."""
    centres = _matrix(cell["centre"].to_pylist())
    centre = _units(centres.mean(0, keepdims=True))[0]
    radius = float((_angles(centres, centre) + cell["radius"].to_numpy()).max())
    return pa.table({"grp": cell["grp"].slice(0, 1), "cell": cell["cell"].slice(0, 1), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [radius], "norm": [max(cell["norm"].to_pylist())]})


def bound(a: str, b: str) -> Column:
    """No inner product of a vector in one cone with one in the other is larger."""
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col(f"{a}.centre"), F.col(f"{b}.centre")))))
    gap = F.least(F.lit(np.pi), F.greatest(F.lit(0.0), angle - F.col(f"{a}.radius") - F.col(f"{b}.radius")))
    return F.greatest(F.lit(0.0), F.cos(gap)) * F.col(f"{a}.norm") * F.col(f"{b}.norm") + SLACK


class Blocks:
    """Vectors (id, v) of each group (grp) in blocks of vectors that point the same way, and cones around them.

    A group of n blocks has about the square root of n cells, each around a pivot picked by the hash of its id, so that
    there are no more pairs of cells than blocks. Pairs of blocks are only looked at within pairs of cells that may hold
    a result; vectors move once to their block, and then only with pairs of blocks that may.
    """

    def __init__(self, rows: DataFrame, block: int):
        sizes = rows.groupBy("grp").agg(F.count("*").alias("n"), F.ceil(F.count("*") / block).cast("int").alias("packs"))
        kinds, each = dict(rows.dtypes), F.collect_list(F.struct("id", "v")).alias("rows")
        self.single = not sizes.where("packs > 1").limit(1).count()
        if self.single:
            # A block per group: there is nothing to choose between.
            self.rows = scratch.stage(rows.groupBy("grp").agg(each).select("grp", F.lit(0).alias("cell"), "rows", F.monotonically_increasing_id().alias("no")), "blocks")
            return
        cells = F.ceil(F.sqrt("packs"))
        picked = rows.join(sizes.where("packs > 1"), "grp").where(F.pmod(F.xxhash64("id"), "n") < 2 * cells)
        pivots = picked.groupBy("grp").agg(F.collect_list("v").alias("pivots"))
        packs = rows.join(sizes, "grp").withColumn("pack", F.pmod(F.hash("id"), "packs")).groupBy("grp", "pack").agg(each)
        dealt = packs.join(pivots, "grp", "left").select("grp", "rows", "pivots").mapInArrow(_assigned, f"grp {kinds['grp']}, id {kinds['id']}, v {kinds['v']}, cell int")
        dealt = scratch.stage(dealt, "cells")
        counts = dealt.groupBy("grp", "cell").agg(F.ceil(F.count("*") / block).alias("parts"))
        blocks = dealt.join(counts, ["grp", "cell"]).groupBy("grp", "cell", F.pmod(F.xxhash64("id"), "parts").alias("part")).agg(each)
        self.rows = scratch.stage(blocks.select("grp", "cell", "rows", F.monotonically_increasing_id().alias("no")), "blocks")
        scratch.drop(dealt)

    @cached_property
    def cones(self) -> DataFrame:
        kind = dict(self.rows.dtypes)["grp"]
        return scratch.stage(self.rows.mapInArrow(_cones, f"no long, grp {kind}, cell int, centre array<double>, radius double, norm double"), "cones")

    @cached_property
    def cells(self) -> DataFrame:
        kind = dict(self.rows.dtypes)["grp"]
        return scratch.stage(self.cones.groupBy("grp", "cell").applyInArrow(_around, f"grp {kind}, cell int, centre array<double>, radius double, norm double"), "around")


def _facing(left: Blocks, right: Blocks, least: Column) -> DataFrame:
    """(p, q, most): pairs of blocks of a group, and of cells before, whose bound reaches ``least``."""
    if left.single and right.single:
        p, q = left.rows.select("grp", F.col("no").alias("p")), right.rows.select(F.col("grp").alias("theirs"), F.col("no").alias("q"))
        return p.join(q, F.col("grp").eqNullSafe(F.col("theirs"))).select("p", "q", F.lit(float("inf")).alias("most"))
    p, q = left.cells.alias("p"), right.cells.alias("q")
    cells = p.join(q, F.col("p.grp").eqNullSafe(F.col("q.grp"))).select(F.col("p.grp").alias("grp"), F.col("p.cell").alias("c"), F.col("q.cell").alias("d"), bound("p", "q").alias("most"))
    p, q = left.cones.alias("p"), right.cones.alias("q")
    near = cells.where(F.col("most") >= least).alias("x")
    pairs = near.join(p, F.col("x.grp").eqNullSafe(F.col("p.grp")) & (F.col("x.c") == F.col("p.cell"))).join(q, F.col("x.grp").eqNullSafe(F.col("q.grp")) & (F.col("x.d") == F.col("q.cell")))
    return pairs.select(F.col("p.no").alias("p"), F.col("q.no").alias("q"), bound("p", "q").alias("most")).where(F.col("most") >= least)


Emit = Callable[[np.ndarray, np.ndarray, np.ndarray, bool], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _products(emit: Emit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, left, right, same in zip(batch["p"].to_pylist(), batch["left"], batch["right"], batch["same"].to_pylist(), strict=True):
                x, y = left.values, left.values if same else right.values
                ids = [np.array(side.field("id").to_pylist(), dtype=np.int64) for side in (x, y)]
                a, b = (_matrix(side.field("v").to_pylist()) for side in (x, y))
                found = emit(ids[0], ids[1], a @ b.T, same)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*found, np.full(len(found[0]), p))], ["a", "b", "cos", "p"])

    return run


def _multiplied(pairs: DataFrame, left: Blocks, right: Blocks, emit: Emit, alike: bool) -> DataFrame:
    same = F.expr("p = q") if alike else F.lit(False)
    duos = pairs.join(left.rows.select(F.col("no").alias("p"), F.col("rows").alias("left")), "p").join(right.rows.select(F.col("no").alias("q"), F.col("rows").alias("right")), "q")
    return duos.select("p", "left", F.when(~same, F.col("right")).alias("right"), same.alias("same")).mapInArrow(_products(emit), "a long, b long, cos double, p long")


def facing_blocks(vectors: DataFrame, ident: str, vector: str, group: str, threshold: float, block: int = BLOCK) -> tuple[Blocks, DataFrame]:
    """Blocks of vectors, and the pairs (p, q), p <= q, of them that may hold a product of ``threshold`` or more."""
    blocks = Blocks(vectors.select(F.col(group).alias("grp"), F.col(ident).alias("id"), F.col(vector).alias("v")), block)
    own = blocks.rows.select(F.col("no").alias("p"), F.col("no").alias("q"))
    if blocks.single:
        return blocks, own
    return blocks, own.union(_facing(blocks, blocks, F.lit(float(threshold))).where("p < q").select("p", "q"))


def similar_pairs(vectors: DataFrame, ident: str, vector: str, group: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b, cos) with a < b in the same group and cos >= threshold: exact, block against block where cones allow it."""
    blocks, pairs = facing_blocks(vectors, ident, vector, group, threshold, block)

    def emit(x: np.ndarray, y: np.ndarray, cos: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = np.nonzero(np.triu(cos >= threshold, 1) if same else cos >= threshold)
        return np.minimum(x[i], y[j]), np.maximum(x[i], y[j]), cos[i, j]

    return _multiplied(pairs, blocks, blocks, emit, alike=True).drop("p")


def knn(queries: DataFrame, entries: DataFrame, ident: str, vector: str, group: str, k: int, block: int = BLOCK) -> DataFrame:
    """(a, b, cos, rank): the k nearest other entries of each query among those of its group, ties to the smaller id.

    Each block of queries first meets the block of entries that its cone is nearest to; from then on only blocks whose
    bound reaches the worst kth product in it.
    """
    asked, told = (Blocks(t.select(F.col(group).alias("grp"), F.col(ident).alias("id"), F.col(vector).alias("v")), block) for t in (queries, entries))

    def emit(x: np.ndarray, y: np.ndarray, cos: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cos = np.where(x[:, None] == y[None, :], -np.inf, cos)
        best = np.lexsort((np.broadcast_to(y, cos.shape), -cos), axis=1)[:, :k]
        i = np.repeat(np.arange(len(x)), best.shape[1])
        j = best.ravel()
        real = cos[i, j] > -np.inf
        return x[i[real]], y[j[real]], cos[i[real], j[real]]

    nearest = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    if asked.single and told.single:
        found = _multiplied(_facing(asked, told, F.lit(-1.0)).select("p", "q"), asked, told, emit, alike=False).drop("p")
        return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    pairs = scratch.stage(_facing(asked, told, F.lit(-1.0)), "facing")
    first = scratch.stage(pairs.groupBy("p").agg(F.max_by("q", F.struct("most", "q")).alias("q")), "nearest-blocks")
    found = scratch.stage(_multiplied(first, asked, told, emit, alike=False), "near")
    kth = found.groupBy("p", "a").agg(F.count("*").alias("n"), F.min("cos").alias("least")).groupBy("p").agg(F.when(F.min("n") >= k, F.min("least")).alias("least"), F.count("*").alias("answered"))
    sizes = asked.rows.select(F.col("no").alias("p"), F.size("rows").alias("size"))
    # A block with a query that has found fewer than k is held against all.
    reached = sizes.join(kth, "p", "left").select("p", F.when(F.col("answered") == F.col("size"), F.col("least")).alias("least"))
    rest = pairs.join(first, ["p", "q"], "left_anti").join(reached, "p").where("least is null or most >= least").select("p", "q")
    found = found.union(_multiplied(rest, asked, told, emit, alike=False)).drop("p")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
