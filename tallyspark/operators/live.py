"""The live cache over rows in order: a row takes its k nearest entries of the moment and then checks them.

Rows of a tenant are cut into blocks. All blocks of one number are decided together: their rows meet the entries of the
blocks before, pack against pack, and a task per tenant goes through its block. No pair of rows is kept but the k nearest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark import scratch
from tallyspark.operators.signed import SLICE, Task, _longs, _matrix

#: Rows of a tenant that one task decides in order, and of a pack that meets another.
BLOCK = 16_384
_SEEN = "array<struct<minus: double, src: bigint, sign: bigint>>"


def _foremost(product: np.ndarray, src: np.ndarray, threshold: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cos): each row's k largest products within the threshold in order, ties by ``src``."""
    i, j = np.nonzero(product >= threshold)
    cos = np.round(product[i, j], 6)
    order = np.lexsort((src[j], -cos, i))
    i, j, cos = i[order], j[order], cos[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first], cos[first]


def _nearest_of(threshold: float, k: int) -> Task:
    """The k nearest entries of a pack for each row of a later block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, told in zip(batch["rows"], batch["told"], strict=True):
                rows, told = rows.values, told.values
                no, v, src, sign, e = _longs(rows, "no"), _matrix(rows), _longs(told, "no"), _longs(told, "sign"), _matrix(told)
                for at in range(0, len(v), SLICE):
                    i, j, cos = _foremost(v[at : at + SLICE] @ e.T, src, threshold, k)
                    yield pa.RecordBatch.from_arrays([pa.array(no[at + i]), pa.array(-cos), pa.array(src[j]), pa.array(sign[j])], ["no", "minus", "src", "sign"])

    return run


def _told_in_order(threshold: float, k: int) -> Task:
    """Goes through the rows of a block: what it decides is known to the rows after it. Of the entries of one vector only the
    first k can be among the k nearest of a row, so that only they are kept for others (``v``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, rows in zip(batch["g"].to_pylist(), batch["rows"], strict=True):
                rows = rows.values.take(pa.array(np.argsort(_longs(rows.values, "no"))))
                no, v, sign = _longs(rows, "no"), _matrix(rows), _longs(rows, "sign")
                seen = [[(s["minus"], s["src"], s["sign"]) for s in mine or ()] for mine in rows.field("seen").to_pylist()]
                names, kept, found, copies = no.tolist(), [], [], Counter()
                for at in range(0, len(v), SLICE):
                    part, entries = v[at : at + SLICE], np.array(kept, dtype=np.int64)
                    for i, j, cos in zip(*(x.tolist() for x in _foremost(part @ v[entries].T, no[entries], threshold, k)), strict=True):
                        seen[at + i].append((-cos, names[kept[j]], int(sign[kept[j]])))
                    among = part @ part.T
                    i, j = np.nonzero(np.tril(among >= threshold, -1))
                    cos, cuts, misses = np.round(among[i, j], 6).tolist(), np.searchsorted(i, np.arange(len(part) + 1)).tolist(), set()
                    j = j.tolist()
                    for r in range(len(part)):
                        a = at + r
                        near = seen[a] + [(-cos[x], names[at + j[x]], int(sign[at + j[x]])) for x in range(cuts[r], cuts[r + 1]) if j[x] in misses]
                        near = sorted(near)[:k]
                        served = next((n for n in near if n[2] == sign[a]), None)
                        if served:
                            found.append((True, served[1], -served[0]))
                            continue
                        found.append((False, None, -near[0][0] if near else None))
                        misses.add(r)
                        name = part[r].tobytes()
                        copies[name] += 1
                        if copies[name] <= k:
                            kept.append(a)
                hit, source, cosine = zip(*found, strict=True)
                place = np.full(len(v), -1)
                place[kept] = kept
                vectors = rows.field("v").take(pa.array(place, mask=place < 0))
                told = [pa.array(hit, pa.bool_()), pa.array(source, pa.int64()), pa.array(cosine, pa.float64()), vectors]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), g)), rows.field("no"), *told, rows.field("sign")], ["g", "no", "hit", "served_from", "cosine", "v", "sign"])

    return run


def _places(rows: DataFrame) -> DataFrame:
    """Adds ``place``, from 0, within each group (g); rows (no) are numbered by ``monotonically_increasing_id`` in order of
    their groups, so the ranges that a group lies in tell it without sorting a group in one task."""
    ranged = rows.withColumn("part", F.shiftright("no", 33))
    sizes = ranged.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("no").alias("least"))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("g", "part", "least", F.coalesce(before, F.lit(0)).alias("before"))
    return ranged.join(starts, ["g", "part"]).withColumn("place", F.col("before") + F.col("no") - F.col("least")).drop("part", "least", "before")


def replay(rows: DataFrame, threshold: float, k: int, block: int = BLOCK) -> DataFrame:
    """(no, hit, served_from, cosine) of rows (g, no, v, sign), in order of ``no``: a row is served by the nearest with its
    own sign among its k nearest entries; ties go to the earlier one."""
    kind = dict(rows.dtypes)["v"]
    placed = _places(rows).withColumn("block", F.floor(F.col("place") / block))
    placed = scratch.stage(placed.repartitionByRange("block", "no").select("g", "no", "v", "sign", "block"), "live-blocks")
    last = placed.agg(F.max("block").alias("last")).first()["last"]
    decided, packs, parts = None, None, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for b in range(0 if last is None else last + 1):
        mine = placed.where(F.col("block") == b)
        if packs is None:
            asked = mine.withColumn("seen", F.lit(None).cast(_SEEN))
        else:
            whole = mine.groupBy("g").agg(F.collect_list(F.struct("no", "v")).alias("rows"))
            # So many parts that few pairs of packs, which are small but take long, share a task.
            met = whole.join(packs, "g").repartition(parts, "g", "b").select("rows", "told")
            near = met.mapInArrow(_nearest_of(threshold, k), "no long, minus double, src long, sign long")
            best = F.slice(F.array_sort(F.collect_list(F.struct("minus", "src", "sign"))), 1, k)
            asked = mine.join(near.groupBy("no").agg(best.alias("seen")), "no", "left")
        each = asked.groupBy("g").agg(F.collect_list(F.struct("no", "v", "sign", "seen")).alias("rows"))
        fresh = scratch.stage(each.mapInArrow(_told_in_order(threshold, k), f"g long, no long, hit boolean, served_from long, cosine double, v {kind}, sign long"), "live-decided")
        own = fresh.select("no", "hit", "served_from", "cosine")
        decided = own if decided is None else decided.union(own)
        if b < last:
            pack = fresh.where("v is not null").groupBy("g").agg(F.collect_list(F.struct("no", "v", "sign")).alias("told"))
            pack = scratch.stage(pack.withColumn("b", F.lit(b)), "live-packs")
            packs = pack if packs is None else packs.union(pack)
    return rows.sparkSession.createDataFrame([], "no long, hit boolean, served_from long, cosine double") if decided is None else decided
