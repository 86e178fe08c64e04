"""Replays of a semantic cache whose checks compare signs: no pair of rows is kept, rows only meet entries.

Rows of one group, vector and signs (a class) see the same entries, and the first of them serves the others: only first
rows can become entries. Which of them do is sieved block by block; then each row looks for its nearest entry.

Rows move as numbers. A vector is kept once a tenant, whatever number of rows has it, and joins them in the tasks' packs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark import scratch
from tallyspark.functions import vectors
from tallyspark.operators import cache

#: Rows of a group that are sieved in order by one task; rows that meet a task's entries at once; rows of one product.
SIEVE, BLOCK, SLICE = 65_536, 8192, 256
#: Rows that ask, rows that are told, and vectors of a pack, about: large ones meet few others, so that little is sent twice.
ASKED, TOLD, VECTORS = 262_144, 524_288, 65_536
#: Products and pairs of rows that a task holds at once; groups with fewer pairs are taken together.
HELD, FEW = 1 << 22, 1 << 14

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _matrix(rows: pa.StructArray) -> np.ndarray:
    flat = rows.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(rows), len(flat) // len(rows))


def _longs(rows: pa.StructArray, name: str) -> np.ndarray:
    return rows.field(name).to_numpy(zero_copy_only=False)


def _levels(cos: np.ndarray, thresholds: Sequence[float]) -> np.ndarray:
    """Bit i is set where the rounded cosine reaches the ith threshold."""
    return (np.int64(1) << np.searchsorted(np.array(thresholds), np.round(cos, 6), side="right").astype(np.int64)) - 1


def _taken(rows: np.ndarray, entries: np.ndarray, bits: np.ndarray, thresholds: Sequence[float], wide: int = HELD // SLICE) -> np.ndarray:
    """The bits that entries take from the rows near them."""
    taken = np.zeros(len(rows), dtype=np.int64)
    for at in range(0, len(entries), wide):
        product = rows @ entries[at : at + wide].T
        i, j = np.nonzero(product >= thresholds[0])
        if len(i):
            starts = np.flatnonzero(np.diff(i, prepend=-1))
            taken[i[starts]] |= np.bitwise_or.reduceat(bits[at + j] & _levels(product[i, j], thresholds), starts)
    return taken


def _entries_of(thresholds: Sequence[float]) -> Task:
    """Goes through the rows of a group in order: a row's bits that no earlier entry near it or of its key has taken make it
    an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, rows in enumerate(batch["rows"]):
                rows = rows.values
                open_ = _longs(rows, "open").copy()
                if len(rows) > 1:
                    rows = rows.take(pa.array(np.argsort(_longs(rows, "seq"))))
                    open_, v = _longs(rows, "open").copy(), _matrix(rows)
                    entries, bits, n = np.empty_like(v), np.empty_like(open_), 0
                    same = np.unique(_longs(rows, "key"), return_inverse=True)[1]
                    kept = np.zeros(len(v), dtype=np.int64)
                    for begin in range(0, len(v), SLICE):
                        open_[begin : begin + SLICE] &= ~_taken(v[begin : begin + SLICE], entries[:n], bits[:n], thresholds)
                        left = begin + np.flatnonzero(open_[begin : begin + SLICE])
                        product = v[left] @ v[left].T
                        i, j = np.nonzero(np.triu(product >= thresholds[0], 1))
                        taken = _levels(product[i, j], thresholds)
                        at = np.searchsorted(i, np.arange(len(left) + 1))
                        for a, row in enumerate(left):
                            open_[row] &= ~kept[same[row]]
                            if open_[row]:
                                near = slice(at[a], at[a + 1])
                                open_[left[j[near]]] &= ~(open_[row] & taken[near])
                                kept[same[row]] |= open_[row]
                        fresh = left[open_[left] != 0]
                        entries[n : n + len(fresh)], bits[n : n + len(fresh)] = v[fresh], open_[fresh]
                        n += len(fresh)
                found = rows.filter(pa.array(open_ != 0))
                yield pa.RecordBatch.from_arrays([batch["g"].take(pa.array(np.full(len(found), k))), found.field("seq"), found.field("v"), found.field("key"), pa.array(open_[open_ != 0])], ["g", "seq", "v", "key", "open"])

    return run


def _left_of(thresholds: Sequence[float]) -> Task:
    """Rows without the bits that the entries near them take; rows with none left are no entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                rows, entries = batch["rows"][k].values, batch["entries"][k].values
                open_, bits, v, e = _longs(rows, "open").copy(), _longs(entries, "open"), _matrix(rows), _matrix(entries)
                for at in range(0, len(v), SLICE):
                    open_[at : at + SLICE] &= ~_taken(v[at : at + SLICE], e, bits, thresholds)
                same = np.unique(np.concatenate([_longs(entries, "key"), _longs(rows, "key")]), return_inverse=True)[1]
                kept = np.zeros(len(same), dtype=np.int64)
                np.bitwise_or.at(kept, same[: len(e)], bits)
                open_ &= ~kept[same[len(e) :]]
                found = rows.filter(pa.array(open_ != 0))
                yield pa.RecordBatch.from_arrays([batch["g"].take(pa.array(np.full(len(found), k))), found.field("seq"), found.field("v"), found.field("key"), pa.array(open_[open_ != 0])], ["g", "seq", "v", "key", "open"])

    return run


def _packed(rows: DataFrame, sizes: DataFrame, block: int, *fields: str) -> DataFrame:
    """Rows of each group (g) in packs of about ``block``, dealt by the hash of their number."""
    pack = F.pmod(F.xxhash64("seq"), F.ceil(F.col("n") / block)).alias("pack")
    return rows.join(sizes, "g").groupBy("g", pack).agg(F.collect_list(F.struct(*fields)).alias("rows"))


def entries(rows: DataFrame, thresholds: Sequence[float], block: int = SIEVE) -> DataFrame:
    """(g, seq, v, open) of the rows (g, seq, v) that become entries: in the order of seq those without an earlier entry of
    their group within the threshold, or of the same key (a column ``key``, if there is one) in their group. ``open`` has a
    bit for each threshold under which a row is one.

    In each round the first rows of a group, ``block`` at most, are decided in one task, and those near the new entries
    leave the rest. So a task holds a block, and the rest soon shrinks where rows are near many others.
    """
    schema = f"g long, seq long, v {dict(rows.dtypes)['v']}, key long, open long"
    key = F.col("key" if "key" in rows.columns else "seq").alias("key")
    left, found = scratch.stage(rows.select("g", "seq", "v", key, F.lit((1 << len(thresholds)) - 1).cast("long").alias("open")), "sieve-rows"), []
    shares = [0.5**i for i in range(40)]
    while True:
        cut = F.element_at(F.percentile_approx("seq", shares), F.greatest(F.lit(1), 1 + F.ceil(F.log2(F.count("*") / F.lit(float(block))))).cast("int"))
        sizes = scratch.stage(left.groupBy("g").agg(F.count("*").alias("n"), F.when(F.count("*") > block, cut).alias("cut")), "sieve-cuts")
        first = left.join(sizes, "g").where("cut is null or seq <= cut").groupBy("g").agg(F.collect_list(F.struct("seq", "v", "key", "open")).alias("rows"))
        fresh = scratch.stage(first.mapInArrow(_entries_of(thresholds), schema), "sieve-entries")
        found.append(fresh)
        more = sizes.where("cut is not null")
        if not more.limit(1).count():
            break
        rest = _packed(left.join(more.select("g", "cut"), "g").where("seq > cut").drop("cut"), more.select("g", "n"), BLOCK, "seq", "v", "key", "open")
        told = fresh.join(more, "g", "left_semi").groupBy("g").agg(F.collect_list(F.struct("v", "key", "open")).alias("entries"))
        after = scratch.stage(rest.join(told, "g").select("g", "rows", "entries").mapInArrow(_left_of(thresholds), schema), "sieve-rows")
        scratch.drop(left, sizes)
        left = after
    scratch.drop(left, sizes)
    together = found[0]
    for part in found[1:]:
        together = together.union(part)
    return together.drop("key")


def _nearest(thresholds: Sequence[float]) -> Task:
    """Of each row and threshold the nearest earlier entry of a pack; ties go to the earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, told in zip(batch["rows"], batch["told"], strict=True):
                rows, told = rows.values, told.values.take(pa.array(np.argsort(_longs(told.values, "seq"))))
                seq, wanted, v = _longs(rows, "seq"), _longs(rows, "open"), _matrix(rows)
                src, bits, e = _longs(told, "seq"), _longs(told, "open"), _matrix(told)
                for at in range(0, len(v), SLICE):
                    product = v[at : at + SLICE] @ e.T
                    i, j = np.nonzero((product >= thresholds[0]) & (src[None, :] < seq[at : at + SLICE, None]))
                    cos = np.round(product[i, j], 6)
                    able = wanted[at + i] & bits[j] & _levels(cos, thresholds)
                    i, j, cos, able = (x[able != 0] for x in (i, j, cos, able))
                    order = np.lexsort((j, -cos, i))
                    i, j, cos, able = (x[order] for x in (i, j, cos, able))
                    best = np.zeros(len(i), dtype=np.int64)
                    for bit in range(len(thresholds)):
                        here = np.flatnonzero(able >> bit & 1)
                        best[here[np.diff(i[here], prepend=-1) != 0]] |= np.int64(1) << bit
                    i, j, cos, best = (x[best != 0] for x in (i, j, cos, best))
                    yield pa.RecordBatch.from_arrays([pa.array(seq[at + i]), pa.array(src[j]), pa.array(cos), pa.array(best)], ["seq", "src", "cos", "best"])

    return run


def _bits(column: str, n: int) -> Column:
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(F.col(column), i) == 1)).alias("level")


def _met(asked: DataFrame, told: DataFrame, block: int) -> DataFrame:
    """(rows, told): each pack of the rows ``asked`` (g, seq and others) with each pack of those ``told`` of its group."""
    mine, theirs = (
        scratch.stage(_packed(rows, rows.groupBy("g").agg(F.count("*").alias("n")), block, *(c for c in rows.columns if c != "g")).withColumn("no", F.monotonically_increasing_id()), "replay-packs")
        for rows in (asked, told)
    )
    pairs = mine.select("g", F.col("no").alias("p")).join(theirs.select("g", F.col("no").alias("q")), "g").drop("g")
    met = pairs.join(mine.select(F.col("no").alias("p"), "rows"), "p").join(theirs.select(F.col("no").alias("q"), F.col("rows").alias("told")), "q")
    return met.select("rows", "told")


def nearest_before(asked: DataFrame, told: DataFrame, thresholds: Sequence[float], block: int = BLOCK) -> DataFrame:
    """(seq, level, cos, src): of each row (g, seq, v, open) and threshold among its bits the nearest earlier entry (g, seq,
    v, open) of its group that has the bit, too; ties go to the earlier one. Packs meet packs."""
    met = _met(asked.select("g", "seq", "v", "open"), told.select("g", "seq", "v", "open"), block)
    found = met.mapInArrow(_nearest(thresholds), "seq long, src long, cos double, best long")
    each = found.select("seq", "src", "cos", _bits("best", len(thresholds)))
    nearest = each.groupBy("seq", "level").agg(F.max(F.struct("cos", (-F.col("src")).alias("minus"))).alias("b"))
    return nearest.select("seq", "level", F.col("b.cos").alias("cos"), (-F.col("b.minus")).alias("src"))


def _number(*columns: str | Column) -> Column:
    """One number for equal values; nulls are equal to each other only."""
    return F.xxhash64(*(x for c in columns for x in (F.isnull(c), F.col(c) if isinstance(c, str) else c)))


def _vector_name(threshold: float) -> Column:
    """Equal for rows (seq, v) of one vector; a vector that is not near itself stands for no other row."""
    norm = vectors.dot(F.col("v"), F.col("v"))
    alone = F.when((norm >= threshold + 1e-5) & ~F.isnan(norm), F.lit(None)).otherwise(F.col("seq"))
    return F.struct(F.xxhash64("v"), F.hash("v"), alone)


def _all_pairs(rows: DataFrame, modes: Mapping[str, Sequence[str]], thresholds: Sequence[float], exact: str | None = None) -> DataFrame:
    """The same by all pairs of rows: unknown signs pass with all others, so that rows are in no classes."""
    pairs = vectors.similar_pairs(rows, "seq", "v", "grp", thresholds[0])
    signs = [c for c in rows.columns if c not in ("seq", "grp", "v", exact)]
    told = rows.select("seq", F.struct(*signs).alias("signs"))
    both = pairs.join(told.toDF("a", "cached"), "a").join(told.toDF("b", "new"), "b")
    reasons = []
    for mode, checked in modes.items():
        found = F.lit(None).cast("string")
        for sign in reversed(checked):
            same = F.col("new")[sign].eqNullSafe(F.col("cached")[sign]) if sign == "context" else F.col("new")[sign] == F.col("cached")[sign]
            found = F.when(~same, f"{sign}_mismatch").otherwise(found)
        reasons.append(found.alias(mode))
    candidates = both.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.bround("cos", 6).alias("cos"), *reasons)
    if exact:
        key = rows.select("seq", _number("grp", exact).alias("key"))
        same = key.withColumnRenamed("seq", "src").join(key.withColumnRenamed("seq", "dst"), "key").where("src < dst")
        candidates = candidates.union(same.select("src", "dst", F.lit(float("inf")), *(F.lit(None).cast("string") for _ in modes)))
    return cache.replay_grid(rows.select("seq"), scratch.stage(candidates, "compared"), list(modes), thresholds)


def unknown_signs(rows: DataFrame, signs: Sequence[str]) -> bool:
    """Whether a sign is null that passes with all others then; an unknown context is a context like others."""
    unknown = [F.col(sign).isNull() for sign in signs if sign != "context"]
    return bool(unknown) and rows.where(F.greatest(*unknown) if len(unknown) > 1 else unknown[0]).limit(1).count() > 0


class _Side:
    """Vectors of a pack (v), and the rows that have them in the order of their keys: place of the vector (at), key, seq
    and bits."""

    def __init__(self, pack: pa.StructArray):
        rows = pack.field("rows")
        at, rows = np.repeat(np.arange(len(pack)), pc.list_value_length(rows).to_numpy(zero_copy_only=False)), rows.flatten()
        key, seq, bits = (_longs(rows, c) for c in ("key", "seq", "bits"))
        order = np.lexsort((at, key))
        self.v, self.at, self.key, self.seq, self.bits = _matrix(pack), at[order], key[order], seq[order], bits[order]

    def ranges(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows of each key begin, and their number."""
        begin = np.searchsorted(self.key, keys)
        return begin, np.searchsorted(self.key, keys, side="right") - begin


def _expanded(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, x, y): of each pair i of ranges, from a[i] on and from b[i] on, all pairs of places, some ``HELD`` at once."""
    ends = np.cumsum(n * m)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(HELD // 2, ends[-1] if len(ends) else 0, HELD // 2), side="right"), [len(ends)]]))
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        i = np.repeat(np.arange(begin, end), (n * m)[begin:end])
        off = np.arange(len(i)) - np.repeat((ends - n * m)[begin:end] - (ends - n * m)[begin], (n * m)[begin:end])
        yield i, a[i] + off // m[i], b[i] + off % m[i]


def _pairs(asked: _Side, told: _Side, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, cos): rows x that ask with rows y before them of their key that have a vector near theirs."""
    keys = np.intersect1d(asked.key, told.key)
    (a, n), (b, m) = asked.ranges(keys), told.ranges(keys)
    few = n * m <= FEW
    for _, x, y in _expanded(a[few], n[few], b[few], m[few]):
        x, y = (z[told.seq[y] < asked.seq[x]] for z in (x, y))
        for at in range(0, len(x), HELD // SLICE):
            i, j = x[at : at + HELD // SLICE], y[at : at + HELD // SLICE]
            cos = np.einsum("ij,ij->i", asked.v[asked.at[i]], told.v[told.at[j]])
            yield i[cos >= least], j[cos >= least], cos[cos >= least]
    for begin, count, first, number in zip(a[~few], n[~few], b[~few], m[~few], strict=True):
        p, own, owned = np.unique(asked.at[begin : begin + count], return_index=True, return_counts=True)
        q, has, had = np.unique(told.at[first : first + number], return_index=True, return_counts=True)
        w, step = told.v[q], max(1, min(SLICE, HELD // len(q)))
        for at in range(0, len(p), step):
            product = asked.v[p[at : at + step]] @ w.T
            i, j = np.nonzero(product >= least)
            cos, i = product[i, j], at + i
            for k, x, y in _expanded(begin + own[i], owned[i], first + has[j], had[j]):
                before = told.seq[y] < asked.seq[x]
                yield x[before], y[before], cos[k[before]]


def _served(thresholds: Sequence[float]) -> Task:
    """Of each row that asks and each threshold among its bits the nearest earlier row that is told in a pack, of its key
    and with the bit; ties go to the earlier one. A close row's key is odd."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, theirs in zip(batch["asked"], batch["told"], strict=True):
                asked, told = _Side(mine.values), _Side(theirs.values)
                # A row needs nothing that is farther than what serves it at all its thresholds.
                floor = np.full(len(asked.seq), -np.inf)
                for x, y, cos in _pairs(asked, told, thresholds[0]):
                    cos = np.round(cos, 6)
                    able = asked.bits[x] & told.bits[y] & _levels(cos, thresholds)
                    whole = able == asked.bits[x]
                    np.maximum.at(floor, x[whole], cos[whole])
                    good = (able != 0) & (cos >= floor[x])
                    x, y, cos, able = (z[good] for z in (x, y, cos, able))
                    order = np.lexsort((told.seq[y], -cos, x))
                    x, y, cos, able = (z[order] for z in (x, y, cos, able))
                    best = np.zeros(len(x), dtype=np.int64)
                    for bit in range(len(thresholds)):
                        here = np.flatnonzero(able >> bit & 1)
                        best[here[np.diff(x[here], prepend=-1) != 0]] |= np.int64(1) << bit
                    x, y, cos, best = (z[best != 0] for z in (x, y, cos, best))
                    yield pa.RecordBatch.from_arrays([pa.array(asked.seq[x]), pa.array(told.seq[y]), pa.array(cos), pa.array(best), pa.array(asked.key[x] & 1 == 1)], ["seq", "src", "cos", "bits", "close"])

    return run


def _with_vectors(rows: DataFrame, vecs: DataFrame, block: int, name: str) -> DataFrame:
    """(tenant, no, pack) of rows (tenant, vid, key, seq, bits): packs of about ``block`` rows under their vectors, which
    move once a pack. Rows of a common vector are dealt to several."""
    rows = scratch.stage(rows.select("tenant", "vid", "key", "seq", "bits"), "replay-dealt")
    sizes = rows.groupBy("tenant").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.approx_count_distinct("vid") / VECTORS)).alias("packs"))
    common = rows.groupBy("vid").agg(F.ceil(F.count("*") / block).alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("seq"), F.coalesce("parts", F.lit(1)))
    dealt = rows.join(sizes, "tenant").join(common, "vid", "left").withColumn("pack", F.pmod(F.xxhash64("vid", part), F.col("packs")))
    under = dealt.groupBy("tenant", "pack", "vid").agg(F.collect_list(F.struct("key", "seq", "bits")).alias("rows"))
    packs = under.join(vecs.select("vid", "v"), "vid").groupBy("tenant", "pack").agg(F.collect_list(F.struct("v", "rows")).alias(name))
    found = scratch.stage(packs.select("tenant", F.monotonically_increasing_id().alias(f"{name}_no"), name), "replay-packs")
    scratch.drop(rows)
    return found


def _nearest_told(asked: DataFrame, told: DataFrame, vecs: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(seq, src, cos, bits, close): for rows that ask the nearest earlier ones that are told, in packs that meet packs."""
    mine, theirs = _with_vectors(asked, vecs, ASKED, "asked"), _with_vectors(told, vecs, TOLD, "told")
    pairs = mine.select("tenant", "asked_no").join(theirs.select("tenant", "told_no"), "tenant").drop("tenant")
    met = pairs.join(mine.drop("tenant"), "asked_no").join(theirs.drop("tenant"), "told_no").select("asked", "told")
    return met.mapInArrow(_served(thresholds), "seq long, src long, cos double, bits long, close boolean")


def _entries_by_number(leaders: DataFrame, vecs: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(seq, open) of the first rows (g, vid, seq, n) of classes that become entries; the only class of a group (n) does."""
    crowd = leaders.where("n > 1").join(vecs.select("vid", "v"), "vid").select("g", "seq", "v", *(c for c in leaders.columns if c == "key"))
    alone = leaders.where("n = 1").select("seq", F.lit((1 << len(thresholds)) - 1).cast("long").alias("open"))
    return entries(crowd, thresholds).select("seq", "open").union(alone)


def signed_replay(rows: DataFrame, modes: Mapping[str, Sequence[str]], thresholds: Sequence[float], carried: Sequence[str] = (), exact: str | None = None) -> DataFrame:
    """(mode, threshold, seq, hit, served_from, cosine, miss_reason): as ``cache.replay_grid``, over rows (seq, grp, v and
    signs) of which an earlier one passes if it has the same signs as those that the mode names; the first other sign is
    the reason. ``thresholds`` go up. Columns that are ``carried`` come along; rows of all thresholds are made last.

    With ``exact``, the column of an exact cache's key, an entry of the group first serves rows of its key, at an infinite
    cosine. Rows that anything serves write no entry, in neither cache. Equal keys have equal signs.
    """
    checked = sorted({sign for signs in modes.values() for sign in signs})
    rows = scratch.stage(rows.select("seq", "grp", "v", *checked, *carried, *([exact] if exact else [])), "signed-rows")
    if unknown_signs(rows, checked):
        found = _all_pairs(rows.drop(*carried), modes, thresholds, exact)
        return found.join(rows.select("seq", *carried), "seq") if carried else found
    n, full = len(modes), (1 << len(thresholds)) - 1
    name = [_number("grp").alias("tenant"), F.xxhash64("v").alias("h"), F.hash("v").alias("k")]
    norm = vectors.dot(F.col("v"), F.col("v"))
    itself = F.coalesce((norm >= thresholds[-1] + 1e-5) & ~F.isnan(norm), F.lit(False)).alias("itself")
    vecs = rows.select(*name, "v").groupBy("tenant", "h", "k").agg(F.first("v").alias("v"))
    vecs = scratch.stage(vecs.select("*", itself, F.monotonically_increasing_id().alias("vid")), "replay-vectors")
    key = ["key"] if exact else []
    named = rows.select("seq", *name, *(_number(sign).alias(sign) for sign in checked), *(_number(exact).alias("key") for _ in key)).join(vecs.drop("v"), ["tenant", "h", "k"])
    # A vector that is not near itself stands for no other row.
    alone = F.when(~F.col("itself"), F.col("seq")).alias("alone")
    named = scratch.stage(named.select("seq", "tenant", "vid", alone, *checked, *key), "replay-rows")
    # Keys of rows that ask for what passes are even.
    each = F.inline(F.array(*(F.struct(F.lit(i).alias("mode"), F.xxhash64(F.lit(i), "tenant", *signs).bitwiseAND(F.lit(-2)).alias("g")) for i, signs in enumerate(modes.values()))))
    each = named.select("seq", "tenant", "vid", "alone", *key, each).withColumn("seq", F.col("seq") * n + F.col("mode"))
    leaders = scratch.stage(each.groupBy("tenant", "mode", "g", "vid", "alone", *key).agg(F.min("seq").alias("seq")), "replay-leaders")
    sized = scratch.stage(leaders.join(leaders.groupBy("g").agg(F.count("*").alias("n")), "g"), "replay-sized")
    own = _entries_by_number(sized, vecs, thresholds)
    own = scratch.stage(leaders.join(own, "seq").select("tenant", "mode", "g", "vid", "seq", "open", *key), "replay-entries")
    wanted = (F.lit(full) - F.coalesce("open", F.lit(0))).cast("long").alias("bits")
    asked = each.join(own.select("seq", "open"), "seq", "left").select("tenant", "vid", F.col("g").alias("key"), "seq", wanted).where("bits <> 0")
    told = own.select("tenant", "vid", F.col("g").alias("key"), "seq", F.col("open").alias("bits"))
    # Entries that nothing passes to: the nearest of any signs, if there are some. Of one vector's entries the first that
    # has a bit is before the others.
    guarded = own.where(F.col("mode").isin([i for i, signs in enumerate(modes.values()) if signs]))
    guarded = guarded.select("tenant", "mode", "vid", F.xxhash64(F.lit("close"), "mode", "tenant").bitwiseOR(F.lit(1)).alias("key"), "seq", "open")
    earlier = F.bit_or("open").over(Window.partitionBy("tenant", "mode", "vid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    firsts = guarded.withColumn("bits", F.col("open").bitwiseAND(F.bitwise_not(F.coalesce(earlier, F.lit(0).cast("long"))))).where("bits <> 0")
    asked = asked.union(guarded.select("tenant", "vid", "key", "seq", F.col("open").alias("bits")))
    told = told.union(firsts.select("tenant", "vid", "key", "seq", "bits"))
    near = scratch.stage(_nearest_told(asked, told, vecs, thresholds), "replay-near")
    signs = named.select("seq", *checked)
    close = near.where("close").withColumn("mode", F.pmod("seq", F.lit(n))).withColumn("row", F.expr(f"(seq - mode) div {n}")).withColumn("other", F.expr(f"(src - mode) div {n}"))
    close = close.join(signs.select(F.col("seq").alias("row"), F.struct("*").alias("new")), "row").join(signs.select(F.col("seq").alias("other"), F.struct("*").alias("cached")), "other")
    why = F.lit(None).cast("string")
    for i, checks in enumerate(modes.values()):
        for sign in reversed(checks):
            why = F.when((F.col("mode") == i) & (F.col("new")[sign] != F.col("cached")[sign]), f"{sign}_mismatch").otherwise(why)
    # Of equal cosines the largest ``minus`` is the earliest row.
    best = lambda reason: F.struct("cos", (-F.col("src")).alias("minus"), "bits", reason.alias("why"))
    found = near.where("not close").select("seq", best(F.lit(None).cast("string")).alias("b")).union(close.select("seq", best(why).alias("b")))
    found = found.groupBy("seq").agg(F.collect_list("b").alias("near"))
    answers = each.select("seq", "mode").join(own.select("seq", "open"), "seq", "left").join(found, "seq", "left")
    if exact:
        kept = own.groupBy("g", "key").agg(F.collect_list(F.struct("seq", "open")).alias("kept"))
        answers = answers.join(each.join(kept, ["g", "key"]).select("seq", F.filter("kept", lambda e: e["seq"] < F.col("seq")).alias("kept")), "seq", "left")
    answers = answers.withColumn("seq", F.expr(f"(seq - mode) div {n}"))
    answers = answers.join(F.broadcast(rows.agg(F.min("seq").alias("_first"))))
    if carried:
        answers = answers.join(rows.select("seq", *carried), "seq")
    open_ = F.getbit(F.coalesce("open", F.lit(0).cast("long")), F.col("level")) == 1
    here = F.array_max(F.filter("near", lambda b: F.getbit(b["bits"], F.col("level")) == 1))
    if exact:
        # At each threshold a key has one entry at most.
        copy = F.get(F.filter("kept", lambda e: F.getbit(e["open"], F.col("level")) == 1), F.lit(0))
        at_once = F.struct(F.lit(float("inf")).alias("cos"), (-copy["seq"]).alias("minus"), copy["open"].alias("bits"), F.lit(None).cast("string").alias("why"))
        here = F.when(~open_ & copy.isNotNull(), at_once).otherwise(here)
    told = answers.select("*", F.posexplode(F.array(*map(F.lit, thresholds))).alias("level", "threshold")).withColumn("hit", ~open_).withColumn("b", here)
    reason = F.when(~F.col("hit"), F.when(F.col("seq") == F.col("_first"), "empty").otherwise(F.coalesce("b.why", F.lit("low_cosine"))))
    source = F.when(F.col("hit"), F.expr(f"(-b.minus - mode) div {n}"))
    return told.select(F.array(*map(F.lit, modes))[F.col("mode")].alias("mode"), "threshold", "seq", "hit", source.alias("served_from"), F.col("b.cos").alias("cosine"), reason.alias("miss_reason"), *carried)


def _looked_at(threshold: float) -> Task:
    """How many earlier entries of a pack each row's judge looks at, and the tokens of its replies about them: those that
    are nearer than the entry which serves the row (cos, src), or all where none does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, told in zip(batch["rows"], batch["told"], strict=True):
                rows, told = rows.values, told.values
                seq, v, src, e = _longs(rows, "seq"), _matrix(rows), _longs(told, "seq"), _matrix(told)
                least, last = (rows.field(c).fill_null(f).to_numpy(zero_copy_only=False) for c, f in (("cos", -np.inf), ("src", -1)))
                costs = [np.ones(len(src)), _longs(told, "input_tokens"), _longs(told, "output_tokens")]
                sums = np.zeros((3, len(v)), dtype=np.int64)
                for at in range(0, len(v), SLICE):
                    product = v[at : at + SLICE] @ e.T
                    i, j = np.nonzero((product >= threshold) & (src[None, :] < seq[at : at + SLICE, None]))
                    cos = np.round(product[i, j], 6)
                    nearer = (cos > least[at + i]) | ((cos == least[at + i]) & (src[j] < last[at + i]))
                    for total, cost in zip(sums, costs, strict=True):
                        total[at : at + SLICE] = np.bincount(i[nearer], cost[j[nearer]], len(product))
                some = np.flatnonzero(sums[0])
                yield pa.RecordBatch.from_arrays([pa.array(seq[some]), *(pa.array(total[some]) for total in sums)], ["seq", "consulted", "judge_input", "judge_output"])

    return run


def judged_replay(rows: DataFrame, signs: Sequence[str], threshold: float, block: int = BLOCK) -> DataFrame:
    """(seq, hit, served_from, judged, consulted, judge_input, judge_output): the replay with a judge as the last check.

    Rows (seq, grp, v, signs, serves, input_tokens, output_tokens) carry the judge's verdict on them as entries. A row
    that doesn't serve becomes an entry, too, where nothing serves it; ``judged`` tells that the nearest entry of a miss
    failed by its verdict only. The judge is asked about a row's entries of the same signs, nearest first, up to and with
    the first that serves. Unknown signs are not for this function.
    """
    tokens = ["input_tokens", "output_tokens"]
    named = rows.select("seq", "v", _number("grp").alias("tenant"), _number("grp", *signs).alias("g"), _vector_name(threshold).alias("h"), "serves", *(F.col(t).cast("long").alias(t) for t in tokens))
    named = scratch.stage(named.withColumn("open", F.lit(1).cast("long")), "judged-rows")
    leaders = named.where("serves").groupBy("g", "h").agg(F.min(F.struct("seq", "v")).alias("first")).select("g", "first.*")
    able = scratch.stage(entries(leaders, [threshold]), "judged-entries")
    asked = named.join(able.select("seq"), "seq", "left_anti")
    hits = nearest_before(asked, able, [threshold], block).select("seq", "cos", "src")
    told = scratch.stage(named.join(hits, "seq", "left"), "judged-told")
    own = told.where("src is null")
    refused = own.where("not serves").select("g", "seq", "v", *tokens)
    looked = _met(told.select("g", "seq", "v", "cos", "src"), refused, block).mapInArrow(_looked_at(threshold), "seq long, consulted long, judge_input long, judge_output long")
    looked = looked.groupBy("seq").agg(*(F.sum(c).alias(c) for c in ("consulted", "judge_input", "judge_output")))
    # The nearest of any signs: of one vector's entries only the first can be it.
    firsts = own.groupBy("tenant", "h").agg(F.min(F.struct("seq", "v", "open")).alias("first")).select(F.col("tenant").alias("g"), "first.*")
    close = nearest_before(own.select(F.col("tenant").alias("g"), "seq", "v", "open"), firsts, [threshold], block).select("seq", F.col("src").alias("close"))
    served = named.select(F.col("seq").alias("src"), *(F.col(t).alias(f"served_{t}") for t in tokens))
    theirs = named.select(F.col("seq").alias("close"), F.col("g").alias("close_g"))
    found = told.select("seq", "g", "src").join(served, "src", "left").join(close, "seq", "left").join(theirs, "close", "left").join(looked, "seq", "left")
    hit = F.col("src").isNotNull()
    plus = lambda total, more: (F.coalesce(total, F.lit(0)) + F.when(hit, more).otherwise(0)).cast("long").alias(total)
    costs = plus("consulted", F.lit(1)), plus("judge_input", F.col("served_input_tokens")), plus("judge_output", F.col("served_output_tokens"))
    return found.select("seq", hit.alias("hit"), F.col("src").alias("served_from"), (~hit & F.coalesce(F.col("close_g") == F.col("g"), F.lit(False))).alias("judged"), *costs)
