"""Exact and semantic caches over ordered request tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType, TimestampType

from tallyspark import scratch
from tallyspark.operators import traffic

#: A guard compares the signs (``text.guard_signs``) of a new query with those of a cached one; the first that fails names
#: the reason.
Guard = tuple[str, Callable[[Column, Column], Column]]
GUARDS: list[Guard] = [("numbers", lambda a, b: a["numbers"] == b["numbers"]), ("negation", lambda a, b: a["negations"] == b["negations"])]

TTL_SECONDS = 604_800
KNN, THRESHOLD = 5, 0.90
#: Rows of a replay that one task decides in order.
SWEEP_ROWS = 2048


def cache_key(query: Column, case: Column, doc_hashes: Column) -> Column:
    """Equal for equal query, case (null counts as empty) and multiset of documents, whatever their order."""
    return F.sha2(F.to_json(F.struct(F.coalesce(case, F.lit("")).alias("case"), F.array_sort(doc_hashes).alias("docs"), query.alias("query"))), 256)


def context_hashes(doc_hashes: Column, case: Column) -> Column:
    """The set of what an answer depends on."""
    return F.array_sort(F.array_union(doc_hashes, F.array(F.concat(F.lit("case:"), F.coalesce(F.sha2(case, 256), F.lit("none"))))))


def context_covers(depends_on: Column, context: Column) -> Column:
    return F.size(F.array_except(depends_on, context)) == 0


def exact_replay(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Adds hit and served_from: the first row with a key fills the entry that later ones are served from.

    A hit never writes, so the fold is a minimum per key: the first row is aggregated and joined back, which a hot
    key survives where a window over it would not.
    """
    first = rows.groupBy(key).agg(F.min(seq).alias("served_from"))
    found = rows.join(first, key).withColumn("hit", F.col(seq) > F.col("served_from"))
    return found.withColumn("served_from", F.when(F.col("hit"), F.col("served_from")))


def exact_outcome(hit: Column, expected: Column, served_from: Column, expected_source: Column) -> Column:
    return (
        F.when(hit & expected & (served_from == expected_source), "true_hit")
        .when(hit & expected, "wrong_source")
        .when(hit, "false_hit")
        .when(expected, "missed_hit")
        .otherwise("true_miss")
    )


def semantic_outcome(hit: Column, same_answer: Column, expected: Column) -> Column:
    return F.when(hit & same_answer, "correct_hit").when(hit, "wrong_hit").when(expected, "missed_hit").otherwise("true_miss")


def reject_reason(new: Column, cached: Column, covered: Column, guards: Sequence[Guard] = GUARDS) -> Column:
    """Null where a candidate passes; else the first failing check's name."""
    found = F.when(~covered, "context_mismatch")
    for name, passes in guards:
        found = found.when(~passes(new, cached), f"{name}_mismatch")
    return found


#: Candidates of a row as a task judges them: whether each is an entry (None: not known), passes, its id and its cosine.
Seen = list[tuple[bool | None, bool, int, float]]
#: What is found: hit, served_from, cosine; None where too little is known.
Judge = Callable[[Seen], tuple[bool, int | None, float | None] | None]
_DECIDED = pa.schema([("seq", pa.int64()), ("hit", pa.bool_()), ("served_from", pa.int64()), ("cosine", pa.float64())])


def _swept(judge: Judge) -> Callable[[pa.Table], pa.Table]:
    """Goes through the open rows of a block in order; what it decides is known to the rows after it."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("dst", "ascending"), ("r", "ascending")])
        told, found = {}, []
        rows = zip(*(block[c].to_pylist() for c in ("dst", "entry", "passes", "src", "cos")), strict=True)
        for dst, mine in groupby(rows, key=itemgetter(0)):
            answer = judge([(told.get(src) if entry is None else entry, passes, src, cos) for _, entry, passes, src, cos in mine])
            if answer:
                told[dst] = not answer[0]
                found.append((dst, *answer))
        return pa.table([pa.array([f[k] for f in found], t) for k, t in enumerate(_DECIDED.types)], schema=_DECIDED)

    return run


def _in_order(rows: DataFrame, candidates: DataFrame, judge: Judge, outside: Callable[[DataFrame], DataFrame], block: int) -> DataFrame:
    """(seq, hit, served_from, cosine) of rows (seq), in order, whose candidates (src, dst, r, cos, passes) are rows before them.

    Rows are cut into blocks in their order. In each round a task goes through the open rows of a block and decides those
    of which it knows enough, from rounds before or from the rows just before them. The first block that is open gets
    decided whole, so there are no more rounds than blocks, however long a chain of rows that depend on each other is.
    A task holds the candidates within its block, at most block squared, and what ``outside`` leaves of a row's others.
    """
    home = scratch.stage(traffic.places(rows, "seq").select("seq", F.floor(F.col("place") / block).alias("block")), "replay-blocks")
    sided = candidates.join(home.select(F.col("seq").alias("dst"), "block"), "dst").join(home.select(F.col("seq").alias("src"), F.col("block").alias("from")), "src")
    open_ = scratch.stage(sided.select("src", "dst", "r", "cos", "passes", "block", (F.col("block") == F.col("from")).alias("inside"), F.lit(None).cast("boolean").alias("entry")), "replay-open")
    alone = rows.select("seq").join(open_.select(F.col("dst").alias("seq")), "seq", "left_anti")
    fresh = scratch.stage(alone.select("seq", F.lit(False).alias("hit"), F.lit(None).cast("long").alias("served_from"), F.lit(None).cast("double").alias("cosine")), "replay-decided")
    decided, spent = fresh, [open_, home]
    while open_.limit(1).count():
        now = open_.join(fresh.select(F.col("seq").alias("src"), (~F.col("hit")).alias("now")), "src", "left")
        known = scratch.stage(now.withColumn("entry", F.coalesce("entry", "now")).drop("now"), "replay-known")
        scratch.drop(*spent)
        shown = known.where("inside").drop("inside").unionByName(outside(known.where("not inside").drop("inside")))
        fresh = scratch.stage(shown.groupBy("block").applyInArrow(_swept(judge), "seq long, hit boolean, served_from long, cosine double"), "replay-decided")
        decided = decided.union(fresh)
        open_, spent = known.join(fresh.select(F.col("seq").alias("dst")), "dst", "left_anti"), [known]
    scratch.drop(*spent)
    return decided


def _any_entry(seen: Seen) -> tuple[bool, None, None] | None:
    states = [entry for entry, *_ in seen]
    if any(states):
        return True, None, None
    return None if None in states else (False, None, None)


def _summed(others: DataFrame) -> DataFrame:
    """One row that stands for all: an entry if one is, not known if one isn't."""
    entry = F.when(F.bool_or("entry"), True).when(F.count_if(F.col("entry").isNull()) == 0, False)
    return others.groupBy("block", "dst").agg(F.min("src").alias("src"), F.min("r").alias("r"), F.min("cos").alias("cos"), F.bool_or("passes").alias("passes"), entry.alias("entry"))


def greedy_replay(rows: DataFrame, edges: DataFrame, seq: str = "seq", block: int = SWEEP_ROWS) -> DataFrame:
    """(seq, hit): a row is a hit iff an earlier row that became an entry, a miss, would be served to it.

    ``edges`` holds (src, dst), src < dst. Misses are the first maximal independent set in row order.
    """
    named = edges.select("src", "dst", F.col("src").alias("r"), F.lit(0.0).alias("cos"), F.lit(True).alias("passes"))
    return _in_order(rows.select(F.col(seq).alias("seq")), named, _any_entry, _summed, block).select(F.col("seq").alias(seq), "hit")


def semantic_replay(rows: DataFrame, candidates: DataFrame, firsts: DataFrame | None = None) -> DataFrame:
    """(seq, hit, served_from, cosine, miss_reason) for rows (seq) and candidates (src, dst, cos, reason).

    ``candidates`` are earlier rows within the threshold; ``reason`` is null where all checks pass. A hit is served by
    the closest passing entry, a miss reports the closest entry's reason, or low_cosine; ties go to the earlier row.
    ``firsts`` (seq) are rows that meet an empty cache, the first one if it isn't given.
    """
    candidates = scratch.stage(candidates.select("src", "dst", "cos", "reason"), "replay-candidates")
    done = scratch.stage(greedy_replay(rows, candidates.where("reason is null")), "replay-done")
    entries = done.where("not hit").select(F.col("seq").alias("src"))
    near = candidates.join(entries, "src").groupBy("dst").agg(
        F.max(F.when(F.col("reason").isNull(), F.struct("cos", (-F.col("src")).alias("minus")))).alias("best"),
        F.max(F.struct("cos", (-F.col("src")).alias("minus"), "reason")).alias("close"),
    )
    found = done.join(near.withColumnRenamed("dst", "seq"), "seq", "left")
    firsts = rows.agg(F.min("seq").alias("seq")) if firsts is None else firsts
    return found.join(firsts.select("seq", F.lit(True).alias("first")), "seq", "left").select(
        "seq",
        "hit",
        F.when(F.col("hit"), -F.col("best.minus")).alias("served_from"),
        F.when(F.col("hit"), F.col("best.cos")).otherwise(F.col("close.cos")).alias("cosine"),
        F.when(~F.col("hit"), F.when(F.col("first"), "empty").otherwise(F.coalesce("close.reason", F.lit("low_cosine")))).alias("miss_reason"),
    )


def replay_grid(rows: DataFrame, candidates: DataFrame, modes: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """(mode, threshold, seq, hit, served_from, cosine, miss_reason): ``semantic_replay`` under each mode and threshold.

    ``candidates`` has (src, dst, cos) within the least threshold and a reason column for each mode. Pairs are scored
    once; those within a threshold are within all lower ones. All replays run together, each over numbers of its own.
    """
    places = scratch.stage(traffic.places(rows, "seq"), "grid-places")
    n = max(1, places.count())
    numbers = F.array(*(F.struct(F.lit(i).alias("config"), F.lit(m).alias("mode"), F.lit(t).alias("threshold")) for i, (m, t) in enumerate((m, t) for m in modes for t in thresholds)))
    each = places.select("seq", "place", F.inline(numbers)).withColumn("number", F.col("config") * F.lit(n) + F.col("place"))
    placed = candidates.join(places.toDF("src", "p"), "src").join(places.toDF("dst", "q"), "dst")
    reasons = F.array(*(F.struct(F.lit(k).alias("k"), F.col(m).alias("reason")) for k, m in enumerate(modes)))
    within = F.filter(F.sequence(F.lit(0), F.lit(len(thresholds) - 1)), lambda i: F.col("cos") >= F.array(*map(F.lit, thresholds))[i])
    told = placed.select("p", "q", "cos", F.inline(reasons), within.alias("within")).select("p", "q", "cos", "reason", "k", F.explode("within").alias("i")).withColumn("config", F.col("k") * len(thresholds) + F.col("i"))
    told = told.select((F.col("config") * F.lit(n) + F.col("p")).alias("src"), (F.col("config") * F.lit(n) + F.col("q")).alias("dst"), "cos", "reason")
    found = semantic_replay(each.select(F.col("number").alias("seq")), told, each.where("place = 0").select(F.col("number").alias("seq")))
    named = found.withColumnRenamed("seq", "number").withColumn("source", F.pmod("served_from", F.lit(n))).drop("served_from")
    return each.join(named, "number").join(places.toDF("served_from", "source"), "source", "left").select("mode", "threshold", "seq", "hit", "served_from", "cosine", "miss_reason")


def sweep_summary(told: DataFrame, by: Sequence[str], variants: Sequence[str], reasons: Sequence[str]) -> DataFrame:
    """Per ``by``: how rows were served, and which traps and paraphrases were not.

    ``told`` has (layer, expected_cache, outcome, variant, miss_reason, tokens); tokens count as saved by correct hits.
    """
    expected = lambda kind: F.col("expected_cache") == kind
    outcome = lambda kind: F.col("outcome") == kind
    stopped = lambda kind, name: [F.count_if(expected(kind) & (F.col("miss_reason") == r)).alias(f"{name}_{r}") for r in reasons]
    caught, saved = F.count_if(expected("semantic_hit") & outcome("correct_hit")), F.sum(F.when(outcome("correct_hit"), F.col("tokens")).otherwise(0))
    return told.groupBy(*by).agg(
        F.count("*").alias("queries"),
        F.count_if(F.col("layer") == "exact").alias("exact_hits"),
        F.count_if(F.col("layer") == "semantic").alias("semantic_hits"),
        caught.alias("paraphrases_caught"),
        F.count_if(expected("semantic_hit")).alias("paraphrases_total"),
        F.bround(caught / F.nullif(F.count_if(expected("semantic_hit")), F.lit(0)), 4).alias("paraphrase_recall"),
        F.count_if(outcome("wrong_hit")).alias("wrong_hits"),
        F.count_if(outcome("wrong_hit") & expected("miss")).alias("wrong_hits_on_traps"),
        F.count_if(expected("miss")).alias("traps_total"),
        F.count_if(outcome("wrong_hit") & expected("cold")).alias("wrong_hits_on_cold"),
        *(F.count_if(outcome("wrong_hit") & (F.col("variant") == v)).alias(f"wrong_{v}") for v in variants),
        *stopped("miss", "traps_stopped_by"),
        *stopped("semantic_hit", "paraphrases_blocked_by"),
        F.count_if(outcome("missed_hit")).alias("missed_hits"),
        saved.alias("tokens_saved"),
        F.bround(saved / F.nullif(F.sum("tokens"), F.lit(0)), 4).alias("tokens_saved_pct"),
    )


def consulted(candidates: DataFrame, replayed: DataFrame) -> DataFrame:
    """The candidates (src, dst, cos, passes) that a lazy last check looks at: a row's entries, nearest first, up to and
    with the first that passes."""
    entries = replayed.where("not hit").select(F.col("seq").alias("src"))
    order = Window.partitionBy("dst").orderBy(F.desc("cos"), "src")
    seen = candidates.join(entries, "src").withColumn("before", F.count_if("passes").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return seen.where(F.coalesce("before", F.lit(0)) == 0).drop("before")


def ttl_replay(rows: DataFrame, key: list[str], ts: str, order: str, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Adds hit and written_at: an entry lives ttl_seconds from its write, and reads don't refresh it.

    A pause of ttl_seconds ends a run of rows: runs of a key don't depend on each other and go to different tasks. In a
    run a task leaps from write to write; it holds one entry, whatever the run's length.
    """
    told = traffic.previous(rows, key, [ts, order], ts, "_prior")
    pause = F.col("_prior").isNull() | (F.col(ts).cast("double") - F.col("_prior").cast("double") >= ttl_seconds)
    runs = traffic.running_total(told, key, [ts, order], F.when(pause, 1).otherwise(0)).withColumnRenamed("total", "_run").drop("_prior")
    schema = StructType([*rows.schema, StructField("hit", BooleanType()), StructField("written_at", TimestampType())])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, written = None, None
        for frame in frames:
            at = frame[ts].to_numpy()
            names = list(zip(*(frame[c] for c in (*key, "_run")), strict=True))
            hits, writes = np.ones(len(frame), dtype=bool), np.empty(len(frame), dtype=at.dtype)
            begins = [i for i, name in enumerate(names) if i == 0 or name != names[i - 1]]
            for begin, end in zip(begins, [*begins[1:], len(names)], strict=True):
                if names[begin] != now:
                    now, written = names[begin], None
                i = begin
                while i < end:
                    if written is None or at[i] - written >= np.timedelta64(ttl_seconds, "s"):
                        written, hits[i] = at[i], False
                    following = i + max(1, int(np.searchsorted(at[i:end], written + np.timedelta64(ttl_seconds, "s"))))
                    writes[i:following] = written
                    i = following
            yield frame.drop(columns="_run").assign(hit=hits, written_at=pd.Series(writes, index=frame.index))

    return runs.repartition(*key, "_run").sortWithinPartitions(*key, "_run", ts, order).select(*rows.columns, "_run").mapInPandas(fold, schema)


def live_replay(requests: DataFrame, threshold: float = THRESHOLD, k: int = KNN) -> DataFrame:
    """(seq, tenant, hit, served_from, cosine) of requests (tenant, seq, vec, numbers, negations) in order.

    The k nearest entries of the tenant are taken before the checks, so a passing entry beyond them stays unreachable.
    A hit reports its entry's cosine, a miss the nearest entry's, or null if none is within the threshold.
    """
    # Imported here: it shares kernels with the replays by signs, which import this module.
    from tallyspark.operators import live

    # Ranges are sampled first: without this table all texts would be searched twice.
    order = scratch.stage(requests, "live-asked").repartitionByRange("tenant", "seq").sortWithinPartitions("tenant", "seq")
    rows = scratch.stage(order.withColumn("no", F.monotonically_increasing_id()), "live-requests")
    # Sizes keep arrays apart, whose elements are hashed in a row.
    sign = F.xxhash64(*(x for c in ("numbers", "negations") for x in (F.coalesce(F.size(c), F.lit(-1)), F.col(c))))
    found = live.replay(rows.select(F.xxhash64(F.isnull("tenant"), "tenant").alias("g"), "no", F.col("vec").alias("v"), sign.alias("sign")), threshold, k)
    names = rows.select(F.col("no").alias("served_from"), F.col("seq").alias("source"))
    named = found.join(rows.select("no", "seq", "tenant"), "no").join(names, "served_from", "left")
    return named.select("seq", "tenant", "hit", F.col("source").alias("served_from"), "cosine")


def _nearest(k: int) -> Judge:
    def judge(seen: Seen) -> tuple[bool, int | None, float | None] | None:
        n, near = 0, None
        for entry, passes, src, cos in seen:
            if entry is None:
                return None
            if entry:
                near = cos if not n else near
                n += 1
                if passes:
                    return True, src, cos
                if n == k:
                    break
        return False, None, near

    return judge


def _foremost(k: int) -> Callable[[DataFrame], DataFrame]:
    """Of each row's candidates the first k entries, up to the first of which nothing is known."""

    def run(others: DataFrame) -> DataFrame:
        before = Window.partitionBy("dst").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
        counted = others.withColumn("unknown", F.count_if(F.col("entry").isNull()).over(before)).withColumn("entries", F.count_if("entry").over(before))
        # A row's nearest candidate stays even if it is no entry, so that a row without any other is judged, too.
        told = F.col("entry").isNull() | F.col("entry") | (F.col("r") == 1)
        return counted.where((F.coalesce("unknown", F.lit(0)) == 0) & (F.coalesce("entries", F.lit(0)) < k) & told).drop("unknown", "entries")

    return run


def nearest_replay(rows: DataFrame, candidates: DataFrame, k: int = KNN, block: int = SWEEP_ROWS) -> DataFrame:
    """(seq, hit, served_from, cosine) for rows (seq) and candidates (src, dst, cos, passes), src an earlier row within
    the threshold of dst: each row sees its k nearest entries of the moment, ties to the earlier one.

    Which rows are entries depends on all before: rows are decided block by block, as in ``greedy_replay``.
    """
    ranked = candidates.withColumn("r", F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("cos"), "src")))
    return _in_order(rows.select("seq"), ranked.select("src", "dst", "r", "cos", "passes"), _nearest(k), _foremost(k), block)


def latest_per_key(writes: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """An upsert: the last write of each key."""
    others = [c for c in writes.columns if c not in keys]
    last = writes.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("last"))
    return last.select(*keys, "last.*")


def entry_counts(entries: DataFrame, tenant: str | None = None) -> DataFrame:
    """How many entries of each kind there are, of one tenant or all."""
    rows = entries if tenant is None else entries.where(F.col("tenant") == tenant)
    return rows.groupBy("kind").count()


def clear(entries: DataFrame, tenant: str | None = None) -> tuple[DataFrame, int]:
    """What is left when a tenant's entries (or all) are deleted, and how many go."""
    gone = F.lit(True) if tenant is None else F.col("tenant").eqNullSafe(tenant)
    return entries.where(~gone), entries.where(gone).count()


def recent(requests: DataFrame, order: list[Column], n: int = 200) -> DataFrame:
    """The ring buffer: the last n requests, newest first."""
    return requests.orderBy(*order).limit(n)
