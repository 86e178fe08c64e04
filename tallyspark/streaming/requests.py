"""The request stream: a cache in keyed state with expiry, and metrics over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyspark.operators import traffic
from tallyspark.operators.cache import TTL_SECONDS

CACHE_OUTPUT = "tenant string, key string, event_id long, hit boolean, served_from long"


class CacheState(StatefulProcessor):
    """One key's exact cache entry of a tenant: it lives a set time from its write, by event time, and reads don't refresh
    it. Keys of a tenant are apart, so a busy tenant is spread over tasks.

    Rows wait, in the order of event time, until the watermark has passed them: no earlier one can come any more, so each
    is answered as if all had arrived in order. A timer at the earliest waiting row, or else at the entry's end, wakes the
    key; then due rows are answered and an entry that has outlived its time is deleted.
    """

    def __init__(self, ttl_seconds: int = TTL_SECONDS):
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "event_id long, written long")
        self.waiting = handle.getListState("waiting", "at long, event_id long")
        self.alarm = handle.getValueState("alarm", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            moments = frame["at"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
            self.waiting.appendList(list(zip(moments, frame["event_id"].tolist(), strict=True)))
            self._wake_at(min(moments))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.alarm.clear()
        held = tuple(self.entry.get()) if self.entry.exists() else None
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in rows if r[0] <= passed]
        out = []
        for at, event_id in due:
            hit = held is not None and 0 <= at - held[1] < self.ttl
            if not hit:
                held = (event_id, at)
            out.append((*key, event_id, hit, held[0] if hit else None))
        left = rows[len(due) :]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        if held is not None and (left or passed - held[1] < self.ttl):
            self.entry.update(held)
            self._wake_at(left[0][0] if left else held[1] + self.ttl)
        else:
            self.entry.clear()
            if left:
                self._wake_at(left[0][0])
        yield pd.DataFrame(out, columns=["tenant", "key", "event_id", "hit", "served_from"]).astype({"served_from": "Int64"})

    def _wake_at(self, at: int) -> None:
        """A timer at the first whole millisecond from ``at`` on, unless one is set for then or before."""
        millis = -(-at // 1000)
        now = self.alarm.get()[0] if self.alarm.exists() else None
        if now is None or millis < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(millis)
            self.alarm.update((millis,))

    def close(self) -> None:
        pass


def cached(requests: DataFrame, ttl_seconds: int = TTL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """A stream (tenant, key, event_id, at) with the cache's answer to each row; needs the RocksDB state store.

    A row is answered once the watermark has passed it; rows later than ``late`` are dropped. Output is in append mode.
    """
    rows = requests.select("tenant", "key", "event_id", "at").withWatermark("at", late)
    return rows.groupBy("tenant", "key").transformWithStateInPandas(CacheState(ttl_seconds), outputStructType=CACHE_OUTPUT, outputMode="Append", timeMode="EventTime")


def rates(requests: DataFrame, late: str = "10 minutes", length: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Requests per layer and window; rows later than the watermark are dropped."""
    return traffic.per_window(requests.withWatermark("at", late), "at", ["layer"], length, slide)


def counters(requests: DataFrame) -> DataFrame:
    """Totals per tenant, layer and model since the stream began, for complete or update mode."""
    return requests.groupBy("tenant", "layer", "model").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))


def latency_buckets(requests: DataFrame, late: str = "10 minutes", length: str = "5 minutes") -> DataFrame:
    """Cumulative bucket counts per layer and window."""
    rows = requests.withWatermark("at", late)
    counts = [F.count_if(F.col("seconds") <= b).alias(f"le_{b:g}".replace(".", "_")) for b in traffic.REQUEST_BOUNDS]
    return rows.groupBy(F.window("at", length).alias("w"), "layer").agg(*counts, F.count("seconds").alias("le_inf")).select(F.col("w.start").alias("start"), "layer", *[f"le_{b:g}".replace(".", "_") for b in traffic.REQUEST_BOUNDS], "le_inf")


def sessions(requests: DataFrame, late: str = "10 minutes", gap: str = "5 minutes") -> DataFrame:
    """Bursts of a tenant's requests with no pause longer than ``gap``."""
    rows = requests.withWatermark("at", late)
    return rows.groupBy(F.session_window("at", gap).alias("w"), "tenant").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "tenant", "n")


def shadowed(requests: DataFrame, shadows: DataFrame, within: str = "20 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests with what shadow runs measured, as results arrive: a request without one is given out, estimated, once the
    watermarks have passed the time in which one may come."""
    return traffic.with_shadow(requests.withWatermark("at", late), shadows.withWatermark("at", late), within)


def first_of_each(requests: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    """Single flight on a stream: of identical calls within the watermark only one goes on to the model."""
    return requests.withWatermark("at", late).dropDuplicatesWithinWatermark(key)
