"""Samples that are functions of a seed and a key, so that any task draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import traffic


def keyed(*parts: Column) -> Column:
    """A number below 2**48 for a list of values."""
    return F.conv(F.left(F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256), F.lit(12)), 16, 10).cast("long")


def prime_from(n: int) -> int:
    """The least prime of n or more."""
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def bundles(rows: DataFrame, ident: str, required: str, pool: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """(id, bundle): for each row its required keys and as many others of ``pool`` as fill ``size`` places, shuffled.

    Others are drawn without repeats: a row walks the places of the pool in steps of its own, modulo a prime, which meet
    each place once. So no row meets the pool, and a draw is a lookup of a few places. ``required`` is an array of keys,
    of which those that the pool doesn't have are left out; a pool of fewer keys than places is taken whole.
    """
    places = traffic.places(pool, key).select(F.col(key).alias("key"), "place")
    n = max(1, places.count())
    prime = prime_from(n)
    needs = rows.select(F.col(ident).alias("id"), F.explode_outer(F.array_distinct(required)).alias("key")).join(places, "key", "left")
    needs = needs.groupBy("id").agg(F.collect_set("place").alias("needed"))
    step = 1 + F.pmod(keyed(F.lit(seed), F.lit("step"), F.col("id")), F.lit(prime - 1))
    start = F.pmod(keyed(F.lit(seed), F.lit("start"), F.col("id")), F.lit(prime))
    # So many steps hold enough places, whatever is skipped: numbers past the pool's end and required ones.
    walk = F.transform(F.sequence(F.lit(0), F.least(F.lit(prime - 1), F.lit(size + prime - n) + F.size("needed"))), lambda k: (F.col("start") + F.col("step") * k) % prime)
    drawn = needs.withColumn("step", step).withColumn("start", start).withColumn("walk", walk)
    fill = F.slice(F.filter("walk", lambda p: (p < n) & ~F.array_contains("needed", p)), 1, F.greatest(F.lit(0), F.lit(size) - F.size("needed")))
    chosen = drawn.select("id", F.explode(F.concat("needed", fill)).alias("place")).join(places, "place")
    mixed = F.array_sort(F.collect_list(F.struct(keyed(F.lit(seed), F.lit("order"), F.col("id"), F.col("key")).alias("h"), "key")))
    return chosen.groupBy("id").agg(mixed.alias("m")).select("id", F.col("m.key").alias("bundle"))
