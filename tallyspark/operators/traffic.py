"""Cost, counters, histograms and rates of request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark import scratch

# Dollars per million input and output tokens, and histogram bounds in seconds.
PRICES = {"small": (0.10, 0.50), "large": (2.00, 10.00), "judge": (1.00, 5.00)}
STAGE_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 20.0, 40.0, 80.0)
REQUEST_BOUNDS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 20.0, 40.0, 80.0)


def price(model: Column, kind: int) -> Column:
    found = F.lit(None).cast("double")
    for name, pair in PRICES.items():
        found = F.when(model == name, F.lit(pair[kind])).otherwise(found)
    return found


def cost(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    return (input_tokens * price(model, 0) + output_tokens * price(model, 1)) / 1e6


def billed(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """The cost to the millionth of a dollar, half to even: prices are in millionths a token."""
    return F.rint(input_tokens * price(model, 0) + output_tokens * price(model, 1)) / F.lit(1e6)


def micros(dollars: Column) -> Column:
    """Whole millionths: their sums don't depend on the order of rows."""
    return F.rint(dollars * 1e6).cast("long")


def dollars(amount: Column) -> Column:
    """The sum of dollar amounts, added up in whole millionths."""
    return F.sum(micros(amount)) / F.lit(1e6)


def savings(total: Column, base: Column) -> Column:
    """(savings_usd, savings_pct): the share is 0 without a baseline."""
    return F.struct(F.bround(base - total, 6).alias("savings_usd"), F.when(base == 0, F.lit(0.0)).otherwise(F.bround(1 - total / base, 4)).alias("savings_pct"))


def histogram(rows: DataFrame, labels: list[str], value: str, bounds: tuple[float, ...] = STAGE_BOUNDS) -> DataFrame:
    """(labels, le, n): cumulative counts up to each bound, the last being infinity, in one aggregation."""
    counts = rows.groupBy(*labels).agg(*(F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)), F.count(value).alias("_n"))
    pairs = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit(float("inf")).alias("le"), F.col("_n").alias("n")))
    return counts.select(*labels, F.inline(pairs))


def histogram_quantile(buckets: DataFrame, labels: list[str], q: float) -> DataFrame:
    """(labels, q): linear within the bucket that holds the rank; from 0 in the first, the last bound beyond it."""
    every = buckets.groupBy(*labels).agg(F.array_sort(F.collect_list(F.struct("le", "n"))).alias("b"))
    rank = F.lit(q) * F.element_at("b", -1).n
    at = every.withColumn("rank", rank).withColumn("i", F.expr("size(filter(b, x -> x.n < rank))")).where("element_at(b, -1).n > 0")
    low, high = F.expr("if(i = 0, 0D, b[i - 1].le)"), F.expr("b[i].le")
    below, inside = F.expr("if(i = 0, 0L, b[i - 1].n)"), F.expr("b[i].n - if(i = 0, 0L, b[i - 1].n)")
    found = F.when(F.expr("i >= size(b) - 1"), F.expr("b[size(b) - 2].le")).otherwise(low + (high - low) * (F.col("rank") - below) / inside)
    return at.select(*labels, found.alias("value"))


def nearest_rank(values: Column, p: float) -> Column:
    """The element at round(p / 100 * (n - 1)), half to even, of an array."""
    ordered = F.array_sort(values)
    at = F.least(F.size(values) - 1, F.rint(F.lit(p / 100) * (F.size(values) - 1)).cast("int"))
    return F.get(ordered, at)


def _meet(rows: DataFrame, told: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by keys in which null is a key like others, so that rows without a label aren't lost."""
    named = told.withColumnsRenamed({key: f"_of_{key}" for key in keys})
    same = [F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys]
    return rows.join(named, same, how).drop(*(f"_of_{key}" for key in keys))


def _counted(rows: DataFrame, labels: list[str], value: str) -> DataFrame:
    """(labels, value, upto, n): how many values of a label there are up to each one, and in all.

    Equal values are counted first; a label's distinct ones are then dealt to ranges, so a hot label is spread over
    tasks.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*labels, value).agg(F.count("*").alias("c"))
    summed = running_total(counted, labels, [value], F.col("c")).withColumnRenamed("total", "upto")
    return _meet(summed, summed.groupBy(*labels).agg(F.max("upto").alias("n")), labels)


def nearest_ranks(rows: DataFrame, labels: list[str], value: str, ps: tuple[float, ...]) -> DataFrame:
    """(labels, n, percentiles) by nearest rank, without collecting or sorting a label in one task."""
    ranked = _counted(rows, labels, value)
    picks = [F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.rint(F.lit(p / 100) * (F.col("n") - 1)).cast("long")), F.col(value))).alias(f"p{p:g}") for p in ps]
    return ranked.groupBy(*labels).agg(F.max("n").alias("n"), *picks)


def load_summary(rows: DataFrame, label: str, value: str, at: str, ok: str, ps: tuple[float, ...]) -> DataFrame:
    """(label, n, n_ok, wall, per_second, percentiles of ``value``) by label, and over all rows under the label ``all``.

    ``wall`` is the seconds between the first and the last row, ``per_second`` the sound rows (``ok``) by it: null where
    there is no such time. Rows without a value count as requests, but in no percentile. No rows give no label.
    """
    both = rows.withColumn(label, F.explode(F.array(F.col(label), F.lit("all"))))
    wall = (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / F.lit(1e6)
    sums = both.groupBy(label).agg(F.count("*").alias("n"), F.count_if(F.col(ok)).alias("n_ok"), wall.alias("wall"))
    sums = sums.withColumn("per_second", F.bround(F.col("n_ok") / F.nullif(F.col("wall"), F.lit(0.0)), 4))
    return _meet(sums, nearest_ranks(both, [label], value, ps).drop("n"), [label], "left")


def upper_median(rows: DataFrame, labels: list[str], value: str) -> DataFrame:
    """(labels, n, least, most, median): the element at position n // 2 of the sorted values."""
    ranked = _counted(rows, labels, value)
    return ranked.groupBy(*labels).agg(F.max("n").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col(value))).alias("median"))


def per_window(rows: DataFrame, ts: str, labels: list[str], length: str, slide: str | None = None) -> DataFrame:
    """(start, labels, n) in tumbling or sliding windows; the same on a stream with a watermark."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return rows.groupBy(window.alias("w"), *labels).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *labels, "n")


def _ranged(rows: DataFrame, order: list[str], parts: int) -> DataFrame:
    """Rows with ``_part``, the number of the range of ``order`` that they are in; ranges hold about as many rows each,
    whatever the values. Written, so that every reader sees the same ranges."""
    return scratch.stage(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def _parts(rows: DataFrame) -> int:
    return max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def places(rows: DataFrame, ident: str) -> DataFrame:
    """(ident, place): each distinct id that isn't null and its place among all of them, from 0.

    Ids are cut into ranges; a place is the id's number within its range and the ids of the ranges before it.
    """
    ids = rows.select(ident).where(F.col(ident).isNotNull()).distinct()
    ranged = ids.repartitionByRange(_parts(rows), ident).sortWithinPartitions(ident)
    # The low 33 bits count the rows of a partition.
    cut = scratch.stage(ranged.select(ident, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_row")), "places")
    before = cut.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    return cut.join(before, "_part").select(ident, (F.col("_row") + F.coalesce("_before", F.lit(0))).alias("place"))


def running_total(rows: DataFrame, labels: list[str], order: list[str], value: Column, parts: int | None = None) -> DataFrame:
    """Adds ``total``: the sum up to and including each row, per label.

    Rows are cut into ranges of their order columns, summed by label and range, and each range starts from the sum of
    those before: a hot label is spread over tasks.
    """
    cut = _ranged(rows.withColumn("_value", value), order, parts or _parts(rows))
    sums = cut.groupBy(*labels, "_part").agg(F.sum("_value").alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy(*labels).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_sum")
    inside = F.sum("_value").over(Window.partitionBy(*labels, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_inside", inside).transform(_meet, before, [*labels, "_part"]).withColumn("total", F.col("_inside") + F.coalesce("_before", F.lit(0))).drop("_part", "_value", "_inside", "_before")


def previous(rows: DataFrame, labels: list[str], order: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``: the value of the row before, per label; null for the first.

    Within ranges as in ``running_total``; a range's first row takes the last value of the ranges before it.
    """
    cut = _ranged(rows, order, parts or _parts(rows))
    last = cut.groupBy(*labels, "_part").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    earlier = last.withColumn("_earlier", F.lag("_last").over(Window.partitionBy(*labels).orderBy("_part"))).drop("_last")
    inside = F.lag(F.struct(value)).over(Window.partitionBy(*labels, "_part").orderBy(*order))
    found = _meet(cut.withColumn("_inside", inside), earlier, [*labels, "_part"])
    return found.withColumn("_inside", F.coalesce("_inside", "_earlier")).drop("_part", "_earlier").withColumn(name, F.col("_inside")[value]).drop("_inside")


def spend_cap(calls: DataFrame, labels: list[str], order: list[str], spend: str, cap: float) -> DataFrame:
    """Adds ``allowed``: a call is refused once what was spent before it has reached the cap."""
    summed = running_total(calls, labels, order, F.col(spend))
    return summed.withColumn("allowed", F.bround(F.col("total") - F.col(spend), 6) < cap).drop("total")


def with_shadow(requests: DataFrame, shadows: DataFrame, within: str = "20 minutes") -> DataFrame:
    """Adds measured, base and source: a baseline that a shadow run measured replaces the estimate.

    ``requests`` has (event_id, at, estimate), ``shadows`` (event_id, at, measured). Results that come later than
    ``within`` after their request don't count. The same on two streams with watermarks.
    """
    told = shadows.select(F.col("event_id").alias("_of"), F.col("at").alias("_came"), "measured")
    in_time = (F.col("_came") >= F.col("at")) & (F.col("_came") <= F.col("at") + F.expr(f"interval {within}"))
    found = requests.join(told, (F.col("event_id") == F.col("_of")) & in_time, "left").drop("_of", "_came")
    return found.withColumn("base", F.coalesce("measured", "estimate")).withColumn("source", F.when(F.col("measured").isNotNull(), "measured").otherwise("estimated"))


def single_flight(calls: DataFrame, key: list[str], order: str) -> DataFrame:
    """One call per key, the first; the others wait for its answer."""
    return calls.groupBy(*key).agg(F.min(order).alias("leader"), (F.count("*") - 1).alias("waiting"))


def ratio_to_base(totals: DataFrame, value: str, is_base: Column) -> DataFrame:
    """Adds ``vs_base``: the value over that of the base row."""
    base = totals.where(is_base).agg(F.max(value).alias("_base"))
    return totals.join(F.broadcast(base)).withColumn("vs_base", F.bround(F.col(value) / F.nullif(F.col("_base"), F.lit(0.0)), 4)).drop("_base")


def gauges(table: DataFrame, ident: str, fields: list[str]) -> DataFrame:
    """(ident, field, value): a row per field."""
    return table.unpivot([ident], [F.col(f).cast("double").alias(f) for f in fields], "field", "value")


def matching(labels: Column, pattern: str) -> Column:
    """Label patterns match whole values."""
    return labels.rlike(f"^(?:{pattern})$")


def counters(results: DataFrame) -> DataFrame:
    """(counter, tenant, label, other, value): all counter families of result records, in one pass.

    ``results`` has (tenant, layer, model, verdict, cost_micros, baseline_micros, input_tokens, output_tokens, rejections,
    failed_stage); rejections is an array of reasons. A batch or a stream in complete mode gives the same.
    """
    text = lambda name, label, value, other=None: F.struct(F.lit(name).alias("counter"), label.cast("string").alias("label"), F.coalesce(other, F.lit("")).cast("string").alias("other") if other is not None else F.lit("").alias("other"), value.cast("long").alias("value"))
    one = F.lit(1)
    fixed = F.array(
        text("requests", F.col("layer"), one, F.col("model")),
        text("cost", F.lit("spent"), F.col("cost_micros")),
        text("cost", F.lit("baseline"), F.col("baseline_micros")),
        text("overhead", F.lit("saved"), F.col("baseline_micros") - F.col("cost_micros")),
        text("tokens", F.lit("input"), F.col("input_tokens")),
        text("tokens", F.lit("output"), F.col("output_tokens")),
        F.when(F.col("verdict").isNotNull(), text("quality", F.col("verdict"), one, F.col("layer"))),
        F.when(F.col("failed_stage").isNotNull(), text("errors", F.col("failed_stage"), one)),
    )
    rejected = F.transform(F.coalesce("rejections", F.array().cast("array<string>")), lambda r: text("rejects", r, F.lit(1)))
    each = results.select("tenant", F.explode(F.concat(F.array_compact(fixed), rejected)).alias("c"))
    return each.groupBy("tenant", F.col("c.counter").alias("counter"), F.col("c.label").alias("label"), F.col("c.other").alias("other")).agg(F.sum("c.value").alias("value"))


def preserved(verdicts: DataFrame) -> DataFrame:
    """(tenant, preserved): the share of judged answers that are equivalent or better."""
    kept = matching(F.col("verdict"), "equivalent|better")
    return verdicts.where("verdict is not null").groupBy("tenant").agg(F.bround(F.count_if(kept) / F.count("*"), 4).alias("preserved"))
