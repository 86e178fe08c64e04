"""Queries over the request log: counters, costs, histograms, rates, caps and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import cache, models, traffic
from tallyspark.plans.tables import SQL_EVENTS, events, table

PERCENTILES = (50.0, 95.0, 99.0)


def request_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("tenant", "layer", "model").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as result records: errors fail their stage, purchases are judged, clicks were turned down by guards."""
    rows, layer = _costs(spark, sf_dir), F.col("layer")
    grade = lambda k: F.element_at(F.array(*map(F.lit, ("wrong", "partial", "correct"))), (F.pmod(k, F.lit(3)) + 1).cast("int"))
    return rows.select(
        "event_id",
        "tenant",
        "layer",
        "model",
        F.when(layer == "purchase", models.quality_verdict(grade(F.col("event_id")), grade(F.col("user_id")))).alias("verdict"),
        traffic.micros(F.col("cost")).alias("cost_micros"),
        traffic.micros(F.col("base")).alias("baseline_micros"),
        F.coalesce("tokens", F.lit(0)).alias("input_tokens"),
        F.lit(120).alias("output_tokens"),
        F.when(layer == "click", F.when(F.col("user_id") % 2 == 0, F.array(F.lit("numbers_mismatch"))).otherwise(F.array(F.lit("low_cosine"), F.lit("numbers_mismatch")))).alias("rejections"),
        F.when(layer == "error", F.when(F.col("user_id") % 3 == 0, "window").otherwise("answer")).alias("failed_stage"),
    )


def counter_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.counters(_records(spark, sf_dir))


def quality_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.preserved(_records(spark, sf_dir))


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of each request by its model, and of the large model with twice the tokens as a baseline."""
    rows = events(spark, sf_dir)
    used = traffic.billed(F.col("model"), F.col("tokens"), F.lit(120))
    return rows.withColumn("cost", used).withColumn("base", traffic.billed(F.lit("large"), F.col("tokens") * 2, F.lit(120)))


def cost_by_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _costs(spark, sf_dir).groupBy("tenant").agg(F.count("*").alias("n"), traffic.dollars(F.col("cost")).alias("cost"), traffic.dollars(F.col("base")).alias("base"))
    return sums.select("tenant", "n", "cost", "base", traffic.savings(F.col("cost"), F.col("base"))["savings_pct"].alias("savings_pct"))


def savings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs per layer and model, per layer, and in all."""
    rows = _costs(spark, sf_dir)
    return rows.rollup("layer", "model").agg(F.count("*").alias("n"), traffic.dollars(F.col("cost")).alias("cost")).select(F.coalesce("layer", F.lit("all")).alias("layer"), F.coalesce("model", F.lit("all")).alias("model"), "n", "cost")


def layers_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _costs(spark, sf_dir).groupBy("layer").agg(F.count("*").alias("n"), (F.sum(traffic.micros(F.col("cost"))) / (F.count("*") * F.lit(1000.0))).alias("per_1k"), F.bround(F.avg("tokens"), 2).alias("mean_tokens"))
    return traffic.ratio_to_base(sums, "per_1k", F.col("layer") == "purchase")


def cache_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares by fully anchored label patterns, per tenant pattern."""
    rows = events(spark, sf_dir).where(traffic.matching(F.col("tenant"), "t[0-4]"))
    return rows.groupBy("tenant").agg(F.bround(F.count_if(traffic.matching(F.col("layer"), "view|sign.*")) / F.count("*"), 4).alias("cached"), F.bround(F.count_if(traffic.matching(F.col("layer"), "err")) / F.count("*"), 4).alias("unmatched"))


def stage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.histogram(events(spark, sf_dir), ["layer"], "seconds").where("le < 1e300")


def histogram_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and 95th percentiles per layer over sliding windows of ten minutes, from cumulative buckets."""
    rows = events(spark, sf_dir).select("layer", "seconds", F.window("at", "10 minutes", "5 minutes").alias("w")).select("layer", "seconds", F.unix_timestamp("w.start").alias("start"))
    buckets = traffic.histogram(rows, ["layer", "start"], "seconds", traffic.REQUEST_BOUNDS)
    found = [traffic.histogram_quantile(buckets, ["layer", "start"], q).select("layer", "start", F.lit(q).alias("q"), F.bround("value", 6).alias("value")) for q in (0.5, 0.95)]
    return found[0].union(found[1])


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.nearest_ranks(events(spark, sf_dir), ["layer"], "seconds", PERCENTILES)


def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies and throughput by layer and over all: an error takes its time, but isn't served."""
    rows = events(spark, sf_dir).withColumn("served", F.col("layer") != "error")
    return traffic.load_summary(rows, "layer", "seconds", "at", "served", PERCENTILES)


def requests_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = traffic.per_window(events(spark, sf_dir), "at", ["layer"], "1 minute")
    return found.select(F.unix_timestamp("start").alias("start"), "layer", "n")


def sliding_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = traffic.per_window(events(spark, sf_dir), "at", ["tenant"], "15 minutes", "5 minutes")
    return found.select(F.unix_timestamp("start").alias("start"), "tenant", "n")


def cumulative_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.running_total(events(spark, sf_dir), ["tenant"], ["at", "event_id"], F.col("tokens")).select("event_id", "tenant", "total")


def spend_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _costs(spark, sf_dir).withColumn("micro", F.rint(F.col("cost") * 1e6).cast("long"))
    return traffic.spend_cap(rows, ["tenant"], ["at", "event_id"], "micro", 400_000).select("event_id", "allowed")


def last_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest request of each tenant as gauges, -1 where its layer has no router."""
    rows = events(spark, sf_dir).groupBy("tenant").agg(F.max_by(F.struct("event_id", "layer", "tokens", "seconds"), F.struct("at", "event_id")).alias("r"))
    told = rows.select("tenant", F.col("r.tokens").alias("tokens"), F.col("r.seconds").alias("seconds"), F.when(F.col("r.layer") == "view", -1).otherwise(1).alias("routed"))
    return traffic.gauges(told, "tenant", ["tokens", "seconds", "routed"])


def recent_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.recent(events(spark, sf_dir), [F.desc("at"), F.desc("event_id")]).select("event_id", "tenant", "layer", "tokens")


def single_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.single_flight(events(spark, sf_dir), ["user_id", "layer", "props"], "event_id")


def tenant_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.when(F.col("c_custkey") % 9 == 0, "").otherwise(F.concat("c_mktsegment", F.lit(" & Co. "), "c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.tenant_slug(names).alias("tenant"))


def tenant_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("tenant").distinct()


def stage_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request's stages as spans: what its map of timings explodes to."""
    rows = events(spark, sf_dir).where("seconds is not null")
    timings = F.create_map(F.lit("lookup"), F.col("seconds") * 0.25, F.lit("answer"), F.col("seconds") * 0.75)
    return rows.select("event_id", F.explode(timings).alias("stage", "took")).select("event_id", "stage", F.bround("took", 6).alias("took"))


def parsed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts read out of free text around JSON; what doesn't parse or isn't allowed is ``unparsed``."""
    k = F.get_json_object("props", "$.k").cast("int")
    reply = F.when(k % 4 == 0, F.lit('Sure. {"verdict": "equivalent"} Done')).when(k % 4 == 1, F.lit('{"verdict": "great"}')).when(k % 4 == 2, F.lit('{"verdict": "worse", "n": 1}')).otherwise("no json")
    rows = events(spark, sf_dir).select("tenant", text.verdict_of(reply, ["equivalent", "better", "worse"]).alias("verdict"))
    return rows.groupBy("tenant", "verdict").agg(F.count("*").alias("n"))


def value_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.upper_median(table(spark, sf_dir, "documents"), ["lang"], "n_chars")


def shadow_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measured baseline, where a shadow run gave one, replaces the estimate."""
    rows = _costs(spark, sf_dir)
    shadow = rows.where("event_id % 4 = 0").select("event_id", (F.rint(traffic.micros(F.col("base")) * F.lit(0.9)) / F.lit(1e6)).alias("measured"))
    told = rows.join(shadow, "event_id", "left").withColumn("source", F.when(F.col("measured").isNotNull(), "measured").otherwise("estimated"))
    return told.groupBy("source").agg(F.count("*").alias("n"), traffic.dollars(F.coalesce("measured", "base")).alias("base"), traffic.dollars(F.col("cost")).alias("cost"))


def trace_vs_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live layers against those that an offline run gave the same requests; others have none."""
    rows = events(spark, sf_dir)
    offline = rows.where("event_id % 10 <> 0").select("event_id", F.when(F.col("event_id") % 7 == 0, "view").otherwise(F.col("layer")).alias("offline"))
    told = rows.join(offline, "event_id", "left")
    return told.groupBy("layer").agg(F.count("*").alias("n"), F.count("offline").alias("compared"), F.count_if(F.col("layer") == F.col("offline")).alias("matches"))


QUERIES = {
    f.__name__: f
    for f in (request_counters, counter_families, quality_preserved, cost_by_tenant, savings_rollup, layers_vs_baseline, cache_share, stage_histogram, histogram_quantiles, latency_percentiles, load_summary, requests_per_minute, sliding_requests, cumulative_tokens, spend_cap, last_request, recent_requests, single_flight, tenant_slugs, tenant_values, stage_spans, parsed_verdicts, value_tally, shadow_baseline, trace_vs_offline)
}


def _cost(model: str, tokens: str) -> str:
    return f"round_even({tokens} * case {model} when 'small' then 0.10::double when 'large' then 2.00::double else 1.00::double end + 120 * case {model} when 'small' then 0.50::double when 'large' then 10.00::double else 5.00::double end, 0) / 1e6::double"


def sql_dollars(amount: str) -> str:
    return f"sum(round_even({amount} * 1e6, 0)::bigint)::bigint / 1e6::double"


_COSTS = f"{SQL_EVENTS}, co as (select *, {_cost('model', 'tokens')} as cost, {_cost(chr(39) + 'large' + chr(39), 'tokens * 2')} as base from ev)"


_RECORDS = f"""{_COSTS}, gr as (select *, event_id % 3 - user_id % 3 as ahead, round_even(cost * 1e6, 0)::bigint as cm, round_even(base * 1e6, 0)::bigint as bm from co),
  rc as (select *, case when layer = 'purchase' then case when ahead = 0 then 'equivalent' when ahead > 0 then 'better' else 'worse' end end as verdict from gr),
  fam as (select tenant, 'requests' as counter, layer as label, model as other, 1 as value from rc union all select tenant, 'cost', 'spent', '', cm from rc union all select tenant, 'cost', 'baseline', '', bm from rc union all select tenant, 'overhead', 'saved', '', bm - cm from rc
    union all select tenant, 'tokens', 'input', '', coalesce(tokens, 0) from rc union all select tenant, 'tokens', 'output', '', 120 from rc union all select tenant, 'quality', verdict, layer, 1 from rc where verdict is not null
    union all select tenant, 'errors', case when user_id % 3 = 0 then 'window' else 'answer' end, '', 1 from rc where layer = 'error' union all select tenant, 'rejects', 'numbers_mismatch', '', 1 from rc where layer = 'click' union all select tenant, 'rejects', 'low_cosine', '', 1 from rc where layer = 'click' and user_id % 2 <> 0)"""


def _buckets(bounds: tuple[float, ...]) -> str:
    return ", ".join(f"({b}::double)" for b in bounds)


def _rank(p: float) -> str:
    return f"list_sort(list(seconds))[least(count(seconds), round_even({p} / 100 * (count(seconds) - 1), 0)::bigint + 1)]"


def _quantile(q: float) -> str:
    n = len(traffic.REQUEST_BOUNDS)
    return f"""select layer, start, {q}::double as q, round_even(case when i >= {n} then les[{n}] else
        (case when i = 0 then 0 else les[i] end) + (les[i + 1] - case when i = 0 then 0 else les[i] end) * ({q}::double * total - case when i = 0 then 0 else ns[i] end) / (ns[i + 1] - case when i = 0 then 0 else ns[i] end) end, 6) as value
        from (select *, len(list_filter(ns, lambda x: x < {q}::double * total)) as i from h where total > 0)"""


ORACLE_SQL = {
    "request_counters": f"with {SQL_EVENTS} select tenant, layer, model, count(*) as requests, sum(tokens)::bigint as tokens from ev group by 1, 2, 3",
    "counter_families": f"with {_RECORDS} select tenant, counter, label, other, sum(value)::bigint as value from fam group by 1, 2, 3, 4",
    "quality_preserved": f"with {_RECORDS} select tenant, round_even(count(*) filter (verdict in ('equivalent', 'better')) / count(*), 4) as preserved from rc where verdict is not null group by 1",
    "cost_by_tenant": f"with {_COSTS}, s as (select tenant, count(*) as n, {sql_dollars('cost')} as cost, {sql_dollars('base')} as base from co group by 1) select *, case when base = 0 then 0 else round_even(1 - cost / base, 4) end as savings_pct from s",
    "savings_rollup": f"with {_COSTS} select coalesce(layer, 'all') as layer, coalesce(model, 'all') as model, count(*) as n, {sql_dollars('cost')} as cost from co group by rollup (layer, model)",
    "layers_vs_baseline": f"""with {_COSTS}, s as (select layer, count(*) as n, sum(round_even(cost * 1e6, 0)::bigint)::bigint / (count(*) * 1000::double) as per_1k, round_even(avg(tokens), 2) as mean_tokens from co group by 1)
        select *, round_even(per_1k / nullif((select per_1k from s where layer = 'purchase'), 0), 4) as vs_base from s""",
    "cache_share": f"with {SQL_EVENTS} select tenant, round_even(count(*) filter (regexp_full_match(layer, 'view|sign.*')) / count(*), 4) as cached, round_even(count(*) filter (regexp_full_match(layer, 'err')) / count(*), 4) as unmatched from ev where regexp_full_match(tenant, 't[0-4]') group by 1",
    "stage_histogram": f"with {SQL_EVENTS}, b(le) as (values {_buckets(traffic.STAGE_BOUNDS)}) select layer, le, count(*) filter (seconds <= le) as n from ev cross join b group by 1, 2",
    "histogram_quantiles": f"""with {SQL_EVENTS}, w as (select layer, seconds, (floor(epoch(moment) / 300)::bigint - k) * 300 as start from ev cross join (values (0), (1)) o(k)), b(le) as (values {_buckets(traffic.REQUEST_BOUNDS)}),
        c as (select layer, start, le, count(*) filter (seconds <= le) as n from w cross join b group by 1, 2, 3), t as (select layer, start, count(seconds) as total from w group by 1, 2),
        h as (select layer, start, total, list_append(list(le order by le), null) as les, list_append(list(n order by le), total) as ns from c join t using (layer, start) group by 1, 2, 3)
        {_quantile(0.5)} union all {_quantile(0.95)}""",
    "latency_percentiles": f"with {SQL_EVENTS} select layer, count(seconds) as n, {_rank(50)} as p50, {_rank(95)} as p95, {_rank(99)} as p99 from ev group by 1",
    "load_summary": f"""with {SQL_EVENTS}, b as (select layer, moment, seconds, layer <> 'error' as served from ev union all select 'all', moment, seconds, layer <> 'error' from ev),
        s as (select layer, count(*) as n, count(*) filter (served) as n_ok, (epoch_us(max(moment)) - epoch_us(min(moment))) / 1e6::double as wall, {_rank(50)} as p50, {_rank(95)} as p95, {_rank(99)} as p99 from b group by 1)
        select *, round_even(n_ok / nullif(wall, 0), 4) as per_second from s""",
    "requests_per_minute": f"with {SQL_EVENTS} select floor(epoch(moment) / 60)::bigint * 60 as start, layer, count(*) as n from ev group by 1, 2",
    "sliding_requests": f"with {SQL_EVENTS} select (floor(epoch(moment) / 300)::bigint - k) * 300 as start, tenant, count(*) as n from ev cross join (values (0), (1), (2)) o(k) group by 1, 2",
    "cumulative_tokens": f"with {SQL_EVENTS} select event_id, tenant, sum(tokens) over (partition by tenant order by moment, event_id)::bigint as total from ev",
    "spend_cap": f"with {_COSTS}, s as (select event_id, coalesce(sum(round_even(cost * 1e6, 0)::bigint) over (partition by tenant order by moment, event_id rows between unbounded preceding and 1 preceding), 0) as before from co) select event_id, before < 400000 as allowed from s",
    "last_request": f"""with {SQL_EVENTS}, r as (select *, row_number() over (partition by tenant order by moment desc, event_id desc) as k from ev), t as (select * from r where k = 1)
        select tenant, 'tokens' as field, tokens::double as value from t union all select tenant, 'seconds', seconds from t union all select tenant, 'routed', case when layer = 'view' then -1 else 1 end::double from t""",
    "recent_requests": f"with {SQL_EVENTS} select event_id, tenant, layer, tokens from ev order by moment desc, event_id desc limit 200",
    "single_flight": f"with {SQL_EVENTS} select user_id, layer, props, min(event_id) as leader, count(*) - 1 as waiting from ev group by 1, 2, 3",
    "tenant_slugs": "select c_custkey, left(regexp_replace(lower(coalesce(nullif(case when c_custkey % 9 = 0 then '' else c_mktsegment || ' & Co. ' || c_name end, ''), 'default')), '[^a-z0-9_]', '_', 'g'), 64) as tenant from customer",
    "tenant_values": f"with {SQL_EVENTS} select distinct tenant from ev",
    "stage_spans": f"with {SQL_EVENTS} select event_id, 'lookup' as stage, round_even(seconds * 0.25, 6) as took from ev where seconds is not null union all select event_id, 'answer', round_even(seconds * 0.75, 6) from ev where seconds is not null",
    "parsed_verdicts": f"with {SQL_EVENTS}, v as (select tenant, case json_extract_string(props, '$.k')::int % 4 when 0 then 'equivalent' when 2 then 'worse' else 'unparsed' end as verdict from ev) select tenant, verdict, count(*) as n from v group by 1, 2",
    "value_tally": "select lang, count(n_chars) as n, min(n_chars) as least, max(n_chars) as most, list_sort(list(n_chars))[count(n_chars) // 2 + 1] as median from documents where n_chars is not null group by 1",
    "shadow_baseline": f"""with {_COSTS}, t as (select *, case when event_id % 4 = 0 then round_even(round_even(base * 1e6, 0) * 0.9::double, 0) / 1e6::double end as measured from co)
        select case when measured is not null then 'measured' else 'estimated' end as source, count(*) as n, {sql_dollars('coalesce(measured, base)')} as base, {sql_dollars('cost')} as cost from t group by 1""",
    "trace_vs_offline": f"""with {SQL_EVENTS}, t as (select layer, case when event_id % 10 <> 0 then case when event_id % 7 = 0 then 'view' else layer end end as offline from ev)
        select layer, count(*) as n, count(offline) as compared, count(*) filter (layer = offline) as matches from t group by 1""",
}
