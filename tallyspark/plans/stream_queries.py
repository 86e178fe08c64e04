"""Queries that run as streams: the tables' rows arrive shuffled, file by file, and the stream is stopped and resumed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallyspark import scratch
from tallyspark.operators import context, traffic
from tallyspark.plans.tables import SQL_BOILERPLATE, SQL_CHUNKS, SQL_EVENTS, events, sections, sql_sentences, table
from tallyspark.streaming import requests, sentences

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts that the rows arrive in, half of them before the stream is stopped; least state partitions; seconds a run may take.
FILES, PARTITIONS, SECONDS = 4, 8, 1800
TTL_SECONDS = 3600


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """The session with the store that timers need and a partition of state for each core; its own settings afterwards."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": str(min(max(PARTITIONS, spark.sparkContext.defaultParallelism), int(spark.conf.get("spark.sql.shuffle.partitions"))))}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _arrivals(rows: DataFrame, order: str) -> list[DataFrame]:
    """The rows in FILES parts, whatever their order in time."""
    return [rows.where(F.pmod(F.xxhash64(order), F.lit(FILES)) == i) for i in range(FILES)]


def _run(live: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """What is there now, then an end: the next run goes on from the checkpoint."""
    _end(live.writeStream.format("parquet").outputMode(mode).option("path", out), checkpoint)


def _end(writer: DataStreamWriter, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        if not query.awaitTermination(SECONDS):
            raise TimeoutError("the stream did not end")
    finally:
        query.stop()


def resumed(spark: SparkSession, rows: DataFrame, order: str, ts: str, last: DataFrame, stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``stream`` makes of rows that arrive shuffled over two runs; ``last`` moves the watermark past all of them."""
    source, out, checkpoint = (scratch.fresh(spark, f"stream-{n}") for n in ("in", "out", "checkpoint"))
    staged = scratch.stage(rows, "arrivals")
    # As many files arrive at once as the table has: each part is written by all tasks and read in one batch.
    files = max(1, len(staged.inputFiles()))
    parts = _arrivals(staged, order)
    with _state_store(spark):
        # The path is a pattern, so that files can be added under it.
        live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{source}/*")
        for i, part in enumerate(parts):
            part.write.parquet(f"{source}/{i}")
            if i == len(parts) // 2 - 1:
                _run(stream(live), out, checkpoint)
        last.coalesce(1).write.parquet(f"{source}/last")
        _run(stream(live), out, checkpoint)
    return spark.read.schema(stream(live).schema).parquet(out)


def stream_ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through the cache in keyed state: each is answered as if all had arrived in order of time."""
    rows = events(spark, sf_dir).select("tenant", F.col("layer").alias("key"), "event_id", "at")
    last = rows.agg(F.lit("").alias("tenant"), F.lit("").alias("key"), F.lit(-1).cast("long").alias("event_id"), (F.max("at") + F.expr("interval 4000 days")).alias("at"))
    found = resumed(spark, rows, "event_id", "at", last, lambda live: requests.cached(live, TTL_SECONDS, late="3650 days"))
    return found.where("event_id >= 0")


def _shadow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests with an estimated baseline, and for every fourth what the large model took, some time later."""
    rows = events(spark, sf_dir)
    spent = F.greatest(F.lit(0), F.col("tokens") * 2 - F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)))
    asked = rows.select(F.lit("request").alias("kind"), "event_id", "at", traffic.billed(F.lit("large"), F.col("tokens") * 2, F.lit(120)).alias("amount"))
    came = F.col("at") + F.make_dt_interval(mins=F.pmod("event_id", F.lit(28)))
    shadows = rows.where("event_id % 4 = 0").select(F.lit("shadow").alias("kind"), "event_id", came.alias("at"), traffic.billed(F.lit("large"), spent, F.lit(120)).alias("amount"))
    return asked.union(shadows)


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests and shadow results out of one stream or table."""
    return rows.where("kind = 'request'").select("event_id", "at", F.col("amount").alias("estimate")), rows.where("kind = 'shadow'").select("event_id", "at", F.col("amount").alias("measured"))


def shadow_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request's baseline, measured where a shadow result came in time."""
    return traffic.with_shadow(*_sides(_shadow_rows(spark, sf_dir))).select("event_id", "measured", "base", "source")


def stream_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as results arrive, shuffled, in a stream that is stopped and resumed."""
    rows = _shadow_rows(spark, sf_dir)
    last = rows.agg((F.max("at") + F.expr("interval 4000 days")).alias("at")).select(F.explode(F.array(F.lit("request"), F.lit("shadow"))).alias("kind"), F.lit(-1).cast("long").alias("event_id"), "at", F.lit(0.0).alias("amount"))
    found = resumed(spark, rows, "event_id", "at", last, lambda live: requests.shadowed(*_sides(live), late="3650 days").select("event_id", "measured", "base", "source"))
    return found.where("event_id >= 0")


def stream_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated sentences of documents that arrive over several runs of a stream, with those of pasted documents (every
    hundredth), which need no repetition; n_docs is null where only a pasted one holds the sentence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    source, place, checkpoint = (scratch.fresh(spark, f"sentences-{n}") for n in ("in", "counts", "checkpoint"))
    live = spark.readStream.schema(docs.schema).parquet(f"{source}/*")
    lines = live.select("doc_id", F.explode(F.split("text", "\n")).alias("body")).where("body <> ''")
    for i, part in enumerate(_arrivals(docs, "doc_id")):
        part.write.parquet(f"{source}/{i}")
        # Each run is a new reader of the folder, as after a restart.
        _end(lines.writeStream.foreachBatch(sentences.SentenceCounts(spark, place).merge), checkpoint)
    pasted = context.boilerplate(sections(spark, sf_dir).where("doc_id % 100 = 1"), least_docs=1)
    # Read twice: staged, so that texts are looked up once.
    repeated = scratch.stage(sentences.SentenceCounts(spark, place).repeated(), "repeated")
    return context.united_boilerplate(repeated, pasted).join(repeated, "sentence", "left")


QUERIES = {f.__name__: f for f in (stream_ttl_cache, shadow_measured, stream_shadow, stream_boilerplate)}

_MEASURED = f"""with {SQL_EVENTS}, r as (select event_id, moment, tokens, round_even(tokens * 2 * 2.00::double + 120 * 10.00::double, 0) / 1e6::double as estimate from ev),
    s as (select event_id, moment + to_minutes(event_id % 28) as came, round_even(greatest(0, tokens * 2 - coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0)) * 2.00::double + 120 * 10.00::double, 0) / 1e6::double as measured from ev where event_id % 4 = 0)
    select r.event_id, s.measured, coalesce(s.measured, estimate) as base, case when s.measured is null then 'estimated' else 'measured' end as source
    from r left join s on s.event_id = r.event_id and s.came >= r.moment and s.came <= r.moment + interval 20 minute"""

ORACLE_SQL = {
    "stream_boilerplate": f"""with {SQL_CHUNKS}, {SQL_BOILERPLATE}, pasted as (select distinct unnest({sql_sentences('body')}) as sentence from sections where doc_id % 100 = 1)
        select coalesce(r.sentence, p.sentence) as sentence, n_docs from repeated r full join pasted p on r.sentence = p.sentence""",
    "shadow_measured": _MEASURED,
    "stream_shadow": _MEASURED,
    "stream_ttl_cache": f"""with recursive {SQL_EVENTS}, o as (select event_id, moment, tenant, layer, row_number() over (partition by tenant, layer order by moment, event_id) as n from ev),
        f as (select event_id, tenant, layer, n, false as hit, moment as written, event_id as writer from o where n = 1 union all
          select o.event_id, o.tenant, o.layer, o.n, o.moment - f.written < interval {TTL_SECONDS} second, case when o.moment - f.written < interval {TTL_SECONDS} second then f.written else o.moment end,
            case when o.moment - f.written < interval {TTL_SECONDS} second then f.writer else o.event_id end
          from f join o on o.tenant = f.tenant and o.layer = f.layer and o.n = f.n + 1)
        select tenant, layer as key, event_id, hit, case when hit then writer end as served_from from f""",
}
