"""Queries over data quality: violations, references, inheritance, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import scratch
from tallyspark.functions import text
from tallyspark.operators import checks, sampling
from tallyspark.plans import cache_queries
from tallyspark.plans.tables import joined, table


def dq_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over documents and labels, and references that lead nowhere."""
    docs = table(spark, sf_dir, "documents")
    rules = {
        "length agrees": F.length("text") == F.col("n_chars"),
        "long enough": F.col("n_chars") >= 100,
        "ends a sentence": F.col("text").rlike(r"[.!?]\s*$"),
        "known source": F.col("source").rlike("^src[0-9]+$"),
    }
    orphans = checks.missing(table(spark, sf_dir, "labels"), "doc_id", "doc_id", docs, "doc_id", "label without document")
    return checks.violations(docs, "doc_id", rules).union(orphans)


def label_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label against every document: the last rule of dq_violations by itself."""
    return checks.missing(table(spark, sf_dir, "labels"), "doc_id", "doc_id", table(spark, sf_dir, "documents"), "doc_id", "label without document")


def missing_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a customer, and customers without an order."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    found = {
        "customer unknown": checks.missing(orders, "o_orderkey", "o_custkey", customers, "c_custkey", ""),
        "no order": checks.missing(customers, "c_custkey", "c_custkey", orders, "o_custkey", ""),
    }
    told = [rows.agg(F.count("*").alias("n"), F.min("id").alias("first")).select(F.lit(rule).alias("rule"), "n", "first") for rule, rows in found.items()]
    return told[0].union(told[1])


def _cluster_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as a cluster of rows; each fourth copies the one before, others share answers."""
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = table(spark, sf_dir, "orders").withColumn("local_index", order)
    variant = F.when((F.col("local_index") % 4 == 3), "exact").when((F.col("local_index") % 4 == 2), "semantic").when(F.col("local_index") % 4 == 1, "tricky").otherwise("cold")
    return rows.select(
        F.col("o_custkey").alias("cluster_id"),
        "local_index",
        variant.alias("variant"),
        F.when(variant == "exact", F.col("local_index") - 1).alias("copy"),
        F.col("o_orderstatus").alias("answer_id"),
        F.concat(F.lit("q"), "o_orderkey").alias("query"),
        F.col("o_orderpriority").alias("reference"),
        F.concat(F.lit("c"), "o_orderkey").alias("case_id"),
        F.when(F.col("o_totalprice") > 150_000, "complex").otherwise("easy").alias("difficulty"),
    )


def cluster_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.expand_cluster(_cluster_rows(spark, sf_dir))


def local_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within a cluster resolved to ids: which query a row copies or confuses."""
    rows = _cluster_rows(spark, sf_dir).select("cluster_id", "local_index", "query", "copy", F.when(F.col("variant") == "tricky", F.col("local_index") - 1).alias("confusable"))
    known = rows.select("cluster_id", F.col("local_index").alias("at"), F.col("query").alias("found"))
    for ref in ("copy", "confusable"):
        rows = rows.join(known.withColumnRenamed("at", ref).withColumnRenamed("found", f"{ref}_query"), ["cluster_id", ref], "left")
    return rows.select("cluster_id", "local_index", "query", "copy_query", "confusable_query")


def source_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-cache hits compared, column by column, with the document that they are served from."""
    docs = table(spark, sf_dir, "documents")
    hits = cache_queries.exact_cache_replay(spark, sf_dir).select("doc_id", F.col("served_from").alias("claimed"))
    return checks.identical(docs.join(hits, "doc_id"), "claimed", "doc_id", ["text", "lang", "source"]).groupBy("rule").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def served_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hit with the answer that was generated for its source."""
    rows = cache_queries.exact_cache_replay(spark, sf_dir)
    answers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("served_from"), F.concat(F.lit("answer of "), F.col("doc_id")).alias("answer"))
    return rows.where("hit").join(answers, "served_from").select("doc_id", "answer")


def metric_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = cache_queries.exact_cache_summary(spark, sf_dir)
    return checks.gates(summary, [("false_hit", "max", 0), ("hits", "min", 36), ("recall", "min", 0.01), ("tokens_saved_pct", "min", 0.95)])


def merged_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with different columns as one, blanks where a column is missing."""
    docs = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"))
    pages = table(spark, sf_dir, "pages").groupBy(F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang")).agg(F.count("*").alias("n_pages"))
    return docs.unionByName(pages, allowMissingColumns=True)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as labelled rows, with faults in every rule: by the number's rest by 10, rows 4 copy the one before, rows 3
    paraphrase the one three before, rows 2 are traps of the one before. All other values are of the row that is copied."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    d = F.col("doc_id")
    kind = F.pmod(d, F.lit(10))
    rows = docs.select(
        "doc_id",
        F.when(kind == 4, d - 1 + F.when(d % 70 == 4, 3).otherwise(0)).alias("exact_of"),
        F.when(kind == 3, d - 3).alias("semantic_of"),
        F.when(kind == 2, d - 1).alias("confusable_with"),
        "text",
        "n_chars",
    )
    source = docs.select(F.col("doc_id").alias("from"), F.col("text").alias("their_text"))
    rows = rows.withColumn("from", F.coalesce("exact_of", "semantic_of", "confusable_with")).join(source, "from", "left")
    words = lambda c, a, n: F.array_join(F.slice(F.split(c, " "), a, n), " ")
    own, theirs = words("text", 1, 8), words("their_text", 1, 8)
    query = F.when(F.col("exact_of").isNotNull() & (d % 40 != 4), theirs).when(F.coalesce("semantic_of", "confusable_with").isNotNull(), F.when(d % 60 == 3, theirs).when(d % 20 < 10, F.concat(theirs, F.lit(" again"))).otherwise(own)).otherwise(own)
    base = F.when(F.coalesce("exact_of", "semantic_of").isNotNull() & (d % 30 > 9), F.col("from")).otherwise(d)
    small = F.col("n_chars") < 2000
    return rows.select(
        F.when(d % 211 == 7, d - 1).otherwise(d).alias("id"),
        d.alias("seq"),
        query.alias("query"),
        F.concat(F.lit("c"), F.pmod(base, F.lit(25)) + F.when(d % 83 == 5, 100).otherwise(0)).alias("case_id"),
        F.array(base, base + 1).alias("attached"),
        F.array(base + F.when(d % 41 == 6, 5).otherwise(0)).alias("gold"),
        F.concat(F.lit("answer of "), F.when(F.col("confusable_with").isNotNull() & (d % 50 == 2), F.col("from")).otherwise(base)).alias("answer"),
        F.col("exact_of"),
        F.col("semantic_of"),
        F.col("confusable_with"),
        (F.contains("text", own) & (d % 29 != 0)).alias("fact_in_gold"),
        F.when(small, "small").otherwise("large").alias("context_size"),
        F.col("n_chars").alias("context_tokens"),
        (~small != (d % 31 == 0)).alias("apply_window"),
        F.when(d % 3 == 0, "easy").otherwise("complex").alias("difficulty"),
        ((d % 3 == 0) != (d % 37 == 0)).alias("small_ok"),
        F.when((d % 3 == 0) != (d % 43 == 0), "small").otherwise("large").alias("model"),
    )


def _other(c: str):
    return F.col(f"other.{c}")


#: Two queries that mean the same, or are mistaken for each other, share at least this much of their words.
LEAST_SIMILARITY = 0.34


def _rules() -> list[checks.Rule]:
    return [
        checks.Unique("id is unique", ("id",)),
        checks.Known("case is known", F.array("case_id"), "cases"),
        checks.Known("document is known", F.col("attached"), "documents"),
        checks.Row("gold is attached", F.size(F.array_except("gold", "attached")) == 0),
        checks.Row("fact is in gold", F.col("fact_in_gold")),
        checks.Row("small context is small", (F.col("context_size") != "small") | (F.col("context_tokens") <= 900)),
        checks.Row("large context is large", (F.col("context_size") != "large") | (F.col("context_tokens") >= 2500)),
        checks.Row("window fits context", F.col("apply_window") == (F.col("context_size") == "large")),
        checks.Row("route fits difficulty", F.col("small_ok") == (F.col("difficulty") == "easy")),
        checks.Row("model fits route", F.col("model") == F.when(F.col("small_ok"), "small").otherwise("large")),
        checks.Pair("exact row is identical", "exact_of", F.col("query").eqNullSafe(_other("query")) & F.col("case_id").eqNullSafe(_other("case_id"))),
        checks.Pair("exact payload is the same", "exact_of", F.col("attached").eqNullSafe(_other("attached")) & F.col("answer").eqNullSafe(_other("answer"))),
        checks.Pair("exact row comes later", "exact_of", F.col("seq") > _other("seq")),
        checks.Pair("paraphrase differs", "semantic_of", F.col("query") != _other("query")),
        checks.Pair("paraphrase keeps answer and context", "semantic_of", F.col("answer").eqNullSafe(_other("answer")) & F.col("attached").eqNullSafe(_other("attached")) & F.col("case_id").eqNullSafe(_other("case_id"))),
        checks.Pair("paraphrase is similar", "semantic_of", text.jaccard(F.col("query"), _other("query")) >= LEAST_SIMILARITY),
        checks.Pair("trap has its own answer", "confusable_with", F.col("answer") != _other("answer")),
        checks.Pair("trap is similar", "confusable_with", text.jaccard(F.col("query"), _other("query")) >= LEAST_SIMILARITY),
    ]


def label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over all labelled rows."""
    rows = scratch.stage(_labelled(spark, sf_dir), "labelled")
    cases = spark.range(25).select(F.concat(F.lit("c"), "id").alias("key"))
    return checks.audit(rows, "id", _rules(), {"cases": cases, "documents": table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))})


BUNDLE, BUNDLE_SEED = 8, 3


def held_out_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the eight that are attached to its request: itself, the next one, and others at random."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    rows = docs.withColumn("required", F.array(F.col("doc_id"), F.col("doc_id") + 1))
    found = sampling.bundles(rows, "doc_id", "required", docs, "doc_id", BUNDLE, BUNDLE_SEED)
    return found.select(F.col("id").alias("doc_id"), joined(F.col("bundle")).alias("bundle"), F.size("bundle").alias("n"))


QUERIES = {f.__name__: f for f in (label_audit, held_out_bundles, dq_violations, label_references, missing_parents, cluster_expansion, local_references, source_identity, served_answers, metric_gates, merged_modes)}

_CLUSTER = """o as (select *, row_number() over (partition by o_custkey order by o_orderkey) - 1 as li from orders),
  c as (select o_custkey as cluster_id, li::int as local_index, case li % 4 when 3 then 'exact' when 2 then 'semantic' when 1 then 'tricky' else 'cold' end as variant, case when li % 4 = 3 then li - 1 end as copy, o_orderstatus as answer_id,
    'q' || o_orderkey as query, o_orderpriority as reference, 'c' || o_orderkey as case_id, case when o_totalprice > 150000 then 'complex' else 'easy' end as difficulty from o)"""
_SUMMARY = cache_queries.ORACLE_SQL["exact_cache_summary"]

_JACCARD = "case when len({0}) = 0 or len({1}) = 0 then 0 else len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) end".format(*(f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))" for c in ("r.query", "o.query")))
_FIRST_WORDS = "array_to_string(string_split({0}, ' ')[1:8], ' ')"
_LABELLED = f"""d as (select doc_id, text, n_chars, case when doc_id % 10 = 4 then doc_id - 1 + case when doc_id % 70 = 4 then 3 else 0 end end as exact_of, case when doc_id % 10 = 3 then doc_id - 3 end as semantic_of,
    case when doc_id % 10 = 2 then doc_id - 1 end as confusable_with from documents),
  e as (select d.*, coalesce(exact_of, semantic_of, confusable_with) as src from d),
  f as (select e.*, s.text as their, {_FIRST_WORDS.format('e.text')} as own, {_FIRST_WORDS.format('s.text')} as theirs, case when coalesce(exact_of, semantic_of) is not null and e.doc_id % 30 > 9 then src else e.doc_id end as base from e left join documents s on s.doc_id = src),
  rows as (select case when doc_id % 211 = 7 then doc_id - 1 else doc_id end as id, doc_id as seq,
    case when exact_of is not null and doc_id % 40 <> 4 then theirs when coalesce(semantic_of, confusable_with) is not null then case when doc_id % 60 = 3 then theirs when doc_id % 20 < 10 then theirs || ' again' else own end else own end as query,
    'c' || (base % 25 + case when doc_id % 83 = 5 then 100 else 0 end) as case_id, [base, base + 1] as attached, [base + case when doc_id % 41 = 6 then 5 else 0 end] as gold,
    'answer of ' || case when confusable_with is not null and doc_id % 50 = 2 then src else base end as answer, exact_of, semantic_of, confusable_with, contains(text, own) and doc_id % 29 <> 0 as fact_in_gold,
    case when n_chars < 2000 then 'small' else 'large' end as context_size, n_chars as context_tokens, (n_chars >= 2000) <> (doc_id % 31 = 0) as apply_window, case when doc_id % 3 = 0 then 'easy' else 'complex' end as difficulty,
    (doc_id % 3 = 0) <> (doc_id % 37 = 0) as small_ok, case when (doc_id % 3 = 0) <> (doc_id % 43 = 0) then 'small' else 'large' end as model from f)"""
_PAIRED = "select r.id, '{0}' as rule from rows r left join rows o on o.id = r.{1} where r.{1} is not null and not coalesce({2}, false)"
_ROWED = "select id, '{0}' from rows where not coalesce({1}, false)"
_NUMBER = "('0x' || left(sha256('{0}:{1}:' || {2}), 12))::bigint"

ORACLE_SQL = {
    "label_audit": f"""with {_LABELLED} select id, 'id is unique' as rule from rows where id in (select id from rows group by 1 having count(*) > 1)
        union all select id, 'case is known' from rows where case_id not in (select 'c' || i from range(25) t(i))
        union all select distinct id, 'document is known' from (select id, seq, unnest(attached) as k from rows) where k not in (select doc_id from documents)
        union all {' union all '.join(_ROWED.format(*x) for x in (
            ('gold is attached', 'list_has_all(attached, gold)'), ('fact is in gold', 'fact_in_gold'), ('small context is small', "context_size <> 'small' or context_tokens <= 900"),
            ('large context is large', "context_size <> 'large' or context_tokens >= 2500"), ('window fits context', "apply_window = (context_size = 'large')"), ('route fits difficulty', "small_ok = (difficulty = 'easy')"),
            ('model fits route', "model = case when small_ok then 'small' else 'large' end")))}
        union all {' union all '.join(_PAIRED.format(*x) for x in (
            ('exact row is identical', 'exact_of', 'r.query is not distinct from o.query and r.case_id is not distinct from o.case_id'),
            ('exact payload is the same', 'exact_of', 'r.attached is not distinct from o.attached and r.answer is not distinct from o.answer'), ('exact row comes later', 'exact_of', 'r.seq > o.seq'),
            ('paraphrase differs', 'semantic_of', 'r.query <> o.query'),
            ('paraphrase keeps answer and context', 'semantic_of', 'r.answer is not distinct from o.answer and r.attached is not distinct from o.attached and r.case_id is not distinct from o.case_id'),
            ('paraphrase is similar', 'semantic_of', f'{_JACCARD} >= {LEAST_SIMILARITY}'), ('trap has its own answer', 'confusable_with', 'r.answer <> o.answer'), ('trap is similar', 'confusable_with', f'{_JACCARD} >= {LEAST_SIMILARITY}')))}""",
    "held_out_bundles": f"""with recursive pool as (select doc_id, row_number() over (order by doc_id) - 1 as place, count(*) over () as n from documents),
        sizes as (select any_value(n) as n, (select min(p) from range(any_value(n), any_value(n) + 1000) t(p) where p >= 2 and len(list_filter(range(2, floor(sqrt(p))::bigint + 1), lambda d: p % d = 0)) = 0) as p from pool),
        needs as (select d.doc_id, list_distinct(list(q.place) filter (q.place is not null)) as needed from (select doc_id, unnest([doc_id, doc_id + 1]) as k from documents) d left join pool q on q.doc_id = d.k group by 1),
        walks as (select doc_id, needed, n, p, list_transform(range(0, least(p - 1, {BUNDLE} + p - n + len(needed)) + 1), lambda k: ({_NUMBER.format(BUNDLE_SEED, 'start', 'doc_id')} % p + (1 + {_NUMBER.format(BUNDLE_SEED, 'step', 'doc_id')} % (p - 1)) * k) % p) as walk from needs, sizes),
        chosen as (select doc_id, unnest(list_concat(needed, list_filter(walk, lambda x: x < n and not list_contains(needed, x))[1:{BUNDLE} - len(needed)])) as place from walks)
        select c.doc_id, string_agg(q.doc_id, ',' order by {_NUMBER.format(BUNDLE_SEED, 'order', "c.doc_id || ':' || q.doc_id")}) as bundle, count(*)::int as n from chosen c join pool q using (place) group by 1""",
    "label_references": "select doc_id as id, 'label without document' as rule from labels l where doc_id is not null and not exists (select 1 from documents d where d.doc_id = l.doc_id)",
    "dq_violations": r"""select doc_id as id, 'length agrees' as rule from documents where length(text) <> n_chars union all select doc_id, 'long enough' from documents where n_chars < 100
        union all select doc_id, 'ends a sentence' from documents where not regexp_matches(text, '[.!?]\s*$') union all select doc_id, 'known source' from documents where not regexp_matches(source, '^src[0-9]+$')
        union all select doc_id, 'label without document' from labels where doc_id not in (select doc_id from documents where doc_id is not null)""",
    "missing_parents": """select 'customer unknown' as rule, count(*) as n, min(o_orderkey) as first from orders where o_custkey not in (select c_custkey from customer)
        union all select 'no order', count(*), min(c_custkey) from customer where c_custkey not in (select o_custkey from orders)""",
    "cluster_expansion": f"""with {_CLUSTER}, f as (select cluster_id, answer_id, arg_min(reference, local_index) as reference, arg_min(case_id, local_index) as case_id, arg_min(difficulty, local_index) as difficulty, min(local_index) as first from c group by 1, 2)
        select c.cluster_id, c.local_index, c.variant, case when c.variant = 'exact' then s.query else c.query end as query,
          case c.variant when 'exact' then s.reference when 'semantic' then f.reference else c.reference end as reference, case c.variant when 'exact' then s.case_id when 'semantic' then f.case_id else c.case_id end as case_id,
          case c.variant when 'exact' then s.difficulty when 'semantic' then f.difficulty else c.difficulty end as difficulty, case when c.variant = 'exact' then s.answer_id else c.answer_id end as answer_id,
          case c.variant when 'exact' then 'exact_hit' when 'semantic' then 'semantic_hit' when 'cold' then 'cold' else 'miss' end as expected_cache, case when c.variant = 'exact' then c.copy end::int as exact_of, case when c.variant = 'semantic' then f.first end as semantic_of
        from c left join c s on s.cluster_id = c.cluster_id and s.local_index = c.copy left join f on f.cluster_id = c.cluster_id and f.answer_id = c.answer_id""",
    "local_references": f"""with {_CLUSTER} select c.cluster_id, c.local_index, c.query, s.query as copy_query, t.query as confusable_query from c left join c s on s.cluster_id = c.cluster_id and s.local_index = c.copy
        left join c t on t.cluster_id = c.cluster_id and c.variant = 'tricky' and t.local_index = c.local_index - 1""",
    "source_identity": """with h as (select doc_id, text, lang, source, min(doc_id) over (partition by text, lang) as first from documents),
        p as (select h.doc_id, h.source = s.source as same from h join documents s on s.doc_id = h.first where h.doc_id > h.first)
        select 'differs from its source' as rule, count(*) as n, min(doc_id) as first from p where not same having count(*) > 0""",
    "served_answers": "with h as (select doc_id, min(doc_id) over (partition by text, lang) as first from documents) select doc_id, 'answer of ' || first as answer from h where doc_id > first",
    "metric_gates": f"""with m as ({_SUMMARY}) select 'false_hit_max' as name, false_hit::double as value, 0::double as bound, false_hit <= 0 as ok from m union all select 'hits_min', hits, 36, hits >= 36 from m
        union all select 'recall_min', recall, 0.01::double, recall >= 0.01 from m union all select 'tokens_saved_pct_min', tokens_saved_pct, 0.95::double, tokens_saved_pct >= 0.95 from m""",
    "merged_modes": "select lang, count(*) as n_docs, null::bigint as n_pages from documents group by 1 union all select regexp_extract(html, '<html lang=\"([a-z]+)\"', 1), null, count(*) from pages group by 1",
}
