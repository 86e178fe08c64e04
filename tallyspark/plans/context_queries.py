"""Queries over context windows: sections, boilerplate, packing, pruning, facts, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import context
from tallyspark.plans.tables import SQL_BOILERPLATE, SQL_CHUNKS, SQL_SCORED, SQL_STRIPPED, chunks, joined, numbered, scored, sections, sql_sentences, sql_tokens, table, attachments

BUDGETS = (100, 200, 300, 400, 500, 600, 800, 1000, 1200)


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(body).alias("n_words"), text.approx_tokens(body).alias("tokens"), F.size(text.sentences(body)).alias("n_sentences"), F.length(text.clean(body)).alias("clean_chars"))


def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("req_id", "doc_id", "pos", "section", "tokens", F.length("body").alias("chars"))


def wanted_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments that name the sections they want (every third), name none, or leave it open."""
    wanted = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("s0"), F.lit("s2"))).when(F.col("doc_id") % 3 == 1, F.array().cast("array<string>"))
    found = context.chunks(attachments(spark, sf_dir).withColumn("wanted", wanted), sections(spark, sf_dir).select("doc_id", "title", "section_pos", "section", "body"))
    return found.select(F.col("req_id").cast("long"), "doc_id", "pos", "section", "tokens")


def eligible_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.eligible(chunks(spark, sf_dir)).select("req_id", "tokens", "n")


def boilerplate_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.boilerplate(sections(spark, sf_dir))


def stripped_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.strip_boilerplate(chunks(spark, sf_dir).select("req_id", "doc_id", "pos", "body"), context.boilerplate_hashes(sections(spark, sf_dir)), keys=("req_id", "doc_id", "pos"))


def strip_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stripped_chunks(spark, sf_dir).select("req_id", "doc_id", "pos", "n_repeated", "tokens", F.sha2("body", 256).alias("body_sha"))


def window_section_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = context.section_first(scored(spark, sf_dir))
    return packed.select("req_id", "used", joined(F.col("kept")).alias("kept"))


def budget_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each budget keeps, requests being ordered once for all of them."""
    rows = scored(spark, sf_dir).where(F.col("section") != context.REMINDER_SECTION)
    ordered = rows.groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "pos", "tokens"))).alias("ordered"), F.sum("tokens").alias("before"))
    each = [F.struct(F.lit(b).alias("budget"), context.pack_sections(F.col("ordered"), b).alias("p")) for b in BUDGETS]
    told = ordered.select("req_id", "before", F.inline(F.array(*each)))
    return told.groupBy("budget").agg(F.count("*").alias("n"), F.sum("before").alias("tokens_before"), F.sum("p.used").alias("tokens_after"), F.bround(F.avg(F.size("p.kept")), 4).alias("mean_sections"), F.bround(1 - F.sum("p.used") / F.sum("before"), 4).alias("saved_pct"))


def window_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = context.hybrid(scored(spark, sf_dir), stripped_chunks(spark, sf_dir).select("req_id", "pos", "tokens"))
    return packed.select("req_id", "top", "used", joined(F.col("kept")).alias("kept"))


def near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.near_documents(context.doc_scores(scored(spark, sf_dir)), gap=0.1).select("req_id", "doc_id", "doc_score", "rank")


def mean_doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    # In whole millionths, so that neither the order of rows nor a tie decides the last digit.
    each = scored(spark, sf_dir).groupBy("req_id", "doc_id").agg((F.sum(F.rint(F.col("score") * 1e6).cast("long")) / F.count("*")).alias("s"))
    return each.select("req_id", "doc_id", (F.rint(F.col("s") / 100) / 10000 + F.lit(0.0)).alias("doc_score"))


def gold_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of the best section of the request's third document."""
    return context.best_gold_rank(scored(spark, sf_dir), F.col("doc_id") % 10 == 2)


def sentence_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences scored by a deterministic stand-in of a vector; what stays of each section."""
    each = chunks(spark, sf_dir).select("req_id", "pos", F.posexplode(text.sentences(F.col("body"))).alias("i", "sentence"))
    rows = each.select("req_id", "pos", "i", (F.pmod(F.col("req_id") * 7919 + F.col("pos") * 104729 + F.col("i") * 1299709, F.lit(1009)) / 1009).alias("score"))
    kept = context.prune_sentences(rows, keep_ratio=0.7, neighbours=1)
    return kept.groupBy("req_id", "pos").agg(F.count("*").alias("n_kept"), F.array_join(F.array_sort(F.collect_list(F.col("i"))).cast("array<string>"), ",").alias("kept"))


def fact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three facts per document, two of its own words and one of a test item, and how many its text keeps."""
    items, n = numbered(table(spark, sf_dir, "benchmark"), "item_id")
    items = items.select("place", F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("foreign"))
    words = F.split("text", " ")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.array_join(F.slice(words, 2, 3), " ").alias("near"), F.concat_ws(" ", F.get(words, 1), F.get(words, 5)).alias("apart"), F.pmod("doc_id", F.lit(n)).alias("place"))
    rows = docs.join(F.broadcast(items), "place")
    facts = F.array("near", "apart", "foreign")
    names = ("near", "apart", "foreign")
    rows = rows.withColumn("n_exact", F.size(text.facts_in(facts, F.col("text"))))
    # An explode keeps the array from being evaluated again for each of its columns.
    told = rows.select("doc_id", "n_exact", F.explode(F.array(text.facts_kept_loose([F.col(c) for c in names], F.col("text")))).alias("loose"))
    return told.select("doc_id", "n_exact", *(F.col("loose")[i].alias(f"{c}_loose") for i, c in enumerate(names)))


def case_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nations), "c_nationkey", "left")
    fields = F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (("id", F.lit("x")), ("segment", F.col("c_mktsegment")), ("nation", F.col("n_name")), ("in_debt", context.render_boolean(F.col("c_acctbal") < 0)))))
    name = F.when(F.col("c_custkey") % 4 != 0, F.col("c_name"))
    return rows.select("c_custkey", context.render_case(F.col("c_custkey").cast("string"), name, fields).alias("rendered"))


def context_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a case, its lines as a document: the prompt's digest and estimate."""
    sections_of = F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("line "), F.col("l_linenumber")).alias("name"), F.concat_ws(" ", F.lit("part"), "l_partkey", F.lit("returned"), "l_returnflag").alias("body"))))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(sections_of.alias("s"))
    rows = table(spark, sf_dir, "orders").join(lines, "o_orderkey")
    document = context.render_document(F.col("o_orderpriority"), F.col("o_orderkey").cast("string"), F.col("s"))
    case = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("Status "), F.col("o_orderstatus")))
    told = rows.select("o_orderkey", context.assemble(case, F.array(document)).alias("context"))
    return told.select("o_orderkey", F.sha2(context.prompt(F.lit("What is open?"), F.col("context")), 256).alias("prompt_sha"), text.approx_tokens(F.col("context")).alias("tokens"))


QUERIES = {f.__name__: f for f in (token_estimates, section_chunks, wanted_sections, eligible_requests, boilerplate_sentences, strip_boilerplate, window_section_first, budget_sweep, window_hybrid, near_documents, mean_doc_scores, gold_rank, sentence_prune, fact_coverage, case_render, context_assemble)}

_PACK = "list_reduce({0}, lambda a, c: case when {1}a.used + c.used > {2} then a else {{'used': a.used + c.used, 'kept': list_concat(a.kept, c.kept)}} end, {{'used': {3}, 'kept': []::int[]}})"
_ORDERED = "list({'used': tokens::bigint, 'kept': [pos]} order by score desc, pos)"


def _loose(fact: str, body: str) -> str:
    words = "regexp_extract_all(lower({0}), '[a-z0-9$]+')"
    stop = "('a','an','the','is','are','was','were','be','been','to','of','in','on','at','for','and','or','it','its','this','that','as','by','with','from','can','do')"
    need = f"(case when len(list_filter({words.format(fact)}, lambda w: w not in {stop})) > 0 then list_filter({words.format(fact)}, lambda w: w not in {stop}) else {words.format(fact)} end)"
    return f"list_reduce(list_concat(['0'], {words.format(body)}), lambda i, w: case when {need}[i::int + 1] = w then (i::int + 1)::varchar else i end)::int = len({need})"


ORACLE_SQL = {
    "token_estimates": rf"select doc_id, len(regexp_extract_all(text, '\S+'))::int as n_words, {sql_tokens('text')} as tokens, len({sql_sentences('text')})::int as n_sentences, length(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))::int as clean_chars from documents",
    "section_chunks": f"with {SQL_CHUNKS} select req_id, doc_id, pos, section, tokens, length(body)::int as chars from chunks",
    "wanted_sections": f"""with {SQL_CHUNKS}, w as (select doc_id // 10 as req_id, doc_id, section, section_pos, body from sections where doc_id % 3 <> 0 or section in ('s0', 's2'))
        select req_id, doc_id, (row_number() over (partition by req_id order by doc_id, section_pos) - 1)::int as pos, section, {sql_tokens('body')} as tokens from w""",
    "eligible_requests": f"with {SQL_CHUNKS} select req_id, sum(tokens)::bigint as tokens, count(*) as n from chunks group by 1 having sum(tokens) >= 1500 and count(*) > 1",
    "boilerplate_sentences": f"with {SQL_CHUNKS}, {SQL_BOILERPLATE} select * from repeated",
    "strip_boilerplate": f"with {SQL_CHUNKS}, {SQL_STRIPPED} select req_id, doc_id, pos, n_repeated, {sql_tokens('body')} as tokens, sha256(body) as body_sha from stripped",
    "window_section_first": f"""with {SQL_SCORED}, g as (select req_id, {_ORDERED} as l from scored where section <> 'repeated_reminders' group by 1),
        p as (select req_id, {_PACK.format('l', 'len(a.kept) > 0 and ', 800, '0::bigint')} as r from g)
        select req_id, r.used as used, array_to_string(list_sort(r.kept), ',') as kept from p""",
    "budget_sweep": f"""with {SQL_SCORED}, g as (select req_id, sum(tokens) as before, {_ORDERED} as l from scored where section <> 'repeated_reminders' group by 1),
        p as ({' union all '.join(f"select {b} as budget, before, {_PACK.format('l', 'len(a.kept) > 0 and ', b, '0::bigint')} as r from g" for b in BUDGETS)})
        select budget, count(*) as n, sum(before)::bigint as tokens_before, sum(r.used)::bigint as tokens_after, round_even(avg(len(r.kept)), 4) as mean_sections, round_even(1 - sum(r.used) / sum(before), 4) as saved_pct from p group by 1""",
    "window_hybrid": f"""with {SQL_SCORED}, {SQL_STRIPPED}, ds as (select req_id, doc_id, max(score) as s, min(pos) as first from scored group by 1, 2),
        top as (select req_id, arg_max(doc_id, (s, -first)) as top from ds group by 1),
        rows as (select c.req_id, t.top, c.doc_id, c.pos, c.score, {sql_tokens('s.body')} as tokens from scored c join stripped s using (req_id, pos) join top t using (req_id)),
        g as (select req_id, top, coalesce(sum(tokens) filter (doc_id = top), 0)::bigint as whole, coalesce(list(pos) filter (doc_id = top), []) as own,
          coalesce(list({{'used': tokens::bigint, 'kept': [pos]}} order by score desc, pos) filter (doc_id <> top), []) as l from rows group by 1, 2),
        p as (select req_id, top, own, {_PACK.format('l', '', 800, 'whole')} as r from g)
        select req_id, top, r.used as used, array_to_string(list_sort(list_concat(own, r.kept)), ',') as kept from p""",
    "near_documents": f"""with {SQL_SCORED}, ds as (select req_id, doc_id, max(score) as doc_score, min(pos) as first from scored group by 1, 2),
        r as (select *, row_number() over (partition by req_id order by doc_score desc, first)::int as rank, max(doc_score) over (partition by req_id) as best from ds)
        select req_id, doc_id, doc_score, rank from r where rank <= 3 and doc_score >= best - 0.1""",
    "mean_doc_scores": f"with {SQL_SCORED} select req_id, doc_id, round_even(sum(round_even(score * 1e6, 0)::bigint)::bigint / count(*) / 100::double, 0) / 10000::double + 0 as doc_score from scored group by 1, 2",
    "gold_rank": f"with {SQL_SCORED}, r as (select *, row_number() over (partition by req_id order by score desc, pos)::int as k from scored) select req_id, min(k) filter (doc_id % 10 = 2) as gold_rank from r group by 1",
    "sentence_prune": f"""with {SQL_CHUNKS}, e as (select req_id, pos, unnest(range(len(ss)))::int as i from (select req_id, pos, {sql_sentences('body')} as ss from chunks)),
        s as (select *, ((req_id * 7919 + pos * 104729 + i::bigint * 1299709) % 1009) / 1009 as score from e),
        r as (select *, row_number() over (partition by req_id order by score desc, pos, i) <= greatest(1, ceil(0.7::double * count(*) over (partition by req_id))) as k0, row_number() over (partition by req_id, pos order by score desc, i) as f from s),
        q as (select *, k0 or (not bool_or(k0) over (partition by req_id, pos) and f = 1) as k1 from r),
        n as (select *, bool_or(k1) over (partition by req_id, pos order by i rows between 1 preceding and 1 following) as k from q)
        select req_id, pos, count(*) as n_kept, string_agg(i, ',' order by i) as kept from n where k group by 1, 2""",
    "fact_coverage": f"""with f as (select d.doc_id, d.text, array_to_string(string_split(d.text, ' ')[2:4], ' ') as near, concat_ws(' ', string_split(d.text, ' ')[2], string_split(d.text, ' ')[6]) as apart, array_to_string(string_split(b.text, ' ')[1:3], ' ') as foreign_
        from documents d join (select *, row_number() over (order by item_id) - 1 as place from benchmark) b on b.place = d.doc_id % (select count(*) from benchmark))
        select doc_id, (contains(lower(text), lower(near))::int + contains(lower(text), lower(apart))::int + contains(lower(text), lower(foreign_))::int) as n_exact,
          {_loose('near', 'text')} as near_loose, {_loose('apart', 'text')} as apart_loose, {_loose('foreign_', 'text')} as foreign_loose from f""",
    "case_render": """select c_custkey, 'Order ' || c_custkey || ' for ' || coalesce(case when c_custkey % 4 <> 0 then c_name end, 'the signed-in customer') || '.' || chr(10) || '- segment: ' || c_mktsegment || chr(10) || '- nation: ' || n_name || chr(10) || '- in_debt: ' || case when c_acctbal < 0 then 'True' else 'False' end as rendered
        from customer left join nation on c_nationkey = n_nationkey""",
    "context_assemble": f"""with d as (select o_orderkey, o_orderstatus, '## ' || o_orderpriority || ' (' || o_orderkey || ')' || chr(10) || chr(10) || string_agg('### line ' || l_linenumber || chr(10) || 'part ' || l_partkey || ' returned ' || l_returnflag, chr(10) || chr(10) order by l_linenumber, 'line ' || l_linenumber, 'part ' || l_partkey || ' returned ' || l_returnflag) as doc
          from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderstatus, o_orderpriority),
        c as (select o_orderkey, case when o_orderkey % 5 <> 0 then '## Case' || chr(10) || 'Status ' || o_orderstatus || chr(10) || chr(10) else '' end || doc as context from d)
        select o_orderkey, sha256(context || chr(10) || chr(10) || '## Question' || chr(10) || 'What is open?') as prompt_sha, {sql_tokens('context')} as tokens from c""",
}
