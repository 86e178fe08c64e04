"""Context windows: rendering, sections, boilerplate, and budgeted selection of sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark import scratch
from tallyspark.functions import text

REMINDER_SECTION = "repeated_reminders"
#: Below so many tokens a context is passed whole.
LEAST_TOKENS = 1500
BUDGET = 800
#: Words of 64 bits in the filter of wanted sentences: rows of a broadcast table, at most, however many are wanted.
FILTER_WORDS = 1 << 18


def render_case(order_id: Column, customer: Column, fields: Column) -> Column:
    """A header line and a line per field; ``fields`` is an ordered array of (k, v) with string values."""
    head = F.concat(F.lit("Order "), order_id, F.lit(" for "), F.coalesce(customer, F.lit("the signed-in customer")), F.lit("."))
    shown = F.filter(fields, lambda f: ~f.k.isin("id", "order_id", "customer"))
    return F.array_join(F.concat(F.array(head), F.transform(shown, lambda f: F.concat(F.lit("- "), f.k, F.lit(": "), f.v))), "\n")


def render_boolean(value: Column) -> Column:
    return F.initcap(value.cast("string"))


def render_document(title: Column, ident: Column, sections: Column) -> Column:
    """Title and sections, blank lines between; ``sections`` is an ordered array of (name, body)."""
    head = F.concat(F.lit("## "), title, F.lit(" ("), ident, F.lit(")"))
    return F.array_join(F.concat(F.array(head), F.transform(sections, lambda s: F.concat(F.lit("### "), s["name"], F.lit("\n"), s["body"]))), "\n\n")


def assemble(case: Column, documents: Column) -> Column:
    """A case block, left out where there is no case, and the documents in order."""
    return F.array_join(F.concat(F.when(case.isNotNull(), F.array(F.concat(F.lit("## Case\n"), case))).otherwise(F.array().cast("array<string>")), documents), "\n\n")


def prompt(query: Column, context: Column) -> Column:
    return F.concat(context, F.lit("\n\n## Question\n"), query)


def optimised(case: Column, kept: Column) -> Column:
    """What is sent in place of the whole context: the case block and the kept sections, an ordered array of (header,
    body), blank lines between."""
    shown = F.transform(kept, lambda s: F.concat(F.lit("## "), s["header"], F.lit("\n"), s["body"]))
    return F.array_join(F.concat(F.when(case.isNotNull(), F.array(F.concat(F.lit("## Case\n"), case))).otherwise(F.array().cast("array<string>")), shown), "\n\n")


def chunks(attachments: DataFrame, sections: DataFrame) -> DataFrame:
    """(req_id, doc_id, pos, section, header, body, tokens): the attached sections in document order.

    ``attachments`` has (req_id, att_pos, doc_id, wanted): a null or empty ``wanted`` attaches all sections.
    """
    every = attachments.join(sections, "doc_id").where(F.coalesce(F.size("wanted"), F.lit(0)).isin(0, -1) | F.array_contains("wanted", F.col("section")))
    return in_order(every)


def in_order(attached: DataFrame) -> DataFrame:
    """The same for sections that have their request already: (req_id, att_pos, doc_id, title, section_pos, section, body)."""
    order = Window.partitionBy("req_id").orderBy("att_pos", "section_pos")
    return attached.select(
        "req_id",
        "doc_id",
        (F.row_number().over(order) - 1).alias("pos"),
        "section",
        F.concat_ws(" - ", "title", "section").alias("header"),
        "body",
        text.approx_tokens(F.col("body")).alias("tokens"),
    )


def eligible(sections: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Requests that are worth a window: enough tokens, those of a case (req_id, case_tokens) among them, and more than
    one section."""
    found = sections.groupBy("req_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    if cases is not None:
        found = found.join(cases, "req_id", "left").withColumn("tokens", F.col("tokens") + F.coalesce("case_tokens", F.lit(0))).drop("case_tokens")
    return found.where((F.col("tokens") >= LEAST_TOKENS) & (F.col("n") > 1))


def boilerplate(sections: DataFrame, least_docs: int = 3) -> DataFrame:
    """(sentence, n_docs) of sentences that at least ``least_docs`` documents hold."""
    each = hashed_sentences(sections)
    # Each document's sentences are counted once, then partial sums meet per sentence: a hot sentence is one row a task.
    if least_docs > 1:
        # Only hashes are counted, as most texts are not wanted.
        counted = each.select("doc_id", "h", "g").distinct().groupBy("h", "g").agg(F.count("*").alias("n_docs"))
        return told(counted.where(F.col("n_docs") >= least_docs), each)
    return each.select("doc_id", "sentence").distinct().groupBy("sentence").agg(F.count("*").alias("n_docs"))


def united_boilerplate(corpus: DataFrame, pasted: DataFrame) -> DataFrame:
    """The repeated sentences of the corpus and those of a request's own documents, each once."""
    return corpus.select("sentence").union(pasted.select("sentence")).distinct()


def boilerplate_hashes(sections: DataFrame, least_docs: int = 3) -> DataFrame:
    """(h): the hashes of ``boilerplate``; no sentence is shuffled."""
    each = sections.select("doc_id", F.explode(F.array_distinct(F.transform(text.sentences(F.col("body")), lambda s: F.xxhash64(s)))).alias("h"))
    return each.distinct().groupBy("h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least_docs).select("h")


def hashed_sentences(sections: DataFrame) -> DataFrame:
    """(doc_id, h, g, sentence): each section's sentences with 96 bits of hashes, which stand for the text where it is counted."""
    each = sections.select("doc_id", F.explode(F.array_distinct(text.sentences(F.col("body")))).alias("sentence"))
    return each.select("doc_id", F.xxhash64("sentence").alias("h"), F.hash("sentence").alias("g"), "sentence")


def _signed(rows: DataFrame) -> DataFrame:
    """Rows with the filter's ``word`` for their hash and a ``mask`` of up to three bits in it."""
    bits = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(h, {k}) & 63 as int))" for k in (40, 46, 52))
    return rows.withColumn("word", F.pmod("h", F.lit(FILTER_WORDS))).withColumn("mask", F.expr(bits))


def told(counted: DataFrame, texts: DataFrame) -> DataFrame:
    """(sentence, n_docs) of counts (h, g, n_docs), each hash once, from texts (h, g, sentence) that may repeat.

    A filter of bits lets few texts pass whose hashes aren't counted, so few are shuffled, each once a task; the join after
    it is exact.
    """
    # Read twice.
    counted = scratch.stage(counted, "counted-sentences")
    words = _signed(counted).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    near = _signed(texts).join(F.broadcast(words), "word").where("bits & mask = mask")
    return near.select("h", "g", "sentence").distinct().join(counted, ["h", "g"]).select("sentence", "n_docs")


def repeated_places(sections: DataFrame, repeated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, i): the places of repeated sentences in their sections. ``repeated`` has sentences, or their hashes (h)."""
    # Sentences meet by hash, so that no text is compared with a key that is frequent by definition.
    each = sections.select(*keys, F.posexplode(F.transform(text.sentences(F.col("body")), lambda s: F.xxhash64(s))).alias("i", "h"))
    known = repeated.select("h" if "h" in repeated.columns else F.xxhash64("sentence").alias("h")).distinct()
    return each.join(known, "h").drop("h")


def bared(body: Column, at: Column, drop_ratio: float = 0.3) -> Column:
    """The body without the sentences at some places (null: none); null if those are too many."""
    told, n = text.sentences(body), F.coalesce(F.size(at), F.lit(0))
    rest = F.array_join(F.filter(told, lambda s, i: ~F.array_contains(at, i)), " ")
    return F.when(at.isNull(), body).when(n / F.size(told) < drop_ratio, rest)


def strip_boilerplate(sections: DataFrame, repeated: DataFrame, drop_ratio: float = 0.3, keys: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """Sections (``keys`` and body) without repeated sentences; ones that mostly consisted of them are dropped.

    A section without any keeps its body as it is; others get their sentences joined by a blank.
    """
    at = repeated_places(sections, repeated, keys).groupBy(*keys).agg(F.collect_list("i").alias("_at"))
    found = sections.join(at, list(keys), "left").withColumn("n_repeated", F.when(F.col("_at").isNull(), 0).otherwise(F.size("_at")).cast("long"))
    found = found.withColumn("_bare", bared(F.col("body"), F.col("_at"), drop_ratio)).where(F.col("_at").isNull() | F.col("_bare").isNotNull())
    return found.withColumn("body", F.col("_bare")).drop("_at", "_bare").withColumn("tokens", text.approx_tokens(F.col("body")))


def pack_sections(ordered: Column, budget: int = BUDGET) -> Column:
    """Greedy packing of an ordered array of (pos, tokens): the first always, then whatever still fits.

    A section that would overflow is skipped and smaller ones after it are tried, so a running sum can't express it.
    Gives (used, kept positions in selection order).
    """
    return F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept")),
        lambda a, c: F.when((F.size(a.kept) > 0) & (a.used + c.tokens > budget), a).otherwise(F.struct((a.used + c.tokens).alias("used"), F.array_append(a.kept, c.pos).alias("kept"))),
    )


def fill_sections(ordered: Column, used: Column, budget: int = BUDGET) -> Column:
    """The same on top of what is used already; not even the first is kept if it overflows."""
    return F.aggregate(
        ordered,
        F.struct(used.cast("long").alias("used"), F.array().cast("array<int>").alias("kept")),
        lambda a, c: F.when(a.used + c.tokens > budget, a).otherwise(F.struct((a.used + c.tokens).alias("used"), F.array_append(a.kept, c.pos).alias("kept"))),
    )


def section_first(scored: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(req_id, used, kept): sections (req_id, pos, section, tokens, score) by score, reminders left out."""
    rows = scored.where(F.col("section") != REMINDER_SECTION).groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "pos", "tokens"))).alias("ordered"))
    packed = rows.select("req_id", pack_sections(F.col("ordered"), budget).alias("p"))
    return packed.select("req_id", F.col("p.used").alias("used"), F.array_sort("p.kept").alias("kept"))


def doc_scores(scored: DataFrame, method: str = "max") -> DataFrame:
    """(req_id, doc_id, doc_score, first): the best or mean section score of each document."""
    score = F.max("score") if method == "max" else F.avg("score")
    return scored.groupBy("req_id", "doc_id").agg(score.alias("doc_score"), F.min("pos").alias("first"))


def near_documents(scores: DataFrame, gap: float = 0.05, max_docs: int = 3) -> DataFrame:
    """The top document of each request and those within ``gap`` of it, among the first ``max_docs``."""
    ranked = Window.partitionBy("req_id").orderBy(F.desc("doc_score"), "first")
    best = F.max("doc_score").over(Window.partitionBy("req_id"))
    return scores.withColumn("rank", F.row_number().over(ranked)).withColumn("best", best).where((F.col("rank") <= max_docs) & (F.col("doc_score") >= F.col("best") - gap)).drop("best")


def hybrid(scored: DataFrame, stripped: DataFrame, method: str = "max", budget: int = BUDGET) -> DataFrame:
    """(req_id, top, used, kept, n_docs): the top document whole, over budget even, then the best sections of others that
    fit.

    ``scored`` holds all sections with the scores of their full text, ``stripped`` (req_id, pos, tokens) those that
    boilerplate left over.
    """
    top = doc_scores(scored, method).groupBy("req_id").agg(F.max(F.struct("doc_score", (-F.col("first")).alias("minus"), "doc_id")).alias("t")).select("req_id", F.col("t.doc_id").alias("top"))
    rows = scored.drop("tokens").join(stripped.select("req_id", "pos", "tokens"), ["req_id", "pos"]).join(top, "req_id")
    mine, other = F.col("doc_id") == F.col("top"), F.struct((-F.col("score")).alias("minus"), "pos", "tokens", "doc_id")
    grouped = rows.groupBy("req_id", "top").agg(
        F.coalesce(F.sum(F.when(mine, F.col("tokens"))), F.lit(0)).alias("whole"),
        F.collect_list(F.when(mine, F.col("pos"))).alias("own"),
        F.array_sort(F.collect_list(F.when(~mine, other))).alias("ordered"),
    )
    packed = grouped.select("req_id", "top", "own", "ordered", fill_sections(F.col("ordered"), F.col("whole"), budget).alias("p"))
    others = F.array_distinct(F.transform(F.filter("ordered", lambda x: F.array_contains("p.kept", x.pos)), lambda x: x.doc_id))
    n_docs = F.size(others) + F.when(F.size("own") > 0, 1).otherwise(0)
    return packed.select("req_id", "top", F.col("p.used").alias("used"), F.array_sort(F.concat("own", "p.kept")).alias("kept"), n_docs.alias("n_docs"))


def prune_sentences(scored: DataFrame, keep_ratio: float = 0.7, neighbours: int = 0) -> DataFrame:
    """Sentences (req_id, pos, i, score) that stay: the best share of a request, at least one a section, and those
    within ``neighbours`` of a kept one in its section."""
    request, section = Window.partitionBy("req_id"), Window.partitionBy("req_id", "pos")
    ranked = scored.withColumn("r", F.row_number().over(request.orderBy(F.desc("score"), "pos", "i"))).withColumn("n", F.count("*").over(request))
    first = F.row_number().over(section.orderBy(F.desc("score"), "i"))
    kept = ranked.withColumn("kept", F.col("r") <= F.greatest(F.lit(1), F.ceil(F.lit(float(keep_ratio)) * F.col("n")))).withColumn("s", first)
    kept = kept.withColumn("kept", F.col("kept") | (~F.max("kept").over(section) & (F.col("s") == 1)))
    around = section.orderBy("i").rowsBetween(-neighbours, neighbours)
    return kept.withColumn("kept", F.max("kept").over(around)).where("kept").select(*scored.columns)


def best_gold_rank(scored: DataFrame, gold: Column) -> DataFrame:
    """(req_id, gold_rank): the place of the best gold section by score; null without any."""
    ranked = scored.withColumn("r", F.row_number().over(Window.partitionBy("req_id").orderBy(F.desc("score"), "pos")))
    return ranked.groupBy("req_id").agg(F.min(F.when(gold, F.col("r"))).alias("gold_rank"))
