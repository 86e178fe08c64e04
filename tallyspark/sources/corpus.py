"""Policy corpora: Markdown files with front matter, and documents pasted into a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import text

SECTIONS = "array<struct<name: string, body: string>>"


def _parts(body: Column) -> Column:
    """What follows each ``## `` heading, in order; text before the first is left out. ``# `` lines are dropped."""
    plain = F.regexp_replace(body, r"(?m)^# [^\n]*(\n|$)", "")
    parts = F.split(plain, r"(?m)^## ")
    return F.slice(parts, 2, F.size(parts))


def _section(part: Column) -> Column:
    return F.struct(text.strip(F.substring_index(part, "\n", 1)).alias("name"), text.strip(F.when(F.contains(part, F.lit("\n")), F.regexp_replace(part, r"^[^\n]*\n", "")).otherwise("")).alias("body"))


def sections_of(body: Column) -> Column:
    """Sections of a Markdown body as an ordered array; of a repeated heading the last text stands at the first place."""
    every = F.transform(_parts(body), _section)
    names = F.array_distinct(F.transform(every, lambda s: s["name"]))
    return F.transform(names, lambda n: F.element_at(F.filter(every, lambda s: s["name"] == n), -1))


def front_matter(whole: Column) -> Column:
    """The ``key: value`` lines between the first two ``---``, as a map; split at the first colon."""
    lines = F.filter(F.split(F.get(F.split(whole, "---", 3), F.lit(1)), "\n"), lambda x: F.contains(x, F.lit(":")))
    key = lambda x: text.strip(F.substring_index(x, ":", 1))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(key(x), text.strip(F.regexp_replace(x, r"^[^:]*:", "")))))


def read_corpus(spark: SparkSession, pattern: str, reminder: str | None = None) -> DataFrame:
    """(doc_id, title, topic, store, path, sections) of the files of a pattern, a file a row.

    A file that doesn't begin with ``---`` is an error. ``reminder`` replaces the text of every section that is named
    repeated_reminders.
    """
    files = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    sound = F.when(F.startswith("value", F.lit("---")), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no front matter in "), F.col("path"))))
    rows = files.select("path", sound.alias("value"))
    told = rows.select("path", front_matter(F.col("value")).alias("front"), sections_of(F.get(F.split("value", "---", 3), F.lit(2))).alias("sections"))
    if reminder is not None:
        told = told.withColumn("sections", F.transform("sections", lambda s: F.struct(s["name"].alias("name"), F.when(s["name"] == "repeated_reminders", F.lit(reminder)).otherwise(s["body"]).alias("body"))))
    field = lambda k: F.try_element_at("front", F.lit(k)).alias(k)
    return told.select(F.try_element_at("front", F.lit("id")).alias("doc_id"), field("title"), field("topic"), field("store"), "path", "sections")


def explode_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, title, section_pos, section, body)"""
    rows = docs.select("doc_id", "title", F.posexplode("sections").alias("section_pos", "s"))
    return rows.select("doc_id", "title", "section_pos", F.col("s.name").alias("section"), F.col("s.body").alias("body"))


def parse_pasted(docs: DataFrame) -> DataFrame:
    """Pasted documents (title, text) as doc_id, title and sections.

    Text before the first heading is the section ``main``, empty sections are dropped, and a text without any section
    is one ``main``. The id is ``custom_`` and a digest of title and text; an empty title is replaced by it.
    """
    body = F.regexp_replace("text", r"(?m)^# [^\n]*(\n|$)", "")
    head = F.struct(F.lit("main").alias("name"), text.strip(F.get(F.split(body, r"(?m)^## "), F.lit(0))).alias("body"))
    found = F.filter(F.concat(F.array(head), sections_of(F.col("text"))), lambda s: s["body"] != "")
    ident = F.concat(F.lit("custom_"), F.left(F.sha2(F.concat(F.coalesce("title", F.lit("")), "text"), 256), F.lit(10)))
    sections = F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(F.lit("main").alias("name"), F.col("text").alias("body"))))
    return docs.select(ident.alias("doc_id"), F.coalesce(F.nullif("title", F.lit("")), ident).alias("title"), sections.alias("sections"))
