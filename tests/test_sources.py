"""Readers and writers on small files."""

import json

import pytest

from tallyspark.sources import corpus, records

PAGE = """---
id: pol_a
title: Pick up: how
topic: pickup
store: any
---
# Heading
lost text
## overview
First line.
# dropped
Second line.
## rules

- one
## repeated_reminders
own text
"""


def test_markdown_corpus(spark, tmp_path):
    (tmp_path / "pol_a.md").write_text(PAGE)
    row = corpus.read_corpus(spark, f"{tmp_path}/pol_*.md", reminder="REMINDER").first()
    assert (row.doc_id, row.title, row.topic, row.store) == ("pol_a", "Pick up: how", "pickup", "any")
    assert [(s.name, s.body) for s in row.sections] == [("overview", "First line.\nSecond line."), ("rules", "- one"), ("repeated_reminders", "REMINDER")]
    (tmp_path / "pol_b.md").write_text("no front matter")
    with pytest.raises(Exception, match="no front matter"):
        corpus.read_corpus(spark, f"{tmp_path}/pol_*.md").collect()


def test_pasted_documents(spark):
    rows = [("T", "intro\n## a\nx\n## b\n\n## a\ny"), ("", "plain text"), ("U", "## only\n# gone\n")]
    got = corpus.parse_pasted(spark.createDataFrame(rows, "title string, text string")).collect()
    assert [(s.name, s.body) for s in got[0].sections] == [("main", "intro"), ("a", "y")]
    assert [(s.name, s.body) for s in got[1].sections] == [("main", "plain text")] and got[1].title == got[1].doc_id
    assert [s.name for s in got[2].sections] == ["main"] and got[2].doc_id.startswith("custom_") and len(got[2].doc_id) == 17


def test_cases_keep_order_and_render_booleans(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps({"c1": {"order_id": "7", "z": 3, "a": False, "customer": "Ann"}, "c2": {"order_id": "8"}}))
    got = {r.case_id: [(f.k, f.v) for f in r.fields] for r in records.read_cases(spark, f"{tmp_path}/cases.json").collect()}
    assert got == {"c1": [("order_id", "7"), ("z", "3"), ("a", "False"), ("customer", "Ann")], "c2": [("order_id", "8")]}


def test_queries_csv_json_and_memo(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "q002", "query": "b", "attachments": [{"doc_id": "d", "sections": ["s"]}]}\n{"id": "q001", "query": "a"}\n')
    rows = records.read_queries(spark, f"{tmp_path}/q.jsonl").orderBy("seq").collect()
    assert [(r.seq, r.query) for r in rows] == [(1, "a"), (2, "b")] and rows[1].attachments[0].sections == ["s"]
    df = spark.createDataFrame([(1, 'x,"y"\nz', ["a", "b"])], "i int, t string, l array<string>")
    records.write_csv(df, f"{tmp_path}/out.csv")
    records.write_csv(df, f"{tmp_path}/out.csv", mode="append")
    assert [tuple(r) for r in records.read_csv(spark, f"{tmp_path}/out.csv").collect()] == [("1", 'x,"y"\nz', "a|b")] * 2
    memo = spark.createDataFrame([("a", "b", "SAME", "SAME", 1, 1)], records.JUDGE_SCHEMA)
    records.write_json(memo, f"{tmp_path}/memo")
    fresh = spark.createDataFrame([("a", "b", "SAME", "", 1, 1), ("b", "a", "DIFFERENT", "", 1, 1), ("b", "a", "DIFFERENT", "", 1, 1)], records.JUDGE_SCHEMA)
    records.remember(records.read_memo(spark, f"{tmp_path}/memo"), fresh, f"{tmp_path}/memo")
    assert records.read_memo(spark, f"{tmp_path}/memo").count() == 2


def test_validation_and_config(spark):
    schema = "query string, budget int, mode string, doc_ids array<string>, attachments array<struct<doc_id: string, sections: array<string>>>"
    rows = [("ok", None, None, ["d"], None), ("", 800, "mock", ["d"], None), ("x" * 4001, 800, "mock", ["d"], None), ("ok", 100, "mock", ["d"], None), ("ok", 800, "odd", ["d"], None), ("ok", 800, "mock", None, None), ("ok", 800, "mock", ["d"], [("e", None)])]
    good, bad = records.validated(spark.createDataFrame(rows, schema))
    assert [[a.doc_id for a in r.attachments] for r in good.collect()] == [["d"], ["e"]] and bad.count() == 5
    config = records.read_config('[prices]\n"m" = [0.1, 0.5]\n')
    assert records.prices(spark, config).first()["price_out"] == 0.5
    assert len(records.config_version("p", ["a", "b"], 4000)) == 12 != records.config_version("q", ["a", "b"], 4000)
