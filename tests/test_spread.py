"""Documents meet all test items and all vectors, also beyond the sizes that the SQL knows."""

from tallyspark.plans import context_queries, tables


def write(spark, folder, **tables_):
    for name, (rows, schema) in tables_.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_documents_meet_all_items(spark, tmp_path):
    """Item k's first three words stand in document k; ids have gaps."""
    docs = [(k, f"start of text number k{k} here: it{k} em{k} ok{k} end.") for k in range(90)]
    items = [(3 * k, f"it{k} em{k} ok{k} more words") for k in range(45)]
    write(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
    got = {r.doc_id: r.foreign_loose for r in context_queries.fact_coverage(spark, str(tmp_path)).collect()}
    assert got == {k: k < 45 for k in range(90)}


def test_sections_meet_all_vectors(spark, tmp_path):
    """Vector k is (k, 1) with id 2 k, so a score tells both places."""
    docs = [(k, f"one line {k}", "src1") for k in range(40)]
    vecs = [(2 * k, [float(k), 1.0]) for k in range(600)]
    write(spark, tmp_path, documents=(docs, "doc_id long, text string, source string"), embeddings=(vecs, "vec_id long, embedding array<float>"))
    got = {r.doc_id: (r.req_id, r.pos, r.score) for r in tables.scored(spark, str(tmp_path)).collect()}
    assert got.keys() == set(range(40))
    for k, (req, pos, score) in got.items():
        assert score == (k * 31 + pos * 17) % 600 * req + 1
    assert any((k * 31 + pos * 17) % 600 >= 500 for k, (_, pos, _) in got.items())
