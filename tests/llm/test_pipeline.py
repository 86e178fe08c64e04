import corpus_pipeline
from pyspark.sql import functions as F

from tallyspark import scratch
from tallyspark.llm import decontam, ngram_join, quality, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_each_stage_does_what_its_operator_decides(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = scratch.stage(stage(spark, docs, sf_dir), "kept")
        assert kept.columns == COLUMNS
        if name == "toxicity":
            gone = ids(toxicity.score_documents(docs, labels).where("predicted = 1"))
        elif name == "quality":
            gone = ids(quality.score_documents(docs, labels).where("score < 0.5"))
        elif name == "near_duplicates":
            gone = ids(ngram_join.classes(docs).where("doc_id <> class_id"))
            assert ngram_join.classes(kept).where("n_links > 0 and doc_id <> class_id").count() == 0
        else:
            gone = ids(decontam.find_leaks(docs, items))
        assert ids(kept) == ids(docs) - gone
        docs = kept
    packed = corpus_pipeline.pack(spark, docs, sf_dir)
    sums = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d"))
    assert sums.where("n <> d").count() == 0 and ids(sums) == ids(docs)


def test_odd_rows_pass_every_stage(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words that stand here", "en", "a", 3), (3, "some words that stand here", "en", "a", 3), (3, "some words that stand here", "en", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert (stage(spark, part, sf_dir).count() > 0) == bool(part.count())
    # One of each group: no-word texts share one, and so do the three copies, whichever have an id.
    assert sorted(str(r.doc_id) for r in corpus_pipeline.drop_copies(spark, docs, sf_dir).collect()) == ["1", "3"]


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row string, score string, x string, id string, content string, part string, keep boolean"


def test_rows_are_judged_by_their_own_values(spark, sf_dir):
    """Ids that repeat or miss, and columns named like those of the operators, change no row's fate."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    toxic = toxicity.judge_documents(docs, labels).where("predicted = 1").select("row.*").orderBy("doc_id").first().text
    clean = "the mill by the river was built long before the road came through the valley and it still stands today"
    other = "a quiet harbour town where fishing boats return at dusk and gulls follow them along the old stone pier"
    long = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
    one, two = 900_001, 900_002
    texts = [(one, clean), (one, other), (one, toxic), (None, toxic), (None, f"{clean} {item}"), (one, item), (None, clean), (None, clean), (two, long), (two, long), (None, "")]
    row = lambda i, t: (i, t, "en", "web", len(t), "r", "s", "x", "i", "c", "p", False)
    ours = spark.createDataFrame([row(*x) for x in texts], CLASHING)
    rows = docs.where("text <> ''").join(ours.drop(*COLUMNS).limit(1)).unionByName(ours)

    def kept(stage):
        found = stage(spark, rows, sf_dir)
        assert found.columns == rows.columns
        return sorted(((r.doc_id, r.text) for r in found.where("doc_id is null or doc_id > 900000").collect()), key=str)

    rejected = {r.text for r in toxicity.judge_documents(rows, labels).where("predicted = 1").select("row.text").collect()}
    assert toxic in rejected and clean not in rejected and other not in rejected
    assert kept(corpus_pipeline.drop_toxic) == sorted((x for x in texts if x[1] not in rejected), key=str)
    assert kept(corpus_pipeline.drop_leaks) == sorted((x for x in texts if item not in x[1]), key=str)
    # The toxic text is a copy of a document with a smaller id.
    single = [(one, clean), (one, other), (None, f"{clean} {item}"), (one, item), (two, long), (None, "")]
    assert kept(corpus_pipeline.drop_copies) == sorted(single, key=str)
    judged = kept(corpus_pipeline.keep_quality)
    assert set(judged) <= set(texts) and all(judged.count(x) in (0, texts.count(x)) for x in texts)
