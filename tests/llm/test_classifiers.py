"""Held-out accuracy, and defined results for odd rows, of the toxicity and quality classifiers."""

import zlib

import pytest

from tallyspark.llm import quality, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture(scope="module")
def corpus():
    return "/root/testdata/sf0.01"


def labelled(spark, corpus, column):
    return {r.doc_id: r[column] for r in spark.read.parquet(f"{corpus}/labels.parquet").collect()}


def test_toxicity_on_the_held_out_fifth(spark, corpus):
    rows = queries.op2_toxicity(spark, corpus).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    truth = labelled(spark, corpus, "toxic")
    pairs = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in pairs) / len(pairs) >= 0.93


def test_quality_on_the_held_out_fifth(spark, corpus):
    rows = queries.op4_quality(spark, corpus).collect()
    assert len(rows) == 1000
    truth = labelled(spark, corpus, "quality")
    pairs = [(r.keep, truth[r.doc_id] == 1) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in pairs) / len(pairs) >= 0.9
    good = [k for k, t in pairs if t]
    assert sum(good) / len(good) >= 0.97


def test_labels_of_the_held_out_fifth_change_nothing(spark, corpus):
    docs, labels = spark.read.parquet(f"{corpus}/documents.parquet").where("doc_id < 400"), spark.read.parquet(f"{corpus}/labels.parquet").where("doc_id < 400")
    flipped = labels.withColumn("toxic", (1 - labels.toxic) * toxicity.held_out(labels.doc_id).cast("int") + labels.toxic * (~toxicity.held_out(labels.doc_id)).cast("int"))
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in toxicity.score_documents(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_features_see_lexicon_obfuscation_and_second_person():
    lexicon = toxicity.Lexicon({"zork*": 4.0, "idiot": 5.0})
    names = dict(zip(toxicity.FEATURES, toxicity.features("YOU are a Zorkling! an 1d10t and i.d.i.o.t", lexicon), strict=True))
    assert names["lexicon_hits"] == 1 and names["nearness"] == pytest.approx(1 / 3) and names["hidden_hits"] >= 1 and names["upper"] > 0
    assert toxicity.features("", lexicon) == [0.0] * len(toxicity.FEATURES)


def test_odd_rows_and_empty_tables(spark):
    rows = [(i, f"plain words number {i} " * 3, "en", "a", 9, "x") for i in range(60)] + [(100 + i, "you idiot zorkly fool $$$", None, None, None, None) for i in range(60)]
    rows += [(500, None, None, None, None, None), (501, "", "en", "a", 0, "x"), (501, "", "en", "a", 0, "x"), (None, "null id", "en", "a", -5, "x"), (502, "w " * 60_000, "en", "a", 9, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 1) for i in range(60)] + [(None, 1, 1), (3, None, None), (3, 1, 0), (900, 1, 1)], "doc_id long, quality int, toxic int")
    for found in (toxicity.score_documents(docs, labels), quality.score_documents(docs, labels)):
        got = found.collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 501}) == 1
    assert {r.predicted for r in toxicity.score_documents(docs, labels).collect() if r.doc_id is not None and 100 <= r.doc_id < 160} == {1}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score_documents(docs, none).collect()} == {0.0}
    assert {r.score for r in quality.score_documents(docs, none).collect()} == {0.0}
    assert {r.score for r in quality.score_documents(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert toxicity.score_documents(docs.limit(0), none).count() == quality.score_documents(docs.limit(0), none).count() == 0


def test_each_view_teaches_the_other_both_classes_in_each_round(spark, corpus):
    docs, labels = (spark.read.parquet(f"{corpus}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality._described(docs, ["doc_id", "lang", "source", "n_chars"])
    model = quality.fit(rows, labels)
    free = docs.join(labels.where("quality is not null"), "doc_id", "left_anti").count()
    assert len(model.exchanged) == quality.ROUNDS - 1
    for turn in model.exchanged:
        assert turn.keys() == {"meta", "text"}
        for passed in turn.values():
            assert passed.keys() == {0, 1} and abs(sum(passed.values()) - quality.SHARE * free) <= 0.02 * free


def test_a_lesson_is_the_surest_share_of_each_class(spark):
    said = spark.createDataFrame([(i, i / 1000, 0.8, i / 1000, 0.8) for i in range(1000)], "doc_id long, says_text double, says_meta double, text_score double, meta_score double")
    told = {r.doc_id: r for r in quality.lesson(said, "text", 0.1, 0.7).collect()}
    assert set(told) <= set(range(31)) | set(range(929, 1000)) and set(told) >= set(range(29)) | set(range(931, 1000))
    assert all(r.y == (i > 500) and 0 < r.weight <= 1 for i, r in told.items()) and told[0].weight == told[999].weight == 1
    # One value for all: still only the share, told apart by a hash, and with little weight.
    told = quality.lesson(said, "meta", 0.1, 0.7).collect()
    assert 90 <= len(told) <= 110 and {r.y for r in told} == {0.0, 1.0} and all(r.weight < 0.2 for r in told)
    assert quality.lesson(said.limit(0), "meta", 0.1, 0.7).count() == 0


def test_an_overconfident_view_teaches_by_its_calibrated_odds(spark):
    said = spark.createDataFrame([(i, i / 1000, 0.7 + i / 10**6) for i in range(1000)], "doc_id long, says_text double, text_score double")
    assert max(r.weight for r in quality.lesson(said, "text", 0.1, 0.7).collect()) < 0.02
