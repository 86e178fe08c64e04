import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyspark import scratch
from tallyspark.llm import queries, tokencount

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_tokens string"
ROWS = [(1, "Hello world"), (2, ""), (3, None), (4, "Hello world"), (4, "Hello world"), (5, "<s> </s> <unk>"), (6, "é\u00a0😀 " * 9000), (None, "x")]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_of_the_library(spark, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        tokenizer = Tokenizer.from_file(path)
        count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA)
    got = sorted(tuple(map(str, (r.doc_id, r.n_bytes, r.n_tokens, r.over_limit))) for r in tokencount.count_tokens(df, scratch.fresh(spark, "cache"), path).collect())
    assert got == sorted(tuple(map(str, (i, len((t or "").encode()), count(t or ""), count(t or "") > 4096))) for i, t in ROWS)


def test_only_misses_are_encoded_and_appended(spark):
    cache = scratch.fresh(spark, "cache")
    first = spark.createDataFrame([(1, "one"), (2, "one"), (3, "two words")], "doc_id long, text string")
    tokencount.count_tokens(first, cache, MODEL).collect()
    table = spark.read.parquet(f"{cache}/tokenizer={tokencount.tokenizer_digest(MODEL)}")
    assert table.count() == 2
    # A stored count is used as it stands, so a doctored one shows that nothing is encoded again.
    other = scratch.fresh(spark, "cache")
    table.withColumn("n_tokens", table.n_tokens + 100).write.parquet(f"{other}/tokenizer={tokencount.tokenizer_digest(MODEL)}")
    more = spark.createDataFrame([(1, "one"), (9, "three more words")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(more, other, MODEL).collect()}
    assert got[1] > 100 > got[9]
    assert spark.read.parquet(f"{other}/tokenizer={tokencount.tokenizer_digest(MODEL)}").count() == 3


def test_texts_of_hits_stay_where_they_are(spark):
    """Of 3,000 stored texts hardly one passes the filter that lets all 50 missing ones through."""
    docs = spark.range(3050).selectExpr("id as doc_id", "concat('text ', id) as text").repartition(4)
    digests = docs.selectExpr("doc_id", "unhex(sha2(text, 256)) as digest", "0L as n_tokens")
    stored = digests.where("doc_id < 3000").drop("doc_id")
    texts = tokencount.missing_texts(docs, stored)
    assert {bytes(r.digest) for r in texts.collect()} == {bytes(r.digest) for r in digests.where("doc_id >= 3000").collect()}
    passed = tokencount.may_miss(docs.selectExpr("unhex(sha2(text, 256)) as digest", "text"), digests.where("doc_id >= 3000"))
    assert 50 <= passed.count() <= 60
    assert tokencount.missing_texts(docs.where("doc_id < 3000"), stored).count() == 0


def test_one_digest_of_a_third_of_the_rows(spark):
    rows = [(i, "the hot text" if i % 3 == 0 else f"text {i}") for i in range(900)]
    cache = scratch.fresh(spark, "cache")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    tokencount.count_tokens(df.where("doc_id < 400 and doc_id % 3 > 0"), cache, MODEL).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(df, cache, MODEL).collect()}
    assert got == {i: len(model.encode(t)) for i, t in rows}


def test_empty_table(spark):
    assert tokencount.count_tokens(spark.createDataFrame([], "doc_id long, text string"), scratch.fresh(spark, "cache"), MODEL).count() == 0


def test_query_over_the_table(spark, sf_dir):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op8_token_counts(spark, sf_dir).collect()}
    assert got == {d.doc_id: (len(d.text.encode()), n := len(model.encode(d.text)), n > 4096) for d in docs}
