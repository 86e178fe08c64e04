"""Token counts with a digest cache: only texts whose digest is not stored for this tokenizer are encoded."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import scratch
from tallyspark.llm.batches import sliced, small_batches

#: Digests that one task remembers while it drops repeats ahead of the shuffle.
REMEMBERED = 200_000
#: Texts per call of the tokenizer.
SLICE = 256
#: Words of 64 bits in the filter of missing digests: rows of a broadcast table, at most, however many digests miss.
FILTER_WORDS = 1 << 18


def tokenizer_digest(path: str) -> str:
    """The tokenizer's version: a digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts by the file's library, without begin, end or added special tokens, truncation or padding."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def normalised(text: Column) -> Column:
    """Null is the empty text. Nothing else may be folded, since any change of a text can change its count."""
    return F.coalesce(text, F.lit(""))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compress texts and drop repeats that this task has seen, so that copies don't cross the network."""
    seen: set[bytes] = set()
    press = zstandard.ZstdCompressor(level=1)
    for batch in sliced(batches):
        digests, blobs = [], []
        for digest, text in zip(batch["digest"], batch["text"], strict=True):
            if (d := digest.as_py()) not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(d)
                digests.append(d)
                blobs.append(press.compress(text.as_py().encode()))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(blobs, pa.binary())], ["digest", "packed"])


def _encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by digest: a text is encoded where its digest first appears."""
        count, open_up, last = counter(path), zstandard.ZstdDecompressor(), None
        for batch in batches:
            all_digests, digests, counts = batch["digest"].to_pylist(), [], []
            for at in range(0, len(all_digests), SLICE):
                texts = []
                for i in range(at, min(at + SLICE, len(all_digests))):
                    if all_digests[i] != last:
                        last = all_digests[i]
                        digests.append(last)
                        texts.append(open_up.decompress(batch["packed"][i].as_py()).decode())
                counts += count(texts) if texts else []
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return encode


def _stored(spark: SparkSession, table: str) -> DataFrame | None:
    """The cache's rows; None as long as the table doesn't exist."""
    try:
        return spark.read.schema("digest binary, n_tokens long").parquet(table)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) to every row; counts of new texts join the cache.

    ``cache`` is a folder of Parquet tables, one per tokenizer version, created when missing. Null texts count as
    empty, repeated rows get equal counts, an empty table changes nothing. Columns of the input that are named like a
    new one are replaced.
    """
    content, digest = _keyed(text)
    table = add_misses(docs, cache, tokenizer, text)
    new = ("n_bytes", "n_tokens", "over_limit", "digest")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    # Two writers at once may store a digest twice, with the same count. Written, so that the join has shuffles of its
    # own and a digest that very many rows share can be split.
    counts = scratch.stage(_stored(docs.sparkSession, table).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    keyed = docs.select(*kept, F.octet_length(content).cast("long").alias("n_bytes"), digest)
    return keyed.join(counts, "digest", "left").drop("digest").withColumn("over_limit", F.col("n_tokens") > limit)


def _keyed(text: str) -> tuple[Column, Column]:
    content = normalised(F.col(f"`{text}`"))
    return content, F.unhex(F.sha2(content, 256)).alias("digest")


def _signed(rows: DataFrame) -> DataFrame:
    """Rows with the filter's ``word`` for their digest and a ``mask`` of up to three bits in it."""
    bits = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(_h, {k}) & 63 as int))" for k in (40, 46, 52))
    signed = rows.withColumn("_h", F.xxhash64("digest"))
    return signed.withColumn("word", F.pmod("_h", F.lit(FILTER_WORDS))).withColumn("mask", F.expr(bits)).drop("_h")


def may_miss(rows: DataFrame, missing: DataFrame) -> DataFrame:
    """The rows whose digests may be among the missing ones: all that are, and few others."""
    words = _signed(missing).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    return _signed(rows).join(F.broadcast(words), "word").where("bits & mask = mask").select(*rows.columns)


def missing_texts(docs: DataFrame, stored: DataFrame | None, text: str = "text") -> DataFrame:
    """(digest, packed): the texts that ``stored`` lacks, all rows of a digest in one partition (repeats are possible).

    Digests meet the cache first. Those it lacks fill a filter of bits, a table of FILTER_WORDS rows at most that is
    broadcast, so of the texts that the cache has nearly none is shuffled; the join after it is exact. At 4 missing
    digests a word 1 in 150 of the others passes; the more are missing, the less the filter can spare.
    """
    content, digest = _keyed(text)
    whole = docs.select(digest, content.alias("text"))
    if stored is None:
        return whole.mapInArrow(_packed, "digest binary, packed binary").repartition("digest")
    missing = scratch.stage(docs.select(digest).distinct().join(stored.hint("merge"), "digest", "left_anti"), "missing")
    return may_miss(whole, missing).mapInArrow(_packed, "digest binary, packed binary").join(missing.hint("merge"), "digest", "left_semi")


def add_misses(docs: DataFrame, cache: str, tokenizer: str, text: str = "text") -> str:
    """Encode the distinct texts that the cache lacks and append their counts; returns the version's table."""
    spark = docs.sparkSession
    small_batches(spark)
    table = f"{cache.rstrip('/')}/tokenizer={tokenizer_digest(tokenizer)}"
    misses = missing_texts(docs, _stored(spark, table), text)
    misses.sortWithinPartitions("digest").mapInArrow(_encoder(tokenizer), "digest binary, n_tokens long").write.mode("append").parquet(table)
    return table
