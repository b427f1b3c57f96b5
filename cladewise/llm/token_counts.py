"""Token counts through a cache of digests.

A text is known by the SHA-256 of its normalised content, a tokenizer by the
SHA-256 of its file.  Stored counts are joined on both digests; of the texts
without a stored count one copy per digest is encoded, and the new counts are
appended to the cache.  A second run over the same texts encodes nothing.

Texts are shuffled at most once, and only those of distinct misses: which row
stands for its digest is decided on keys alone, and a bitmap of bounded size
recognises those rows where they are read.

Defined cases: a null text is an empty one (no tokens); the count is that of
the library for the whole text, without begin, end or other added tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm.common import bitmap, map_runs, may_hold, text_or_empty
from cladewise.session import scratch_path, written

CACHE = "content_sha256 string, tokenizer_sha256 string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _counter(path: str):
    """Function from a list of texts to their token counts, of the library that the file is for."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(model.encode(t, add_special_tokens=False).ids) for t in texts]


def encoded_counts(texts: DataFrame, path: str, chunk: int = 64) -> DataFrame:
    """(content_sha256, text) -> (content_sha256, n_tokens); texts go through the library in small chunks."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(path)
        for batch in batches:
            bodies = batch["text"].tolist()
            counts = [n for i in range(0, len(bodies), chunk) for n in counter(bodies[i:i + chunk])]
            yield pd.DataFrame({"content_sha256": batch["content_sha256"], "n_tokens": counts})

    return map_runs(texts.select("content_sha256", "text"), count, "content_sha256 string, n_tokens long")


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; none where the folder doesn't exist yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache)


def token_counts(docs: DataFrame, path: str, cache: str | None = None, normalised: Column | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, content_sha256.

    ``normalised`` (the text with null as empty by default) is what is digested
    and encoded; ``cache`` is a folder that outlives the call, or a new one.
    The cache may hold a digest twice if two runs append at once; the counts
    are then equal and joined once.
    """
    spark = docs.sparkSession
    cache = cache or scratch_path(spark, "token-cache")
    version = tokenizer_digest(path)
    body = text_or_empty() if normalised is None else F.coalesce(normalised, F.lit(""))
    rows = docs.select("doc_id", body.alias("text")).withColumn("content_sha256", F.sha2("text", 256))
    keys = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content_sha256")

    def stored() -> DataFrame:
        known = read_cache(spark, cache).where(F.col("tokenizer_sha256") == version)
        return known.groupBy("content_sha256").agg(F.max("n_tokens").alias("n_tokens"))

    # One row per digest that is not stored: the smallest doc_id stands for it.
    misses = (
        keys.groupBy("content_sha256").agg(F.min("doc_id").alias("doc_id"))
        .join(stored(), "content_sha256", "left_anti")
        .withColumn("pair", F.struct("content_sha256", "doc_id"))
    )
    suspects = may_hold(rows, F.struct("content_sha256", "doc_id"), bitmap(misses, F.col("pair")))
    texts = (
        suspects.join(misses.select("content_sha256", F.col("doc_id").alias("_first")).hint("shuffle_hash"), "content_sha256")
        .where(F.col("doc_id").eqNullSafe(F.col("_first")))
    )
    (
        encoded_counts(texts, path).dropDuplicates(["content_sha256"])
        .select("content_sha256", F.lit(version).alias("tokenizer_sha256"), "n_tokens")
        .write.mode("append").parquet(cache)
    )
    # Written, so that a digest that many documents share is an ordinary skewed join.
    return keys.join(written(stored(), "counts"), "content_sha256", "left").select("doc_id", "n_bytes", "n_tokens", "content_sha256")
