"""From raw documents to packed training sequences: five stages, each written before the next one reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm import exact_dedup, language_id, ngram_join, packing, toxicity
from cladewise.llm.common import table, training_fold
from cladewise.session import written


def _rows(docs: DataFrame) -> DataFrame:
    """Each document as one column, so that an operator's column never meets one of the documents."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, whether or not a language was learned; texts that are null or have no letter go."""
    profiles = language_id.learn(docs.where(training_fold(F.col("doc_id"))))
    return language_id.identified(_rows(docs), profiles, F.col("row.text")).where("_language.letters").select("row.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    network = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(_rows(docs), network, F.col("row.text")).where("_toxicity < 0.5").select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five words, similarity 0.8), the smallest doc_id."""
    return ngram_join.representatives(docs, ngram_join.Rule(words=5, percent=80))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in windows of 2048."""
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), small=True)
    return packing.packed(cut).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("language ID", language_stage),
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("packing", packing_stage),
]

#: Profiles, a trained classifier and tokenizers can't be said in SQL: tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each result is a Parquet table that the next stage reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
