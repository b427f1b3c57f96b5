"""Exact duplicates by progressive refinement, with DataFrame functions only.

1. Lengths (bytes) are counted; a text whose length no other text has is unique.
2. Of the rest, groups of one length are cut by a hash of their first characters.
3. Only texts whose (length, prefix hash) occurs at least twice are read as a
   whole and hashed with SHA-256.

The refinement moves keys (id, length, hashes) and never texts: survivors are
recognised where they are read, by a bitmap of bounded size, and the exact
joins that follow see digests only.

Defined cases: a null text equals an empty one.  Of equal texts the largest
doc_id stays; a null doc_id is smaller than any other.  Rows that repeat the
staying doc_id with the same text are the same document: all are marked
``kept``, and ``drop_copies`` leaves one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.llm.common import bitmap, flagged, text_or_empty
from cladewise.session import written

PREFIX_CHARS = 256


def _keys() -> tuple[Column, Column]:
    return F.octet_length(text_or_empty()), F.xxhash64(F.substring(text_or_empty(), 1, PREFIX_CHARS))


def _suspects(docs: DataFrame) -> DataFrame:
    """Bitmap of the (length, prefix hash) pairs that at least two rows share."""
    length, prefix = _keys()
    same_length = docs.groupBy(length.alias("length")).count().where("count > 1").select("length")
    pairs = docs.groupBy(length.alias("length"), prefix.alias("prefix")).count().where("count > 1")
    both = F.struct("length", "prefix")
    return written(bitmap(pairs.join(same_length, "length", "left_semi").select("length", "prefix"), both), "suspects")


def _digested(docs: DataFrame, suspects: DataFrame, carry: list[Column | str]) -> DataFrame:
    """Rows with ``_sha``: the digest of the whole text for suspects, else null (the text is not hashed)."""
    length, prefix = _keys()
    rows = docs.select(*carry, F.col("doc_id").alias("_id"), text_or_empty().alias("_body"),
                       F.struct(length.alias("length"), prefix.alias("prefix")).alias("_pair"))
    rows = flagged(rows, F.col("_pair"), suspects)
    return rows.withColumn("_sha", F.when(F.col("_hit"), F.sha2("_body", 256))).drop("_body", "_pair", "_hit")


def _groups(docs: DataFrame, suspects: DataFrame) -> DataFrame:
    per_id = _digested(docs, suspects, []).where("_sha is not null").groupBy("_sha", "_id").agg(F.count("*").alias("rows"))
    groups = per_id.groupBy("_sha").agg(
        F.max("_id").alias("keep_id"), F.sum("rows").alias("group_size"),
        F.max(F.struct("_id", "rows"))["rows"].alias("_keep_rows"),
    )
    return written(groups.where("group_size > 1"), "copies")


def copy_groups(docs: DataFrame) -> DataFrame:
    """Groups of at least two equal texts: text_sha256, keep_id, group_size."""
    return _groups(docs, _suspects(docs)).select(F.col("_sha").alias("text_sha256"), "keep_id", "group_size")


def _classified(docs: DataFrame, suspects: DataFrame, groups: DataFrame, carry: list[Column | str]) -> DataFrame:
    return _grouped(_digested(docs, suspects, carry), groups)


def _grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row with its group; rows of no group join on a key of their own, so that none gathers them."""
    own = F.concat(F.lit("id "), F.coalesce(F.col("_id").cast("string"), F.rand(1).cast("string")))
    rows = rows.withColumn("_key", F.coalesce("_sha", own)).drop("_sha")
    alone = F.col("group_size").isNull()
    return (
        rows.join(groups.withColumnRenamed("_sha", "_key"), "_key", "left")
        .withColumn("keep_id", F.when(alone, F.col("_id")).otherwise(F.col("keep_id")))
        .withColumn("kept", alone | F.col("_id").eqNullSafe(F.col("keep_id")))
        .withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
    )


def mark_copies(docs: DataFrame, *more: Column) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and the columns ``more`` of the document."""
    suspects = _suspects(docs)
    out = _classified(docs, suspects, _groups(docs, suspects), [F.struct(*more).alias("_more")] if more else [])
    own = out.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", *(["_more.*"] if more else []))
    return own


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns (also any named like this operator's)."""
    suspects = _suspects(docs)
    groups = _groups(docs, suspects)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    # Only suspects meet the groups; all others are unique and stay where they are.
    rows = _digested(docs, suspects, [row])
    alone = rows.where("_sha is null").select("_row")
    kept = _grouped(rows.where("_sha is not null"), groups).where("kept")
    if not groups.where("_keep_rows > 1").isEmpty():
        order = Window.partitionBy("_key").orderBy(F.to_json("_row"))
        repeated = kept.where("_keep_rows > 1").withColumn("_n", F.row_number().over(order)).where("_n = 1")
        kept = kept.where("_keep_rows is null or _keep_rows = 1").unionByName(repeated.drop("_n"))
    return kept.select("_row").unionByName(alone).select("_row.*")
