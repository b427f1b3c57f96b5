"""Repeatable sampling: every draw is a function of a seed and of key columns.

Nothing here depends on partitioning or task order, so a recomputed task draws
the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HEX_DIGITS = 12
_RANGE = float(16**_HEX_DIGITS)


def _text(key) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("string")


def draw_order(seed, *keys) -> Column:
    """Sort key of a shuffled order: md5 of ``seed|key|...`` as hex text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string"),
                             *[_text(k) for k in keys]))


def uniform(seed, *keys) -> Column:
    """Uniform number in [0, 1) drawn for the keys."""
    return F.conv(F.substring(draw_order(seed, *keys), 1, _HEX_DIGITS), 16, 10).cast("double") / F.lit(_RANGE)


def uniform_int(seed, upper, *keys) -> Column:
    """Uniform whole number in ``0 .. upper-1`` drawn for the keys."""
    top = upper if isinstance(upper, Column) else F.lit(upper)
    return F.floor(uniform(seed, *keys) * top).cast("long")


def explode_range(df: DataFrame, count: str, name: str, block: int = 20_000) -> DataFrame:
    """One output row per whole number ``0 .. count-1`` of each input row.

    A row with a large count is first split in blocks which are spread over the
    tasks, so no task has to generate the whole range of one row.
    """
    blocks = F.floor((F.col(count) - 1) / F.lit(block)).cast("long")
    cut = (
        df.where(F.col(count) > 0)
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), blocks)))
        .repartition(*[F.col(c) for c in df.columns], F.col("_block"))
    )
    first = F.col("_block") * F.lit(block)
    last = F.least(first + F.lit(block - 1), F.col(count).cast("long") - 1)
    return cut.withColumn(name, F.explode(F.sequence(first, last))).drop("_block")


def distinct_numbers(totals: DataFrame, keys: list[str], total: str, wanted: int, seed, name: str,
                     own: list[str] | None = None) -> DataFrame:
    """``wanted`` distinct whole numbers of ``0 .. total-1`` for each row of ``totals``; all where there are no more.

    Up to ``4 * wanted`` numbers compete as a whole; of more, that many are drawn with replacement.  The first
    ``wanted`` distinct ones in hash order stay.  ``keys`` name the row in the draws; ``own`` tell rows apart
    (the keys, if not given).
    """
    own = own or keys
    rivals = explode_range(totals.withColumn("_rivals", F.least(F.col(total), F.lit(4 * wanted))), "_rivals", "_j")
    number = F.when(F.col(total) > 4 * wanted, uniform_int(seed, F.col(total), *keys, "_j")).otherwise(F.col("_j"))
    rivals = rivals.withColumn(name, number).drop("_j", "_rivals").distinct().withColumn(
        "_order", draw_order(seed, F.lit("pick"), *keys, name))
    first = Window.partitionBy(*own).orderBy("_order", name)  # at most 4 * wanted rows
    return rivals.withColumn("_no", F.row_number().over(first)).where(F.col("_no") <= wanted).drop("_order", "_no")
