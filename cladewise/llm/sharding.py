"""Reproducible shuffle and shards by a Feistel permutation over global row numbers.

Rows are numbered 0..N-1 in the order of their key.  A Feistel network over the
mixed-radix domain a x b (a = ceil(sqrt N), b = ceil(N / a)) permutes the
numbers; a result of N or more is permuted again until it falls below N (cycle
walking).  At most ``a`` numbers of the domain lie outside, so walks are short
and always end.  The permuted number p gives shard p mod S and slot p div S: the
shards differ by one row at most, slots have no gaps, and both follow from the
row number, N, S and the seed alone.  ``inverse`` gives the row number back.

Only keys and row numbers are shuffled, by DataFrame functions throughout.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.session import written

ROUNDS = 6


def domain(rows: int) -> tuple[int, int]:
    """The sides a, b with a * b >= rows and a * b - rows < a."""
    a = math.isqrt(max(rows, 1) - 1) + 1
    return a, max(1, -(-rows // a))


def _quotient(value: Column, by: int) -> Column:
    """Whole quotient, without a detour over doubles."""
    return F.call_function("div", value, F.lit(by))


def _draw(step: int, seed: int, value: Column) -> Column:
    """A number below 2^52 that follows from the seed, the round and the other half."""
    digest = F.md5(F.concat_ws("-", F.lit(seed), F.lit(step), value.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def _turn(step: int, seed: int, a: int, b: int, sign: int) -> Callable[[Column], Column]:
    """One round: one half is moved (by ``sign``) by a number drawn from the other."""

    def turn(x: Column) -> Column:
        left, right = x["l"], x["r"]
        if step % 2 == 0:
            left = F.pmod(left + sign * F.pmod(_draw(step, seed, right), F.lit(a)), F.lit(a))
        else:
            right = F.pmod(right + sign * F.pmod(_draw(step, seed, left), F.lit(b)), F.lit(b))
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    return turn


def _permute(value: Column, a: int, b: int, seed: int, rounds: int, back: bool) -> Column:
    """One pass of the network, forwards or ``back``."""
    pair = F.struct((value % a).alias("l"), _quotient(value, a).alias("r"))
    for step in reversed(range(rounds)) if back else range(rounds):
        pair = F.transform(F.array(pair), _turn(step, seed, a, b, -1 if back else 1))[0]
    return F.transform(F.array(pair), lambda x: x["r"] * a + x["l"])[0]


def _walk(number: Column, rows: int, seed: int, rounds: int, back: bool) -> Column:
    a, b = domain(rows)
    steps = min(64, a * b - rows + 1)
    first = _permute(number, a, b, seed, rounds, back)
    if steps > 1:
        first = F.aggregate(
            F.array_repeat(F.lit(0), steps - 1), first,
            lambda x, _: F.when(x < rows, x).otherwise(_permute(x, a, b, seed, rounds, back)),
        )
    return F.when(first < rows, first).otherwise(F.raise_error(F.lit("a cycle walk did not end")))


def permuted(number: Column, rows: int, seed: int = 1, rounds: int = ROUNDS) -> Column:
    """The place of row ``number`` in the shuffle of ``rows`` rows."""
    return _walk(number, rows, seed, rounds, False)


def inverse(place: Column, rows: int, seed: int = 1, rounds: int = ROUNDS) -> Column:
    """The row number that stands at ``place``."""
    return _walk(place, rows, seed, rounds, True)


def numbered(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """``df`` with a gap-free long from 0 in the order of the columns, null first; equal rows in any order.

    Rows are range-partitioned and sorted, each partition numbers its own rows,
    and the partitions' counts give the offsets.  A draw is the last sort
    column, so that equal rows spread over partitions.  The numbered rows are
    written once: a lost executor can't number them anew.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in order]
    ranged = (
        df.withColumn("_draw", F.rand(7)).repartitionByRange(parts, *keys, "_draw")
        .sortWithinPartitions(*keys, "_draw").drop("_draw")
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33)).withColumn("_id", F.col("_id") - F.shiftleft("_part", 33))
    )
    ranged = written(ranged, "numbered")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    # One row per partition of the step above: as many as the session has shuffle partitions.
    offsets = counts.select(
        "_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before")
    )
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_id") + F.col("_before")).drop("_id", "_part", "_before")
    )


def sharded(df: DataFrame, order: list[str], shards: int = 16, seed: int = 1) -> DataFrame:
    """``df`` with row_number, place, shard and slot.

    Defined cases: an empty table stays empty; null keys come first; repeated
    rows are rows of their own and get places of their own.
    """
    rows = numbered(df, order)
    count = rows.count()
    place = permuted(F.col("row_number"), max(count, 1), seed)
    return (
        rows.withColumn("place", place)
        .withColumn("shard", (F.col("place") % shards).cast("int"))
        .withColumn("slot", _quotient(F.col("place"), shards))
    )
