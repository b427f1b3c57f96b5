"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cladewise.session import written


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def training_fold(doc_id: Column) -> Column:
    """True for documents that models may learn from: crc32(doc_id as text) mod 5 is not 0.

    A null doc_id belongs to neither fold: it is never learned from.
    """
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (u, v): one row (node, component) per node.

    ``component`` is the smallest node that is reachable.  Large-star and
    small-star steps alternate: every round is two grouped minima and two
    equi-joins, whatever the degree of a node, and the rounds grow with the
    logarithm of the longest path.  Each round is a written table.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = written(edges, "edges"), None
    while True:
        seen = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if seen == before or seen[0] == 0:
            break
        before = seen
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.inline(F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            )))
            .where("u <> v").distinct()
        )
        edges = written(small, "edges")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


BITMAP_SLOTS = 1 << 16


def _slot(key: Column, slots: int) -> Column:
    return F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(slots - 1))


def _bit(key: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), key.bitwiseAND(F.lit(63)).cast("int"))


def bitmap(keys: DataFrame, key: Column, slots: int = BITMAP_SLOTS) -> DataFrame:
    """A bitmap of the hashed ``key`` values: at most ``slots`` rows of 64 bits, whatever the input.

    Because of that bound it may be broadcast.  Where more values are set it
    only filters less; a test against it never loses a row that belongs.
    """
    hashed = F.xxhash64(key)
    return keys.groupBy(_slot(hashed, slots).alias("_slot")).agg(F.bit_or(_bit(hashed)).alias("_bits"))


def flagged(df: DataFrame, key: Column, bits: DataFrame, slots: int = BITMAP_SLOTS) -> DataFrame:
    """``df`` with ``_hit``: whether its ``key`` is set in the bitmap (a few others may be hit too)."""
    hashed = F.xxhash64(key)
    held = F.coalesce(F.col("_bits").bitwiseAND(_bit(hashed)) != 0, F.lit(False))
    return (
        df.withColumn("_slot", _slot(hashed, slots)).join(F.broadcast(bits), "_slot", "left")
        .withColumn("_hit", held).drop("_slot", "_bits")
    )


def may_hold(df: DataFrame, key: Column, bits: DataFrame, slots: int = BITMAP_SLOTS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is set in the bitmap; nothing is shuffled."""
    return flagged(df, key, bits, slots).where("_hit").drop("_hit")


RUN_BYTES, BATCH_ROWS = 2_000_000, 500


def small_batches(spark: SparkSession) -> None:
    """Let the session send at most ``BATCH_ROWS`` rows to Python at a time.

    The default of 10,000 rows is a bound on rows only: with texts of a megabyte
    one batch would hold gigabytes.  A smaller setting of the caller stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def runs(batch: pa.RecordBatch | pa.Array, size: int = RUN_BYTES) -> Iterator[pa.RecordBatch | pa.Array]:
    """A batch in slices of about ``size`` bytes, without copying; at least one row each."""
    step = max(1, int(len(batch) * size / max(batch.nbytes, 1)))
    for start in range(0, len(batch), step):
        yield batch.slice(start, step)


def give_back() -> None:
    """Hand freed memory back to the system, for Python workers stay alive between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def regrouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches cut and put together to tables of about ``size`` bytes."""
    held, total = [], 0
    for batch in batches:
        for part in runs(batch, size):
            held.append(part)
            total += part.nbytes
            if total >= size:
                yield pa.Table.from_batches(held)
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


def map_runs(
    df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, size: int = RUN_BYTES,
) -> DataFrame:
    """``mapInPandas`` over tables of about ``size`` bytes, whatever the length of texts.

    Spark sends batches by number of rows, so long texts make large ones and
    short texts small ones.
    """
    small_batches(df.sparkSession)
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = run(part.to_pandas() for part in regrouped(batches, size))
        for frame in frames:
            yield pa.RecordBatch.from_pandas(frame, schema=fields, preserve_index=False)
        give_back()

    return df.mapInArrow(mapped, schema)


def by_size(texts: list[str], chars: int = 2_000_000) -> Iterator[list[int]]:
    """The positions of the texts, in runs of about ``chars`` characters (a longer text is a run of its own)."""
    run, size = [], 0
    for i, text in enumerate(texts):
        if run and size + len(text) > chars:
            yield run
            run, size = [], 0
        run.append(i)
        size += len(text)
    if run:
        yield run


def interned(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Lists of strings as (distinct strings, the place of each string among them, bounds of the lists)."""
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), lists.offsets.to_numpy()


def rows_of(flat: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs ``flat[start[i]:start[i] + size[i]]`` for each i of ``at``, one after another."""
    size = size[at]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(start[at] - (ends - size), size)]
