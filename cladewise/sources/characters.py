"""Text exports of character matrices and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.functions.ranking import number_rows


def _states(matrix: DataFrame, cells: DataFrame) -> DataFrame:
    """States of every cell as one text over all features in name order.

    Absent entries are 0, null entries ``?``.  Features are numbered in name
    order; a cell's entries are put in that order and the gaps between them are
    filled, so a row only ever holds its own entries and the text it becomes.
    """
    named = matrix.select("feature").distinct()
    numbers = number_rows(named, [], ["feature"], "_no")
    total = named.agg(F.count(F.lit(1)).cast("int").alias("n")).select("n").scalar()
    value = F.when(F.col("value").isNull(), "?").when(F.pmod("value", F.lit(1.0)) == 0, F.col("value").cast("bigint").cast("string")).otherwise(
        F.col("value").cast("string"))
    entries = matrix.join(numbers, "feature").groupBy("cell").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_no").cast("int").alias("no"), value.alias("state")))).alias("_e"))
    rows = cells.select("cell").distinct().join(entries, "cell", "left").withColumn("columns", total)

    def zeros(n: Column) -> Column:
        return F.repeat(F.lit("0"), n)

    def filled(entry: Column, place: Column) -> Column:
        before = F.when(place > 0, F.get("_e", place - 1)["no"]).otherwise(0)
        return F.concat(zeros(entry["no"] - before - 1), entry["state"])

    tail = zeros(F.col("columns") - F.element_at("_e", -1)["no"])
    states = F.when(F.col("_e").isNull(), zeros(F.col("columns"))).otherwise(
        F.concat(F.array_join(F.transform("_e", filled), ""), tail))
    return rows.select("cell", states.alias("states"), "columns")


def fasta(matrix: DataFrame, cells: DataFrame) -> DataFrame:
    """Character-state FASTA, one record per cell."""
    return _states(matrix, cells).select("cell", F.concat(F.lit(">"), F.col("cell").cast("string"), F.lit("\n"), "states").alias("record"))


def phylip(matrix: DataFrame, cells: DataFrame) -> DataFrame:
    """Relaxed PHYLIP: header ``cells columns`` first, then one line per cell."""
    states = _states(matrix, cells)
    header = states.agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.max("columns").cast("string")).alias("line")).select(
        F.lit(0).alias("place"), F.lit(None).cast("string").alias("cell"), "line")
    return header.unionByName(states.select(F.lit(1).alias("place"), F.col("cell").cast("string").alias("cell"),
                                            F.concat_ws(" ", F.col("cell").cast("string"), "states").alias("line")))


def sequence_fasta(sequences: DataFrame, name: Column) -> DataFrame:
    """FASTA records of reconstructed sequences."""
    return sequences.select(F.concat(F.lit(">"), name, F.lit("\n"), "sequence").alias("record"))


def write_records(records: DataFrame, path: str, column: str, order: list[str]) -> None:
    """Write text records in order; files follow each other by name."""
    records.orderBy(*order).select(column).write.text(path)
