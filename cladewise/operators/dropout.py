"""Missing-data injection, sampling and recovery, repeatable by hash draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.functions.ranking import number_rows
from cladewise.functions.sampling import draw_order, uniform


def conditions(unit_rates: list[float], cell_rates: list[float]) -> Column:
    """Every condition of a dropout grid as an array of structs."""
    return F.array(*[F.struct(F.lit(float(u)).alias("unit_dropout"), F.lit(float(c)).alias("cell_dropout"))
                     for u in unit_rates for c in cell_rates])


def with_conditions(recording: DataFrame, unit_rates: list[float], cell_rates: list[float]) -> DataFrame:
    """The recording once per condition."""
    return recording.select("*", F.inline(conditions(unit_rates, cell_rates)))


def drop_units(recording: DataFrame, seed) -> DataFrame:
    """Lose whole units per cell: all characters of a lost unit become missing."""
    lost = uniform(seed, "unit_dropout", "cell_dropout", "cell", "unit") < F.col("unit_dropout")
    return recording.withColumn("edited", F.when(~lost, F.col("edited")))


def drop_cells(recording: DataFrame, seed) -> DataFrame:
    """Lose whole cells."""
    return recording.where(uniform(seed, "unit_dropout", "cell_dropout", "cell") >= F.col("cell_dropout"))


def drop_empty_cells(recording: DataFrame, keys: list[str]) -> DataFrame:
    """Leave out cells with nothing observed (D3)."""
    seen = recording.where(F.col("edited").isNotNull()).select(*keys, "cell").distinct()
    return recording.join(seen, [*keys, "cell"], "left_semi")


def missing_fraction(recording: DataFrame, keys: list[str]) -> DataFrame:
    """Missing share over informative characters, with their number.

    Every cell that is left counts for every character of its group.
    """
    cells = recording.groupBy(*keys).agg(F.count_distinct("cell").alias("cells"))
    sites = recording.groupBy(*keys, "unit", "site").agg(
        F.count("edited").alias("_seen"), F.sum("edited").alias("_edits")).where(
        (F.col("_seen") >= 2) & (F.col("_edits") > 0) & (F.col("_edits") < F.col("_seen")))
    totals = sites.groupBy(*keys).agg(F.count(F.lit(1)).alias("informative_characters"), F.sum("_seen").alias("_seen"))
    return totals.join(cells, keys).select(
        *keys, "cells", "informative_characters",
        (1 - F.col("_seen") / (F.col("cells") * F.col("informative_characters"))).alias("missing_fraction"))


def recover_units(units: DataFrame, rate: float, seed) -> DataFrame:
    """Units recovered per cell, each with the same chance.

    Independent draws per unit give the same distribution as a binomial count
    followed by a sample of that many units.
    """
    return units.where(uniform(seed, "cell", "unit") < rate)


def recover_share(rows: DataFrame, keys: list[str], identity: list[str], rate: float, seed) -> DataFrame:
    """Exactly ``ceil(n * rate)`` rows of each group in hash order."""
    ordered = rows.withColumn("_order", draw_order(seed, *identity))
    numbered = number_rows(ordered, keys, ["_order", *identity], "_no")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return numbered.join(counts, keys).where(F.col("_no") <= F.ceil(F.col("_n") * F.lit(float(rate)))).drop(
        "_order", "_no", "_n")


def cap_rows(rows: DataFrame, keys: list[str], identity: list[str], most: int, seed) -> DataFrame:
    """At most so many rows per group in hash order."""
    ordered = rows.withColumn("_order", draw_order(seed, *identity))
    return number_rows(ordered, keys, ["_order", *identity], "_no").where(F.col("_no") <= most).drop("_order", "_no")


def select_cells(cells: DataFrame, seed, number: int | None = None, fraction: float | None = None) -> DataFrame:
    """A fixed number of cells or a share of them."""
    if (number is None) == (fraction is None):
        raise ValueError("give a number or a fraction")
    if number is not None:
        return cap_rows(cells, [], ["cell"], number, seed)
    return cells.where(uniform(seed, "cell") < fraction)


def recovery_grid(fractions: dict[str, list[float]]) -> list[tuple[str, dict[str, float]]]:
    """Name and rates of every combination of per-type recovery fractions."""
    combos: list[dict[str, float]] = [{}]
    for kind, values in fractions.items():
        combos = [{**c, kind: x} for x in values for c in combos]
    return [("_".join(f"{k}-{x:g}" for k, x in c.items()), c) for c in combos]


def recover_by_type(cells: DataFrame, fractions: dict[str, list[float]], seed) -> DataFrame:
    """Living terminal cells kept with their type's chance, once per combination.

    Types without a fraction are never kept; combinations without any cell have
    no rows, which the caller reports by ``empty_combinations``.
    """
    grid = F.array(*[F.struct(F.lit(name).alias("combination"), F.create_map(*[
        x for k, r in rates.items() for x in (F.lit(k), F.lit(float(r)))]).alias("rates")) for name, rates in recovery_grid(fractions)])
    rows = cells.where(F.col("terminal") & F.col("alive")).select("cell", "cell_type", F.inline(grid))
    chance = F.coalesce(F.try_element_at("rates", F.col("cell_type")), F.lit(0.0))
    return rows.where(uniform(seed, "combination", "cell") < chance).drop("rates")


def empty_combinations(spark, recovered: DataFrame, fractions: dict[str, list[float]]) -> DataFrame:
    """Combinations that kept no cell and are skipped."""
    names = spark.createDataFrame([(n,) for n, _ in recovery_grid(fractions)], "combination string")
    return names.join(recovered.select("combination").distinct(), "combination", "left_anti")
