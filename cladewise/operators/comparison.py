"""Side-by-side comparison of recorded and modelled molecule sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.operators.observations import allele_spectrum, molecule_statistics, target_pairs
from cladewise.operators.tables import share_of_total


def _target_table(molecules: DataFrame, dataset: str) -> DataFrame:
    return molecules.groupBy(dataset, "target").agg(
        F.avg((F.col("call") != "0").cast("int")).alias("rate"), F.count_distinct("call").alias("alleles"))


def _per_molecule(molecules: DataFrame, dataset: str) -> DataFrame:
    keyed = molecules.withColumn("mol", F.struct(dataset, "mol"))
    return molecule_statistics(keyed).withColumn(dataset, F.col(f"mol.{dataset}"))


def rescored(molecules: DataFrame, deleted: Column, state: str = "-1") -> DataFrame:
    """Molecules under an encoding in which every deletion is one state."""
    return molecules.withColumn("call", F.when(deleted, F.lit(state)).otherwise(F.col("call")))


def _pairs(molecules: DataFrame, dataset: str, targets: list[int]) -> DataFrame:
    return target_pairs(molecules, targets, [dataset])


def long_comparison(molecules: DataFrame, dataset: str, matched: DataFrame | None = None,
                    targets: list[int] | None = None) -> DataFrame:
    """Feature, level, dataset, value rows of every set.

    ``matched`` holds re-scored molecules under a dataset name of their own; they show calls and spans
    only.  Entropies and, by gap, means over pairs of ``targets`` are given where these are named.
    """
    table, stats = _target_table(molecules, dataset), _per_molecule(molecules, dataset)
    if matched is not None:
        stats = stats.unionByName(_per_molecule(matched, dataset))

    def levels(value: str, feature: str) -> DataFrame:
        counts = stats.groupBy(dataset, F.col(value).alias("level")).agg(F.count(F.lit(1)).alias("n"))
        return share_of_total(counts, "n", [dataset], "value").select(
            F.lit(feature).alias("feature"), F.col("level").cast("long").alias("level"), dataset, "value")

    def by_level(rows: DataFrame, level: str, column: str, feature: str) -> DataFrame:
        return rows.select(F.lit(feature).alias("feature"), F.col(level).cast("long").alias("level"), dataset,
                           F.col(column).cast("double").alias("value"))

    parts = [by_level(table, "target", "rate", "per-target editing rate"), levels("distinct_calls", "distinct calls per molecule"),
             levels("span", "largest shared span"), by_level(table, "target", "alleles", "distinct alleles per target")]
    if targets:
        spectrum, pairs = allele_spectrum(molecules, [dataset]), _pairs(molecules, dataset, targets)
        parts += [by_level(spectrum, "target", "normalised_entropy", "normalised entropy per target"),
                  by_level(pairs, "gap", "phi", "pairwise phi"),
                  by_level(pairs, "gap", "same_given_both", "P(same allele | both edited)")]
    return reduce(DataFrame.unionByName, parts)


def headline(molecules: DataFrame, dataset: str, real: str = "real", simulated: str = "simulated",
             matched: DataFrame | None = None, targets: list[int] | None = None) -> DataFrame:
    """Headline metrics of the two sets and their ratio.

    ``matched`` holds the re-scored molecules of the real set, under its name; the two metrics under
    the matched encoding take them in its place.  ``targets`` names the targets that pairs are made of;
    pairs with a target that does not vary have no phi and are left out of its mean.
    """
    # The names of the metrics.
    table = _target_table(molecules, dataset).groupBy(dataset).agg(
        F.avg("rate").alias("mean per-target editing rate"),
        (F.max("rate") - F.min("rate")).alias("spread of per-target rate"),
        F.percentile(F.col("alleles").cast("double"), 0.5).alias("median distinct alleles per target"))
    stats = _per_molecule(molecules, dataset).groupBy(dataset).agg(
        F.avg("distinct_calls").alias("mean distinct calls per molecule"),
        F.avg((F.col("span") == 0).cast("int")).alias("molecules with no edited target"),
        F.avg((F.col("span") >= 4).cast("int")).alias("molecules where one event spans >= 4 targets"))
    joined = table.join(stats, dataset)
    if matched is not None:
        same = matched.unionByName(molecules.where(F.col(dataset) == simulated))
        joined = joined.join(_per_molecule(same, dataset).groupBy(dataset).agg(
            F.avg("distinct_calls").alias("mean distinct calls, real re-scored as the simulator encodes"),
            F.avg((F.col("span") >= 7).cast("int")).alias("one event spans >= 7 targets, matched encoding")), dataset)
    if targets:
        joined = joined.join(allele_spectrum(molecules, [dataset]).groupBy(dataset).agg(
            F.avg("normalised_entropy").alias("mean normalised entropy per target")), dataset)
        joined = joined.join(_pairs(molecules, dataset, targets).groupBy(dataset).agg(
            F.avg("phi").alias("mean pairwise phi between targets"),
            F.try_divide(F.sum("same_call"), F.sum("n11")).alias("P(same allele | both edited)")), dataset)
    long = joined.unpivot([dataset], [c for c in joined.columns if c != dataset], "metric", "value")
    wide = long.groupBy("metric").agg(
        F.max(F.when(F.col(dataset) == real, F.col("value"))).alias("real"),
        F.max(F.when(F.col(dataset) == simulated, F.col("value"))).alias("simulated"))
    return wide.withColumn("ratio", F.try_divide("simulated", "real"))
