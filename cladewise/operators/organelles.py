"""Mitochondrial variant fractions and extrachromosomal haplotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.functions.ranking import number_rows
from cladewise.functions.sampling import draw_order
from cladewise.functions.scalars import alternate, ones, variant_name


def variant_fractions(variants: DataFrame, genomes_per_cell: DataFrame) -> DataFrame:
    """Carrier genomes over all genomes of the cell per (position, allele) (M1).

    ``genomes_per_cell`` counts genomes without variants as well.
    """
    counts = variants.groupBy("cell", "position", "allele").agg(F.count_distinct("genome").alias("variant_genomes"))
    return counts.join(genomes_per_cell, "cell").withColumn(
        "variant_fraction", F.col("variant_genomes") / F.col("genomes")).drop("genomes")


def burden(fractions: DataFrame, cells: DataFrame) -> DataFrame:
    """Count, sum, mean and max of variant fractions per cell, 0 without variants (M2)."""
    f = F.col("variant_fraction")
    checked = F.when((f > 0) & (f <= 1), f).otherwise(F.raise_error(F.lit("variant fractions lie in (0, 1]")))
    stats = fractions.groupBy("cell").agg(
        F.count(F.lit(1)).alias("variants"), F.sum(checked).alias("fraction_sum"),
        F.avg(checked).alias("fraction_mean"), F.max(checked).alias("fraction_max"))
    joined = cells.select("cell").distinct().join(stats, "cell", "left")
    return joined.na.fill(0).na.fill(0.0)


def genome_order(genomes: DataFrame, seed) -> DataFrame:
    """Rank of every genome in one shuffled order of its cell (M3)."""
    return number_rows(genomes.select("cell", "genome").distinct().withColumn("_order", draw_order(seed, "cell", "genome")),
                       ["cell"], ["_order", "genome"], "genome_rank").drop("_order")


def depth_panels(variants: DataFrame, order: DataFrame, depths: list[int]) -> DataFrame:
    """Variant fractions among the first d genomes of each cell for several depths (M3)."""
    fits = F.filter(F.array(*[F.lit(d) for d in depths]), lambda d: F.col("genome_rank") <= d)
    rows = variants.join(order, ["cell", "genome"]).withColumn("depth", F.explode(fits))
    return rows.groupBy("depth", "cell", "position", "allele").agg(
        (F.count_distinct("genome") / F.col("depth")).alias("fraction"))


def variant_manifest(variants: DataFrame, reference: DataFrame) -> DataFrame:
    """Distinct variants with reference and alternate text (M4)."""
    seen = variants.select("position", "allele").distinct()
    return seen.join(reference, "position", "left").select(
        variant_name(F.col("position"), F.col("allele")).alias("feature"), "position", "allele", "reference",
        alternate(F.col("allele")).alias("alternate"), F.lit("0=not_observed;1=observed").alias("encoding"))


def shared_universe(panels: DataFrame, samples: DataFrame) -> DataFrame:
    """Panel entries of features seen at the deepest depth in the sampled cells (M5)."""
    deepest = panels.agg(F.max("depth").alias("d")).select("d").scalar()
    seen = panels.where(F.col("depth") == deepest).join(samples, "cell", "left_semi").select("position", "allele").distinct()
    return panels.join(samples, "cell", "left_semi").join(seen, ["position", "allele"], "left_semi")


def ecdna_summary(haplotypes: DataFrame, targets: int) -> DataFrame:
    """Copies, species and copy-weighted edited fraction per cell (M6)."""
    labeled = F.col("labeled")
    return haplotypes.groupBy("cell").agg(
        F.sum("count").alias("total_copies"),
        F.coalesce(F.sum(F.when(labeled, F.col("count"))), F.lit(0)).alias("labeled_copies"),
        F.count_distinct("species").alias("species"),
        F.count_distinct(F.when(labeled, F.col("species"))).alias("labeled_species"),
        F.coalesce(F.try_divide(
            F.sum(F.when(labeled, ones(F.col("haplotype")) * F.col("count"))),
            F.sum(F.when(labeled, F.col("count"))) * targets), F.lit(0.0)).alias("edit_fraction"))


def haplotype_table(haplotypes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Haplotypes with species names and edit counts (M7)."""
    return haplotypes.join(manifest, "species").withColumn("edit_count", ones(F.col("haplotype")))


def collapse_haplotypes(haplotypes: DataFrame) -> DataFrame:
    """Identical haplotypes of a cell as one row with summed counts (M9)."""
    return haplotypes.groupBy("cell", "species", "labeled", "haplotype").agg(F.sum("count").alias("count"))


def copy_matrix(haplotypes: DataFrame) -> DataFrame:
    """Copies per cell and labelled species (M8)."""
    return haplotypes.where("labeled").groupBy("cell", F.col("species").cast("string").alias("feature")).agg(
        F.sum("count").cast("double").alias("value")).where("value > 0")


def edited_fraction_matrix(haplotypes: DataFrame, targets: int) -> DataFrame:
    """Edited share of labelled copies per cell, species and target (M8)."""
    edited = [F.sum(F.when(F.substring("haplotype", t, 1) == "1", F.col("count")).otherwise(0)).alias(f"t{t}")
              for t in range(1, targets + 1)]
    per = haplotypes.where("labeled").groupBy("cell", "species").agg(F.sum("count").alias("_copies"), *edited)
    rows = per.where("_copies > 0").select("cell", "species", "_copies", F.inline(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(f"t{t}").alias("_edited")) for t in range(1, targets + 1)])))
    return rows.where("_edited > 0").select(
        "cell", F.concat_ws("_", "species", "target").alias("feature"), (F.col("_edited") / F.col("_copies")).alias("value"))


def variants_at_thresholds(fractions: DataFrame, thresholds: list[float]) -> DataFrame:
    """Variants per cell at each fraction threshold."""
    fits = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("variant_fraction") >= t)
    return fractions.withColumn("threshold", F.explode(fits)).groupBy("threshold", "cell").agg(
        F.count(F.lit(1)).alias("variants"))


def variant_sharing(fractions: DataFrame, founders: DataFrame, at_least: int = 5) -> DataFrame:
    """Variants in enough cells, their founder-private share and most founders of one."""
    per = fractions.join(founders, "cell").groupBy("position", "allele").agg(
        F.count_distinct("cell").alias("cells"), F.count_distinct("founder").alias("founders")).where(F.col("cells") >= at_least)
    return per.agg(
        F.count(F.lit(1)).alias("shared_variants"), F.avg((F.col("founders") == 1).cast("int")).alias("founder_private_share"),
        F.max("founders").alias("max_founders"))


def covariates(tips: DataFrame, parts: dict[str, tuple[DataFrame, dict[str, object]]], key: str = "cell") -> DataFrame:
    """Tips with optional covariate tables; cells a table does not know get its defaults."""
    wide = tips
    for table, defaults in parts.values():
        wide = wide.join(table.select(key, *defaults), key, "left")
        for name, default in defaults.items():
            if default is not None:
                wide = wide.withColumn(name, F.coalesce(F.col(name), F.lit(default)))
    return wide


def modality_union(matrices: dict[str, DataFrame]) -> DataFrame:
    """Feature tables of several modalities as one, features prefixed by modality."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [
        m.select("cell", F.lit(name).alias("modality"), F.concat(F.lit(f"{name}:"), "feature").alias("feature"), "value")
        for name, m in matrices.items()])


def modality_gaps(matrices: dict[str, DataFrame], cells: DataFrame) -> DataFrame:
    """Cells of a modality that the sample table does not hold."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [
        m.select("cell").distinct().join(cells.select("cell"), "cell", "left_anti").withColumn("modality", F.lit(name))
        for name, m in matrices.items()])


def cyclic_assignment(targets: DataFrame, pool: DataFrame, pool_size: Column) -> DataFrame:
    """Catalogue row of each target, starting over when the catalogue ends."""
    wanted = targets.withColumn("pool_index", F.pmod(F.col("target_index") - 1, pool_size) + 1)
    return wanted.join(pool, "pool_index")


def explicit_assignment(targets: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalogue row of each target by id, and the targets whose id is unknown."""
    return targets.join(pool, "guide_id"), targets.join(pool, "guide_id", "left_anti")


def mark_blocks(targets: DataFrame, pool: DataFrame, pool_size: int, marks: int) -> DataFrame:
    """Blocks of marks per target with the chance of each mark.

    The chance is the share of the block's efficiency, equal when all are zero.
    """
    if marks > pool_size:
        raise ValueError("a target cannot hold more marks than the catalogue")
    rows = targets.withColumn("mark_index", F.explode(F.sequence(F.lit(1), F.lit(marks)))).withColumn(
        "pool_index", F.pmod((F.col("target_index") - 1) * marks + F.col("mark_index") - 1, F.lit(pool_size)) + 1).join(
        pool, "pool_index")
    totals = rows.groupBy("target_index").agg(F.sum("efficiency").alias("_total"))
    return rows.join(totals, "target_index").withColumn(
        "mark_probability", F.when(F.col("_total") > 0, F.col("efficiency") / F.nullif("_total", F.lit(0.0))).otherwise(
            F.lit(1.0 / marks))).drop("_total")
