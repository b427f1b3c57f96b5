"""Character encodings of recordings, kept as long (cell, feature, value) rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.functions.ranking import number_rows
from cladewise.functions.sampling import draw_order
from cladewise.functions.scalars import feature_name, sequence_piece


def allele_matrix(alleles: DataFrame, positions: list[int] | None = None) -> DataFrame:
    """Sparse allele matrix at output positions."""
    kept = alleles.where(F.col("allele") != 0)
    if positions is not None:
        kept = kept.where(F.col("position").isin(positions))
    return kept.select("cell", feature_name(F.col("unit"), F.col("position")).alias("feature"), F.col("allele").alias("value"))


def binary_matrix(matrix: DataFrame) -> DataFrame:
    """Every nonzero entry becomes 1."""
    return matrix.where(F.col("value") != 0).withColumn("value", F.lit(1.0))


def units_up_to(alleles: DataFrame, k: int) -> DataFrame:
    """Entries of the first k units (P10)."""
    return alleles.where(F.col("unit") <= k)


def ranked_windows(windows: DataFrame, positions: DataFrame) -> DataFrame:
    """Window positions that exist as columns, ranked in listed order per target."""
    known = windows.join(positions.select("position").distinct(), "position", "left_semi")
    order = Window.partitionBy("target").orderBy("listed")  # positions of one target
    return known.withColumn("rank", F.row_number().over(order))


def window_problems(windows: DataFrame, ranked: DataFrame, capacity: int = 52) -> DataFrame:
    """Targets without any known position or with more than the mask can hold."""
    none = windows.select("target").distinct().join(ranked.select("target"), "target", "left_anti").withColumn(
        "problem", F.lit("no_positions"))
    many = ranked.where(F.col("rank") > capacity).select("target").distinct().withColumn("problem", F.lit("too_many_positions"))
    return none.unionByName(many)


def window_bitmask(alleles: DataFrame, ranked: DataFrame) -> DataFrame:
    """Mask per cell, unit and logical target: the edited position of rank j adds 2^(j-1)."""
    edited = alleles.where(F.col("allele") != 0).select("cell", "unit", "position").distinct()
    bits = F.expr("shiftleft(1L, rank - 1)")
    # the layout has one row per window position of the recorder
    placed = edited.join(ranked.select("target", "position", bits.alias("_bit")), "position")
    return placed.groupBy("cell", F.concat(F.lit("int_"), "unit", F.lit("_target_"), "target").alias("feature")).agg(
        F.sum("_bit").alias("value"))


def target_layout(ranked: DataFrame, is_mark: bool = False) -> DataFrame:
    """Targets with their positions as text and how their states are encoded."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "position")))
    text = F.array_join(F.transform(listed, lambda s: s["position"].cast("string")), ";")
    # The texts that tell readers how states are written.
    encoding = ("0=unedited;1=assigned_mark" if is_mark
                else "nonzero integer bitmask over logical_positions in listed order; 0=unedited")
    return ranked.groupBy("target").agg(text.alias("logical_positions")).withColumn("encoding", F.lit(encoding))


STATES = ["left", "right", "both"]


def one_hot_states(states: DataFrame) -> DataFrame:
    """States 1, 2, 3 as one column each, value 1; other states are an error."""
    kind = F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("state").cast("int"))
    name = F.concat(F.lit("int_"), "unit", F.lit("_"), "bit", F.lit("_"), kind)
    wrong = F.raise_error(F.concat(F.lit("state must be 0, 1, 2 or 3, not "), F.col("state").cast("string")))
    return states.where(F.col("state") != 0).select(
        "cell", F.when(F.col("state").isin(1, 2, 3), name).otherwise(wrong).alias("feature"), F.lit(1.0).alias("value"))


def characters_by_alphabet(matrix: DataFrame) -> DataFrame:
    """Mark identity where the recorder has several marks, else presence."""
    return matrix.where(F.col("value") != 0).withColumn(
        "value", F.when(F.col("alphabet") > 1, F.col("value")).otherwise(F.lit(1.0))).drop("alphabet")


def unit_target_layout(units: DataFrame, targets: list[tuple[int, int]]) -> DataFrame:
    """Every unit with every (target, position) of the recorder."""
    return units.select("unit", F.inline(F.array(*[
        F.struct(F.lit(t).alias("target"), F.lit(p).alias("position")) for t, p in targets]))).withColumn(
        "feature", feature_name(F.col("unit"), F.col("position")))


def unique_mutation_matrix(alleles: DataFrame, kind: str, recovered: DataFrame | None = None) -> DataFrame:
    """Score matrix with one column per distinct mutation.

    ``bc`` counts (unit, position, value); ``mt`` gives the share of the cell's
    recovered units that carry (position, value).
    """
    seen = alleles.where(F.col("allele") != 0)
    value = F.when(F.pmod("allele", F.lit(1.0)) == 0, F.col("allele").cast("bigint").cast("string")).otherwise(
        F.col("allele").cast("string"))
    if kind == "bc":
        name = F.concat_ws("_", F.lit("bc"), "unit", "position", value)
        return seen.groupBy("cell", name.alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    name = F.concat_ws("_", F.lit("mt"), "position", value)
    counts = seen.groupBy("cell", name.alias("feature")).agg(F.count(F.lit(1)).alias("_n"))
    totals = recovered.groupBy("cell").agg(F.count_distinct("unit").alias("_units"))
    return counts.join(totals, "cell", "left").select(
        "cell", "feature", F.coalesce(F.try_divide(F.col("_n"), F.col("_units")), F.lit(0.0)).alias("value"))


def with_control_column(matrix: DataFrame, cells: DataFrame) -> DataFrame:
    """A recording without any mutation becomes one zero column ``control``."""
    n = matrix.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    control = cells.select("cell", F.lit("control").alias("feature"), F.lit(0.0).alias("value")).where(n == 0)
    return matrix.unionByName(control)


def threshold_variants(matrix: DataFrame, thresholds: list[float], binarise: list[bool]) -> DataFrame:
    """One matrix per threshold and binarise flag; entries below the threshold are zero, so absent."""
    options = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(b).alias("binary"))
                        for t in thresholds for b in binarise])
    kept = F.filter(options, lambda o: (F.col("value") >= o["threshold"]) & (F.col("value") > 0))
    return matrix.select("cell", "feature", F.col("value").alias("_v"), F.inline(kept)).select(
        "cell", "feature", "threshold", "binary",
        F.when(F.col("binary"), F.lit(1.0)).otherwise(F.col("_v")).alias("value"))


def sequences(alleles: DataFrame, molecules: DataFrame, reference: str | Column, prefix: Column | None = None) -> DataFrame:
    """Sequence of every (cell, unit): reference with its alleles applied.

    One group holds at most one entry per reference position.
    """
    calls = alleles.groupBy("cell", "unit").agg(
        F.map_from_entries(F.collect_list(F.struct("position", "allele"))).alias("_calls"))
    letters = F.split(F.lit(reference) if isinstance(reference, str) else reference, "")
    joined = molecules.join(calls, ["cell", "unit"], "left").withColumn("_ref", F.filter(letters, lambda x: x != ""))
    pieces = F.transform("_ref", lambda letter, i: sequence_piece(F.try_element_at("_calls", (i + 1).cast("int")), letter))
    text = F.array_join(pieces, "")
    return joined.withColumn("sequence", F.concat(prefix, text) if prefix is not None else text).drop("_calls", "_ref")


def mask_unrecovered(matrix: DataFrame, cells: DataFrame, recovered: DataFrame) -> DataFrame:
    """Explicit missing entries: a mutation on a unit the cell never recovered is null, not 0.

    ``matrix`` has ``cell, unit, feature, value``.  Only the (cell, unit) pairs
    that were not recovered are listed; all other absent rows still mean 0.
    """
    units = matrix.select("unit", "feature").distinct()
    per_cell = recovered.groupBy("cell").agg(F.collect_set("unit").alias("_units"))  # units of one cell
    every = matrix.select("unit").distinct().agg(F.collect_set("unit").alias("_all")).select("_all").scalar()
    missing = cells.select("cell").distinct().join(per_cell, "cell", "left").select(
        "cell", F.explode(F.array_except(every, F.coalesce(F.col("_units"), F.array().cast("array<int>")))).alias("unit"))
    hidden = missing.join(units, "unit").select("cell", "unit", "feature", F.lit(None).cast("double").alias("value"))
    seen = matrix.join(recovered.select("cell", "unit").distinct(), ["cell", "unit"], "left_semi")
    return seen.select("cell", "unit", "feature", "value").unionByName(hidden)


def deletion_runs(deletions: DataFrame) -> DataFrame:
    """Consecutive deleted positions as one row: last position and ``d<length>``."""
    order = Window.partitionBy("cell", "unit").orderBy("position")  # positions of one barcode
    run = deletions.select("cell", "unit", "position").distinct().withColumn(
        "_run", F.col("position") - F.row_number().over(order))
    return run.groupBy("cell", "unit", "_run").agg(
        F.max("position").alias("position"), F.concat(F.lit("d"), F.count(F.lit(1)).cast("string")).alias("value")).drop("_run")


def weighted_burden(matrix: DataFrame, severity: DataFrame) -> DataFrame:
    """Dot product of a cell's values with the severity of shared mutations."""
    scored = matrix.join(severity, "feature", "left")
    return scored.groupBy("cell").agg(F.coalesce(F.sum(F.col("value") * F.col("severity")), F.lit(0.0)).alias("burden"))


def sample_ranks(cells: DataFrame, seed, cell: str = "cell") -> DataFrame:
    """Rank of every cell in one shuffled order."""
    return number_rows(cells.select(cell).distinct().withColumn("_order", draw_order(seed, cell)), [],
                       ["_order", cell], "sample_rank").drop("_order")


def nested_samples(ranks: DataFrame, sizes: list[int]) -> DataFrame:
    """Cells of each sample size; smaller samples are prefixes of larger ones."""
    fits = F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: F.col("sample_rank") <= s)
    return ranks.withColumn("sample_size", F.explode(fits))


def condition_matrix(matrix: DataFrame, samples: DataFrame, units: list[int]) -> DataFrame:
    """The recording under every (sample size, unit count) condition."""
    fits = F.filter(F.array(*[F.lit(k) for k in units]), lambda k: F.col("unit") <= k)
    return matrix.join(samples, "cell").withColumn("unit_count", F.explode(fits))


def condition_manifest(conditions: DataFrame) -> DataFrame:
    """Columns and nonzero entries of every condition."""
    return conditions.groupBy("sample_size", "unit_count").agg(
        F.count_distinct("feature").alias("columns"), F.count(F.when(F.col("value") != 0, 1)).alias("nonzeros"),
        F.count_distinct("cell").alias("cells_with_edits"))


def capacity_design(design: DataFrame) -> DataFrame:
    """Targets of each design row: per unit times units."""
    return design.withColumn("targets", F.col("targets_per_unit") * F.col("units"))


def character_coverage(table: DataFrame) -> DataFrame:
    """Mean characters per target and percent of the design."""
    return table.groupBy("system", "targets").agg(F.avg("characters").alias("mean_characters")).withColumn(
        "percent", F.try_divide(F.lit(100.0) * F.col("mean_characters"), F.col("targets")))


class RecorderRegistry:
    """Named recorders with a predicate and encoders from DataFrame to DataFrame."""

    def __init__(self) -> None:
        self._recorders: dict[str, dict] = {}

    def register(self, name: str, predicate: Callable[[dict], bool], **hooks: Callable) -> None:
        if not name:
            raise ValueError("a recorder needs a name")
        self._recorders[name] = {"predicate": predicate, **hooks}

    def unregister(self, name: str) -> bool:
        return self._recorders.pop(name, None) is not None

    def names(self) -> list[str]:
        return list(self._recorders)

    def active(self, model: dict) -> list[str]:
        """Recorders whose predicate holds; a predicate that fails skips its recorder."""
        found = []
        for name, recorder in self._recorders.items():
            try:
                if recorder["predicate"](model) is True:
                    found.append(name)
            except Exception:
                continue
        return found

    def hook(self, model: dict, kind: str) -> Callable | None:
        """First encoder of the kind among active recorders, None when there is none."""
        for name in self.active(model):
            if kind in self._recorders[name]:
                return self._recorders[name][kind]
        return None

    def prepare(self, model: dict) -> dict:
        """Run the ``prepare`` hook of every active recorder on the model."""
        for name in self.active(model):
            step = self._recorders[name].get("prepare")
            if step is not None:
                model = step(model)
        return model


def sweep(values: list[float], apply_rate: Callable[[float], DataFrame], name: str = "rate") -> DataFrame:
    """Union of a caller's DataFrame per sweep value."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [apply_rate(x).withColumn(name, F.lit(float(x))) for x in values])
