"""Experiment summaries and paired statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladewise.functions.ranking import average_rank, percentiles
from cladewise.session import shuffled


def summarise(table: DataFrame, keys: list[str], value: str, weight: float = 1.96) -> DataFrame:
    """Rows, mean, sd, standard error and normal interval per group; one row has no error."""
    error = F.try_divide(F.stddev_samp(value), F.sqrt(F.count(value).cast("double")))
    return table.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), error.alias("se"),
        (F.avg(value) - weight * error).alias("lower"), (F.avg(value) + weight * error).alias("upper"))


def accuracy_summary(table: DataFrame, keys: list[str], rf: str) -> DataFrame:
    """Mean distance with interval, accuracy and exact share."""
    extra = table.groupBy(*keys).agg(
        F.avg((F.col(rf) == 0).cast("int")).alias("exact_fraction"), F.count(F.when(F.col(rf) == 0, 1)).alias("perfect"))
    return summarise(table, keys, rf).join(extra, keys).withColumn("mean_accuracy", 1 - F.col("mean"))


def largest_spread(summary: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Largest difference between the curves within one bin."""
    spread = summary.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), (F.max(value) - F.min(value)).alias("_s"))
    return spread.where("_n >= 2").agg(F.max("_s").alias("largest_spread"))


def paired_penalty(summary: DataFrame, keys: list[str], by: str, high: float, full: float, value: str) -> DataFrame:
    """Value at one level minus value at another within the same bin."""
    a = summary.where(F.col(by) == high).select(*keys, F.col(value).alias(f"{value}_high"))
    b = summary.where(F.col(by) == full).select(*keys, F.col(value).alias(f"{value}_full"))
    return a.join(b, keys).withColumn("penalty", F.col(f"{value}_high") - F.col(f"{value}_full"))


def median_summary(table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows, mean, median and perfect rows per group."""
    base = table.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("clones"), F.avg("leaves").alias("mean_leaves"), F.avg(value).alias("mean_rf"),
        F.count(F.when(F.col(value) == 0, 1)).alias("perfect"))
    return base.join(percentiles(table, keys, value, {"median_rf": 0.5}), keys)


def metric_means(table: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sd of many metric columns."""
    return table.groupBy(*keys).agg(*[a for m in metrics for a in (
        F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd"))])


def status_overview(table: DataFrame, value: str) -> DataFrame:
    """Counts per status with the share of all rows."""
    total = table.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return table.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_rf"),
                                       F.count(F.when(F.col(value) == 0, 1)).alias("perfect")).withColumn(
        "share", F.col("n") / total)


def usable_rows(table: DataFrame, value: str) -> DataFrame:
    """Successful rows with a finite value."""
    return table.where((F.col("status") == "success") & F.col(value).isNotNull() & ~F.isnan(value)
                       & (F.abs(value) < float("inf")))


def failure_counts(table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows and unusable rows per group."""
    good = (F.col("status") == "success") & F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(~F.coalesce(good, F.lit(False)), 1)).alias("failed"))


def compare_runs(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Old and new value, change and percent gain per key (X11)."""
    joined = old.select(*keys, F.col(value).alias("old")).join(new.select(*keys, F.col(value).alias("new")), keys)
    return joined.withColumn("change", F.col("new") - F.col("old")).withColumn(
        "percent_gain", F.try_divide(100 * (F.col("old") - F.col("new")), F.col("old")))


def paired_differences(table: DataFrame, unit: str, model: str, first: str, second: str, metrics: list[str]) -> DataFrame:
    """Mean difference of two models per metric over unit means, with wins."""
    long = table.select(unit, model, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [unit, model], metrics, "metric", "value")
    means = long.groupBy("metric", unit).agg(
        F.avg(F.when(F.col(model) == first, F.col("value"))).alias("_a"),
        F.avg(F.when(F.col(model) == second, F.col("value"))).alias("_b"))
    gap = F.col("_a") - F.col("_b")
    return means.where(gap.isNotNull()).groupBy("metric").agg(
        F.avg(gap).alias("difference"), F.count(F.when(gap > 0, 1)).alias("won"), F.count(F.lit(1)).alias("total"))


def by_suffix_number(table: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Columns ``<prefix><k>`` as rows, with mean and sd per k."""
    columns = [c for c in table.columns if c.startswith(prefix)]
    long = table.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, columns, "_name", "_value")
    return long.withColumn("k", F.regexp_extract("_name", r"(\d+)$", 1).cast("int")).groupBy(*keys, "k").agg(
        F.avg("_value").alias("mean"), F.stddev_samp("_value").alias("sd"))


def engine_comparison(table: DataFrame, engine: str, first: str, second: str, metrics: list[str]) -> DataFrame:
    """Mean, sd, difference and relative percent per metric of two engines."""
    long = table.select(engine, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([engine], metrics, "metric", "value")
    def of(name: str) -> Column:
        return F.when(F.col(engine) == name, F.col("value"))
    means = long.groupBy("metric").agg(
        F.avg(of(first)).alias("first_mean"), F.stddev_samp(of(first)).alias("first_sd"),
        F.avg(of(second)).alias("second_mean"), F.stddev_samp(of(second)).alias("second_sd"))
    gap = F.col("second_mean") - F.col("first_mean")
    return means.withColumn("difference", gap).withColumn(
        "relative_percent", F.when(F.abs("first_mean") > 0, F.try_divide(100 * gap, F.col("first_mean"))))


def cell_type_summary(cells: DataFrame, types: DataFrame) -> DataFrame:
    """Mean and sd of counts and fractions per engine and cell type, absent types as zero."""
    counts = cells.groupBy("engine", "replicate", "cell_type").agg(F.count(F.lit(1)).alias("_n"))
    names = types.select("cell_type").distinct().agg(F.collect_set("cell_type").alias("t")).select("t").scalar()
    runs = cells.select("engine", "replicate").distinct().withColumn("_types", names)
    grid = runs.select("engine", "replicate", F.explode("_types").alias("cell_type"))
    totals = counts.groupBy("engine", "replicate").agg(F.sum("_n").alias("_all"))
    filled = grid.join(counts, ["engine", "replicate", "cell_type"], "left").join(totals, ["engine", "replicate"], "left")
    n = F.coalesce("_n", F.lit(0))
    share = F.coalesce(F.try_divide(n, F.col("_all")), F.lit(0.0))
    return filled.select("engine", "cell_type", n.alias("_c"), share.alias("_f")).groupBy("engine", "cell_type").agg(
        F.avg("_c").alias("mean_cell_count"), F.stddev_samp("_c").alias("sd_cell_count"),
        F.avg("_f").alias("mean_cell_fraction"), F.stddev_samp("_f").alias("sd_cell_fraction"))


def identical_curves(results: DataFrame, combo: list[str], endpoint: str, value: str) -> DataFrame:
    """Combinations grouped by equal result curves; first row and cell count of each.

    A curve is the digest of its sorted (endpoint, value) list, one entry per
    time point of the run.
    """
    curves = results.where(F.col(value).isNotNull()).groupBy(*combo).agg(
        F.array_sort(F.collect_list(F.struct(endpoint, value))).alias("_curve"), F.max(endpoint).alias("_last"))
    keyed = curves.select(*combo, F.md5(F.to_json("_curve")).alias("curve"), F.pow(F.lit(2.0), F.col("_last")).alias("num_cells"))
    sizes = keyed.groupBy("curve").agg(F.count(F.lit(1)).alias("combinations"), F.min(F.struct(*combo)).alias("_first"))
    return keyed.join(sizes, "curve").withColumn("is_first", F.struct(*combo) == F.col("_first")).drop("_first")


def phase_shares(timing: DataFrame) -> DataFrame:
    """Seconds per phase and percent of the whole run."""
    totals = timing.groupBy("run").agg(F.sum("seconds").alias("_all"))
    return timing.join(totals, "run").withColumn("percent", F.try_divide(100 * F.col("seconds"), F.col("_all"))).drop("_all")


def stage_timing(timing: DataFrame, time: str, stages: list[str]) -> DataFrame:
    """Stage seconds and their total per time point in long form."""
    total = sum((F.col(s) for s in stages[1:]), F.col(stages[0]))
    wide = timing.withColumn("total", total)
    return wide.select(time, *[F.col(s).cast("double").alias(s) for s in [*stages, "total"]]).unpivot(
        [time], [*stages, "total"], "modality", "seconds")


# ---- finishers: tail probabilities of a few aggregated rows ------------------


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _upper_tail(k: int, n: int, p: float) -> float:
    """Chance of at least k hits."""
    if k <= 0:
        return 1.0
    if p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    return _beta(p, k, n - k + 1)


def _beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(1 - x, b, a)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 100_000):
        step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 + step * d
        c = 1 + step / c
        d = 1 / (d if abs(d) > tiny else tiny)
        c = c if abs(c) > tiny else tiny
        h *= d * c
        step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + step * d
        c = 1 + step / c
        d = 1 / (d if abs(d) > tiny else tiny)
        c = c if abs(c) > tiny else tiny
        change = d * c
        h *= change
        if abs(change - 1) < 1e-15:
            break
    return front * h / a


def _solve(target: float, k: int, n: int) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        middle = (low + high) / 2
        if _upper_tail(k, n, middle) < target:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def binomial_interval(hits: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact interval of a share."""
    alpha = (1 - level) / 2
    low = 0.0 if hits == 0 else _solve(alpha, hits, n)
    high = 1.0 if hits == n else _solve(1 - alpha, hits + 1, n)
    return low, high


@F.pandas_udf(T.StructType([T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())]))
def _intervals(hits: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([binomial_interval(int(h), int(m)) for h, m in zip(hits, n)], columns=["lower", "upper"])


def exact_share_by_bin(table: DataFrame, keys: list[str], rf: str) -> DataFrame:
    """Exact share per bin with its exact binomial interval."""
    counts = table.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("clones"), F.avg(1 - F.col(rf)).alias("mean_accuracy"),
        F.count(F.when(F.col(rf) == 0, 1)).alias("_hits"))
    return counts.withColumn("_i", _intervals("_hits", "clones")).select(
        *keys, "clones", "mean_accuracy", (F.col("_hits") / F.col("clones")).alias("exact_fraction"),
        F.col("_i.lower").alias("lower"), F.col("_i.upper").alias("upper"))


@F.pandas_udf(T.DoubleType())
def _t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or math.isnan(x) or d < 1 else _beta(d / (d + x * x), d / 2, 0.5) for x, d in zip(t, df)],
                     dtype="float64")


def paired_t_test(table: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """Paired t test per group; the statistic is an aggregate, the tail a finisher."""
    gap = F.col(first) - F.col(second)
    stats = table.where(gap.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(gap).alias("mean_difference"), F.stddev_samp(gap).alias("_sd"))
    stats = stats.withColumn("t", F.try_divide(F.col("mean_difference"), F.col("_sd") / F.sqrt(F.col("n").cast("double"))))
    return stats.withColumn("df", F.col("n") - 1).withColumn("p_value", _t_tail("t", F.col("df").cast("double"))).drop("_sd")


@F.pandas_udf(T.DoubleType())
def _normal_tail(z: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or math.isnan(x) else math.erfc(abs(x) / math.sqrt(2)) for x in z], dtype="float64")


def paired_wilcoxon(table: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """Paired signed-rank test, normal approximation with tie and continuity correction.

    Zero differences are left out.
    """
    gap = F.col(first) - F.col(second)
    rows = shuffled(table.where(gap.isNotNull() & (gap != 0)).select(*keys, gap.alias("_gap"), F.abs(gap).alias("_size")), "gaps")
    ranked = average_rank(rows, keys, "_size", "_rank")
    ties = rows.groupBy(*keys, "_size").agg(F.count(F.lit(1)).cast("double").alias("_t")).groupBy(*keys).agg(
        F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).alias("_ties"))
    sums = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.when(F.col("_gap") > 0, F.col("_rank")).otherwise(0.0)).alias("v"))
    joined = sums.join(ties, keys) if keys else sums.withColumn("_ties", ties.select("_ties").scalar())
    n = F.col("n")
    centre = F.col("v") - n * (n + 1) / 4
    sigma = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    z = F.try_divide(centre - F.signum(centre) * 0.5, sigma)
    return joined.select(*keys, n.cast("long").alias("n"), "v", z.alias("z"), _normal_tail(z).alias("p_value"))
