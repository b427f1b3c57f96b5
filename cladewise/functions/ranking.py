"""Orders, ranks and exact quantiles that do not need one task per group.

A plain window pulls a whole group into one task.  Here rows are cut into slices
of their order first, by one range partitioning over group and order: slice
totals give every slice its offset, and the window only runs inside (group,
slice).  A group that holds a third of the rows is then spread over as many
tasks as its share of the slices, whatever type its order has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.session import shuffled


def running_total(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str,
                  slices: int | None = None) -> DataFrame:
    """Add ``name`` = sum of ``value`` over the rows up to this one in its group.

    ``order`` must be unique inside a group; group keys must not be null.  The
    input is read once: its slices are written, so that a lost executor can't
    cut them anew.  The number of slices follows the session's shuffle
    partitions.
    """
    wanted = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = shuffled(
        df.withColumn("_value", value).repartitionByRange(wanted, *keys, *order).withColumn("_slice", F.spark_partition_id()),
        "slices")
    by_slice = keys + ["_slice"]
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*by_slice).agg(F.sum("_value").alias("_total"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    if not keys:
        offsets = F.broadcast(offsets)  # one row per slice
    inside = Window.partitionBy(*by_slice).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(offsets, by_slice)
        .withColumn(name, F.sum("_value").over(inside) + F.col("_offset"))
        .drop("_slice", "_value", "_offset")
        .hint("merge")  # as large as the input
    )


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str = "row_no",
                slices: int | None = None) -> DataFrame:
    """Row number 1.. in each group along a unique order, without one task per group."""
    return running_total(df, keys, order, F.lit(1).cast("long"), name, slices)


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count of every distinct non-null value per group and the running count."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_count"))
    )
    return running_total(shuffled(counts, "counts"), keys, [value], F.col("_count"), "_upto")


def average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Rank of ``value`` in its group; ties share the mean of their ranks."""
    ranks = value_counts(df, keys, value).select(
        *keys, value,
        (F.col("_upto") - (F.col("_count") - 1) / F.lit(2.0)).alias(name),
    )
    return df.join(ranks, keys + [value])


def spearman(df: DataFrame, keys: list[str], left: str, right: str, name: str = "spearman",
             at_least: int = 3) -> DataFrame:
    """Spearman correlation per group over rows where both values are present.

    Equal pairs of values are counted first, and ranks and moments are taken of
    the counts: ties make the data smaller instead of gathering on one key.
    """
    counts = shuffled(
        df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(*keys, left, right)
        .agg(F.count(F.lit(1)).alias("_n")), "ranked")
    return counted_spearman(counts, keys, left, right, name, at_least)


def counted_spearman(counts: DataFrame, keys: list[str], left: str, right: str, name: str = "spearman",
                     at_least: int = 3) -> DataFrame:
    """``spearman`` of a written table of distinct pairs of values with their number ``_n``."""
    def ranks(value: str, rank: str) -> DataFrame:
        per = counts.groupBy(*keys, value).agg(F.sum("_n").alias("_count"))
        placed = running_total(per, keys, [value], F.col("_count"), "_upto")
        return placed.select(*keys, value, (F.col("_upto") - (F.col("_count") - 1) / F.lit(2.0)).alias(rank))

    ranked = counts.join(ranks(left, "_x"), keys + [left]).join(ranks(right, "_y"), keys + [right])
    n, x, y = F.col("_n"), F.col("_x"), F.col("_y")
    sums = ranked.groupBy(*keys).agg(
        F.sum(n).alias("pairs"), F.sum(n * x).alias("_sx"), F.sum(n * y).alias("_sy"), F.sum(n * x * y).alias("_sxy"),
        F.sum(n * x * x).alias("_sxx"), F.sum(n * y * y).alias("_syy"),
        ((F.min("_x") < F.max("_x")) & (F.min("_y") < F.max("_y"))).alias("_vary"))

    return sums.select(*keys, "pairs", moment_correlation(at_least).alias(name))


def moment_correlation(at_least: int) -> Column:
    """Correlation from ``pairs`` and the sums ``_sx, _sy, _sxy, _sxx, _syy``; null for fewer pairs, or where not both sides ``_vary``."""
    def moment(product: str, a: str, b: str) -> Column:
        return F.col(product) / F.col("pairs") - F.col(a) / F.col("pairs") * F.col(b) / F.col("pairs")

    rho = moment("_sxy", "_sx", "_sy") / F.sqrt(moment("_sxx", "_sx", "_sx") * moment("_syy", "_sy", "_sy"))
    return F.when((F.col("pairs") >= at_least) & F.col("_vary"), rho)


def percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear interpolation) per group from running value counts.

    The built-in exact quantile keeps every distinct value of a group in one
    task; this one only aggregates, so a group may be of any size.
    """
    counts = value_counts(df, keys, value)
    totals = counts.groupBy(*keys).agg(F.sum("_count").alias("_rows"))
    if keys:
        placed = counts.join(totals, keys)
    else:
        placed = counts.withColumn("_rows", totals.select("_rows").scalar())
    picks = []
    for name, share in wanted.items():
        spot = (F.col("_rows") - 1) * F.lit(float(share))
        picks += [
            F.min(F.when(F.col("_upto") > F.floor(spot), F.col(value))).alias(f"_low_{name}"),
            F.min(F.when(F.col("_upto") > F.ceil(spot), F.col(value))).alias(f"_high_{name}"),
            F.max(spot - F.floor(spot)).alias(f"_part_{name}"),
        ]
    found = placed.groupBy(*keys).agg(*picks)
    return found.select(*keys, *[
        (F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_part_{n}")).alias(n)
        for n in wanted
    ])
