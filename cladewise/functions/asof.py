"""As-of lookups by group: the last break at or before a row and the first one behind it.

Rows and breaks are put in one order (keys, place) and cut into slices by range
partitioning, so a group of any size spreads over as many tasks as its share of
the slices.  Every slice of a group knows the last break of the group's earlier
slices and the first one of its later slices; inside a slice a window does the
rest.  What is carried is one row per group and slice that the group lies in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.session import shuffled


def bracket(rows: DataFrame, breaks: DataFrame, keys: list[str], at: str, before: str | None = "before",
            behind: str | None = None, slices: int | None = None) -> DataFrame:
    """``rows`` with structs of the break at or before the row's ``at`` and of the first break behind it.

    Both tables have the ``keys`` and ``at``; a struct holds the columns of
    ``breaks`` other than the keys.  Of breaks at one place the greatest struct
    counts.  A row whose ``at`` or one of whose keys is null, or that has no break
    on that side in its group, gets null.
    """
    wanted = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = [c for c in breaks.columns if c not in keys]
    groups = [f"_key{i}" for i in range(len(keys))]
    named = [F.col(k).alias(g) for k, g in zip(keys, groups)]
    known = F.lit(True)
    for k in [*keys, at]:
        known = known & F.col(k).isNotNull()
    points = breaks.where(known).groupBy(*named, F.col(at).alias("_at")).agg(F.max(F.struct(*held)).alias("_break"))
    mine = rows.select(*named, F.col(at).alias("_at"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"))
    both = mine.unionByName(points, allowMissingColumns=True).withColumn("_is_row", F.col("_row").isNotNull())
    # rows of one place may be many: a hash of the row cuts them too
    order = ["_at", "_is_row", "_spread"]
    placed = both.withColumn("_spread", F.xxhash64("_row")).repartitionByRange(wanted, *groups, *order).withColumn(
        "_slice", F.spark_partition_id())
    placed = shuffled(placed, "asof")
    ends = placed.groupBy(*groups, "_slice").agg(
        F.min_by("_break", F.when(F.col("_break").isNotNull(), F.col("_at"))).alias("_first"),
        F.max_by("_break", F.when(F.col("_break").isNotNull(), F.col("_at"))).alias("_last"))
    near = Window.partitionBy(*groups).orderBy("_slice")  # one row per slice of a group
    ends = ends.select(
        *groups, "_slice", F.last("_last", True).over(near.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", True).over(near.rowsBetween(1, Window.unboundedFollowing)).alias("_behind"))
    on = [F.col(f"near.{g}").eqNullSafe(F.col(f"far.{g}")) for g in [*groups, "_slice"]]
    joined = placed.alias("near").join(ends.alias("far"), on).select("near.*", "far._before", "far._behind")
    inside = Window.partitionBy(*groups, "_slice").orderBy(*order)
    found: list[Column] = []
    usable = F.col("_at").isNotNull()
    for g in groups:
        usable = usable & F.col(g).isNotNull()
    if before:
        last = F.last("_break", True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
        found.append(F.when(usable, F.coalesce(last, "_before")).alias(before))
    if behind:
        following = F.first("_break", True).over(inside.rowsBetween(1, Window.unboundedFollowing))
        found.append(F.when(usable, F.coalesce(following, "_behind")).alias(behind))
    names = [f"_found{i}" for i in range(len(found))]
    out = joined.select("_row", *[c.alias(n) for c, n in zip(found, names)]).where("_row is not null")
    return out.select("_row.*", *[F.col(n).alias(c) for n, c in zip(names, [x for x in (before, behind) if x])]).hint("merge")


def bin_by_table(rows: DataFrame, breaks: DataFrame, keys: list[str], value: str, lower: str, upper: str, label: str) -> DataFrame:
    """``rows`` with the ``label`` of the bin ``lower <= value < upper`` of their group; null outside of all bins.

    Bins of a group must not overlap; gaps are allowed, and a null ``upper`` is open.
    """
    at = "_place"
    edges = breaks.select(*keys, F.col(lower).alias(at), F.col(upper).alias("_upper"), F.col(label).alias("_label"))
    found = bracket(rows.withColumn(at, F.col(value)), edges, keys, at, "_bin")
    inside = F.col("_bin._upper").isNull() | (F.col(at) < F.col("_bin._upper"))
    return found.withColumn(label, F.when(F.col("_bin").isNotNull() & inside, F.col("_bin._label"))).drop("_bin", at)
