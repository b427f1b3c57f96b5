"""Small table shapes used by many summaries: lookups, shares, unions, order helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.functions.asof import bracket
from cladewise.functions.ranking import number_rows


def share_of_total(table: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """Value over the total of its group, by aggregate and join rather than one task per group."""
    if not keys:
        total = table.agg(F.sum(value).alias("_total")).select("_total").scalar()
        return table.withColumn(name, F.try_divide(F.col(value), total))
    totals = table.groupBy(*keys).agg(F.sum(value).alias("_total"))
    return table.join(totals, keys).withColumn(name, F.try_divide(F.col(value), F.col("_total"))).drop("_total")


def project(df: DataFrame, required: list[str], optional: list[str] = ()) -> DataFrame:
    """Required columns and those optional ones that exist; a missing required one is an error."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df.select(*required, *[c for c in optional if c in df.columns and c not in required])


def first_present(df: DataFrame, candidates: list[str]) -> str:
    """The first of several column names that the table has (P20)."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of {', '.join(candidates)} is present")


def numeric_columns(df: DataFrame, skip: list[str] = ()) -> list[str]:
    """Numeric columns for summaries whose columns are not known beforehand."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, t in df.dtypes if (t in kinds or t.startswith("decimal")) and c not in skip]


def lookup(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join in which every left row must find exactly one right row.

    ``lookup_violations`` lists what breaks the rule.
    """
    return left.join(right, keys)


def lookup_violations(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys without a match and keys repeated on either side."""
    def repeated(side: DataFrame, rule: str) -> DataFrame:
        return side.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys, F.lit(rule).alias("rule"))
    missing = left.select(*keys).join(right.select(*keys), keys, "left_anti").distinct().withColumn("rule", F.lit("no_match"))
    return missing.unionByName(repeated(left, "left_repeated")).unionByName(repeated(right, "right_repeated"))


def attach_reference(samples: DataFrame, reference: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Samples with the reference value of their key; samples without one stay, with null.

    A key that the reference repeats would multiply samples: its smallest value is taken, and
    ``reference_rows`` tells how many rows it has (0: unmatched).  ``lookup_violations`` lists such keys.
    """
    unique = reference.groupBy(*keys).agg(F.min(value).alias(value), F.count(F.lit(1)).alias("reference_rows"))
    joined = samples.join(unique, keys, "left")
    return joined.withColumn("reference_rows", F.coalesce("reference_rows", F.lit(0)))


def in_large_groups(rows: DataFrame, keys: list[str], at_least: int) -> DataFrame:
    """Rows whose group has at least so many rows."""
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least).select(*keys)
    return rows.join(large, keys, "left_semi")


def union_shared(tables: list[DataFrame]) -> DataFrame:
    """Union over the columns every table has."""
    shared = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
    return reduce(DataFrame.unionByName, [t.select(*shared) for t in tables])


def union_all_columns(tables: list[DataFrame]) -> DataFrame:
    """Union over all columns, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def unique_names(df: DataFrame, name: str, order: str, out: str) -> DataFrame:
    """Repeated names get ``.1``, ``.2`` ... in order."""
    numbered = number_rows(df, [name], [order], "_no")
    return numbered.withColumn(out, F.when(F.col("_no") > 1, F.concat(F.col(name), F.lit("."), (F.col("_no") - 1)
                                                                      .cast("string"))).otherwise(F.col(name))).drop("_no")


def ordered_category(value: Column, levels: list[str]) -> Column:
    """1-based rank of a label in a fixed order (O2)."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in levels]), value), F.lit(0).cast("long"))


def parameter_grid(base: DataFrame, **values: list) -> DataFrame:
    """Every row of ``base`` with every combination of parameter values."""
    for name, items in values.items():
        base = base.withColumn(name, F.explode(F.array(*[F.lit(i) for i in items])))
    return base


def best_rows(table: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per group in an explicit order (X9, W3); only aggregates, so groups may be large."""
    rest = [c for c in table.columns if c not in keys]
    picked = table.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[
        o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def empirical_cdf(table: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Share of values at or below each distinct value of its group."""
    from cladewise.functions.ranking import value_counts

    counts = value_counts(table, keys, value)
    totals = counts.groupBy(*keys).agg(F.sum("_count").alias("_rows"))
    return counts.join(totals, keys).select(*keys, value, (F.col("_upto") / F.col("_rows")).alias(name))


def interpolate(points: DataFrame, wanted: DataFrame, x: str, y: str, at: str, name: str,
                keys: list[str] | None = None) -> DataFrame:
    """Linear interpolation through the response curve of each group, clamped at its ends.

    Of repeated x the smallest y stays; where the wanted place is null, or a
    group has no curve, the result is null.  A group may hold any share of the
    points and of the wanted rows.
    """
    keys = keys or []
    curve = points.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(
        F.min(F.col(y).cast("double")).alias("_y"))
    rows = wanted.withColumn("_x", F.col(at).cast("double"))
    found = bracket(rows, curve, keys, "_x", "_low", "_high")
    share = (F.col("_x") - F.col("_low._x")) / (F.col("_high._x") - F.col("_low._x"))
    value = F.when(F.col("_low").isNull(), F.col("_high._y")).when(F.col("_high").isNull(), F.col("_low._y")).otherwise(
        F.col("_low._y") + share * (F.col("_high._y") - F.col("_low._y")))
    return found.withColumn("_value", value).drop("_x", "_low", "_high").withColumn(name, F.col("_value")).drop("_value")


def apply_mask(values: DataFrame, observed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values where another dataset was observed, null elsewhere."""
    seen = observed.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return values.join(seen, keys, "left").withColumn(value, F.when(F.col("_seen"), F.col(value))).drop("_seen")


def exclude_by_position(table: DataFrame, unit: str, positions: list[int]) -> DataFrame:
    """Leave out units by their place in the sorted list of units."""
    ranked = table.select(unit).distinct().withColumn("_no", F.row_number().over(Window.orderBy(unit)))  # one row per unit
    return table.join(ranked.where(~F.col("_no").isin(positions)).select(unit), unit, "left_semi")


def keep_listed(table: DataFrame, listed: DataFrame, keys: list[str], at_least: int = 1) -> DataFrame:
    """Rows whose key an earlier result lists; fewer than ``at_least`` keys leave nothing."""
    count = listed.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return table.join(listed.select(*keys).distinct(), keys, "left_semi").where(count >= at_least)


def map_labels(table: DataFrame, column: str, mapping: dict[str, str], keep: str) -> DataFrame:
    """Mapped labels; the old one stays in ``keep`` and unmapped labels stay as they are."""
    names = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return table.withColumn(keep, F.col(column)).withColumn(column, F.coalesce(F.try_element_at(names, F.col(keep)), F.col(keep)))


def exclude_labels(table: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Rows whose label matches none of the patterns, ignoring case."""
    for pattern in patterns:
        table = table.where(~F.col(column).rlike(f"(?i){pattern}"))
    return table


def apportion(table: DataFrame, keys: list[str], weight: str, order: str, total: int, name: str) -> DataFrame:
    """Whole counts that add up to ``total`` per group, by largest remainder.

    Ties go to the smaller ``order``.  Remainders are rounded to nine digits, so
    equal shares stay equal whatever the order of addition.
    """
    sums = table.groupBy(*keys).agg(F.sum(weight).alias("_all"))
    raw = table.join(sums, keys).withColumn("_raw", F.lit(float(total)) * F.col(weight) / F.col("_all")).withColumn(
        "_floor", F.floor("_raw").cast("long")).withColumn("_rest", -F.round(F.col("_raw") - F.floor("_raw"), 9))
    missing = raw.groupBy(*keys).agg((F.lit(total) - F.sum("_floor")).alias("_missing"))
    ranked = number_rows(raw.drop("_all"), keys, ["_rest", order], "_no").join(missing, keys)
    return ranked.withColumn(name, F.col("_floor") + (F.col("_no") <= F.col("_missing")).cast("long")).drop(
        "_raw", "_floor", "_rest", "_no", "_missing")


def paired_runs(wanted: DataFrame, first: DataFrame, second: DataFrame, run: str, same: list[str], one: str, two: str) -> DataFrame:
    """Features of both runs side by side for each wanted pair whose conditions agree.

    ``wanted`` names the pairs as ``<one>_run`` and ``<two>_run``; the columns of
    ``same`` must be equal and appear once, all others take the prefix of their side.
    """
    def side(table: DataFrame, tag: str) -> DataFrame:
        return table.select(*same, *[F.col(c).alias(f"{tag}_{c}") for c in table.columns if c not in same])

    left, right = side(first.withColumnRenamed(run, "run"), one), side(second.withColumnRenamed(run, "run"), two)
    joined = wanted.join(left, f"{one}_run").join(right, [f"{two}_run", *same])
    return joined.withColumn("joint_id", F.concat_ws("_", F.lit("J"), f"{one}_run", f"{two}_run"))
