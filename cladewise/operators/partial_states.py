"""Summaries of append-only tables, kept as stored states that merge.

A batch is reduced to one row of states per group and written on its own; the
summary of everything so far merges the stored rows and reads no earlier input
again.  Counts and moments are exact up to rounding.  Distinct numbers and
quantiles come from sketches, and only where the caller asks for them: a
distinct number has a relative standard error of 1.04 / sqrt(2^``log_slots``)
(1.6 % at 12), a quantile a rank error that stays under 1 % of the rows at
``kept`` = 800 (about 1.3 % at 200).

A batch is named by the caller.  Appending the same name again replaces its
states, so a job that was repeated after a failure counts its rows once.  An
empty batch adds nothing; null values are left out of moments and sketches;
null keys form a group.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Summary:
    """What is kept for each group of ``keys``.

    ``counts`` names SQL conditions, ``moments`` columns of numbers, ``distinct``
    and ``quantiles`` the columns that are sketched.
    """

    keys: list[str]
    counts: dict[str, str] = field(default_factory=dict)
    moments: list[str] = field(default_factory=list)
    distinct: list[str] = field(default_factory=list)
    quantiles: list[str] = field(default_factory=list)
    log_slots: int = 12
    kept: int = 800

    def states(self, batch: DataFrame) -> DataFrame:
        """One row of states per group of a batch; rows are combined before they are shuffled."""
        out = [F.count("*").alias("rows")]
        out += [F.count_if(F.expr(condition)).alias(f"count_{name}") for name, condition in self.counts.items()]
        for v in self.moments:
            x, n = F.col(v).cast("double"), F.count(v)
            out += [n.alias(f"n_{v}"), F.avg(x).alias(f"mean_{v}"), (F.var_pop(x) * n).alias(f"squares_{v}"),
                    F.min(x).alias(f"min_{v}"), F.max(x).alias(f"max_{v}")]
        out += [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(self.log_slots)).alias(f"distinct_{c}") for c in self.distinct]
        out += [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(self.kept)).alias(f"quantiles_{c}") for c in self.quantiles]
        return batch.groupBy(*self.keys).agg(*out)

    def merged(self, states: DataFrame) -> DataFrame:
        """States of several batches as one row per group, of the same columns."""
        own = Window.partitionBy(*self.keys)  # one row per batch
        for v in self.moments:
            mean = F.sum(F.col(f"n_{v}") * F.col(f"mean_{v}")).over(own) / F.nullif(F.sum(f"n_{v}").over(own), F.lit(0))
            states = states.withColumn(f"_mean_{v}", mean)
        out = [F.sum("rows").alias("rows")] + [F.sum(f"count_{name}").alias(f"count_{name}") for name in self.counts]
        for v in self.moments:
            apart = F.col(f"mean_{v}") - F.col(f"_mean_{v}")
            out += [F.sum(f"n_{v}").alias(f"n_{v}"), F.max(f"_mean_{v}").alias(f"mean_{v}"),
                    F.sum(F.col(f"squares_{v}") + F.col(f"n_{v}") * apart * apart).alias(f"squares_{v}"),
                    F.min(f"min_{v}").alias(f"min_{v}"), F.max(f"max_{v}").alias(f"max_{v}")]
        out += [F.hll_union_agg(f"distinct_{c}").alias(f"distinct_{c}") for c in self.distinct]
        out += [F.kll_merge_agg_double(f"quantiles_{c}", F.lit(self.kept)).alias(f"quantiles_{c}") for c in self.quantiles]
        return states.groupBy(*self.keys).agg(*out)

    def append(self, batch: DataFrame, folder: str, name: str) -> None:
        """Write the states of a batch; the same name replaces what it held."""
        self.states(batch).write.mode("overwrite").parquet(f"{folder}/batch={name}")

    def stored(self, spark: SparkSession, folder: str) -> DataFrame:
        """The merged states of all appended batches."""
        return self.merged(spark.read.option("basePath", folder).parquet(f"{folder}/batch=*").drop("batch"))

    def compact(self, spark: SparkSession, folder: str, target: str) -> None:
        """The states of a folder as the first batch of a new one."""
        self.stored(spark, folder).write.mode("overwrite").parquet(f"{target}/batch=merged")


def moment_table(states: DataFrame, keys: list[str], value: str, weight: float = 1.96) -> DataFrame:
    """Rows, mean, sd, standard error and normal interval from states, as ``summaries.summarise`` gives them."""
    n, mean = F.col(f"n_{value}"), F.col(f"mean_{value}")
    sd = F.sqrt(F.try_divide(F.col(f"squares_{value}"), F.nullif(n - 1, F.lit(0))))
    table = states.select(*keys, n.alias("n"), mean.alias("mean"), F.when(n > 1, sd).alias("sd"))
    error = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    return table.withColumn("se", error).withColumn("lower", F.col("mean") - weight * F.col("se")).withColumn(
        "upper", F.col("mean") + weight * F.col("se"))


def distinct_estimate(column: str) -> Column:
    """The estimated number of distinct values of a sketched column."""
    return F.hll_sketch_estimate(f"distinct_{column}")


def quantile_estimate(column: str, p: float) -> Column:
    """The estimated quantile of a sketched column; null where the group has no value."""
    sketch = F.col(f"quantiles_{column}")
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(p))))


def checkpoint_counts(times: list[float], opened: str = "opened_at", closed: str = "closed_at") -> dict[str, str]:
    """Conditions that count openings and closings up to each checkpoint, for a log that gets a row for either."""
    out = {}
    for i, t in enumerate(times):
        out |= {f"opened_{i}": f"{opened} <= {float(t)!r}D", f"closed_{i}": f"{closed} <= {float(t)!r}D"}
    return out


def active_from_states(states: DataFrame, keys: list[str], times: list[float]) -> DataFrame:
    """Open entries per group and checkpoint from states of ``checkpoint_counts``."""
    rows = [F.struct(F.lit(float(t)).alias("time"), (F.col(f"count_opened_{i}") - F.col(f"count_closed_{i}")).alias("active_cells"))
            for i, t in enumerate(times)]
    return states.select(*keys, F.inline(F.array(*rows)))
