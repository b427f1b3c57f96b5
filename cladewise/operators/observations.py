"""Recorder features of observation and molecule tables.

Observations are long rows ``cell, unit, site, state``; a cell and unit without
a row was not seen, which is not the same as unedited.  Site tables are as wide
as the recorder (thousands of rows); cell and molecule tables are unbounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.functions.asof import bracket
from cladewise.functions.ranking import number_rows, percentiles, running_total
from cladewise.functions.sampling import distinct_numbers, draw_order
from cladewise.session import shuffled

UNEDITED, EDITED, UNCALLED, NOT_CAPTURED = "0", "1", "?", "+"


def typed_state(state: Column) -> Column:
    """Four symbols to 0, 1 or null."""
    return F.when(state == UNEDITED, 0).when(state == EDITED, 1)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def position_tally(obs: DataFrame, minimum_rate: float = 0.0, generations: float | None = None) -> DataFrame:
    """Tally of the four symbols per position with rate and retained flag."""
    cells = obs.agg(F.count_distinct("cell").alias("n")).select("n").scalar()
    tally = obs.groupBy("unit", "site").agg(
        count_where(F.col("state") == UNEDITED).alias("unedited"),
        count_where(F.col("state") == EDITED).alias("edited"),
        count_where(F.col("state") == UNCALLED).alias("uncalled"),
        count_where(F.col("state") == NOT_CAPTURED).alias("not_captured"),
        count_where(~F.col("state").isin(UNEDITED, EDITED, UNCALLED, NOT_CAPTURED)).alias("unexpected"),
    )
    return tally_rates(tally, cells, minimum_rate, generations)


#: The conditions of ``position_tally`` for states that are kept per batch.
TALLY_CONDITIONS = {
    "unedited": f"state = '{UNEDITED}'", "edited": f"state = '{EDITED}'", "uncalled": f"state = '{UNCALLED}'",
    "not_captured": f"state = '{NOT_CAPTURED}'",
    "unexpected": f"state not in ('{UNEDITED}', '{EDITED}', '{UNCALLED}', '{NOT_CAPTURED}')",
}


def tally_rates(tally: DataFrame, cells: Column | int, minimum_rate: float = 0.0, generations: float | None = None) -> DataFrame:
    """Rates and flags of positions whose symbols are counted."""
    tally = tally.withColumn("observed", F.col("unedited") + F.col("edited"))
    rate = F.when(F.col("observed") > 0, F.col("edited") / F.col("observed"))
    tally = tally.withColumn("editing_rate", rate).withColumn("observed_fraction", F.col("observed") / cells)
    tally = tally.withColumn("retained", F.coalesce(F.col("editing_rate") >= minimum_rate, F.lit(False)))
    if generations:
        tally = tally.withColumn("per_division_rate", per_division_rate(F.col("editing_rate"), generations))
    return tally


def per_division_rate(rate: Column, generations) -> Column:
    """Rate per division that reaches ``rate`` after so many divisions (A2)."""
    n = generations if isinstance(generations, Column) else F.lit(float(generations))
    return F.lit(1.0) - F.pow(F.lit(1.0) - rate, F.lit(1.0) / n)


def rate_assumptions(tally: DataFrame, generations: list[float], identifiable: float = 0.95) -> DataFrame:
    """Median per-division rate of identifiable positions under several division counts (A2)."""
    usable = tally.where(F.col("retained") & (F.col("editing_rate") < identifiable))
    spread = usable.select("editing_rate", F.explode(F.array(*[F.lit(float(g)) for g in generations])).alias("generations"))
    return spread.groupBy("generations").agg(
        F.percentile(per_division_rate(F.col("editing_rate"), F.col("generations")), 0.5).alias("median_rate"),
        F.count(F.lit(1)).alias("positions"))


def rate_distribution(tally: DataFrame, keys: list[str], rate: str = "editing_rate") -> DataFrame:
    """Size, mean, quartiles and saturated / identifiable / low shares of site rates (A3)."""
    scored = tally.where(F.col(rate).isNotNull())
    quartiles = F.percentile(rate, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("positions"), F.avg(rate).alias("mean"),
        quartiles[0].alias("q25"), quartiles[1].alias("median"), quartiles[2].alias("q75"),
        F.min(rate).alias("min"), F.max(rate).alias("max"),
        F.avg((F.col(rate) >= 0.99).cast("int")).alias("saturated"),
        F.avg((F.col(rate) < 0.95).cast("int")).alias("identifiable"),
        F.avg((F.col(rate) < 0.01).cast("int")).alias("low"))


def dropout_accounting(tally: DataFrame, cells: Column) -> DataFrame:
    """Uncalled and not-captured share of all entries; median observed of kept and dropped positions (A4)."""
    entries = F.count(F.lit(1)) * F.max("_cells")
    return tally.withColumn("_cells", cells).agg(
        (F.sum("uncalled") / entries).alias("uncalled_share"),
        (F.sum("not_captured") / entries).alias("not_captured_share"),
        F.percentile(F.when(F.col("retained"), F.col("observed")), 0.5).alias("median_observed_kept"),
        F.percentile(F.when(~F.col("retained"), F.col("observed")), 0.5).alias("median_observed_dropped"))


def threshold_sensitivity(tally: DataFrame, thresholds: list[float]) -> DataFrame:
    """Positions kept and dropped and mean rate of kept at each candidate threshold."""
    spread = tally.where(F.col("editing_rate").isNotNull()).select(
        "editing_rate", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    keep = F.col("editing_rate") >= F.col("threshold")
    return spread.groupBy("threshold").agg(
        count_where(keep).alias("kept"), count_where(~keep).alias("dropped"),
        F.avg(F.when(keep, F.col("editing_rate"))).alias("mean_rate_kept"))


def site_rates(typed: DataFrame, keys: list[str]) -> DataFrame:
    """Edited over observed per site of a typed table (A5)."""
    return typed.groupBy(*keys).agg(
        (F.sum("edited") / F.nullif(F.count("edited"), F.lit(0))).alias("rate"),
        F.count("edited").alias("observed"))


def cell_burden(typed: DataFrame, keys: list[str]) -> DataFrame:
    """Edits, observed entries and edited fraction per cell."""
    return typed.groupBy(*keys).agg(
        F.coalesce(F.sum("edited"), F.lit(0)).alias("edits"), F.count("edited").alias("observed")).withColumn(
        "edited_fraction", F.try_divide(F.col("edits"), F.col("observed")))


def nonzero_burden(matrix: DataFrame, columns: Column | int, cell: str = "cell") -> DataFrame:
    """Nonzero entries per cell of a COO matrix and their share of all columns."""
    width = columns if isinstance(columns, Column) else F.lit(columns)
    return matrix.groupBy(cell).agg(count_where(F.col("value") != 0).alias("edits")).withColumn(
        "edit_fraction", F.col("edits") / width)


def allele_diversity(typed: DataFrame, min_observed: float = 0.5, min_cells: int = 10,
                     min_sites: int = 5) -> DataFrame:
    """Distinct edit patterns per unit and how evenly they are used.

    Only cells that captured the unit count, compared at the sites observed in
    all of them.  Entropy is normalised by the log of the number of cells.
    """
    seen = typed.where(F.col("edited").isNotNull()).select("unit", "cell", "site", "edited")
    width = typed.groupBy("unit").agg(F.count_distinct("site").alias("_width"))
    captured = (
        seen.groupBy("unit", "cell").agg(F.count(F.lit(1)).alias("_seen"))
        .join(width, "unit")
        .where(F.col("_seen") / F.col("_width") >= min_observed).select("unit", "cell"))
    units = captured.groupBy("unit").agg(F.count(F.lit(1)).alias("cells")).where(F.col("cells") >= min_cells)
    block = seen.join(captured, ["unit", "cell"], "left_semi")
    sites = (
        block.groupBy("unit", "site").agg(F.count(F.lit(1)).alias("_seen"))
        .join(units, "unit").where(F.col("_seen") == F.col("cells")).select("unit", "site", "cells"))
    enough = sites.groupBy("unit", "cells").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    comparable = sites.join(enough.select("unit"), "unit", "left_semi").select("unit", "site")
    alleles = (
        block.join(comparable, ["unit", "site"]).groupBy("unit", "cell")
        .agg(F.array_sort(F.collect_list(F.struct("site", "edited"))).alias("_key"))  # at most one entry per site
        .select("unit", F.transform("_key", lambda x: x["edited"]).alias("_key"))
        .groupBy("unit", "_key").agg(F.count(F.lit(1)).alias("_n")))
    shares = alleles.join(enough, "unit").withColumn("_p", F.col("_n") / F.col("cells"))
    return shares.groupBy("unit", "cells", "sites").agg(
        F.count(F.lit(1)).alias("alleles"), (-F.sum(F.col("_p") * F.ln("_p"))).alias("entropy"),
        F.max("_p").alias("top_allele_fraction"),
    ).withColumn("normalised_entropy", F.col("entropy") / F.ln("cells"))


def informative_sites(typed: DataFrame, at_least: int = 20) -> DataFrame:
    """Sites with both states among enough observed cells (A9, A26 with missing data)."""
    return typed.groupBy("unit", "site").agg(
        F.count("edited").alias("observed"), F.sum("edited").alias("edits")).where(
        (F.col("observed") >= at_least) & (F.col("edits") > 0) & (F.col("edits") < F.col("observed"))
    ).select("unit", "site")


def variable_characters(typed: DataFrame) -> DataFrame:
    """Characters with more than one state, missing ignored (A26, complete data)."""
    return typed.where(F.col("edited").isNotNull()).groupBy("unit", "site").agg(
        F.count_distinct("edited").alias("states")).where("states > 1")


def site_pairs(sites: DataFrame, stratum: str, wanted: int, seed) -> DataFrame:
    """Sampled site pairs within one unit or between units, without repetition.

    Sites are put in (unit, site) order; a site's partners are a run of later
    ranks, so running totals of their numbers give every pair a number.  Numbers
    are drawn, and only drawn pairs are made.
    """
    return _stratum_pairs(_ranked_sites(sites), stratum, wanted, seed)


def _ranked_sites(sites: DataFrame) -> DataFrame:
    return shuffled(number_rows(sites.select("unit", "site").distinct(), [], ["unit", "site"], "rank"), "sites")


def _stratum_pairs(ranked: DataFrame, stratum: str, wanted: int, seed) -> DataFrame:
    last = ranked.groupBy("unit").agg(F.max("rank").alias("_last"))
    every = ranked.count()
    first, count = ((F.col("rank") + 1, F.col("_last") - F.col("rank")) if stratum == "within"
                    else (F.col("_last") + 1, F.lit(every) - F.col("_last")))
    runs = ranked.join(last, "unit").withColumn("_next", first).withColumn("_partners", count).where("_partners > 0")
    return _drawn_pairs(runs, [], ranked, stratum, wanted, seed)


def _drawn_pairs(runs: DataFrame, keys: list[str], ranked: DataFrame, stratum: str, wanted: int, seed) -> DataFrame:
    """Drawn site pairs: ``runs`` has for each rank its number of partners, a run of ranks from ``_next`` on."""
    placed = shuffled(running_total(runs, keys, ["rank"], F.col("_partners"), "_upto"), "runs")
    totals = placed.groupBy(*keys).agg(F.max("_upto").alias("_total")).where("_total > 0").withColumn("stratum", F.lit(stratum))
    numbers = distinct_numbers(totals, ["stratum", *keys], "_total", wanted, seed, "_number")
    starts = placed.select(*keys, (F.col("_upto") - F.col("_partners")).alias("_number"), "rank", "_next",
                           (F.col("_upto") - F.col("_partners")).alias("_first"))
    found = bracket(numbers, starts, keys, "_number", "_run").select(
        "stratum", *keys, F.col("_run.rank").alias("rank_a"),
        (F.col("_run._next") + F.col("_number") - F.col("_run._first")).alias("rank_b"))
    for side in ("a", "b"):
        names = ranked.select(*[F.col(k) for k in keys], F.col("rank").alias(f"rank_{side}"),
                              F.col("unit").alias(f"unit_{side}"), F.col("site").alias(f"site_{side}"))
        found = found.join(names, [*keys, f"rank_{side}"])
    return found.select("stratum", "unit_a", "site_a", "unit_b", "site_b")


#: Cells whose calls at one site are one row: this many words of 64 bits.
PACKED_WORDS = 64


def packed_sites(typed: DataFrame, sites: DataFrame, words: int = PACKED_WORDS) -> DataFrame:
    """Calls of the named sites as bits: (unit, site, block, seen, ones), arrays of ``words`` words a block of cells.

    Bit i of a block is its i-th cell, in no special order; ``seen`` marks cells with a call and ``ones`` edited ones.  Of repeated
    calls of one cell an edited one counts.
    """
    seen = typed.where(F.col("edited").isNotNull()).select("cell", "unit", "site", "edited").join(
        sites.select("unit", "site").distinct(), ["unit", "site"], "left_semi")
    seen = shuffled(seen, "calls")
    # numbers without gaps inside a partition: blocks are full but the last of each partition
    places = shuffled(seen.select("cell").distinct().withColumn("_no", F.monotonically_increasing_id()), "cells")
    at = F.col("_no")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    block = F.floor(at / (64 * words)).alias("block")
    by_word = seen.join(places, "cell").groupBy("unit", "site", block, (F.floor(at / 64) % words).alias("_word")).agg(
        F.bit_or(bit).alias("seen"), F.bit_or(F.when(F.col("edited") == 1, bit).otherwise(0)).alias("ones"))
    filled = by_word.groupBy("unit", "site", "block").agg(*[
        F.map_from_entries(F.collect_list(F.struct("_word", name))).alias(name) for name in ("seen", "ones")])  # at most ``words`` each
    every = F.sequence(F.lit(0).cast("long"), F.lit(words - 1).cast("long"))

    def dense(name: str) -> Column:
        return F.transform(every, lambda w: F.coalesce(F.try_element_at(F.col(name), w), F.lit(0).cast("long"))).alias(name)
    return shuffled(filled.select("unit", "site", "block", dense("seen"), dense("ones")), "packed")


def pair_gametes(typed: DataFrame, pairs: DataFrame, words: int = PACKED_WORDS) -> DataFrame:
    """Counts of the four state combinations per site pair over common cells.

    Both sites' bits meet block by block: a pair makes one row per ``64 * words`` cells, not one per cell.
    """
    ends = pairs.selectExpr("unit_a as unit", "site_a as site").unionByName(pairs.selectExpr("unit_b as unit", "site_b as site"))
    packed = packed_sites(typed, ends, words)

    def side(tag: str) -> DataFrame:
        return packed.selectExpr(f"unit as unit_{tag}", f"site as site_{tag}", "block", f"seen as seen_{tag}", f"ones as ones_{tag}")
    both = pairs.join(side("a"), ["unit_a", "site_a"]).join(side("b"), ["unit_b", "site_b", "block"])

    def counted(x: int, y: int) -> Column:
        def of(tag: str, state: int) -> Column:
            ones, seen = F.col(f"ones_{tag}"), F.col(f"seen_{tag}")
            return ones if state else F.zip_with(seen, ones, lambda s, o: s.bitwiseAND(F.bitwise_not(o)))
        hits = F.zip_with(of("a", x), of("b", y), lambda a, b: F.bit_count(a.bitwiseAND(b)).cast("long"))
        return F.sum(F.aggregate(hits, F.lit(0).cast("long"), lambda total, n: total + n))
    return both.groupBy("stratum", "unit_a", "site_a", "unit_b", "site_b").agg(*[
        counted(x, y).alias(f"n{x}{y}") for x in (0, 1) for y in (0, 1)])


def pair_statistics(typed: DataFrame, wanted: int, seed, at_least: int = 20, min_sites: int = 4) -> DataFrame:
    """Four-gamete incompatibility and mean absolute association by stratum."""
    sites = shuffled(informative_sites(typed, at_least), "informative")
    enough = sites.where(sites.agg(F.count(F.lit(1)).alias("n")).select("n").scalar() >= min_sites)
    ranked = _ranked_sites(enough)
    pairs = shuffled(_stratum_pairs(ranked, "within", wanted, seed).unionByName(
        _stratum_pairs(ranked, "between", wanted, seed)), "site_pairs")
    # a pair without any common cell still counts as a sampled pair
    found = pairs.join(pair_gametes(typed, pairs), pairs.columns, "left").na.fill(0, ["n00", "n01", "n10", "n11"])
    n = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    usable = n >= at_least
    scored = found.select(
        "stratum",
        F.when(usable, ((F.col("n00") > 0) & (F.col("n01") > 0) & (F.col("n10") > 0) & (F.col("n11") > 0)).cast("int"))
        .alias("incompatible"),
        F.when(usable, phi("n11", "n10", "n01", "n00")).alias("association"))
    return scored.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("incompatible").alias("incompatible_fraction"),
        F.avg(F.abs("association")).alias("mean_abs_association"))


def phi(n11: str, n10: str, n01: str, n00: str) -> Column:
    """Correlation of two binary columns from their four counts; null when one does not vary."""
    a, b, c, d = (F.col(x).cast("double") for x in (n11, n10, n01, n00))
    return F.try_divide(a * d - b * c, F.sqrt((a + b) * (c + d) * (a + c) * (b + d)))


def excess_association(statistics: DataFrame, keys: list[str]) -> DataFrame:
    """Association within units minus between units (A10)."""
    def pick(name):
        return F.max(F.when(F.col("stratum") == name, F.col("mean_abs_association")))
    return statistics.groupBy(*keys).agg((pick("within") - pick("between")).alias("excess_association"))


def unit_features(typed: DataFrame, cells: DataFrame, wanted: int, seed) -> DataFrame:
    """Fourteen-column feature vector per unit.

    The edited fraction is the mean over all cells of edits / max(observed, 1).
    """
    n_cells = cells.select("cell").distinct().agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    rates = site_rates(typed, ["unit", "site"])
    per_site = rates.groupBy("unit").agg(
        F.count(F.lit(1)).alias("sites"), F.avg("rate").alias("site_rate_mean"),
        F.percentile("rate", 0.5).alias("site_rate_median"),
        F.avg((F.col("rate") >= 0.99).cast("int")).alias("site_rate_saturated"),
        F.sum("observed").alias("_observed"))
    per_cell = cell_burden(typed, ["unit", "cell"]).groupBy("unit").agg(
        F.sum("edits").alias("_edits"),
        F.sum(F.col("edits") / F.greatest(F.col("observed"), F.lit(1))).alias("_fraction"))
    alleles = allele_diversity(typed).select("unit", "alleles", "normalised_entropy", "top_allele_fraction")
    pairs = unit_pair_statistics(typed, wanted, seed)
    index = F.dense_rank().over(Window.orderBy("unit"))  # one row per unit
    return (
        per_site.join(per_cell, "unit").join(alleles, "unit", "left").join(pairs, "unit", "left")
        .withColumn("_cells", n_cells)
        .select(
            "unit", index.alias("unit_index"), "sites",
            (F.col("_observed") / (F.col("sites") * F.col("_cells"))).alias("observed_fraction"),
            "site_rate_mean", "site_rate_median", "site_rate_saturated",
            (F.col("_edits") / F.col("_cells")).alias("edits_per_cell_mean"),
            (F.col("_fraction") / F.col("_cells")).alias("edited_fraction"),
            "alleles", "normalised_entropy", "top_allele_fraction", "incompatible_fraction", "mean_abs_association"))


def unit_pair_statistics(typed: DataFrame, wanted: int, seed, at_least: int = 20, min_sites: int = 4) -> DataFrame:
    """Within-unit pair statistics, ``wanted`` pairs drawn per unit."""
    sites = informative_sites(typed, at_least)
    enough = sites.groupBy("unit").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_sites)
    ranked = shuffled(number_rows(sites.join(enough, "unit"), ["unit"], ["site"], "rank"), "sites")
    runs = ranked.select("unit", "rank", (F.col("rank") + 1).alias("_next"), (F.col("_n") - F.col("rank")).alias("_partners"))
    names = ranked.select(F.col("unit").alias("_unit"), "unit", "site", "rank")
    chosen = shuffled(_drawn_pairs(
        runs.where("_partners > 0").withColumnRenamed("unit", "_unit"), ["_unit"], names, "within", wanted, seed), "site_pairs")
    found = chosen.join(pair_gametes(typed, chosen), chosen.columns, "left").na.fill(0, ["n00", "n01", "n10", "n11"])
    usable = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11") >= at_least
    four = (F.col("n00") > 0) & (F.col("n01") > 0) & (F.col("n10") > 0) & (F.col("n11") > 0)
    return found.groupBy(F.col("unit_a").alias("unit")).agg(
        F.avg(F.when(usable, four.cast("int"))).alias("incompatible_fraction"),
        F.avg(F.when(usable, F.abs(phi("n11", "n10", "n01", "n00")))).alias("mean_abs_association"))


def dataset_summary(typed: DataFrame, cells: DataFrame) -> DataFrame:
    """One feature row per dataset: site rates, edits per cell, allele diversity.

    Every table carries ``dataset``; cells without a row count with no edits.
    """
    rates = site_rates(typed, ["dataset", "unit", "site"]).groupBy("dataset").agg(
        F.avg("rate").alias("site_rate_mean"), F.percentile("rate", 0.5).alias("site_rate_median"),
        F.avg((F.col("rate") >= 0.99).cast("int")).alias("site_rate_saturated"))
    edits = typed.groupBy("dataset", "cell").agg(F.coalesce(F.sum("edited"), F.lit(0)).alias("edits"))
    burden = cells.select("dataset", "cell").distinct().join(edits, ["dataset", "cell"], "left").withColumn(
        "edits", F.coalesce("edits", F.lit(0))).groupBy("dataset").agg(
        F.avg("edits").alias("edits_per_cell_mean"), F.stddev_samp("edits").alias("edits_per_cell_sd"))
    merged = typed.withColumn("unit", F.struct("dataset", "unit"))
    alleles = allele_diversity(merged).groupBy(F.col("unit.dataset").alias("dataset")).agg(
        F.avg("cells").alias("comparable_cells"), F.avg("sites").alias("comparable_sites"),
        F.avg("alleles").alias("alleles_per_unit"), F.avg("normalised_entropy").alias("normalised_entropy"),
        F.avg("top_allele_fraction").alias("top_allele_fraction"))
    return rates.join(burden, "dataset").join(alleles, "dataset", "left")


def metric_spread(table: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Level and spread of each metric over its finite values."""
    long = table.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        keys, metrics, "metric", "value")
    finite = long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    return finite.groupBy(*keys, "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.try_divide(F.stddev_samp("value"), F.abs(F.avg("value"))).alias("cv"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def lowest(table: DataFrame, order: list[str], k: int) -> DataFrame:
    """The k rows that come first."""
    return table.orderBy(*order).limit(k)


def molecule_statistics(molecules: DataFrame) -> DataFrame:
    """Per molecule: distinct calls, largest group of equal edited calls, edited targets.

    ``0`` counts as a call for the distinct count and not for the span.  A
    molecule holds no more calls than it has targets.
    """
    calls = molecules.groupBy("mol", "call").agg(F.count(F.lit(1)).alias("n"))
    edited = F.col("call") != "0"
    return calls.groupBy("mol").agg(
        F.count(F.lit(1)).alias("distinct_calls"),
        F.coalesce(F.max(F.when(edited, F.col("n"))), F.lit(0)).alias("span"),
        F.coalesce(F.sum(F.when(edited, F.col("n"))), F.lit(0)).alias("edited"))


def level_histogram(table: DataFrame, value: str, levels: list[int], keys: list[str] | None = None) -> DataFrame:
    """Counts per level, levels without a row included."""
    keys = keys or []
    counts = table.groupBy(*keys, F.col(value).cast("long").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    every = F.explode(F.array(*[F.lit(x).cast("long") for x in levels])).alias("level")
    if keys:
        grid = counts.select(*keys).distinct().select(*keys, every)
    else:
        grid = table.sparkSession.range(1).select(every)
    return grid.join(counts, [*keys, "level"], "left").select(
        *keys, "level", F.coalesce("n", F.lit(0)).alias("n"))


def allele_spectrum(molecules: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Allele spectrum per target; entropy normalised by log of distinct alleles, 0 for one."""
    keys = [*(keys or []), "target"]
    counts = molecules.groupBy(*keys, "call").agg(F.count(F.lit(1)).alias("n"))
    # sum(p ln p) = sum(n ln n)/N - ln N, so one more aggregation is enough
    n, total = F.col("n").cast("double"), F.sum("n")
    grouped = counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("distinct_alleles"),
        (F.ln(total) - F.sum(n * F.ln(n)) / total).alias("entropy"),
        (F.max("n") / total).alias("top_fraction"),
        # the first name wins a tie
        F.min_by("call", F.struct((-F.col("n")).alias("a"), F.col("call").alias("b"))).alias("top_allele"))
    return grouped.withColumn("normalised_entropy", F.when(
        F.col("distinct_alleles") > 1, F.col("entropy") / F.ln("distinct_alleles")).otherwise(0.0))


def target_pairs(molecules: DataFrame, targets: list[int], keys: list[str] | None = None) -> DataFrame:
    """Contingency of every pair of targets over molecules that read both.

    Each molecule becomes one row of calls; the counts of all pairs are plain
    conditional sums over those rows, so no pair rows are ever made.
    """
    keys = keys or []
    row = molecules.groupBy(*keys, "mol").agg(*[
        F.max(F.when(F.col("target") == t, F.col("call"))).alias(f"t{t}") for t in targets])
    sums, cells = [], []
    for i, a in enumerate(targets):
        for b in targets[i + 1:]:
            x, y = F.col(f"t{a}"), F.col(f"t{b}")
            names = {
                "n11": (x != "0") & (y != "0"), "n10": (x != "0") & (y == "0"), "n01": (x == "0") & (y != "0"),
                "n00": (x == "0") & (y == "0"), "same_call": (x != "0") & (x == y)}
            sums += [count_where(c).alias(f"{n}_{a}_{b}") for n, c in names.items()]
            cells.append(F.struct(
                F.lit(a).alias("target_a"), F.lit(b).alias("target_b"), F.lit(b - a).alias("gap"),
                *[F.col(f"{n}_{a}_{b}").alias(n) for n in names]))
    flat = row.groupBy(*keys).agg(*sums).select(*keys, F.inline(F.array(*cells)))
    return flat.withColumn("phi", phi("n11", "n10", "n01", "n00")).withColumn(
        "same_given_both", F.try_divide(F.col("same_call"), F.col("n11")))


def pair_means_by_gap(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean phi and conditional share per gap."""
    return pairs.groupBy(*keys, "gap").agg(F.avg("phi").alias("phi"), F.avg("same_given_both").alias("same_given_both"))


def wide_molecules(alleles: DataFrame, positions: list[int]) -> DataFrame:
    """One row per (cell, unit) with its calls at ordered positions; unedited places are 0."""
    kept = alleles.where(F.col("position").isin(positions)).groupBy("cell", "unit").agg(
        F.map_from_entries(F.collect_list(F.struct("position", "allele"))).alias("_calls"))
    return kept.select("cell", "unit", F.array(*[
        F.coalesce(F.try_element_at("_calls", F.lit(p)), F.lit(0.0)) for p in positions]).alias("calls"))


def nearest_setting(sweep: DataFrame, setting: str, value: str, target: float, keys: list[str]) -> DataFrame:
    """Mean of ``value`` per sweep point, its distance to the target and the best row flag."""
    means = sweep.groupBy(*keys, setting).agg(F.avg(value).alias("mean_rate")).withColumn(
        "distance", F.abs(F.col("mean_rate") - F.lit(target)))
    first = F.min(F.struct("distance", setting)).over(Window.partitionBy(*keys))  # one row per sweep point
    return means.withColumn("is_best", F.struct("distance", setting) == first)


def span_distance(histograms: DataFrame, reference: DataFrame, candidate: str) -> DataFrame:
    """L1 distance of span histograms from level 1 on, shares >= 7 and 2-6."""
    def share(df: DataFrame, keys: list[str]) -> DataFrame:
        some = df.where("level >= 1")
        return some.withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(*keys))))
    ours = share(histograms, [candidate])
    theirs = share(reference, []).selectExpr("level", "share as _reference")
    return ours.join(theirs, "level", "left").groupBy(candidate).agg(
        F.sum(F.abs(F.col("share") - F.coalesce("_reference", F.lit(0.0)))).alias("l1_distance"),
        F.sum(F.when(F.col("level") >= 7, F.col("share")).otherwise(0.0)).alias("span_ge7"),
        F.sum(F.when(F.col("level").between(2, 6), F.col("share")).otherwise(0.0)).alias("span_2to6"))


def rarefaction(outcomes: DataFrame, outcome: str, key: str, depths: list[int], seed) -> DataFrame:
    """Distinct outcomes among the first k of one shuffled order."""
    shuffled = number_rows(outcomes.withColumn("_order", draw_order(seed, key)), [], ["_order", key], "_rank")
    first = shuffled.groupBy(outcome).agg(F.min("_rank").alias("_rank"))
    counts = first.agg(*[count_where(F.col("_rank") <= k).alias(f"k{k}") for k in depths])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("depth"), F.col(f"k{k}").alias("distinct_outcomes")) for k in depths])))


def distinct_states(molecules: DataFrame) -> DataFrame:
    """Distinct states per target and distinct whole-molecule outcomes in one table."""
    per_target = molecules.groupBy(F.col("target").cast("string").alias("scope")).agg(
        F.count_distinct("call").alias("distinct_states"))
    whole = molecules.groupBy("mol").agg(
        F.array_sort(F.collect_list(F.struct("target", "call"))).alias("_outcome")).agg(
        F.count_distinct("_outcome").alias("distinct_states")).select(F.lit("molecule").alias("scope"), "distinct_states")
    return per_target.unionByName(whole)


def quantile_distance(samples: DataFrame, reference: DataFrame, candidate: str, value: str = "rate",
                      steps: int = 99) -> DataFrame:
    """Mean absolute difference of the percentiles 1..99 to a reference.
    """
    probabilities = {f"p{i}": i / (steps + 1) for i in range(1, steps + 1)}
    together = samples.select(F.col(candidate).alias("_who"), value, F.lit(0).alias("_reference")).unionByName(
        reference.select(F.lit(None).cast(samples.schema[candidate].dataType).alias("_who"), value, F.lit(1).alias("_reference")))
    keyed = together.withColumn("_who", F.struct("_reference", "_who"))
    points = percentiles(keyed, ["_who"], value, probabilities).select("_who", F.array(*probabilities).alias("_q"))
    points = shuffled(points, "quantiles")  # one row per candidate
    wanted = points.where("_who._reference = 1").select("_q").scalar()
    ours = points.where("_who._reference = 0").select(F.col("_who._who").alias(candidate), "_q").withColumn("_r", wanted)
    gaps = F.zip_with("_q", "_r", lambda a, b: F.abs(a - b))
    return ours.select(candidate, (F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / steps).alias("quantile_distance"))


def carry_over(existing: DataFrame, rerun: DataFrame, key: str) -> DataFrame:
    """New rows replace the old rows of their key; the other old rows stand."""
    return rerun.unionByName(existing.join(rerun.select(key).distinct(), key, "left_anti"))


def captured_entries(features: DataFrame, cells: str, share: float = 0.15, real: str = "real") -> DataFrame:
    """Captured entries and a flag for the low tail of the real dataset."""
    real_rows = features.where(F.col("dataset") == real)
    low = {m: real_rows.agg(F.percentile(m, share).alias("q")).select("q").scalar()
           for m in ("normalised_entropy", "edits_per_cell_mean")}
    with_cuts = features.withColumn("_low_entropy", low["normalised_entropy"]).withColumn(
        "_low_edits", low["edits_per_cell_mean"])
    flag = (F.col("dataset") == real) & (
        (F.col("normalised_entropy") < F.col("_low_entropy")) | (F.col("edits_per_cell_mean") < F.col("_low_edits")))
    return with_cuts.withColumn("captured", F.col("observed_fraction") * F.col("sites") * F.col(cells)).withColumn(
        "low_tail", F.coalesce(flag, F.lit(False))).drop("_low_entropy", "_low_edits")


def growth_summary(runs: DataFrame, keys: list[str], founders: float) -> DataFrame:
    """Median generation of survivors, growth per generation and effective rate."""
    middle = percentiles(runs, keys, "generation", {"generation": 0.5})
    sizes = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("alive"), F.avg("edited").alias("saturation"))
    joined = sizes.join(middle, keys)
    return joined.select(
        *keys, "alive", "generation", "saturation",
        F.when(F.col("generation") > 0, F.pow(F.col("alive") / F.lit(float(founders)), F.lit(1.0) / F.col("generation")))
        .alias("growth_per_generation"),
        F.when((F.col("generation") > 0) & (F.col("saturation") < 1),
               per_division_rate(F.col("saturation"), F.col("generation"))).alias("effective_rate"))
