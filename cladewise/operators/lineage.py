"""From persistent-identifier division logs to event-resolved lineage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.functions.ranking import number_rows
from cladewise.operators.ancestry import cycle_members
from cladewise.session import shuffled


def plain_id(value: Column) -> Column:
    """Plain decimal text of a finite, non-negative whole number, else null."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    whole = text.try_cast("decimal(38,6)")
    good = number.isNotNull() & ~F.isnan(number) & (number >= 0) & (whole == F.floor(whole))
    return F.when(good, whole.cast("decimal(38,0)").cast("string"))


def _sure_id(column: str) -> Column:
    fail = F.raise_error(F.concat(F.lit(f"{column} is not a cell id: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
    return F.coalesce(plain_id(F.col(column)), fail.cast("string"))


def _within(time: Column, end_time: float) -> Column:
    fail = F.raise_error(F.lit("a division has no time or lies after end_time")).cast("double")
    return F.when(time.isNotNull() & (time <= F.lit(float(end_time))), time).otherwise(fail)


def division_violations(divisions: DataFrame) -> DataFrame:
    """Rows that break a rule of a division log, with the rule.

    Expects ``time, seq, parent_id, daughter_id``; *earlier* means earlier in
    (time, seq).  An empty result is a valid log.
    """
    rows = divisions.select(
        "seq", F.col("time").cast("double").alias("time"),
        F.col("parent_id").alias("raw_parent"), F.col("daughter_id").alias("raw_daughter"),
        plain_id(F.col("parent_id")).alias("parent"), plain_id(F.col("daughter_id")).alias("daughter"),
    )
    bad_time = F.col("time").isNull() | F.isnan("time") | (F.col("time") < 0) | (F.col("time") == float("inf"))
    checks = F.array(
        F.when(bad_time, F.lit("time")),
        F.when(F.col("parent").isNull(), F.lit("parent_id")),
        F.when(F.col("daughter").isNull(), F.lit("daughter_id")),
        F.when(F.col("parent") == F.col("daughter"), F.lit("own_daughter")),
    )
    by_row = rows.select("seq", F.explode(F.array_compact(checks)).alias("rule"))
    twice = (
        rows.where(F.col("daughter").isNotNull()).groupBy("daughter")
        .agg(F.count(F.lit(1)).alias("births")).where("births > 1").select("daughter")
    )
    born_twice = rows.join(twice, "daughter", "left_semi").select("seq", F.lit("born_twice").alias("rule"))
    first_parent = rows.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("daughter")).agg(
        F.min(F.struct("time", "seq")).alias("first_use"))
    existed = (
        rows.join(first_parent, "daughter")
        .where(F.col("first_use") < F.struct("time", "seq"))
        .select("seq", F.lit("already_existed").alias("rule"))
    )
    return by_row.unionByName(born_twice).unionByName(existed)


def node_violations(nodes: DataFrame) -> DataFrame:
    """Rows that break a rule of a node table, with the rule."""
    twice = nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(
        "node_id", F.lit("node_id_repeated").alias("rule"))
    checks = F.array(
        F.when(F.col("end_time") < F.col("birth_time"), F.lit("ends_before_birth")),
        F.when(F.col("branch_length") < 0, F.lit("negative_branch")),
    )
    by_row = nodes.select("node_id", F.explode(F.array_compact(checks)).alias("rule"))
    children = nodes.where(F.col("parent_node_id").isNotNull()).select("node_id", "parent_node_id", "birth_time")
    parents = nodes.select(F.col("node_id").alias("parent_node_id"), F.col("birth_time").alias("parent_birth"))
    linked = children.join(parents, "parent_node_id", "left")
    dangling = linked.where(F.col("parent_birth").isNull()).select("node_id", F.lit("parent_missing").alias("rule"))
    early = linked.where(F.col("birth_time") < F.col("parent_birth")).select(
        "node_id", F.lit("born_before_parent").alias("rule"))
    cycles = cycle_members(nodes).select("node_id", F.lit("in_cycle").alias("rule"))
    return twice.unionByName(by_row).unionByName(dangling).unionByName(early).unionByName(cycles)


def build_lineage(divisions: DataFrame, end_time: float, founder_time: float = 0.0,
                  founders: DataFrame | None = None) -> DataFrame:
    """Event-resolved lineage of a division log (L1).

    Every division closes the current segment of its parent and opens one
    segment for the continuing parent and one for the daughter.  The k-th
    division of a cell, in (time, seq) order, closes segment k-1, so the whole
    table follows from numbering the divisions of each cell; no replay is
    needed.  ``founders`` (column ``cell_id``) may hold cells that never divide.
    The log must be valid (``division_violations``); an id that is none or a
    division after ``end_time`` ends the job.
    """
    log = divisions.select(
        _within(F.col("time").cast("double"), end_time).alias("time"), F.col("seq").cast("long").alias("seq"),
        _sure_id("parent_id").alias("parent_id"), _sure_id("daughter_id").alias("daughter_id"),
    )
    # both numberings are read several times below, so each is written once
    log = shuffled(number_rows(log, [], ["time", "seq"], "event_no"), "events")
    log = shuffled(number_rows(log, ["parent_id"], ["time", "seq"], "nth"), "divisions")

    opened = log.select(
        F.inline(F.array(
            F.struct(F.col("parent_id").alias("cell_id"), F.col("nth").alias("segment"),
                     F.lit("continuing_parent").alias("opened_as")),
            F.struct(F.col("daughter_id").alias("cell_id"), F.lit(0).cast("long").alias("segment"),
                     F.lit("new_daughter").alias("opened_as")),
        )),
        F.col("time").alias("birth_time"), F.col("event_no").alias("opening_event"),
        F.concat_ws(":", "parent_id", (F.col("nth") - 1).cast("string")).alias("parent_node_id"),
    )
    cells = log.select(F.col("parent_id").alias("cell_id"))
    if founders is not None:
        cells = cells.unionByName(founders.select(plain_id(F.col("cell_id")).alias("cell_id")))
    born = log.select(F.col("daughter_id").alias("cell_id"))
    first = cells.distinct().join(born, "cell_id", "left_anti").select(
        "cell_id", F.lit(0).cast("long").alias("segment"), F.lit("founder").alias("opened_as"),
        F.lit(float(founder_time)).alias("birth_time"),
        F.lit(None).cast("long").alias("opening_event"), F.lit(None).cast("string").alias("parent_node_id"),
    )
    closed = log.select(
        F.col("parent_id").alias("cell_id"), (F.col("nth") - 1).alias("segment"),
        F.col("time").alias("closing_time"), F.col("event_no").alias("closing_event"),
    )
    segments = opened.unionByName(first).join(closed, ["cell_id", "segment"], "left")
    end = F.coalesce(F.col("closing_time"), F.lit(float(end_time)))
    return segments.select(
        F.concat_ws(":", "cell_id", F.col("segment").cast("string")).alias("node_id"),
        "cell_id", "segment", "parent_node_id", "birth_time", end.alias("end_time"),
        (end - F.col("birth_time")).alias("branch_length"),
        F.coalesce("closing_event", "opening_event").alias("division_event"),
        "opened_as", F.col("closing_event").isNull().alias("is_terminal"),
    )


def sequential_labels(nodes: DataFrame) -> DataFrame:
    """Add ``node_label`` = ``node_000001`` .. in birth order, on request only."""
    ordered = nodes.withColumn("_opens", F.coalesce(F.col("birth_time"), F.lit(0.0)))
    numbered = number_rows(ordered, [], ["_opens", "node_id"], "_no")
    digits = F.greatest(F.lit(6), F.length(F.col("_no").cast("string")))
    return numbered.withColumn("node_label", F.concat(F.lit("node_"), F.lpad(F.col("_no").cast("string"), digits, F.lit("0")))
                               ).drop("_no", "_opens")


def terminal_cells(nodes: DataFrame) -> DataFrame:
    """Tip table: one row per terminal segment."""
    return nodes.where("is_terminal").select(
        F.concat(F.lit("cell_"), F.col("cell_id")).alias("sample_id"), "cell_id", "node_id",
        "birth_time", "end_time", "branch_length",
    )


def active_at_checkpoints(nodes: DataFrame, times: list[float], cell_type: str = "cell_type",
                          alive: str = "is_terminal") -> DataFrame:
    """Active cells per type at checkpoint times, zeros included.

    A node is active at ``t`` when ``birth <= t`` and it has not ended by ``t``
    or is still alive.  Each node adds one at the first checkpoint that sees it
    and takes one away at the first that no longer does; running sums over the
    (type, checkpoint) table give the counts, so nodes are never multiplied by
    checkpoints.
    """
    marks = sorted(float(t) for t in times)
    spark = nodes.sparkSession

    def first_seen(moment: Column) -> Column:
        found = F.when(moment <= marks[0], 0)
        for index, mark in enumerate(marks[1:], start=1):
            found = found.when(moment <= mark, index)
        return found

    steps = nodes.select(
        F.col(cell_type).alias("cell_type"),
        F.inline(F.array(
            F.struct(first_seen(F.col("birth_time")).alias("step"), F.lit(1).alias("gain"), F.lit(1).alias("opened"),
                     F.when(F.col("opened_as") == "new_daughter", 1).otherwise(0).alias("events")),
            F.struct(F.when(~F.col(alive), first_seen(F.col("end_time"))).alias("step"),
                     F.lit(-1).alias("gain"), F.lit(0).alias("opened"), F.lit(0).alias("events")),
        )),
    )
    changes = steps.where(F.col("step").isNotNull()).groupBy("cell_type", "step").agg(
        F.sum("gain").alias("gain"), F.sum("opened").alias("opened"), F.sum("events").alias("events"))
    types = nodes.select(F.col(cell_type).alias("cell_type")).distinct()
    grid = types.select("cell_type", F.posexplode(F.array(*[F.lit(m) for m in marks])).alias("step", "time"))
    upto = Window.partitionBy("cell_type").orderBy("step")  # one row per checkpoint
    at_time = Window.partitionBy("step")  # one row per type
    filled = grid.join(changes, ["cell_type", "step"], "left")
    running = filled.select(
        "time", "cell_type", "step",
        F.coalesce(F.sum("gain").over(upto), F.lit(0)).alias("active_cells"),
        F.coalesce(F.sum("opened").over(upto), F.lit(0)).alias("_nodes"),
        F.coalesce(F.sum("events").over(upto), F.lit(0)).alias("_events"),
    )
    return running.select(
        "time", "cell_type", "active_cells",
        F.sum("active_cells").over(at_time).alias("total_active_cells"),
        F.sum("_nodes").over(at_time).alias("total_nodes"),
        F.sum("_events").over(at_time).alias("population_events"),
    )


def survivor_states(nodes: DataFrame, generations: DataFrame) -> DataFrame:
    """Survivor table with parent cell and pseudotime = generation / highest generation of all nodes."""
    top = generations.agg(F.max("generation").alias("top")).select("top").scalar()
    tips = nodes.where("is_terminal").join(generations.select("node_id", "generation"), "node_id")
    parents = nodes.select(F.col("node_id").alias("parent_node_id"), F.col("cell_id").alias("parent_cell_id"))
    return tips.join(parents, "parent_node_id", "left").select(
        "cell_id", "parent_cell_id", "generation",
        F.when(top > 0, F.col("generation") / top).otherwise(0.0).alias("pseudotime"),
        "birth_time", "end_time",
    )


def depth_from_lineage_text(value: Column, separator: str = "_") -> Column:
    """Segments of a delimited lineage string minus one; empty text is depth 0."""
    return F.when(value.isNull() | (value == ""), 0).otherwise(F.size(F.split(value, separator)) - 1)


def neighbour_count(value: Column) -> Column:
    """Entries of a ``;`` list, 0 when blank."""
    return F.when(value.isNull() | (F.trim(value) == ""), 0).otherwise(F.size(F.split(F.trim(value), ";")))


def ground_truth_edges(cells: DataFrame, cell: str, parent: str, root_name: str = "root") -> DataFrame:
    """Child/parent edges of cell records; several founders get one synthetic root.

    The root name is lengthened until no cell uses it.
    """
    links = cells.select(F.col(cell).cast("string").alias("node"), F.col(parent).cast("string").alias("parent"))
    founders = links.where(F.col("parent").isNull()).agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    clash = links.where(F.col("node").rlike(f"^{root_name}_*$")).agg(
        F.coalesce(F.max(F.length("node")) - len(root_name) + 1, F.lit(0)).alias("n")).select("n").scalar()
    root = F.concat(F.lit(root_name), F.repeat(F.lit("_"), clash))
    several = founders > 1
    edges = links.withColumn("parent", F.when(F.col("parent").isNull() & several, root).otherwise(F.col("parent")))
    parents = cells.where(F.col(parent).isNotNull()).select(F.col(parent).cast("string").alias("node")).distinct()
    return (
        edges.where(F.col("parent").isNotNull())
        .join(parents.withColumn("_inner", F.lit(True)), "node", "left")
        .select("node", "parent", F.col("_inner").isNull().alias("is_tip"))
    )
