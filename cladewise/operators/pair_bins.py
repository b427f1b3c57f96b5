"""Cell pairs by distance bin without listing the pairs: counts, and draws from the counts.

The cells of a group are put along a space-filling curve (Z-order) and cut into
leaves of equal numbers of cells; ``FAN`` neighbouring tiles make a tile of the next
level, up to one tile a group.  Starting from the pair of the top tile with itself,
a pair of tiles whose boxes are so far apart that all its distances are in one bin
counts as a product; any other pair is replaced by the pairs of its parts.  What
is left are pairs of leaves on a border of bins, whose cells are compared in numpy
and only counted.  So a pair of cells is a row only where it was drawn.

The pairs of a bin have numbers: pairs follow the leaf of their first cell, then
the leaf of the second one, then both cells (first and second along the curve).
Running totals of the counts give every entry its first number, so a drawn number
finds its entry by an as-of lookup and its pair by arithmetic, or by comparing
one pair of leaves.

With n cells there are about (n / leaf)^1.5 entries in the plane, fewer than n up to
leaf^3 cells; a level of the tree is one round of equi-joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.functions import bins
from cladewise.functions.asof import bracket
from cladewise.functions.ranking import number_rows, running_total
from cladewise.functions.sampling import distinct_numbers
from cladewise.operators.spatial import dealt_values
from cladewise.session import shuffled

LEAF, FAN, CURVE_BITS = 256, 8, 16
#: Cells of a side where all pairs are measured, and how many block pairs a task may get.
BLOCK, BLOCK_PAIRS = 2048, 128


def curve_code(coords: list[str], low: list[Column], side: Column) -> Column:
    """Place on the Z-order curve over a grid of 2^``CURVE_BITS`` steps an axis."""
    steps = float(1 << CURVE_BITS)
    total = F.lit(0).cast("long")
    for axis, (c, start) in enumerate(zip(coords, low)):
        step = F.when(side > 0, F.least(F.floor((F.col(c) - start) / side * steps), F.lit(int(steps) - 1))).otherwise(0).cast("long")
        for bit in range(CURVE_BITS):
            total = total + F.call_function(
                "shiftleft", F.call_function("shiftright", step, F.lit(bit)).bitwiseAND(F.lit(1)), F.lit(bit * len(coords) + axis))
    return total


def bin_state(value: Column, breaks: list[float], right: bool) -> Column:
    """0-based bin of a value; -1 before all bins, their number behind them.  Never falls as the value rises."""
    last = len(breaks) - 1
    if right:
        passed = sum((F.when(value > b, 1).otherwise(0) for b in breaks), F.lit(0)) - 1
        return F.when(value == breaks[0], 0).otherwise(passed)
    passed = sum((F.when(value >= b, 1).otherwise(0) for b in breaks), F.lit(0)) - 1
    return F.when(value == breaks[-1], last - 1).otherwise(passed)


def bin_states(values: np.ndarray, breaks: np.ndarray, right: bool) -> np.ndarray:
    """``bin_state`` of an array."""
    if right:
        found = np.searchsorted(breaks, values, side="left") - 1
        found[values == breaks[0]] = 0
    else:
        found = np.searchsorted(breaks, values, side="right") - 1
        found[values == breaks[-1]] = len(breaks) - 2
    return found


def _leaf_distances(row: dict, coords: list[str]) -> np.ndarray:
    total = 0.0
    for c in coords:
        gap = row[f"{c}_a"][:, None] - row[f"{c}_b"][None, :]
        total = total + gap * gap
    return np.sqrt(total)


def _leaf_rows(batch: pa.RecordBatch, coords: list[str]) -> Iterator[dict]:
    """Rows with numbers as Python values and coordinates as arrays."""
    plain = {n: batch[n].to_pylist() for n in batch.schema.names if n[:-2] not in coords}
    lists = {n: (batch[n].flatten().to_numpy(), batch[n].offsets.to_numpy()) for n in batch.schema.names if n not in plain}
    for i in range(batch.num_rows):
        row = {n: v[i] for n, v in plain.items()}
        for n, (flat, offsets) in lists.items():
            row[n] = flat[offsets[i] - offsets[0]:offsets[i + 1] - offsets[0]]
        yield row


def _in_bins(row: dict, coords: list[str], breaks: np.ndarray, right: bool) -> np.ndarray:
    """Bins of the pairs of two leaves; -1 for pairs that are no pair (a leaf with itself) or in no bin."""
    state = bin_states(_leaf_distances(row, coords), breaks, right)
    state[state == len(breaks) - 1] = -1
    if row["ka"] == row["kb"]:
        state[np.tril_indices(len(state))] = -1
    return state


class PairBins:
    """The tile tree of the cells of each group, and the entries of each bin.

    ``cells`` has the ``keys`` (null is a group of its own), a unique ``order`` and the ``coords``; cells
    without a position take no part.  ``carry`` names columns that drawn pairs show.
    """

    def __init__(self, cells: DataFrame, keys: list[str], order: str, coords: list[str], breaks: list[float],
                 right: bool = False, carry: list[str] = (), leaf: int = LEAF) -> None:
        self.keys, self.order, self.coords, self.right, self.leaf = keys, order, coords, right, leaf
        self.breaks = bins.check_breaks(breaks)
        self.carry = [c for c in dict.fromkeys([order, *carry])]
        placed = reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in coords])
        base = cells.where(placed).select(
            *keys, F.struct(*[F.col(c) for c in self.carry]).alias("_own"), F.col(order).alias("_id"),
            *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(coords)])
        self._axes = [f"c{i}" for i in range(len(coords))]
        base = shuffled(base, "cells")
        extent = [F.max(c) - F.min(c) for c in self._axes]
        boxes = base.groupBy(*keys).agg(
            *[F.min(c).alias(f"_lo{i}") for i, c in enumerate(self._axes)],
            (F.greatest(*extent) if len(extent) > 1 else extent[0]).alias("_side"), F.count(F.lit(1)).alias("_n"))
        self.groups = shuffled(boxes.withColumn("_g", F.monotonically_increasing_id()), "groups")
        self.cells = self._ranked(base)
        self.leaves = self._leaves()
        self.entries = self._entries()

    def _by_keys(self, left: DataFrame, right: DataFrame, columns: list) -> DataFrame:
        """Join on the keys, null matching null."""
        on = reduce(Column.__and__, [F.col(f"near.`{k}`").eqNullSafe(F.col(f"far.`{k}`")) for k in self.keys], F.lit(True))
        if not self.keys:
            right = F.broadcast(right)  # one row
        return left.alias("near").join(right.alias("far"), on).select(*columns)

    def _ranked(self, base: DataFrame) -> DataFrame:
        low = [F.col(f"far._lo{i}") for i in range(len(self._axes))]
        coded = self._by_keys(base, self.groups, [
            "far._g", "far._n", "near._own", "near._id", *[f"near.{c}" for c in self._axes],
            curve_code([f"near.{c}" for c in self._axes], low, F.col("far._side")).alias("_code")])
        ranked = number_rows(coded, ["_g"], ["_code", "_id"], "_rank")
        return shuffled(ranked.withColumn("p", F.col("_rank") - 1).drop("_rank", "_code", "_id"), "ranked")

    def _leaves(self) -> DataFrame:
        """A row per leaf: its cells' coordinates along the curve, and its box."""
        point = F.struct("p", *self._axes)
        rows = self.cells.groupBy("_g", F.floor(F.col("p") / self.leaf).alias("k")).agg(
            F.first("_n").alias("_n"), F.sort_array(F.collect_list(point)).alias("_points"),  # at most ``leaf`` cells
            *[f(c).alias(f"{name}_{c}") for c in self._axes for f, name in ((F.min, "lo"), (F.max, "hi"))])
        return shuffled(rows.select(
            "_g", "k", "_n", *[F.col("_points").getField(c).alias(c) for c in self._axes], *self._box()), "leaves")

    def _box(self, tag: str = "") -> list[Column]:
        return [F.col(f"{side}_{c}").alias(f"{side}_{c}{tag}") for c in self._axes for side in ("lo", "hi")]

    def _size(self, k: str, level: int) -> Column:
        """Cells of tile ``k`` of a level: all full but the last of a group."""
        full = self.leaf * FAN**level
        return F.least(F.lit(full), F.col("_n") - F.col(k) * full)

    def _bounds(self, sign: int) -> Column:
        """Least (-1) or greatest (1) distance that two boxes allow."""
        total = F.lit(0.0)
        for c in self._axes:
            one, other = F.col(f"lo_{c}_b") - F.col(f"hi_{c}_a"), F.col(f"lo_{c}_a") - F.col(f"hi_{c}_b")
            gap = F.greatest(one, other, F.lit(0.0)) if sign < 0 else F.greatest(
                F.abs(F.col(f"hi_{c}_b") - F.col(f"lo_{c}_a")), F.abs(F.col(f"hi_{c}_a") - F.col(f"lo_{c}_b")))
            total = total + gap * gap
        return F.sqrt(total)

    def _entries(self) -> DataFrame:
        """(_g, bin, ka, kb, count, listed): leaf ``ka`` with the leaves from ``kb`` on, in the order of pair numbers."""
        top, widest = 0, self.leaves.agg(F.max("k")).first()[0]
        while widest is not None and widest >= FAN**top:
            top += 1
        tiles = [self.leaves.select("_g", "k", *self._box())]
        for _ in range(top):
            up = tiles[-1].groupBy("_g", F.floor(F.col("k") / FAN).alias("k")).agg(*[
                f(f"{name}_{c}").alias(f"{name}_{c}") for c in self._axes for f, name in ((F.min, "lo"), (F.max, "hi"))])
            tiles.append(shuffled(up, "tiles"))
        open_pairs = self.groups.select("_g", "_n", F.lit(0).cast("long").alias("ka"), F.lit(0).cast("long").alias("kb"))
        found = []
        for level in range(top, -1, -1):
            seen = open_pairs
            for side in ("a", "b"):
                boxes = tiles[level].select("_g", F.col("k").alias(f"k{side}"), *self._box(f"_{side}"))
                seen = seen.join(boxes, ["_g", f"k{side}"])
            near, far = (bin_state(self._bounds(s), self.breaks, self.right) for s in (-1, 1))
            seen = seen.select("_g", "_n", "ka", "kb", near.alias("near"), far.alias("far"))
            outside = (F.col("far") < 0) | (F.col("near") == len(self.breaks) - 1)
            alike = (F.col("near") == F.col("far")) & (F.col("ka") != F.col("kb"))
            seen = shuffled(seen.where(~outside).select("_g", "_n", "ka", "kb", "near", alike.alias("alike")), "tile_pairs")
            found.append(self._products(seen.where("alike"), level))
            open_pairs = seen.where("not alike").select("_g", "_n", "ka", "kb")
            if level:
                for side in ("ka", "kb"):
                    parts = F.sequence(F.col(side) * FAN, F.col(side) * FAN + (FAN - 1))
                    open_pairs = open_pairs.withColumn(side, F.explode(parts)).where(
                        F.col(side) * self.leaf * FAN ** (level - 1) < F.col("_n"))
                open_pairs = open_pairs.where("ka <= kb")
        found.append(self._listed(open_pairs))
        self.border = open_pairs
        return shuffled(reduce(DataFrame.unionByName, found), "entries")

    def _products(self, pairs: DataFrame, level: int) -> DataFrame:
        leaves = F.sequence(F.col("ka") * FAN**level, F.col("ka") * FAN**level + (FAN**level - 1))
        others = self._size("kb", level)
        each = pairs.withColumn("_others", others).withColumn("ka", F.explode(leaves)).withColumn("_own", self._size("ka", 0)).where("_own > 0")
        return each.select("_g", "_n", F.col("near").alias("bin"), "ka", (F.col("kb") * FAN**level).alias("kb"),
                           (F.col("_own") * F.col("_others")).alias("count"), F.lit(False).alias("listed"))

    def _with_leaves(self, pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            points = self.leaves.select("_g", F.col("k").alias(f"k{side}"), *[F.col(c).alias(f"{c}_{side}") for c in self._axes])
            pairs = pairs.join(points, ["_g", f"k{side}"])
        return pairs

    def _listed(self, pairs: DataFrame) -> DataFrame:
        axes, breaks, right = self._axes, np.array(self.breaks), self.right

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in _leaf_rows(batch, axes):
                    state = _in_bins(row, axes, breaks, right)
                    counts = np.bincount(state[state >= 0], minlength=len(breaks) - 1)
                    out += [(row["_g"], row["_n"], int(b), row["ka"], row["kb"], int(counts[b]), True) for b in np.flatnonzero(counts)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                        zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))],
                        ["_g", "_n", "bin", "ka", "kb", "count", "listed"])

        return self._with_leaves(pairs).mapInArrow(
            count, "_g long, _n long, bin int, ka long, kb long, count long, listed boolean")

    def _named(self, table: DataFrame, columns: list) -> DataFrame:
        return table.join(self.groups.select("_g", *self.keys), "_g").select(*self.keys, *columns)

    def _label(self, names: list[str] | None) -> Column:
        names = names or bins.labels(self.breaks, self.right)
        return F.element_at(F.array(*[F.lit(n) for n in names]), F.col("bin") + 1).alias("distance_bin")

    def counts(self, names: list[str] | None = None) -> DataFrame:
        """Pairs of every group and bin that has any: the keys, ``distance_bin`` and ``candidate_pairs``."""
        sums = self.entries.groupBy("_g", "bin").agg(F.sum("count").alias("candidate_pairs"))
        return self._named(sums, [self._label(names), "candidate_pairs"])

    def distances(self, names: list[str] | None = None) -> DataFrame:
        """Pairs of every group and bin that has any, and their mean distance: the keys, ``distance_bin``, ``pairs``, ``mean_distance``.

        A mean needs the distance of every pair, so all pairs of cells are measured, block against block in numpy
        and a part of a block at a time.  The work grows like the square of the cells; what is shuffled is a row
        per pair of blocks.
        """
        point = F.struct("p", *self._axes)
        blocks = shuffled(self.cells.groupBy("_g", F.floor(F.col("p") / BLOCK).alias("k")).agg(
            F.sort_array(F.collect_list(point)).alias("_points")).select(
            "_g", "k", *[F.col("_points").getField(c).alias(c) for c in self._axes]), "blocks")
        last = blocks.groupBy("_g").agg(F.max("k").alias("_last"))
        pairs = blocks.select("_g", F.col("k").alias("ka")).join(last, "_g").select(
            "_g", "ka", F.explode(F.sequence("ka", "_last")).alias("kb"))
        for side in ("a", "b"):
            pairs = pairs.join(blocks.select(
                "_g", F.col("k").alias(f"k{side}"), *[F.col(c).alias(f"{c}_{side}") for c in self._axes]), ["_g", f"k{side}"])
        most = last.agg(F.sum((F.col("_last") + 1) * (F.col("_last") + 2) / 2)).first()[0] or 0
        tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(most) // BLOCK_PAIRS + 1)
        axes, breaks, right = self._axes, np.array(self.breaks), self.right

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in _leaf_rows(batch, axes):
                    counts, sums = np.zeros(len(breaks) - 1, dtype=np.int64), np.zeros(len(breaks) - 1)
                    own = len(row[f"{axes[0]}_a"])
                    for start in range(0, own, 64):
                        part = row | {f"{c}_a": row[f"{c}_a"][start:start + 64] for c in axes}
                        far = _leaf_distances(part, axes)
                        if row["ka"] == row["kb"]:
                            far = far[np.arange(far.shape[1])[None, :] > start + np.arange(len(far))[:, None]]
                        far = far.ravel()
                        state = bin_states(far, breaks, right)
                        inside = (state >= 0) & (state < len(breaks) - 1)
                        state, far = state[inside], far[inside]
                        counts += np.bincount(state, minlength=len(breaks) - 1)
                        sums += np.bincount(state, far, minlength=len(breaks) - 1)
                    out += [(row["_g"], int(b), int(counts[b]), float(sums[b])) for b in np.flatnonzero(counts)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                        zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["_g", "bin", "_pairs", "_sum"])

        found = pairs.repartition(tasks, "_g", "ka", "kb").mapInArrow(measure, "_g long, bin int, _pairs long, _sum double")
        means = found.groupBy("_g", "bin").agg(F.sum("_pairs").alias("pairs"), (F.sum("_sum") / F.sum("_pairs")).alias("mean_distance"))
        return self._named(means, [self._label(names), "pairs", "mean_distance"])

    def draws(self, cap: int, seed, names: list[str] | None = None) -> DataFrame:
        """At most ``cap`` pairs of each group and bin, all where there are no more.

        Their numbers are drawn by ``sampling.distinct_numbers``.  Pairs show the carried columns with ``_a`` and
        ``_b`` (``_a`` is smaller in ``order``), ``distance_bin`` and ``candidate_pairs``.
        """
        numbered = running_total(self.entries, ["_g", "bin"], ["ka", "kb"], F.col("count"), "_upto")
        numbered = shuffled(numbered.withColumn("_first", F.col("_upto") - F.col("count")), "numbered")
        totals = self._named(numbered.groupBy("_g", "bin").agg(F.max("_upto").alias("candidate_pairs")),
                             ["_g", "bin", "candidate_pairs"])
        chosen = distinct_numbers(totals, [*self.keys, "bin"], "candidate_pairs", cap, seed, "_number", ["_g", "bin"])
        entry = numbered.select("_g", "bin", F.col("_first").alias("_number"), "_n", "ka", "kb", "listed", F.col("_first").alias("first"))
        found = bracket(chosen, entry, ["_g", "bin"], "_number", "_entry")
        found = shuffled(found.select("*", "_entry.ka", "_entry.kb", "_entry._n", "_entry.listed",
                                     (F.col("_number") - F.col("_entry.first")).alias("_left")).drop("_entry"), "drawn")
        shown = ["_g", "bin", "candidate_pairs", *self.keys]
        pairs = self._arithmetic(found.where("not listed"), shown).unionByName(self._compared(found.where("listed"), shown))

        def side(tag: str) -> DataFrame:
            return self.cells.select("_g", F.col("p").alias(f"p{tag}"), F.col("_own").alias(f"_own_{tag}"))

        both = pairs.join(side("a"), ["_g", "pa"]).join(side("b"), ["_g", "pb"])
        turned = F.col(f"_own_a.`{self.order}`") > F.col(f"_own_b.`{self.order}`")
        one = F.when(turned, F.col("_own_b")).otherwise(F.col("_own_a"))
        two = F.when(turned, F.col("_own_a")).otherwise(F.col("_own_b"))
        return both.withColumn("_one", one).withColumn("_two", two).select(
            *self.keys, self._label(names), "candidate_pairs",
            *[F.col(f"{s}.`{c}`").alias(f"{c}_{tag}") for s, tag in (("_one", "a"), ("_two", "b")) for c in self.carry])

    def _arithmetic(self, drawn: DataFrame, shown: list[str]) -> DataFrame:
        """Pairs of products: full leaves follow each other, only the last of a group may be short."""
        own = self._size("ka", 0)
        at = F.floor(F.col("_left") / (own * self.leaf))
        spot = drawn.withColumn("_own", own).withColumn("kb", F.col("kb") + at).withColumn(
            "_left", F.col("_left") - at * F.col("_own") * self.leaf).withColumn("_others", self._size("kb", 0))
        return spot.select(
            *shown, (F.col("ka") * self.leaf + F.floor(F.col("_left") / F.col("_others"))).alias("pa"),
            (F.col("kb") * self.leaf + F.col("_left") % F.col("_others")).alias("pb"))

    def _compared(self, drawn: DataFrame, shown: list[str]) -> DataFrame:
        """Pairs of leaves on a border: the drawn places among the pairs that are in the bin."""
        axes, breaks, right, leaf = self._axes, np.array(self.breaks), self.right, self.leaf
        asked = drawn.groupBy("_g", "bin", "ka", "kb").agg(F.collect_list("_left").alias("_places"))  # at most cap

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in _leaf_rows(batch, axes):
                    one, two = np.nonzero(_in_bins(row, axes, breaks, right) == row["bin"])
                    out += [(row["_g"], row["bin"], row["ka"], row["kb"], i, row["ka"] * leaf + int(one[i]), row["kb"] * leaf + int(two[i]))
                            for i in row["_places"]]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), *[pa.int64()] * 5))],
                        ["_g", "bin", "ka", "kb", "_left", "pa", "pb"])

        places = self._with_leaves(asked).mapInArrow(look, "_g long, bin int, ka long, kb long, _left long, pa long, pb long")
        return drawn.join(places, ["_g", "bin", "ka", "kb", "_left"]).select(*shown, "pa", "pb")


def pair_counts(cells: DataFrame, keys: list[str], order: str, coords: list[str], breaks: list[float], right: bool = False,
                leaf: int = LEAF) -> DataFrame:
    """Number of cell pairs per group and distance bin, exact, without listing them."""
    return PairBins(cells, keys, order, coords, breaks, right, leaf=leaf).counts()


def stratified_pairs(cells: DataFrame, keys: list[str], order: str, carry: list[str], coords: list[str], breaks: list[float],
                     cap: int, seed, right: bool = False, leaf: int = LEAF) -> DataFrame:
    """At most ``cap`` cell pairs per group and distance bin, with the size of the bin."""
    return PairBins(cells, keys, order, coords, breaks, right, carry, leaf).draws(cap, seed)


def same_founder_by_distance(cells: DataFrame, keys: list[str], order: str, founder: str, coords: list[str], breaks: list[float],
                             cap: int | None, seed, right: bool = True, leaf: int = LEAF, permutations: int = 2) -> DataFrame:
    """Share of all pairs with the same founder per distance bin, with one null per group.

    ``pairs`` and the share rest on every pair of the bin: pairs of one founder are counted by a tile tree a
    founder.  ``mean_distance`` is that of the ``evaluated_pairs``: every pair, or with a ``cap`` that many drawn
    ones of a bin.  The null deals founders to other positions and takes the share of all pairs, whatever their
    distance, from the number of cells that each founder got.
    """
    every = PairBins(cells, keys, order, coords, breaks, right, coords, leaf)
    if cap is None:
        seen = every.distances().withColumn("evaluated_pairs", F.col("pairs"))
    else:
        far = reduce(Column.__add__, [(F.col(f"{c}_a") - F.col(f"{c}_b")) * (F.col(f"{c}_a") - F.col(f"{c}_b")) for c in coords])
        seen = every.draws(cap, seed).groupBy(*keys, "distance_bin").agg(
            F.max("candidate_pairs").alias("pairs"), F.avg(F.sqrt(far)).alias("mean_distance"), F.count(F.lit(1)).alias("evaluated_pairs"))
    seen = seen.select(*keys, "distance_bin", "pairs", "evaluated_pairs", "mean_distance")
    own = pair_counts(cells.where(F.col(founder).isNotNull()), [*keys, founder], order, coords, breaks, right, leaf)
    same = own.groupBy(*keys, "distance_bin").agg(F.sum("candidate_pairs").alias("_same"))
    n = F.col("_n").cast("double")
    dealt = dealt_values(cells, keys, order, founder, permutations, seed)
    each = dealt.groupBy(*keys, "permutation", "_value").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys, "permutation").agg(F.try_divide(
        F.sum(F.when(F.col("_value").isNotNull(), n * (n - 1)).otherwise(0.0)), F.sum(n) * (F.sum(n) - 1)).alias("_share"))
    null = each.groupBy(*keys).agg(F.avg("_share").alias("null_same_founder_fraction"))
    found = seen.join(same, [*keys, "distance_bin"], "left").withColumn(
        "same_founder_fraction", F.coalesce("_same", F.lit(0)) / F.col("pairs")).drop("_same")
    if keys:
        return found.join(null, keys)
    return found.withColumn("null_same_founder_fraction", each.agg(F.avg("_share").alias("n")).select("n").scalar())
