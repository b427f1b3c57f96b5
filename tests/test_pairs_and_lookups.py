"""Pairs by distance bin, as-of lookups, gametes, ancestors at a time: against brute force."""

import bisect
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.functions import bins
from cladewise.functions.asof import bin_by_table, bracket
from cladewise.operators import ancestry, lineage, nearest_cells as nc, observations as ob, pair_bins as pb, tables as tb, trees as tr


def _points(kind, dim, seed=1):
    draw = np.random.default_rng(seed)
    rows = [("a" if i % 3 else None, i, *map(float, draw.normal(size=dim) * 200)) for i in range(400)]
    rows += [("c", 10_000 + i, *([5.0] * dim)) for i in range(120)]  # one place
    rows += [("d", 20_000, *([1.0] * dim)), ("e", 20_001, *([None] * dim)), ("e", 20_002, *([float("nan")] * dim))]
    rows += [("f", 30_000 + i, *([float(10 * i)] + [0.0] * (dim - 1))) for i in range(60)]  # distances on the breaks
    return rows


def _plain_bins(rows, breaks, right):
    found = {}
    groups = {}
    for g, cell, *place in rows:
        if place[0] is not None and not math.isnan(place[0]):
            groups.setdefault(g, []).append((cell, np.array(place)))
    labels = bins.labels(breaks, right)
    for g, cells in groups.items():
        for (a, x), (b, y) in itertools.combinations(sorted(cells, key=lambda c: c[0]), 2):
            d = math.sqrt(sum((x - y) ** 2))
            for i, (lo, hi) in enumerate(zip(breaks, breaks[1:])):
                inside = (lo < d <= hi or (i == 0 and d == lo)) if right else (lo <= d < hi or (i == len(labels) - 1 and d == hi))
                if inside:
                    found.setdefault((g, labels[i]), set()).add((a, b))
    return found


@pytest.mark.parametrize("dim,right,leaf,breaks", [
    (2, False, 8, [0.0, 40.0, 90.0, 160.0, 260.0, math.inf]), (3, True, 8, [0.0, 40.0, 90.0, 260.0, 500.0]),
    (2, True, 256, [20.0, 40.0, 90.0]), (1, False, 8, [0.0, 40.0, 590.0])])
def test_pairs_by_bin_equal_all_pairs(spark, dim, right, leaf, breaks):
    rows, axes = _points("plane", dim), ["x", "y", "z"][:dim]
    cells = spark.createDataFrame(rows, "g string, cell long, " + ", ".join(f"{c} double" for c in axes))
    want = _plain_bins(rows, breaks, right)
    tree = pb.PairBins(cells, ["g"], "cell", axes, breaks, right, leaf=leaf)
    counts = {(r.g, r.distance_bin): r.candidate_pairs for r in tree.counts().collect()}
    assert counts == {k: len(v) for k, v in want.items()}
    drawn = {}
    for r in tree.draws(40, 7).collect():
        assert r.candidate_pairs == counts[r.g, r.distance_bin]
        drawn.setdefault((r.g, r.distance_bin), []).append((r.cell_a, r.cell_b))
    for key, pairs in want.items():
        assert len(drawn[key]) == len(set(drawn[key])) == min(40, len(pairs)) and set(drawn[key]) <= pairs


def test_draws_are_even_over_a_bin(spark):
    draw = np.random.default_rng(5)
    rows = [(i, *map(float, draw.uniform(0, 100, 2))) for i in range(200)]
    cells = spark.createDataFrame(rows, "cell long, x double, y double")
    found = pb.stratified_pairs(cells, [], "cell", ["x"], ["x", "y"], [0.0, 30.0, math.inf], 1500, 3, leaf=16).collect()
    near = [r for r in found if r.distance_bin == "[0,30)"]
    total = near[0].candidate_pairs
    assert len(near) == 1500 < total
    # cells appear as often as their share of the bin's pairs says
    at = np.array([r[1:] for r in rows])
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
    expected = ((d < 30).sum(axis=1) - 1) * 1500 / total
    seen = np.bincount([r.cell_a for r in near] + [r.cell_b for r in near], minlength=200)
    assert ((seen - expected) ** 2 / np.maximum(expected, 1)).sum() < 300


def test_rows_made_grow_like_the_cells(spark):
    breaks, made = [0.0, 50.0, 100.0, 200.0, math.inf], {}
    for n in (5_000, 20_000):
        at = np.random.default_rng(n).uniform(0, 1000, (n, 2))
        cells = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "cell long, x double, y double")
        tree = pb.PairBins(cells, [], "cell", ["x", "y"], breaks, leaf=128)
        made[n] = tree.entries.count()
        counts = {r.distance_bin: r.candidate_pairs for r in tree.counts().collect()}
        want = np.zeros(4, dtype=np.int64)
        for start in range(0, n, 1000):
            d = np.sqrt(((at[start:start + 1000, None] - at[None]) ** 2).sum(axis=2))
            want += np.histogram(d, [0, 50, 100, 200, 1e9])[0]
        want[0] -= n
        assert [counts[b] for b in bins.labels(breaks)] == (want // 2).tolist()
    assert made[20_000] < 20_000 and made[20_000] < 12 * made[5_000]


def test_same_founder_share_equals_all_pairs(spark):
    draw = np.random.default_rng(2)
    rows = [(i, i % 5 if i % 7 else None, *map(float, draw.normal(size=2) * 50)) for i in range(150)]
    cells = spark.createDataFrame(rows, "cell long, founder long, x double, y double")
    breaks = [0.0, 30.0, 60.0, 500.0]
    found = {r.distance_bin: r for r in pb.same_founder_by_distance(cells, [], "cell", "founder", ["x", "y"], breaks, 10_000, 1, leaf=16).collect()}
    pairs = [(math.hypot(a[2] - b[2], a[3] - b[3]), a[1] is not None and a[1] == b[1]) for a, b in itertools.combinations(rows, 2)]
    for i, name in enumerate(bins.labels(breaks, True)):
        own = [(d, s) for d, s in pairs if breaks[i] < d <= breaks[i + 1]]
        r = found[name]
        assert r.pairs == r.evaluated_pairs == len(own)
        assert r.mean_distance == pytest.approx(np.mean([d for d, _ in own]))
        assert r.same_founder_fraction == pytest.approx(np.mean([s for _, s in own]))
        assert r.null_same_founder_fraction == pytest.approx(np.mean([s for _, s in pairs]))


def _plain_bracket(rows, breaks):
    places = {}
    for g, at, v in breaks:
        if g is not None and at is not None:
            places.setdefault(g, {}).setdefault(at, []).append(v)
    out = []
    for i, g, at in rows:
        before = behind = None
        if g in places and at is not None:
            own = sorted(places[g])
            k = bisect.bisect_right(own, at)
            before = max(places[g][own[k - 1]]) if k else None
            behind = max(places[g][own[k]]) if k < len(own) else None
        out.append((i, before, behind))
    return sorted(out)


def test_last_break_before_and_first_behind(spark):
    draw = np.random.default_rng(4)
    # group a holds most rows and few breaks, group b the other way round, c has rows only, d breaks only
    rows = [(i, "a", float(draw.integers(0, 1000))) for i in range(3000)] + [(3000 + i, "b", float(i)) for i in range(20)]
    rows += [(4000, "c", 1.0), (4001, None, 1.0), (4002, "a", None)] + [(5000 + i, "a", 500.0) for i in range(500)]
    breaks = [("a", 100.0, 1), ("a", 500.0, 2), ("a", 500.0, 3), ("a", 900.0, 4), ("d", 1.0, 9), (None, 0.0, 9), ("a", None, 8)]
    breaks += [("b", i / 50, i) for i in range(2000)]
    one = spark.createDataFrame(rows, "id long, g string, at double").repartition(3)
    two = spark.createDataFrame(breaks, "g string, at double, v int")
    found = bracket(one, two, ["g"], "at", "before", "behind", slices=16)
    assert found.columns == ["id", "g", "at", "before", "behind"]
    got = sorted((r.id, r.before and r.before.v, r.behind and r.behind.v) for r in found.collect())
    assert got == _plain_bracket(rows, breaks)
    whole = bracket(one.drop("g"), two.where("g = 'a'").drop("g"), [], "at")
    assert whole.where("before is null").count() == sum(at is None or at < 100 for _, _, at in rows)
    assert bracket(one.limit(0), two, ["g"], "at").count() == 0


def test_interpolation_by_group(spark):
    points = [("a", 0.0, 1.0), ("a", 10.0, 3.0), ("a", 10.0, 2.0), ("b", 5.0, 7.0), ("a", None, 4.0)]
    wanted = [(1, "a", -1.0), (2, "a", 5.0), (3, "a", 10.0), (4, "a", 99.0), (5, "b", 1.0), (6, "c", 1.0), (7, "a", None), (8, "a", 0.0)]
    found = tb.interpolate(spark.createDataFrame(points, "g string, x double, y double"),
                           spark.createDataFrame(wanted, "id int, g string, at double"), "x", "y", "at", "rate", ["g"])
    assert {r.id: r.rate for r in found.collect()} == {1: 1.0, 2: 1.5, 3: 2.0, 4: 2.0, 5: 7.0, 6: None, 7: None, 8: 1.0}


def test_bins_of_a_table(spark):
    breaks = spark.createDataFrame([("a", 0.0, 1.0, "low"), ("a", 2.0, None, "high"), ("b", 0.0, 5.0, "only")],
                                   "g string, lo double, hi double, bin string")
    rows = spark.createDataFrame([(1, "a", 0.0), (2, "a", 1.0), (3, "a", 2.0), (4, "a", 1e9), (5, "b", 4.9), (6, "b", 5.0), (7, "a", -1.0), (8, "z", 1.0)],
                                 "id int, g string, v double")
    found = bin_by_table(rows, breaks, ["g"], "v", "lo", "hi", "bin")
    assert found.columns == ["id", "g", "v", "bin"]
    assert {r.id: r.bin for r in found.collect()} == {1: "low", 2: None, 3: "high", 4: "high", 5: "only", 6: None, 7: None, 8: None}


def _calls(cells, sites, seed):
    draw = np.random.default_rng(seed)
    table = draw.integers(-1, 2, (cells, sites))  # -1: no call
    table[:, 0] = 1
    return table


@pytest.mark.parametrize("cells,words", [(50, 1), (300, 1), (700, 2), (130, 64)])
def test_gametes_of_packed_sites_equal_plain_counts(spark, cells, words):
    table = _calls(cells, 9, cells)
    rows = [(c * 7, f"u{s % 2}", s, int(x) if x >= 0 else None) for c, own in enumerate(table) for s, x in enumerate(own) if x >= 0 or c % 2]
    typed = spark.createDataFrame(rows, "cell long, unit string, site int, edited int").repartition(4)
    wanted = [(a, b) for a in range(9) for b in range(a + 1, 9) if (a + b) % 3]
    pairs = spark.createDataFrame([("x", f"u{a % 2}", a, f"u{b % 2}", b) for a, b in wanted],
                                  "stratum string, unit_a string, site_a int, unit_b string, site_b int")
    found = {(r.site_a, r.site_b): (r.n00, r.n01, r.n10, r.n11) for r in ob.pair_gametes(typed, pairs, words).collect()}
    for a, b in wanted:
        want = tuple(int(((table[:, a] == x) & (table[:, b] == y)).sum()) for x in (0, 1) for y in (0, 1))
        assert found[a, b] == want
    packed = ob.packed_sites(typed, pairs.selectExpr("unit_a as unit", "site_a as site"), words)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert packed.groupBy("unit", "site").count().agg(F.max("count")).first()[0] <= cells // (64 * words) + partitions


def test_site_pairs_are_drawn_by_number(spark):
    sites = spark.createDataFrame([(f"u{i % 7}", i) for i in range(700)], "unit string, site int")
    for stratum, total in (("within", 7 * 100 * 99 // 2), ("between", 700 * 699 // 2 - 7 * 100 * 99 // 2)):
        found = [tuple(r) for r in ob.site_pairs(sites, stratum, 300, 5).collect()]
        assert len(found) == len(set(found)) == 300 and total > 1200
        assert all((r[1] == r[3]) == (stratum == "within") and (r[1], r[2]) < (r[3], r[4]) for r in found)
        assert len({r[2] for r in found}) > 200
    few = ob.site_pairs(sites.where("site < 20"), "within", 300, 5)
    assert few.count() == sum(n * (n - 1) // 2 for n in (3, 3, 3, 3, 3, 3, 2))
    assert ob.site_pairs(sites.where("site < 1"), "within", 5, 1).count() == 0


def test_unit_pairs_stay_in_their_unit(spark):
    table = _calls(60, 12, 3)
    rows = [(c, "a" if s < 8 else "b", s, int(x)) for c, own in enumerate(table) for s, x in enumerate(own) if x >= 0]
    typed = spark.createDataFrame(rows, "cell long, unit string, site int, edited int")
    found = {r.unit: r for r in ob.unit_pair_statistics(typed, 1000, 1, at_least=5).collect()}
    for unit, sites in (("a", range(1, 8)), ("b", range(8, 12))):
        values = []
        for x, y in itertools.combinations(sites, 2):
            both = (table[:, x] >= 0) & (table[:, y] >= 0)
            values.append(abs(np.corrcoef(table[both, x], table[both, y])[0, 1]))
        assert found[unit].mean_abs_association == pytest.approx(np.mean(values))


def _forest(n, comb, seed=0):
    """(node, parent, time): times never fall on the way down; ``comb`` hangs each node below the one before."""
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        parent = None if i % 100 == 0 else (i - 1 if comb else int(draw.integers(max(0, i - i % 100), i)))
        above = rows[parent][2] if parent is not None else 0.0
        rows.append((i, parent, above + float(draw.integers(0, 3))))
    return rows


@pytest.mark.parametrize("comb", [True, False])
def test_ancestor_at_a_time(spark, comb):
    rows = _forest(400, comb)
    nodes = spark.createDataFrame(rows, "node_id long, parent_node_id long, time double")
    index = ancestry.chain_index(nodes, time="time")
    queries = [(i, float(t)) for i in range(0, 400, 3) for t in (-1, 0, 3, 7, 20, 500)] + [(999, 1.0), (5, None)]
    found = ancestry.ancestor_at(spark.createDataFrame(queries, "node_id long, at double"), index, "at").collect()

    def plain(node, at):
        best = None
        while node is not None and node < len(rows) and at is not None:
            if rows[node][2] > at:
                best = node
            node = rows[node][1]
        return best
    assert sorted(((r.node_id, r.at, r.ancestor) for r in found), key=repr) == sorted(((n, t, plain(n, t)) for n, t in queries), key=repr)


def test_cuts_of_several_sizes_agree_with_single_ones(spark):
    rows = [("p", r, f"{r}{i}", f"{r}{(i - 1) // 2}" if i else None, i if i >= 31 else None, 0.0 if i == 0 else 1.0 + i % 3 / 10)
            for r in ("truth", "estimate") for i in range(63)]
    table = tr.tree_table(spark.createDataFrame(rows, "pair string, role string, key string, parent_key string, label long, length double"))
    every = {(r.role, r.groups, r.label): r.group for r in tr.cut_trees(table, (2, 5, 9, 400)).collect()}
    assert {k[1] for k in every} == {2, 5, 9}
    for k in (2, 5, 9):
        own = {(r.role, k, r.label): r.group for r in tr.cut_trees(table, k).collect()}
        assert own == {key: g for key, g in every.items() if key[1] == k}
        assert len({g for (role, _, _), g in own.items() if role == "truth"}) >= k


def test_members_of_cycles(spark):
    rows = [(1, 2), (2, 3), (3, 1), (4, 3), (5, 4), (6, 6), (7, None), (8, 7), (9, 8), (10, 99), (11, 12), (12, 11), (None, 1)]
    rows += [(100 + i, 99 + i if i else 150) for i in range(51)] + [(200 + i, 199 + i if i else 2) for i in range(40)]
    found = ancestry.cycle_members(spark.createDataFrame(rows, "node_id long, parent_node_id long"))
    want = [(1, 1), (1, 2), (1, 3), (6, 6), (11, 11), (11, 12)] + [(100, 100 + i) for i in range(51)]
    assert sorted(map(tuple, found.collect())) == want
    named = spark.createDataFrame([("a", "b", 0.0, 1.0, 1.0), ("b", "a", 0.0, 1.0, 1.0), ("c", None, 0.0, 1.0, 1.0)],
                                  "node_id string, parent_node_id string, birth_time double, end_time double, branch_length double")
    assert sorted(map(tuple, lineage.node_violations(named).collect())) == [("a", "in_cycle"), ("b", "in_cycle")]
    assert ancestry.cycle_members(named.where("node_id = 'c'")).count() == 0


def _recorded(cells, sites, seed):
    """Characters inherited along random divisions: (cell, feature, value), values 1 to 3."""
    draw = np.random.default_rng(seed)
    alive = [{}]
    while len(alive) < cells:
        parent = alive.pop(int(draw.integers(len(alive))))
        for _ in range(2):
            child = dict(parent)
            for s in draw.integers(0, sites, 3):
                child.setdefault(int(s), int(draw.integers(1, 4)))
            alive.append(child)
    alive[:40] = [alive[0]] * 40  # equal cells
    return {i: c for i, c in enumerate(alive)}


@pytest.mark.parametrize("kind", ["jaccard", "manhattan"])
def test_nearest_cells_by_characters(spark, kind):
    table, k = _recorded(500, 120, 3), 5
    rows = [(c, s, float(x)) for c, own in table.items() for s, x in own.items()] + [(9_000, 1, 0.0)]
    characters = spark.createDataFrame(rows, "cell long, feature long, value double").repartition(3)
    if kind == "jaccard":
        marked = characters.selectExpr("cell", "feature * 10 + value as feature", "value")
        found = nc.nearest_by_jaccard(marked, k).collect()
        sets = {c: {(s, x) for s, x in own.items()} for c, own in table.items()}

        def apart(a, b):
            return 1 - len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    else:
        found = nc.nearest_by_manhattan(characters, k, 120, 12.0).collect()

        def apart(a, b):
            one, two = table.get(a, {}), table.get(b, {})
            return sum(abs(one.get(s, 0) - two.get(s, 0)) for s in set(one) | set(two)) / 120
    got = {}
    for r in found:
        assert r.distance == pytest.approx(apart(r.cell, r.neighbour)) and r.cell != r.neighbour
        got.setdefault(r.cell, []).append((r.rank, r.distance))
    near = 0
    for c in table:
        others = sorted(apart(c, b) for b in table if b != c)[:k]
        own = [d for _, d in sorted(got[c])]
        assert own == sorted(own) and len(own) == k
        near += sum(d <= others[-1] + 1e-12 for d in own)
    assert near / (k * len(table)) >= 0.9, near / (k * len(table))
    few = nc.candidates(spark.createDataFrame([(i, 0, [7]) for i in range(300)], "cell long, table int, signature array<int>"), 4)
    assert few.count() <= 4 * 300
