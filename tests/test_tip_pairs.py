"""Distances of every pair of tips along trees, against brute force over listed pairs."""

import hashlib
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest

from cladewise.functions import bins
from cladewise.operators import ancestry, tip_pairs as tp, trees as tr
from cladewise.plans import registry, views
import __spark_entry__  # noqa: F401  registers the queries


def _ways(parents, lengths):
    """Per node its way to the root and its distance from there."""
    ways = {}
    for k in parents:
        way = [k]
        while parents[way[-1]] is not None:
            way.append(parents[way[-1]])
        ways[k] = way
    return ways, {k: sum(lengths[x] for x in w) for k, w in ways.items()}


def _path(a, b, ways, far):
    met = next((x for x in ways[a] if x in set(ways[b])), None)
    return None if met is None else far[a] + far[b] - 2 * far[met]


def _spearman(left, right):
    both = pd.DataFrame({"l": left, "r": right}).dropna()
    ranks = both.rank()
    return ranks["l"].corr(ranks["r"])


def _dealt(cells, seed, permutation):
    """The cell that gets the place of each cell."""
    drawn = sorted(cells, key=lambda c: (hashlib.md5(f"{seed}|{permutation}|{c}".encode()).hexdigest(), c))
    return dict(zip(drawn, sorted(cells)))


def _space(at, a, b):
    return None if at[a] is None or at[b] is None else math.dist(at[a], at[b])


@pytest.fixture
def clones(spark, monkeypatch):
    """Three clones on uneven trees: several cells on a node, equal places, a missing place, lengths of 0 and below."""
    monkeypatch.setattr(tp, "BLOCK", 16)
    monkeypatch.setattr(tp, "RANGE", 150)
    draw = random.Random(5)
    parents = {f"n{i}": None if i < 3 else f"n{draw.randrange(i % 3, i, 3) if i % 2 else i - 3}" for i in range(240)}
    lengths = {k: draw.choice([-0.5, 0.0, 1.0, 2.25]) for k in parents}
    ways, far = _ways(parents, lengths)
    cells = {c: f"n{draw.randrange(240)}" for c in range(120)}
    at = {c: None if c == 17 else tuple(draw.choice([draw.uniform(0, 90), 40.0]) for _ in "xy") for c in cells}
    nodes = spark.createDataFrame([(k, p, lengths[k]) for k, p in parents.items()], "node_id string, parent_node_id string, length double")
    index = ancestry.chain_index(nodes, paths=False).join(
        ancestry.root_paths(nodes, sums={"root_distance": "length"}).select("node_id", "root_distance"), "node_id")
    rows = [(ways[n][-1], c, n, *(at[c] or (None, 1.0))) for c, n in cells.items()]
    rows.append(("n0", 900, "absent", 1.0, 1.0))
    table = spark.createDataFrame(rows, "root string, cell long, node_id string, x double, y double")
    found = tp.WithinClones(table, ["root"], "cell", ["x", "y"], index, min_pairs=10)
    groups = {r: [c for c, n in cells.items() if ways[n][-1] == r] for r in ("n0", "n1", "n2")}
    return found, groups, at, {(a, b): _path(cells[a], cells[b], ways, far) for g in groups.values() for a, b in itertools.permutations(g, 2)}


def test_bins_of_every_pair_of_a_clone(clones):
    found, groups, at, path = clones
    breaks = [0.0, 20.0, 45.0, 80.0]
    rows = {(r.root, r.distance_bin): r for r in found.distance_bins(breaks).collect()}
    for root, cells in groups.items():
        pairs = [(_space(at, a, b), path[a, b]) for a, b in itertools.combinations(cells, 2)]
        for i, name in enumerate(bins.labels(breaks, True)):
            inside = [(s, y) for s, y in pairs if s is not None and (breaks[i] < s <= breaks[i + 1] or s == breaks[0] == breaks[i])]
            r = rows.pop((root, name))
            assert r.pairs == len(inside) > 16
            assert (r.mean_distance, r.mean_lineage_distance) == pytest.approx(tuple(np.mean(inside, axis=0)))
    assert not rows


def test_correlation_of_every_pair_of_a_clone(clones):
    found, groups, at, path = clones
    rows = {r.root: r for r in found.correlation(3, 6).collect()}
    assert set(rows) == set(groups)
    for root, cells in groups.items():
        pairs = list(itertools.combinations(cells, 2))
        space = [_space(at, a, b) for a, b in pairs]
        assert rows[root].pairs == sum(s is not None for s in space)
        assert rows[root].spearman == pytest.approx(_spearman(space, [path[p] for p in pairs]))
        null = []
        for q in (1, 2, 3):
            to = _dealt(cells, 6, q)
            null.append(_spearman(space, [path[to[a], to[b]] for a, b in pairs]))
        assert (rows[root].null_mean, rows[root].null_sd) == pytest.approx((np.mean(null), np.std(null, ddof=1)))


def _tables(spark, path, orders, cells):
    spark.range(orders).selectExpr("id as o_orderkey").write.parquet(f"{path}/orders.parquet")
    draw = np.random.default_rng(4)
    rows = [(i, i % 5, [float(v) for v in draw.normal(size=3) * 0.1]) for i in range(cells)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return {i: tuple(float(np.float32(x)) * 1000 for x in e) for i, _, e in rows}


def _lineage(spark, path, at):
    nodes = views.nodes(spark, path).collect()
    ways, far = _ways({r.node_id: r.parent_node_id for r in nodes}, {r.node_id: r.branch_length for r in nodes})
    tip = {int(r.cell_id): r.node_id for r in nodes if r.is_terminal and int(r.cell_id) in at}
    groups = {}
    for c in sorted(tip):
        groups.setdefault(ways[tip[c]][-1], []).append(c)
    return tip, ways, far, {root: cells for root, cells in groups.items() if len(cells) >= 8}


@pytest.mark.parametrize("large", [False, True])
def test_within_clone_bins_query(spark, tmp_path, monkeypatch, large):
    if large:
        monkeypatch.setattr(ancestry, "WHOLE", 100)
    at = _tables(spark, str(tmp_path), 600, 150)
    found = {(r.root, r.distance_bin): r for r in registry.BUILDERS["within_clone_bins"](spark, str(tmp_path)).collect()}
    tip, ways, far, groups = _lineage(spark, str(tmp_path), at)
    breaks = [0.0, 100.0, 200.0, 300.0, 1000.0]
    for root, cells in groups.items():
        pairs = [(_space(at, a, b), _path(tip[a], tip[b], ways, far)) for a, b in itertools.combinations(cells, 2)]
        for low, high, name in zip(breaks, breaks[1:], bins.labels(breaks, True)):
            inside = [p for p in pairs if low < p[0] <= high]
            if inside:
                r = found.pop((root, name))
                assert (r.pairs, r.mean_distance, r.mean_lineage_distance) == pytest.approx((len(inside), *np.mean(inside, axis=0)), abs=2e-6)
    assert groups and not found


def test_the_null_of_a_clone_has_all_published_permutations(spark, tmp_path):
    at = _tables(spark, str(tmp_path), 400, 100)
    found = {r.root: r for r in registry.BUILDERS["within_clone_space_and_lineage"](spark, str(tmp_path)).collect()}
    tip, ways, far, groups = _lineage(spark, str(tmp_path), at)
    assert found and set(found) == set(groups)
    for root, cells in groups.items():
        pairs = list(itertools.combinations(cells, 2))
        space, path = [_space(at, a, b) for a, b in pairs], {(a, b): _path(tip[a], tip[b], ways, far) for a, b in itertools.permutations(cells, 2)}
        dealt = [_dealt(cells, 6, q) for q in range(1, 21)]
        null = [_spearman(space, [path[to[a], to[b]] for a, b in pairs]) for to in dealt]
        assert (found[root].pairs, found[root].spearman) == pytest.approx((len(pairs), _spearman(space, [path[p] for p in pairs])), abs=2e-6)
        assert (found[root].null_mean, found[root].null_sd) == pytest.approx((np.mean(null), np.std(null, ddof=1)), abs=2e-6)


def _path_lengths(trees, pair):
    """Path lengths of all couples of labels that both trees of a pair have, in the truth and the estimate."""
    own = [r for r in trees if r[0] == pair]
    ways, far = _ways({r[2]: r[3] for r in own}, {r[2]: r[5] for r in own})
    tips = {(r[1], r[4]): r[2] for r in own if r[4] is not None}
    labels = sorted(label for role, label in tips if role == "truth" and ("estimate", label) in tips)
    return [[round(_path(tips[role, a], tips[role, b], ways, far), 9) for a, b in itertools.combinations(labels, 2)] for role in ("truth", "estimate")]


@pytest.mark.parametrize("indexed", [True, False])
def test_cophenetic_correlation_of_all_tip_pairs(spark, monkeypatch, indexed):
    monkeypatch.setattr(tp, "BLOCK", 16)
    monkeypatch.setattr(tp, "HELD", 100)
    draw, rows = random.Random(9), []
    for pair, role, salt in (("p", "truth", 1), ("p", "estimate", 2), ("q", "truth", 3), ("q", "estimate", 3)):
        above, inner = random.Random(salt), {}
        for i in range(60):
            inner[i] = None if i == 0 else above.randrange(max(0, i - 3), i)
        labels = [x for x in range(90) if x % 31 != salt]
        rows += [(pair, role, f"{pair}{role}{i}", None if up is None else f"{pair}{role}{up}", None, draw.choice([0.1, 0.7, 2.0])) for i, up in inner.items()]
        rows += [(pair, role, f"{pair}{role}t{x}", f"{pair}{role}{above.randrange(60)}", x, draw.choice([0.3, 1.1])) for x in labels]
    trees = spark.createDataFrame(rows, "pair string, role string, key string, parent_key string, label long, length double")
    index = tr.tip_index(tr.tree_table(trees)) if indexed else trees
    found = {r.pair: r for r in tr.cophenetic_spearman(tr.shared_labels(trees), index, None, "all").collect()}
    assert set(found) == {"p", "q"}
    for pair, r in found.items():
        truth, estimate = _path_lengths(rows, pair)
        assert r.pairs == len(truth) > 3000
        assert r.cophenetic_spearman == pytest.approx(_spearman(truth, estimate))


def test_cophenetic_query_measures_all_pairs_of_tips(spark, tmp_path):
    spark.range(421).selectExpr("id as o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    found = {r.pair: r for r in registry.BUILDERS["cophenetic_spearman"](spark, str(tmp_path)).collect()}
    names = ["pair", "role", "key", "parent_key", "label", "length"]
    trees = [tuple(r) for r in views.tree_nodes(spark, str(tmp_path)).select(*names).collect()]
    for pair in ("near", "far"):
        truth, estimate = _path_lengths(trees, pair)
        assert found[pair].pairs == len(truth) == 211 * 210 // 2 > tr.DRAWS
        assert found[pair].cophenetic_spearman == pytest.approx(_spearman(truth, estimate), abs=2e-6)
