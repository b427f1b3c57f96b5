"""Large forests are peeled, indexes without paths climb, nearest cells move no candidate's characters."""

import random

import pytest
from pyspark.sql import functions as F

from cladewise.operators import ancestry, nearest_cells as nc, trees as tr


def _forest(n, seed):
    """Parents of nodes 0 .. n-1: a bushy part and a comb."""
    draw = random.Random(seed)
    return {i: None if i in (0, 1) else (draw.randrange(max(0, i - 40), i) if i < 9 * n // 10 else i - 1) for i in range(n)}


def _way(parents, i):
    way = [i]
    while parents[way[-1]] is not None:
        way.append(parents[way[-1]])
    return way


@pytest.mark.parametrize("peel", [5, 60])
def test_peeled_forest_against_brute_force(spark, monkeypatch, peel):
    monkeypatch.setattr(ancestry, "PEEL", peel)
    parents = _forest(300, peel)
    nodes = spark.createDataFrame([(i, p, float(i % 7)) for i, p in parents.items()], "node_id long, parent_node_id long, length double").repartition(3)
    rounds = []
    whole = ancestry._peel
    monkeypatch.setattr(ancestry, "_peel", lambda *a: rounds.append(whole(*a)) or rounds[-1])
    ways = {i: _way(parents, i) for i in parents}
    paths = {r.node_id: (r.root, r.depth, r.far) for r in ancestry.root_paths(nodes, sums={"far": "length"}).collect()}
    assert paths == {i: (w[-1], len(w) - 1, sum(float(x % 7) for x in w)) for i, w in ways.items()}
    sums = {r.node_id: r.n for r in ancestry.subtree_sums(nodes, {"n": F.col("node_id")}).collect()}
    assert sums == {i: sum(j for j, w in ways.items() if i in w) for i in parents}
    assert all(r is not None for r in rounds) and any(r[1] for r in rounds)

    index = ancestry.chain_index(nodes, paths=False)
    assert "path" not in index.columns
    asked = [(random.Random(i).randrange(300), random.Random(-i).randrange(300)) for i in range(1, 60)]
    for limit in (10_000, 3):  # climbing, and the ways of all chains
        monkeypatch.setattr(ancestry, "FEW", limit)
        found = ancestry.common_ancestor(spark.createDataFrame(asked, "a long, b long"), index, "a", "b").distinct().collect()
        assert {(r.a, r.b) for r in found} == set(asked)
        for r in found:
            meet = next((x for x in ways[r.a] if x in ways[r.b]), None)
            assert (r.mrca, r.same_founder, r.depth_a) == (meet, meet is not None, len(ways[r.a]) - 1)


def test_peeling_leaves_odd_forests_to_doubling(spark, monkeypatch):
    monkeypatch.setattr(ancestry, "PEEL", 0)
    rows = "node_id long, parent_node_id long"
    lost = spark.createDataFrame([(1, None), (2, 1), (3, 9)], rows)
    with pytest.raises(Exception, match="the parent 9 is not in the table"):
        ancestry.root_paths(lost).collect()
    assert {r.node_id: r.root for r in ancestry.root_paths(lost, strict=False).collect()}[2] == 1
    with pytest.raises(ancestry.LineageCycle):
        ancestry.root_paths(spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 3)], rows))


def test_nearest_cells_in_chunks_are_exact_with_a_long_reach(spark, monkeypatch):
    monkeypatch.setattr(nc, "CHUNK", 7)
    draw = random.Random(4)
    own = {c: {draw.randrange(20): draw.choice([1.0, 2.0, -1.5]) for _ in range(draw.randrange(1, 9))} for c in range(90)}
    rows = [(c, f, x) for c, held in own.items() for f, x in held.items()]
    characters = spark.createDataFrame(rows, "cell long, feature long, value double").repartition(3)
    for reach in (4, 90):
        signatures = nc.projection_signatures(characters, 3.0, 3, 2)
        pairs = {(r.cell_a, r.cell_b) for r in nc.candidates(signatures, reach).collect()}
        near = {"jaccard": tr.jaccard_pairs, "manhattan": lambda c, p: tr.manhattan_pairs(c, p, F.lit(20))}
        for kind, measure in near.items():
            if kind == "jaccard":
                pairs_ = {(r.cell_a, r.cell_b) for r in nc.candidates(nc.minhash_signatures(characters, 3, 2), reach).collect()}
                found = nc.nearest_by_jaccard(characters, 5, 3, 2, reach)
            else:
                pairs_, found = pairs, nc.nearest_by_manhattan(characters, 5, 20, 3.0, 3, 2, reach)
            exact = measure(characters, spark.createDataFrame(sorted(pairs_), "cell_a long, cell_b long")).collect()
            each = {}
            for r in exact:
                for a, b in ((r.cell_a, r.cell_b), (r.cell_b, r.cell_a)):
                    each.setdefault(a, []).append((round(r.distance, 9), b))
            got = {}
            for r in found.collect():
                got.setdefault(r.cell, []).append((r.rank, round(r.distance, 9), r.neighbour))
            assert {c: [(d, b) for _, d, b in sorted(g)] for c, g in got.items()} == {c: sorted(g)[:5] for c, g in each.items()}


def test_candidates_do_not_shuffle_characters(spark):
    characters = spark.range(400).selectExpr("id div 4 as cell", "id % 37 as feature", "1.0D as value")
    plan = nc.nearest_by_jaccard(characters, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "cell_b" not in plan
    plan = nc.projection_signatures(characters, 3.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
