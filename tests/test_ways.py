"""Large forests are not indexed whole where few nodes are wanted: only their ways to the roots are."""

import random

import pytest
from pyspark.sql import functions as F

from cladewise.operators import ancestry, trees as tr


def _parents(n, seed):
    draw = random.Random(seed)
    return {f"k{i}": None if i < 2 else f"k{draw.randrange(i // 3, i // 2 + 1)}" for i in range(n)}


def _way(parents, k):
    way = [k]
    while parents[way[-1]] is not None:
        way.append(parents[way[-1]])
    return way


def test_ways_of_wanted_nodes(spark, monkeypatch):
    parents = _parents(200, 3)
    nodes = spark.createDataFrame([(k, p, float(len(_way(parents, k)))) for k, p in parents.items()],
                                  "node_id string, parent_node_id string, end_time double").repartition(3)
    asked = [(f"k{a}", f"k{b}") for a, b in ((199, 198), (199, 40), (12, 150), (7, 7))]
    wanted = spark.createDataFrame([(k,) for pair in asked for k in pair] + [(None,), ("absent",)], "node_id string")
    assert ancestry.above(nodes, wanted) is nodes  # small
    monkeypatch.setattr(ancestry, "WHOLE", 10)
    on_ways = {k for pair in asked for one in pair for k in _way(parents, one)}
    part = ancestry.above(nodes, wanted)
    found = [r.node_id for r in part.collect()]
    assert sorted(found) == sorted(on_ways) and len(found) < 100 and part.columns == nodes.columns
    assert ancestry.above(nodes, wanted.where("node_id = 'absent'")).isEmpty()
    monkeypatch.setattr(ancestry, "WANTED", 3)
    assert ancestry.above(nodes, wanted) is nodes  # many


def test_ways_longer_than_the_rounds_leave_the_forest_whole(spark, monkeypatch):
    monkeypatch.setattr(ancestry, "WHOLE", 0)
    monkeypatch.setattr(ancestry, "math", type("m", (), {"ceil": staticmethod(lambda x: 1), "log2": staticmethod(lambda x: 1)}))
    comb = spark.range(12).selectExpr("id as node_id", "nullif(id - 1, -1) as parent_node_id")
    assert ancestry.above(comb, spark.createDataFrame([(11,)], "node_id long")) is comb
    assert ancestry.above(comb, spark.createDataFrame([(5,)], "node_id long")).count() == 6


def test_drawn_tips_need_no_index_of_all_trees(spark, monkeypatch):
    rows = []
    for role, deal in (("truth", 1), ("estimate", 7)):
        for i in range(39):
            rows.append(("p", role, f"{role}{i}", f"{role}{(i - 1) // 2}" if i else None,
                         (i - 19) * deal % 20 if i >= 19 else None, 1.0 + i * 13 % 7 / 10 if i else 0.0))
    trees = spark.createDataFrame(rows, "pair string, role string, key string, parent_key string, label long, length double")
    for module in (ancestry, tr):
        monkeypatch.setattr(module, "WHOLE", 20)
    assert tr.draws_index(trees, lambda: pytest.fail("the table is not needed")) is trees
    drawn = spark.createDataFrame([("truth38", "truth20"), ("estimate30", "estimate2")], "key_a string, key_b string")
    found = {r.key: (r.depth, round(r.root_distance, 9)) for r in tr._way_index(trees, [F.col("key_a"), F.col("key_b")], drawn).collect()}
    parents, lengths = {r[2]: r[3] for r in rows}, {r[2]: r[5] for r in rows}
    ways = {k: _way(parents, k) for one in ("truth38", "truth20", "estimate30", "estimate2") for k in _way(parents, one)}
    assert found == {k: (len(w) - 1, round(sum(lengths[x] for x in w), 9)) for k, w in ways.items()}
