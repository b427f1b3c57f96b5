"""Distances of every pair, and joins that keep growing tables off the driver."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.functions import bins
from cladewise.operators import ancestry, pair_bins as pb
from cladewise.plans import registry
from cladewise.sources import newick as nw
import __spark_entry__  # noqa: F401  registers the queries


def test_mean_distance_rests_on_every_pair(spark, monkeypatch):
    monkeypatch.setattr(pb, "BLOCK", 100)
    monkeypatch.setattr(pb, "BLOCK_PAIRS", 2)
    draw = np.random.default_rng(8)
    rows = [(i, "ab"[i % 3 > 0] if i % 11 else None, *map(float, draw.normal(size=2) * 50)) for i in range(400)]
    rows.append((400, "a", float("nan"), 1.0))
    breaks = [0.0, 30.0, 60.0, 120.0]
    cells = spark.createDataFrame(rows, "cell long, part string, x double, y double")
    found = {(r.part, r.distance_bin): r for r in pb.PairBins(cells, ["part"], "cell", ["x", "y"], breaks, True, leaf=16).distances().collect()}
    for part in ("a", "b", None):
        own = [r for r in rows[:-1] if r[1] == part]
        far = [math.hypot(a[2] - b[2], a[3] - b[3]) for a, b in itertools.combinations(own, 2)]
        for i, name in enumerate(bins.labels(breaks, True)):
            inside = [d for d in far if breaks[i] < d <= breaks[i + 1]]
            r = found.pop((part, name))
            assert r.pairs == len(inside)
            assert r.mean_distance == pytest.approx(np.mean(inside), rel=1e-12)
    assert not found


@pytest.mark.parametrize("name", ["same_founder_by_distance", "same_founder_bin_summary"])
def test_founder_queries_measure_every_pair(spark, tmp_path, name):
    draw = np.random.default_rng(3)
    rows = [(i, int(i % 6), [float(v) for v in draw.normal(size=3) * 0.1]) for i in range(240)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = {r.distance_bin: r for r in registry.BUILDERS[name](spark, str(tmp_path)).collect()}
    at = {r[0]: np.array(r[2], dtype=np.float32).astype(float) * 1000 for r in rows}
    groups = [list(at)] if name == "same_founder_by_distance" else [[c for c in at if c % 4 == g] for g in range(4)]
    breaks = [0.0, 100.0, 200.0, 300.0, 1000.0]
    far = [[float(np.sqrt(((at[a] - at[b]) ** 2).sum())) for a, b in itertools.combinations(g, 2)] for g in groups]
    for i, label in enumerate(bins.labels(breaks, True)):
        inside = [[d for d in g if breaks[i] < d <= breaks[i + 1]] for g in far]
        assert found[label].pairs == sum(map(len, inside)) > 400 * (i < 2)
        assert found[label].mean_distance == pytest.approx(np.mean([np.mean(g) for g in inside if g]), abs=2e-6)
    if name == "same_founder_by_distance":
        share = np.mean([a % 6 == b % 6 for a, b in itertools.combinations(at, 2)])
        assert found[label].null_same_founder_fraction == pytest.approx(share, abs=2e-6)


def _comb(spark):
    return spark.range(3000).selectExpr(
        "concat('n', id) as node_id", "case when id > 0 then concat('n', id div 2) end as parent_node_id", "1.0D as branch_length", "id as child_no")


def test_ancestry_sends_no_table_through_the_driver(spark):
    nodes = _comb(spark)
    index = ancestry.chain_index(nodes)
    pairs = spark.range(1000).selectExpr("concat('n', id) as a", "concat('n', id + 1000) as b")
    found = ancestry.common_ancestor(pairs, index, "a", "b")
    assert found.count() == 1000
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_newick_sends_no_table_through_the_driver(spark):
    tokens = nw.newick_tokens(_comb(spark).withColumn("tree", F.lit(1)), "tree", "node_id", "parent_node_id", "node_id", "branch_length", "child_no")
    edges = nw.parse_tokens(nw.single_tokens(tokens), "tree")
    named = edges.join(edges.selectExpr("tree", "node as parent", "label as parent_label"), ["tree", "parent"], "left")
    assert {(r.label, r.parent_label) for r in named.collect()} == {(f"n{i}", f"n{i // 2}" if i else None) for i in range(3000)}
    assert "Broadcast" not in named._jdf.queryExecution().executedPlan().toString()
