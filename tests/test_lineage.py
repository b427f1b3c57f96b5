"""Division logs, forests and ancestry against hand-computed results."""

import pytest
from pyspark.sql import functions as F

from cladewise.operators import ancestry, lineage

LOG = [(1.0, 0, "0", "1"), (2.0, 1, "0", "2"), (2.5, 2, "1", "3")]


@pytest.fixture(scope="module")
def nodes(spark):
    log = spark.createDataFrame(LOG, "time double, seq long, parent_id string, daughter_id string")
    return ancestry.written(lineage.build_lineage(log, 3.0), "nodes")


def test_segments_of_a_small_log(nodes, rows):
    assert rows(nodes, "node_id", "parent_node_id", "birth_time", "end_time", "division_event", "opened_as", "is_terminal") == sorted([
        ("0:0", None, 0.0, 1.0, 1, "founder", False),
        ("0:1", "0:0", 1.0, 2.0, 2, "continuing_parent", False),
        ("0:2", "0:1", 2.0, 3.0, 2, "continuing_parent", True),
        ("1:0", "0:0", 1.0, 2.5, 3, "new_daughter", False),
        ("1:1", "1:0", 2.5, 3.0, 3, "continuing_parent", True),
        ("2:0", "0:1", 2.0, 3.0, 2, "new_daughter", True),
        ("3:0", "1:0", 2.5, 3.0, 3, "new_daughter", True),
    ], key=repr)


def test_equal_times_follow_input_order(spark, rows):
    log = spark.createDataFrame([(1.0, 7, "0", "9"), (1.0, 3, "0", "5")], "time double, seq long, parent_id string, daughter_id string")
    built = lineage.build_lineage(log, 2.0)
    assert rows(built.where("opened_as = 'new_daughter'"), "cell_id", "parent_node_id") == [("5", "0:0"), ("9", "0:1")]


def test_founder_that_never_divides(spark, rows):
    log = spark.createDataFrame(LOG, "time double, seq long, parent_id string, daughter_id string")
    founders = spark.createDataFrame([("0",), ("8",)], "cell_id string")
    built = lineage.build_lineage(log, 3.0, founders=founders)
    assert rows(built.where("opened_as = 'founder'"), "node_id", "end_time", "is_terminal") == [("0:0", 1.0, False), ("8:0", 3.0, True)]


def test_empty_log(spark):
    log = spark.createDataFrame([], "time double, seq long, parent_id string, daughter_id string")
    assert lineage.build_lineage(log, 3.0).count() == 0
    assert lineage.division_violations(log).count() == 0


def test_bad_logs_end_the_job(spark):
    schema = "time double, seq long, parent_id string, daughter_id string"
    late, wrong = spark.createDataFrame([(9.0, 0, "0", "1")], schema), spark.createDataFrame([(1.0, 0, "0", "1.5")], schema)
    with pytest.raises(Exception, match="after end_time"):
        lineage.build_lineage(late, 3.0).collect()
    with pytest.raises(Exception, match="not a cell id"):
        lineage.build_lineage(wrong, 3.0).collect()


def test_division_rules(spark, rows):
    log = spark.createDataFrame([
        (1.0, 0, "0", "1"), (-1.0, 1, "0", "2"), (2.0, 2, "3", "3"), (3.0, 3, "0", "1"), (4.0, 4, "x", "7"), (5.0, 5, "0", "1.5"),
        (6.0, 6, "1", "0"),
    ], "time double, seq long, parent_id string, daughter_id string")
    assert rows(lineage.division_violations(log), "seq", "rule") == sorted([
        (0, "born_twice"), (1, "time"), (2, "own_daughter"), (3, "born_twice"), (4, "parent_id"),
        (5, "daughter_id"), (6, "already_existed")], key=repr)


def test_inherited_events(spark, nodes, rows):
    tips = nodes.where("is_terminal").select("node_id", "cell_id")
    ordered = nodes.selectExpr("node_id", "parent_node_id", "case when segment > 0 then 0 else 1 end as child_no")
    intervals = ancestry.tip_intervals(ordered, tips, "child_no")
    # founder event on all, one on the second segment of cell 0, one on cell 3 only
    events = spark.createDataFrame([("a", "0:0"), ("b", "0:1"), ("c", "3:0")], "event string, node_id string")
    found = ancestry.event_cells(events, intervals, tips)
    assert rows(found, "event", "cell_id") == [
        ("a", "0"), ("a", "1"), ("a", "2"), ("a", "3"), ("b", "0"), ("b", "2"), ("c", "3")]
    counts = {r.event: r.tips for r in events.join(intervals, "node_id").collect()}
    assert counts == {"a": 4, "b": 2, "c": 1}
    # depth-first order: continuing parent before daughter
    assert rows(intervals.join(tips, "node_id"), "first_place", "cell_id") == [(0, "0"), (1, "2"), (2, "1"), (3, "3")]


MRCA = [("n1", None, 0.0, 1.0), ("n2", "n1", 1.0, 3.0), ("n3", "n1", 1.0, 2.0), ("n4", "n3", 2.0, 3.0), ("n5", "n3", 2.0, 3.0), ("n6", None, 0.0, 3.0)]


def test_pair_relations(spark):
    nodes = spark.createDataFrame(MRCA, "node_id string, parent_node_id string, birth_time double, end_time double")
    index = ancestry.chain_index(nodes, time="end_time")
    pairs = [("n4", "n5"), ("n2", "n4"), ("n2", "n6"), ("n5", "n4"), ("n1", "n4"), ("n4", "n4")]
    found = {(r.node_a, r.node_b): r for r in ancestry.pair_relations(
        spark.createDataFrame(pairs, "node_a string, node_b string"), index).collect()}
    assert [found[p].mrca_node_id for p in pairs] == ["n3", "n1", None, "n3", "n1", "n4"]
    assert [found[p].patristic_distance for p in pairs] == [2.0, 4.0, 6.0, 2.0, 2.0, 0.0]
    assert [found[p].division_distance for p in pairs] == [2, 3, None, 2, 2, 0]
    assert not found[("n2", "n6")].same_founder


def test_deep_comb(spark):
    """A chain of 2,000 levels with a tip at each: depth must not matter."""
    n = 2000
    spine = spark.range(n).selectExpr("concat('s', id) as node_id", "case when id > 0 then concat('s', id - 1) end as parent_node_id")
    tips = spark.range(n).selectExpr("concat('t', id) as node_id", "concat('s', id) as parent_node_id")
    nodes = spine.unionByName(tips)
    index = ancestry.chain_index(nodes)
    assert index.agg(F.max(F.size("path"))).first()[0] <= 3
    pairs = spark.createDataFrame([("t5", "t1500"), ("t1999", "t0"), ("t700", "t701")], "a string, b string")
    found = {(r.a, r.b): (r.mrca, r.mrca_depth) for r in ancestry.common_ancestor(pairs, index, "a", "b").collect()}
    assert found == {("t5", "t1500"): ("s5", 5), ("t1999", "t0"): ("s0", 0), ("t700", "t701"): ("s700", 700)}
    few = spark.createDataFrame([("t3",), ("s1",)], "node_id string")
    closed = ancestry.ancestor_closure(nodes, few).collect()
    assert sorted((r.node_id, r.ancestor, r.steps) for r in closed) == [
        ("s1", "s0", 1), ("s1", "s1", 0), ("t3", "s0", 4), ("t3", "s1", 3), ("t3", "s2", 2), ("t3", "s3", 1), ("t3", "t3", 0)]


def test_cycle_is_found(spark):
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "node_id string, parent_node_id string")
    with pytest.raises(ancestry.LineageCycle):
        ancestry.root_paths(loop)


def test_unary_nodes_are_summed(spark, rows):
    nodes = spark.createDataFrame([
        ("r", None, 0.0), ("u", "r", 1.0), ("w", "u", 2.0), ("a", "w", 3.0), ("b", "w", 4.0)], "node_id string, parent_node_id string, length double")
    assert rows(ancestry.collapse_unary(nodes, "length"), "node_id", "parent_node_id", "length") == [
        ("a", "w", 3.0), ("b", "w", 4.0), ("w", None, 3.0)]


def test_checkpoints_keep_empty_types(nodes, rows):
    typed = nodes.withColumn("cell_type", F.concat(F.lit("t"), "cell_id"))
    found = lineage.active_at_checkpoints(typed, [0.0, 1.0, 3.0])
    assert rows(found.where("cell_type = 't3'"), "time", "active_cells", "total_active_cells", "total_nodes", "population_events") == [
        (0.0, 0, 1, 1, 0), (1.0, 0, 2, 3, 1), (3.0, 1, 4, 7, 3)]


def test_a_missing_parent_is_an_error_unless_allowed(spark, rows):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "lost")], "node_id string, parent_node_id string")
    with pytest.raises(Exception, match="the parent lost is not in the table"):
        ancestry.root_paths(nodes)
    assert rows(ancestry.root_paths(nodes, strict=False), "node_id", "root", "depth") == [("a", "a", 0), ("b", "a", 1), ("c", "lost", 1)]
    with pytest.raises(Exception, match="the parent lost is not in the table"):
        ancestry.numbered(nodes, "node_id", "parent_node_id")


def test_loops_leave_one_table(spark):
    import os

    from cladewise.session import shared_folder

    before = set(os.listdir(shared_folder(spark).removeprefix("file:")))
    comb = spark.range(64).selectExpr("id as node_id", "case when id > 0 then id - 1 end as parent_node_id")
    found = ancestry.root_paths(comb)
    assert found.agg(F.max("depth")).first()[0] == 63
    left = set(os.listdir(shared_folder(spark).removeprefix("file:"))) - before
    assert len([x for x in left if x.startswith("paths-")]) == 1


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    from types import SimpleNamespace

    from cladewise.session import shared_folder

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)


def test_running_totals_of_text_orders_ties_and_hot_groups(spark, rows):
    from cladewise.functions.ranking import number_rows, spearman

    names = spark.range(500).selectExpr("'g' as g", "concat('cell_common_prefix_', lpad(id, 5, '0')) as name")
    assert rows(number_rows(names, ["g"], ["name"], "no"), "no") == [(i + 1,) for i in sorted(range(500), key=lambda i: str((i + 1,)))]
    tied = spark.range(400).selectExpr("case when id % 4 < 3 then 0 else id end as x", "case when id % 4 < 3 then 0 else id end as y")
    assert spearman(tied, [], "x", "y").first().spearman == pytest.approx(1.0)
    assert spearman(tied.selectExpr("0 as x", "y"), [], "x", "y").first().spearman is None


def test_nearest_event_wins_without_listing_all_carriers(spark, rows):
    # a comb of 60 levels: node i has child i + 1 and the tip 100 + i; every inner node carries an event at place 0
    depth = 60
    nodes = [(i, i - 1 if i else None, 0) for i in range(depth)] + [(100 + i, i, 1) for i in range(depth)]
    forest = spark.createDataFrame(nodes, "node_id long, parent_node_id long, child_no int")
    sampled = forest.where("node_id >= 100").selectExpr("node_id", "concat('c', node_id) as cell_id")
    intervals = ancestry.tip_intervals(forest, sampled, "child_no").join(ancestry.root_paths(forest).select("node_id", "depth"), "node_id")
    events = [(i, 0, float(i), 1) for i in range(depth)] + [(0, 1, 5.0, 1), (0, 1, 6.0, 2), (103, 1, 7.0, 1), (30, 1, 8.0, 1)]
    table = spark.createDataFrame(events, "node_id long, place int, allele double, seq int")
    found = ancestry.terminal_genotypes(table, intervals, sampled, ["place"], "allele", ["seq", "allele"])
    want = [(f"c{100 + i}", 0, float(i)) for i in range(depth)]
    want += [(f"c{100 + i}", 1, 7.0 if i == 3 else 8.0 if i >= 30 else 6.0) for i in range(depth)]
    assert rows(found, "cell_id", "place", "allele") == sorted(want, key=repr)
