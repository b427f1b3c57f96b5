"""Recorder features, encodings, spatial and tree metrics on small fixtures."""

import itertools
import math

import numpy as np
import os

import pytest
from pyspark.sql import functions as F

from cladewise.operators import dropout, encodings as en, observations as ob, organelles as og, spatial as sp, summaries as su, tables as tb, trees as tr
from cladewise.sources import files as fi, newick as nw


def _block(spark, cells, sites=6, unit="u", missing=()):
    rows = [(c, unit, s, None if (c, s) in missing else (c >> s) & 1) for c in range(cells) for s in range(sites)]
    return spark.createDataFrame(rows, "cell int, unit string, site int, edited int")


def test_allele_diversity_by_hand(spark):
    found = ob.allele_diversity(_block(spark, 16)).first()
    # four low bits vary, the other two sites are all zero: 16 alleles of one cell each
    assert (found.cells, found.sites, found.alleles) == (16, 6, 16)
    assert found.entropy == pytest.approx(math.log(16)) and found.normalised_entropy == pytest.approx(1.0)
    assert ob.allele_diversity(_block(spark, 9)).count() == 0  # too few cells
    holes = {(0, 0), (1, 1)}
    assert ob.allele_diversity(_block(spark, 16, missing=holes)).count() == 0  # four comparable sites only


def test_allele_spectrum_normaliser(spark):
    rows = [(m, 1, "a" if m < 3 else "b") for m in range(4)] + [(m, 2, "0") for m in range(4)]
    found = {r.target: r for r in ob.allele_spectrum(spark.createDataFrame(rows, "mol int, target int, call string")).collect()}
    entropy = -(0.75 * math.log(0.75) + 0.25 * math.log(0.25))
    assert found[1].entropy == pytest.approx(entropy) and found[1].normalised_entropy == pytest.approx(entropy / math.log(2))
    assert found[1].top_allele == "a" and found[2].normalised_entropy == 0.0


def test_phi_of_counts(spark):
    row = spark.createDataFrame([(11839703, 20052, 60002, 1580795), (5, 0, 0, 0)], "n11 long, n10 long, n01 long, n00 long")
    a, b = [r[0] for r in row.select(ob.phi("n11", "n10", "n01", "n00")).collect()]
    n11, n10, n01, n00 = 11839703, 20052, 60002, 1580795
    expected = (n11 * n00 - n10 * n01) / math.sqrt((n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00))
    assert a == pytest.approx(expected, abs=1e-12) and b is None


def test_pair_counts_add_up(spark):
    rows = [(m, t, "0" if (m * t) % 3 else f"A{m % 2}") for m in range(60) for t in (1, 2, 3) if not (m == 5 and t == 2)]
    df = spark.createDataFrame(rows, "mol int, target int, call string")
    found = ob.target_pairs(df, [1, 2, 3]).collect()
    calls = {(m, t): c for m, t, c in rows}
    for r in found:
        both = [(calls[m, r.target_a], calls[m, r.target_b]) for m in range(60) if (m, r.target_a) in calls and (m, r.target_b) in calls]
        assert r.n11 + r.n10 + r.n01 + r.n00 == len(both)
        assert r.same_call == sum(a == b != "0" for a, b in both)


def test_pair_statistics_against_brute_force(spark):
    random = np.random.default_rng(3)
    x = random.integers(0, 2, size=(40, 8)).astype(float)
    x[random.random((40, 8)) < 0.2] = np.nan
    unit = ["u"] * 4 + ["w"] * 4
    rows = [(c, unit[s], s, None if np.isnan(x[c, s]) else int(x[c, s])) for c in range(40) for s in range(8)]
    df = spark.createDataFrame(rows, "cell int, unit string, site int, edited int")
    found = {r.stratum: r for r in ob.pair_statistics(df, 100, 1).collect()}
    for stratum in ("within", "between"):
        gametes, values = [], []
        for a, b in itertools.combinations(range(8), 2):
            if (unit[a] == unit[b]) != (stratum == "within"):
                continue
            use = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
            if use.sum() >= 20:
                gametes.append(len({tuple(p) for p in x[use][:, [a, b]]}) == 4)
                values.append(abs(np.corrcoef(x[use, a], x[use, b])[0, 1]))
        assert found[stratum].incompatible_fraction == pytest.approx(np.mean(gametes))
        assert found[stratum].mean_abs_association == pytest.approx(np.mean(values))


def test_drawn_site_pairs_are_distinct(spark):
    sites = spark.createDataFrame([(f"u{i % 5}", i) for i in range(60)], "unit string, site int")
    for stratum in ("within", "between"):
        found = [tuple(r) for r in ob.site_pairs(sites, stratum, 40, 2).collect()]
        assert len(found) == len(set(found)) == 40
        assert all((r[1] == r[3]) == (stratum == "within") for r in found)


def test_deletion_runs(spark, rows):
    df = spark.createDataFrame([("cell1", 1, 1), ("cell1", 1, 2), ("cell1", 1, 5), ("cell2", 1, 9)], "cell string, unit int, position int")
    assert rows(en.deletion_runs(df), "cell", "unit", "position", "value") == [
        ("cell1", 1, 2, "d2"), ("cell1", 1, 5, "d1"), ("cell2", 1, 9, "d1")]


def test_samples_are_nested(spark):
    ranks = en.sample_ranks(spark.range(200).withColumnRenamed("id", "cell"), 4)
    sets = {}
    for r in en.nested_samples(ranks, [10, 50, 120]).collect():
        sets.setdefault(r.sample_size, set()).add(r.cell)
    assert [len(sets[s]) for s in (10, 50, 120)] == [10, 50, 120] and sets[10] < sets[50] < sets[120]


def test_window_capacity(spark, rows):
    windows = spark.createDataFrame([(1, i, i) for i in range(60)] + [(2, 0, 999)], "target int, listed int, position int")
    known = spark.createDataFrame([(i,) for i in range(60)], "position int")
    ranked = en.ranked_windows(windows, known)
    assert rows(en.window_problems(windows, ranked), "target", "problem") == [(1, "too_many_positions"), (2, "no_positions")]


def test_registry_skips_failing_predicates():
    registry = en.RecorderRegistry()
    registry.register("broken", lambda m: m["absent"], character_matrix=lambda df: 1)
    registry.register("marks", lambda m: m.get("marks", 0) > 1, character_matrix=lambda df: 2)
    assert registry.active({"marks": 3}) == ["marks"] and registry.hook({"marks": 3}, "character_matrix")(None) == 2
    assert registry.hook({"marks": 1}, "character_matrix") is None and registry.hook({"marks": 3}, "layout") is None
    assert registry.unregister("marks") and not registry.unregister("marks")


def test_wrong_states_are_refused(spark):
    bad = spark.createDataFrame([(1, 1, "b1", 4)], "cell int, unit int, bit string, state int")
    with pytest.raises(Exception, match="state must be"):
        en.one_hot_states(bad).collect()


def test_all_reference_recording_has_a_control_column(spark, rows):
    empty = spark.createDataFrame([], "cell int, feature string, value double")
    cells = spark.createDataFrame([(1,), (2,)], "cell int")
    assert rows(en.with_control_column(empty, cells), "cell", "feature", "value") == [(1, "control", 0.0), (2, "control", 0.0)]


def test_variant_fraction_counts_empty_genomes(spark):
    variants = spark.createDataFrame([(1, 1, 5, 2.0), (1, 2, 5, 2.0)], "cell int, genome int, position int, allele double")
    genomes = spark.createDataFrame([(1, 4), (2, 3)], "cell int, genomes int")
    found = og.variant_fractions(variants, genomes)
    assert found.first().variant_fraction == 0.5
    assert {r.cell: r.variants for r in og.burden(found, genomes).collect()} == {1: 1, 2: 0}


def test_capture_array_geometry(spark):
    spots = sp.capture_array(spark, ["slice 1"])
    first = spots.agg(F.count("*").alias("n"), F.avg("spot_u").alias("u"), F.min("spot_u").alias("lo"), F.max("spot_u").alias("hi"),
                      F.min("spot_v").alias("vlo"), F.max("spot_v").alias("vhi")).first()
    assert first.n == 4992 and first.lo == pytest.approx(-first.hi) and first.vlo == pytest.approx(-first.vhi)
    assert spots.where("array_row % 2 <> array_col % 2").count() == 0
    assert spots.where("array_row = 3 and array_col = 7").first().barcode == "SIM-slice1-r03-c007"


def test_nearest_spot_against_brute_force(spark):
    random = np.random.default_rng(1)
    cells = [(i, "s", float(u), float(v)) for i, (u, v) in enumerate(random.uniform(-200, 200, size=(300, 2)))]
    spots = sp.capture_array(spark, ["s"], 50.0, 8, 8, 30.0, (5.0, 1.0))
    found = {r.cell: r for r in sp.assign_spots(spark.createDataFrame(cells, "cell int, slice_id string, plane_u double, plane_v double"), spots, 40.0).collect()}
    table = [(r.spot_id, r.spot_u, r.spot_v) for r in spots.orderBy("array_row", "array_col").collect()]
    assert any(not r.captured for r in found.values()) and any(r.captured for r in found.values())
    for i, _, u, v in cells:
        distance, spot = min(((math.hypot(u - a, v - b), s) for s, a, b in table), key=lambda t: t[0])
        assert found[i].captured == (distance <= 20.0) and found[i].spot_id == (spot if distance <= 20.0 else None)


def test_all_pairs_are_listed_once(spark):
    cells = spark.createDataFrame([("a", i) for i in range(30)] + [("b", 1), ("b", 2), ("c", 9)], "g string, cell int")
    found = sp.cell_pairs(cells, ["g"], "cell", [], 1, "all").select("g", "cell_a", "cell_b").collect()
    assert sorted(map(tuple, found)) == [("a", i, j) for i in range(30) for j in range(i + 1, 30)] + [("b", 1, 2)]


def test_dropout_extremes(spark):
    typed = _block(spark, 12)
    for rate, left in ((0.0, 72), (1.0, 0)):
        grid = dropout.with_conditions(typed, [rate], [0.0])
        assert dropout.drop_units(grid, 1).where("edited is not null").count() == left
        assert dropout.drop_cells(dropout.with_conditions(typed, [0.0], [rate]), 1).count() == left
    assert dropout.drop_empty_cells(dropout.drop_units(dropout.with_conditions(typed, [1.0], [0.0]), 1), ["unit_dropout"]).count() == 0
    with pytest.raises(ValueError):
        dropout.select_cells(typed, 1)


def test_exact_interval():
    low, high = su.binomial_interval(887, 1104)
    assert (low, high) == (pytest.approx(0.778751818111564, abs=1e-9), pytest.approx(0.826502992410026, abs=1e-9))
    assert su.binomial_interval(0, 10)[0] == 0.0 and su.binomial_interval(10, 10)[1] == 1.0


def test_paired_tests(spark):
    df = spark.createDataFrame([("g", 1.0, 0.0), ("g", 2.0, 0.5), ("g", 3.5, 1.0), ("g", 1.0, 1.5)], "k string, a double, b double")
    t = su.paired_t_test(df, ["k"], "a", "b").first()
    gaps = np.array([1.0, 1.5, 2.5, -0.5])
    assert t.t == pytest.approx(gaps.mean() / (gaps.std(ddof=1) / 2)) and t.df == 3
    x = t.t / math.sqrt(3)  # closed form of the distribution with three degrees of freedom
    assert t.p_value == pytest.approx(2 * (0.5 - (x / (1 + x * x) + math.atan(x)) / math.pi))
    w = su.paired_wilcoxon(df, ["k"], "a", "b").first()
    assert w.v == 9.0 and w.p_value == pytest.approx(math.erfc(abs((4 - 0.5) / math.sqrt(7.5)) / math.sqrt(2)))


def test_single_row_has_no_error(spark):
    r = su.summarise(spark.createDataFrame([("a", 1.0)], "k string, v double"), ["k"], "v").first()
    assert r.n == 1 and r.se is None and r.lower is None


def test_rand_index(spark):
    same = spark.createDataFrame([(i % 4, i % 4) for i in range(40)], "a int, b int")
    assert tr.adjusted_rand(same, [], "a", "b").first().adjusted_rand == pytest.approx(1.0)


def _caterpillar(role, order):
    rows, parent = [], None
    for depth, label in enumerate(order[:-1]):
        key = f"{role}{depth}"
        rows.append(("p", role, key, parent, None, 1.0))
        rows.append(("p", role, f"{role}{label}", key, label, 1.0))
        parent = key
    rows.append(("p", role, f"{role}{order[-1]}", parent, order[-1], 1.0))
    return rows


def test_tree_scores_by_hand(spark):
    schema = "pair string, role string, key string, parent_key string, label string, length double"
    same = spark.createDataFrame(_caterpillar("truth", "abcdef") + _caterpillar("estimate", "abcdef"), schema)
    found = tr.score_pairs(same, 1, 200).first()
    assert (found.rooted_rf, found.unrooted_rf, found.triplet_agreement, found.ordering_agreement) == (0.0, 0.0, 1.0, 1.0)
    assert found.cophenetic_spearman == pytest.approx(1.0) and found.drawn_pairs == 200
    assert found.clone_ari_k5 == pytest.approx(1.0) and found.clone_ari_k25 is None
    other = spark.createDataFrame(_caterpillar("truth", "abcdef") + _caterpillar("estimate", "abdcef"), schema)
    table = tr.tree_table(other)
    # clades by size 2..5: {ef},{def},{cdef},{bcdef} against {ef},{cef},{cdef},{bcdef}
    scores = tr.rooted_scores(table).first()
    assert (scores.truth_clades, scores.shared_clades, scores.rooted_rf) == (4, 3, 0.25)
    assert tr.unrooted_rf(table).first().unrooted_rf == pytest.approx(2 / 6)


def test_a_tree_pair_without_clades_stays(spark):
    schema = "pair string, role string, key string, parent_key string, label string, length double"
    rows = [("q", r, r, None, None, 0.0) for r in ("t", "e")] + [("q", r, r + x, r, x, 1.0) for r in ("t", "e") for x in "ab"]
    rows = [(p, {"t": "truth", "e": "estimate"}[r], *rest) for p, r, *rest in rows]
    table = tr.tree_table(spark.createDataFrame(rows, schema))
    found = tr.rooted_scores(table).first()
    assert (found.pair, found.truth_clades, found.rooted_rf) == ("q", 0, None)
    assert tr.unrooted_rf(table).first().unrooted_rf is None


def test_newick_forth_and_back(spark, rows, tmp_path):
    text = "((a:1,'it''s b':2.5)x:0.5,c,(d:1e-3):4)r;"
    edges = nw.parse_newick(spark.createDataFrame([(1, text)], "tree int, text string"), "tree", "text")
    parents = edges.selectExpr("node as parent", "label as parent_label")
    found = rows(edges.join(parents, "parent", "left"), "label", "length", "parent_label", "is_tip")
    assert found == sorted([("a", 1.0, "x", True), ("it's b", 2.5, "x", True), ("x", 0.5, "r", False), ("c", None, "r", True),
                            ("d", 0.001, None, True), (None, 4.0, "r", False), ("r", None, None, False)], key=repr)
    nodes = edges.selectExpr("tree", "concat('n', node) as node", "concat('n', parent) as parent", "label", "length", "node as place")
    tokens = nw.newick_tokens(nodes, "tree", "node", "parent", "label", "length", "place")
    path = f"{tmp_path}/trees"
    nw.write_newick(tokens, path)
    parts = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    again = "".join(open(f"{path}/{f}", encoding="utf-8").read() for f in parts).replace("\n", "")
    assert again == "(((a:1,'it''s b':2.5)x:0.5,c,(d:0.001):4)r);"


def test_trees_of_files_keep_their_line(spark, tmp_path, rows):
    (tmp_path / "one.txt").write_text("(a,b);\n\n(c,d);\n")
    (tmp_path / "two.txt").write_text("(e,f);\n")
    found = nw.read_lines(spark, str(tmp_path)).selectExpr("substring_index(file, '/', -1) as file", "tree_line", "newick")
    assert rows(found, "file", "tree_line", "newick") == [("one.txt", 0, "(a,b);"), ("one.txt", 2, "(c,d);"), ("two.txt", 0, "(e,f);")]


def test_gzip_form_is_preferred(spark, tmp_path):
    one, two = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "a int")
    fi.write_table(one, f"{tmp_path}/t.csv", compress=False)
    assert fi.read_table(spark, f"{tmp_path}/t.csv.gz").first().a == "1"
    fi.write_table(two, f"{tmp_path}/t.csv.gz")
    assert fi.read_table(spark, f"{tmp_path}/t.csv").first().a == "2"
    assert fi.read_table(spark, f"{tmp_path}/none.csv", required=False) is None
    with pytest.raises(FileNotFoundError):
        fi.read_table(spark, f"{tmp_path}/none.csv")


def test_columns_and_names(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, name string")
    assert rows(tb.unique_names(df, "name", "id", "u"), "u") == [("a",), ("a.1",), ("b",)]
    with pytest.raises(ValueError):
        tb.project(df, ["absent"])
    assert tb.first_present(df, ["absent", "id"]) == "id" and tb.numeric_columns(df) == ["id"]
