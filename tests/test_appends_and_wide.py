"""States of append-only tables, sketches, trees larger than a split, wide files: against plain versions."""

import csv
import gzip
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.operators import partial_states as ps, summaries as su
from cladewise.session import scratch_path
from cladewise.sources import files as fi, newick as nw

SCHEMA = "g string, no int, x double, name string"


def _rows(n=3000):
    draw = np.random.default_rng(3)
    # one group holds most rows; values far from zero, so that a naive sum of squares would lose them
    rows = [("hot" if i % 4 else ("b" if i % 8 else None), i, float(1e7 + draw.normal()), f"n{i % 500}") for i in range(n)]
    return rows + [("one", n, 5.0, None), ("none", n + 1, None, None), ("one", n + 2, None, "z")]


def test_appended_batches_give_the_rows_of_one(spark):
    rows, folder = _rows(), scratch_path(spark, "states")
    table = spark.createDataFrame(rows, SCHEMA)
    kept = ps.Summary(["g"], {"odd": "no % 2 = 1"}, ["x"], ["name"], ["x"])
    kept.append(table.where("no < 1000"), folder, "a")
    kept.append(table.where("no < 1700"), folder, "b")  # a batch that was wrong is replaced
    kept.append(table.where("no >= 1000"), folder, "b")
    kept.append(table.where("no < 0"), folder, "empty")
    states = kept.stored(spark, folder)
    whole = {r.g: r for r in su.summarise(table, ["g"], "x").collect()}
    found = {r.g: r for r in ps.moment_table(states, ["g"], "x").collect()}
    assert set(found) == set(whole) == {"hot", "b", None, "one", "none"}
    for g, r in found.items():
        assert r.n == whole[g].n
        for c in ("mean", "sd", "se", "lower", "upper"):
            want = whole[g][c]
            assert (r[c] is None and want is None) or r[c] == pytest.approx(want, rel=1e-9), (g, c)
    counts = {r.g: (r.rows, r.count_odd, r.min_x, r.max_x) for r in states.collect()}
    for g in counts:
        own = [r for r in rows if r[0] == g]
        values = [r[2] for r in own if r[2] is not None]
        assert counts[g] == (len(own), sum(r[1] % 2 for r in own), min(values, default=None), max(values, default=None))
    target = scratch_path(spark, "compact")
    kept.compact(spark, folder, target)
    kept.append(table.where("g = 'one'"), target, "more")
    again = {r.g: r.n for r in ps.moment_table(kept.stored(spark, target), ["g"], "x").collect()}
    assert again == {g: r.n + (g == "one") for g, r in whole.items()}


def test_sketches_keep_their_error(spark):
    table = spark.range(200_000, numPartitions=8).selectExpr("id % 3 as g", "id div 5 as name", "pow(id % 9973, 3) as x", "id")
    folder = scratch_path(spark, "states")
    kept = ps.Summary(["g"], distinct=["name"], quantiles=["x"])
    for i in range(3):
        kept.append(table.where(f"id % 7 % 3 = {i}"), folder, str(i))
    cuts = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    found = kept.stored(spark, folder).select(
        "g", ps.distinct_estimate("name").alias("d"), *[ps.quantile_estimate("x", p).alias(f"q{i}") for i, p in enumerate(cuts)]).collect()
    names, values = {}, {}
    for i in range(200_000):
        names.setdefault(i % 3, set()).add(i // 5)
        values.setdefault(i % 3, []).append(float(i % 9973) ** 3)
    assert len(found) == 3
    for r in found:
        assert abs(r.d - len(names[r.g])) <= 5 * 0.0163 * len(names[r.g])
        own = np.sort(values[r.g])
        for i, p in enumerate(cuts):
            low, high = np.searchsorted(own, r[f"q{i}"], "left") / len(own), np.searchsorted(own, r[f"q{i}"], "right") / len(own)
            assert low - 0.01 <= p <= high + 0.01
    empty = kept.merged(kept.states(table.where("id < 0")))
    assert empty.count() == 0
    none = kept.states(spark.createDataFrame([(1, None, None)], "g long, name string, x double"))
    assert none.select(ps.distinct_estimate("name"), ps.quantile_estimate("x", 0.5)).first() == (0, None)


def _edges(edges, tree):
    parents = edges.selectExpr(tree, "node as parent", "label as parent_label")
    found = edges.join(parents, [tree, "parent"], "left").select("label", "length", "parent_label", "is_tip").collect()
    return sorted(map(tuple, found), key=repr)


def test_one_line_over_many_splits(spark, tmp_path):
    draw = np.random.default_rng(4)

    def tree(name, n):
        parts = [f"'{name}, tip ''{i}''':{i % 9}.5" if i % 3 else f"{name}{i}:1" for i in range(n)]
        while len(parts) > 1:
            k = int(draw.integers(2, 6))
            parts = parts[k:] + [f"({','.join(parts[:k])}){name}i{len(parts)}:2"]
        return parts[0] + ";"

    first, second, third = tree("a", 3000), tree("b", 40), "(x,(y,z)w)top;"
    (tmp_path / "trees.nwk").write_text(first + second + "\n" + third + "\n")
    (tmp_path / "single.nwk").write_text("lonely;\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        assert spark.read.option("lineSep", ",").text(str(tmp_path)).rdd.getNumPartitions() > 10
        tokens = nw.read_tokens(spark, str(tmp_path)).withColumn("tree", F.concat_ws("#", "file", "tree"))
        found = _edges(nw.parse_tokens(tokens, "tree"), "tree")
    finally:
        spark.conf.set(key, before)
    texts = spark.createDataFrame([(0, first), (1, second), (2, third), (3, "lonely;")], "tree int, newick string")
    assert found == _edges(nw.parse_newick(texts, "tree", "newick"), "tree")
    assert tokens.select("tree").distinct().count() == 4


def _read(folder):
    out = []
    for path in sorted(Path(folder).glob("part-*")):
        with (gzip.open if path.suffix == ".gz" else open)(path, "rt", newline="") as f:
            lines = list(csv.reader(f, doublequote=False, escapechar="\\"))
        if lines:
            out.append((lines[0], lines[1:]))
    return out


def test_wide_files_of_many_features(spark):
    n, folder = 20_000, scratch_path(spark, "wide")
    matrix = spark.range(n).selectExpr(
        "inline(array(struct('all' as cell, id as feature, id + 1L as value), struct('few' as cell, id as feature, if(id % 1000 = 0, 7L, null) as value)))"
    ).unionByName(spark.createDataFrame([("last", n - 1, 3)], "cell string, feature long, value long"))
    fi.write_wide(matrix.selectExpr("cell", "lpad(feature, 6, '0') as feature", "value"), folder, files=3)
    files = _read(folder)
    assert len(files) == 3
    rows = {}
    for header, lines in files:
        assert header == ["cell"] + [f"{i:06d}" for i in range(n)]
        rows |= {line[0]: line[1:] for line in lines}
    assert rows["all"] == [str(i + 1) for i in range(n)]
    assert rows["few"] == ["7" if i % 1000 == 0 else "0" for i in range(n)]
    assert rows["last"] == ["0"] * (n - 1) + ["3"]


def test_wide_files_defined_cases(spark):
    folder = scratch_path(spark, "wide")
    rows = [("c,1", 'a"b', 2.5), ("c,1", "x,y", 1.0), ("c,1", "x,y", 4.0), ("c\\2", "plain", None), ("c3", None, 9.0), (None, "plain", 9.0)]
    matrix = spark.createDataFrame(rows, "cell string, feature string, value double")
    fi.write_wide(matrix, folder, files=2, compress=False)
    back = {r["cell"]: r.asDict() for r in fi.read_table(spark, folder).collect()}
    assert back == {"c,1": {"cell": "c,1", 'a"b': "2.5", "plain": "0", "x,y": "1.0"},
                    "c\\2": {"cell": "c\\2", 'a"b': "0", "plain": "0", "x,y": "0"}}
    none = scratch_path(spark, "wide")
    fi.write_wide(matrix.where("false"), none, files=1)
    assert _read(none) == [(["cell"], [])]
