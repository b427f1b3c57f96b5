"""Orders, ranks, quantiles, bins and scalars."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cladewise.functions import bins, ranking, scalars as fn
from cladewise.functions.sampling import explode_range, uniform


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, values repeat, some are null."""
    random = np.random.default_rng(5)
    frame = pd.DataFrame({"g": np.where(random.random(3000) < 0.7, "hot", random.choice(list("abc"), 3000)),
                          "x": np.round(random.normal(size=3000), 1), "y": np.round(random.exponential(size=3000), 1), "id": range(3000)})
    frame.loc[::50, "x"] = np.nan
    df = spark.createDataFrame(frame).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return frame, df


@pytest.mark.parametrize("slices", [4, 200])
def test_row_numbers_of_a_hot_group(skewed, slices):
    frame, df = skewed
    found = ranking.number_rows(df.select("g", "y", "id"), ["g"], ["y", "id"], "no", slices).toPandas().set_index("id")["no"]
    expected = frame.sort_values(["y", "id"]).groupby("g").cumcount() + 1
    assert (found.sort_index() == expected.sort_index()).all()


def test_percentiles_match_linear_interpolation(skewed):
    frame, df = skewed
    found = ranking.percentiles(df, ["g"], "x", {"q25": 0.25, "q50": 0.5, "q99": 0.99}).toPandas().set_index("g")
    for name, q in (("q25", 0.25), ("q50", 0.5), ("q99", 0.99)):
        assert np.allclose(found[name].sort_index(), frame.groupby("g")["x"].quantile(q).sort_index())


def test_spearman_with_ties(skewed):
    frame, df = skewed
    found = ranking.spearman(df, ["g"], "x", "y").toPandas().set_index("g")["spearman"]
    for g, part in frame.dropna().groupby("g"):
        assert found[g] == pytest.approx(part["x"].rank().corr(part["y"].rank()))


def test_spearman_without_spread_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("a", 1.0, 4.0), ("b", 1.0, 1.0)], "g string, x double, y double")
    assert {r.g: r.spearman for r in ranking.spearman(df, ["g"], "x", "y").collect()} == {"a": None, "b": None}


def test_bins_close_as_asked(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (-1.0,), (None,)], "v double")

    def ask(**how):
        return [r[0] for r in df.select(bins.bin_index(F.col("v"), [0, 1, 2], **how)).collect()]

    assert ask() == [1, 2, 2, None, None, None]
    assert ask(include_lowest=False) == [1, 2, None, None, None, None]
    assert ask(right=True) == [1, 1, 2, None, None, None]
    assert ask(right=True, include_lowest=False) == [None, 1, 2, None, None, None]
    assert bins.labels([0, 1.5, float("inf")]) == ["[0,1.5)", "[1.5,Inf)"]
    with pytest.raises(ValueError):
        bins.check_breaks([0, 0, 1])


def test_ranges_are_listed_whole(spark):
    df = spark.createDataFrame([("a", 45), ("b", 0), ("c", 1)], "k string, n long")
    found = explode_range(df, "n", "i", block=10)
    assert sorted((r.k, r.i) for r in found.collect()) == [("a", i) for i in range(45)] + [("c", 0)]


def test_draws_repeat(spark):
    df = spark.range(2000)
    first = df.select(uniform(1, "id")).toPandas().iloc[:, 0]
    again = df.repartition(7).orderBy("id").select(uniform(1, "id")).toPandas().iloc[:, 0]
    assert (first.to_numpy() == again.to_numpy()).all() and 0.45 < first.mean() < 0.55 and first.between(0, 1).all()


def test_allele_decoding(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (1.0,), (4.0,), (0.1,), (0.24,), (-0.3,)], "a double")
    found = df.select(fn.allele_kind(F.col("a")), fn.alternate(F.col("a")), fn.sequence_piece(F.col("a"), F.lit("T"))).collect()
    assert [tuple(r) for r in found] == [
        ("reference", None, "T"), ("deletion", "-", ""), ("substitution", "A", "A"), ("substitution", "T", "T"),
        ("insertion", "+A", "TA"), ("insertion", "+G", "TGT"), ("insertion", None, "C")]


def test_labels_and_names(spark):
    df = spark.createDataFrame([("ok_1.x",), ("it's",), ("",)], "s string")
    assert [r[0] for r in df.select(fn.newick_label(F.col("s"))).collect()] == ["ok_1.x", "'it''s'", "''"]
    name = "score_proc_time_12.5_3_ints_RP_0.5_samp_stem-0.2_prog-1.0_CD_T_AF_0.01_B_F.txt"
    fields = spark.createDataFrame([(name,)], "n string").select(*[c.alias(k) for k, c in fn.result_name_fields(F.col("n")).items()]).first()
    assert tuple(fields) == ("12.5", 3, 0.5, "T", "0.01", "F", "stem: 0.2, prog: 1.0")


def test_grid_argument_and_seeds():
    assert fn.whole_numbers("5,1,5") == [1, 5]
    for wrong in ("", "a", "0,1"):
        with pytest.raises(ValueError):
            fn.whole_numbers(wrong)
    assert fn.seed_for(7, 1, 2) != fn.seed_for(7, 2, 1) and 0 <= fn.seed_for(7, 10**9) < 2**31
