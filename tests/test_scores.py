"""The scores of tree pairs look all their draws up at once."""

import pytest
from pyspark.sql import functions as F

from cladewise.operators import ancestry, trees as tr


def _trees(spark):
    rows = []
    for role, deal in (("truth", 1), ("estimate", 7)):
        for i in range(79):
            rows.append(("p", role, f"{role}{i}", f"{role}{(i - 1) // 2}" if i else None,
                         (i - 39) * deal % 40 if i >= 39 else None, 1.0 + i * 13 % 7 / 10 if i else 0.0))
    return spark.createDataFrame(rows, "pair string, role string, key string, parent_key string, label long, length double")


@pytest.mark.parametrize("whole", [0, 1_000_000])
def test_one_index_answers_all_draws(spark, monkeypatch, whole):
    trees = _trees(spark)
    labels, index = tr.shared_labels(trees), tr.tip_index(tr.tree_table(trees))
    alone = {
        "triplet_agreement": tr.triplet_agreement(labels, index, "5t", 300).first().triplet_agreement,
        "ordering_agreement": tr.ordering_agreement(labels, index, "5o", 300).first().ordering_agreement,
        "cophenetic_spearman": tr.cophenetic_spearman(labels, index, "5c", 300).first().cophenetic_spearman}
    made = []
    build = tr.chain_index
    for module in (ancestry, tr):
        monkeypatch.setattr(module, "WHOLE", whole)
    monkeypatch.setattr(tr, "chain_index", lambda *a, **b: made.append(1) or build(*a, **b))
    found = tr.score_pairs(trees, "5", 300).first()
    assert len(made) == 1
    assert found.drawn_pairs == 300 and {k: found[k] for k in alone} == pytest.approx(alone)


def test_trees_that_are_wanted_whole_are_not_climbed(spark, monkeypatch):
    monkeypatch.setattr(ancestry, "WHOLE", 0)
    nodes = _trees(spark).select(F.col("key").alias("node_id"), F.col("parent_key").alias("parent_node_id"))
    tips = nodes.where("node_id like 'truth%'")
    assert ancestry.above(nodes, tips) is nodes
    assert ancestry.above(nodes, tips.where("node_id in ('truth70', 'truth71')")).count() == 11
