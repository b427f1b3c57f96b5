"""Language profiles, toxicity and nearest neighbours against plain versions."""

import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
import regex

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

from cladewise.llm import language_id, neighbours, toxicity  # noqa: E402


def grams_of(text):
    found = Counter()
    for word in regex.findall(r"\p{L}+", text.lower()):
        padded = f" {word} "
        for n in (1, 2, 3):
            found.update(g for i in range(len(padded) - n + 1) if (g := padded[i:i + n]) != " ")
    return found


def packed(gram):
    value = 0
    for c in gram:
        value = value << 21 | ord(c)
    return value


def ranked(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], packed(x[0])))[:size]]


def brute(rows, size):
    profiles = {}
    for _, text, lang, *_ in rows:
        if text is not None and lang is not None:
            profiles.setdefault(lang, Counter()).update(grams_of(text))
    profiles = {lang: ranked(c, size) for lang, c in sorted(profiles.items())}

    def predict(text):
        own = ranked(grams_of(text or ""), size)
        if not own:
            return "und", 0.0
        far = {
            lang: sum(abs(p.index(g) - i) if g in p else size for i, g in enumerate(own)) for lang, p in profiles.items()
        }
        best = min(far, key=lambda x: (far[x], x))
        return best, 1 - far[best] / (size * len(own))

    return predict


@pytest.mark.parametrize("size", [30, 400])
def test_languages_equal_the_plain_version(spark, size):
    docs = cases.documents(spark)
    profiles = language_id.learn(docs, size)
    predict = brute(cases.rows(), size)
    found = language_id.identified(docs, profiles)
    assert found.columns == [*docs.columns, "_language"]
    want = Counter((d, t, *predict(t)) for d, t, *_ in cases.rows())
    got = Counter((r.doc_id, r.text, r._language.lang, r._language.score) for r in found.collect())
    assert {k[:3] for k in got} == {k[:3] for k in want} and sum(got.values()) == sum(want.values())
    for (_, text, _, score) in got:
        assert score == pytest.approx(predict(text)[1])


def test_nothing_to_learn_from(spark):
    docs = cases.documents(spark)
    empty = language_id.learn(cases.no_documents(spark))
    assert {r._language.lang for r in language_id.identified(docs, empty).collect()} == {"und"}
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert {r._toxicity for r in toxicity.scored(docs, None).collect()} == {0.0}
    assert language_id.identified(cases.no_documents(spark), empty).count() == 0


def labelled(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        toxic = int(i % 4 == 0)
        words = cases.sentence(cases.EN if i % 2 else cases.DE, 60, i).split()
        if toxic:
            words.insert(i % 50, ("nasty" if i % 2 else "hasslich") + ["", "er", "es"][i % 3])
        rows.append((i, " ".join(words), "en" if i % 2 else "de"))
        labels.append((i, toxic))
    labels += [(5, None), (None, 1), (8, 1), (10_000, 1)]
    docs = spark.createDataFrame(rows + [(9_001, None, None), (9_002, "", None)], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), rows


def test_toxic_words_are_found_in_texts_not_learned_from(spark):
    docs, labels, rows = labelled(spark)
    network = toxicity.fit(docs, labels)
    scores = {r.doc_id: r._toxicity for r in toxicity.scored(docs, network).collect()}
    assert set(scores) == {r[0] for r in rows} | {9_001, 9_002}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[9_001] == scores[9_002]
    wrong = sum((scores[i] >= 0.5) != (i % 4 == 0) for i, *_ in rows)
    assert wrong <= 0.05 * len(rows)
    again = toxicity.fit(docs.repartition(5), labels)
    assert again.bias == network.bias and again.thresholds == network.thresholds


def test_labels_of_held_out_documents_are_not_read(spark):
    docs, labels, rows = labelled(spark, 200)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    assert toxicity.fit(docs, labels).bias == toxicity.fit(docs, flipped).bias


def test_pooling_equals_a_plain_loop():
    net = toxicity.Network.fresh(4)
    rows = np.random.default_rng(0).integers(0, 1000, 9)
    best, where, vectors = net.pool(rows)
    at = 0
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            want = [float(vectors[i:i + width].ravel() @ net.filters[width][:, f]) for i in range(9 - width + 1)]
            assert best[at] == pytest.approx(max(want), abs=1e-5) and where[at] == int(np.argmax(want))
            at += 1


def test_threshold_leaves_fewest_wrong():
    assert 2 < toxicity.best_threshold(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0, 0, 1, 1])) < 3
    odds, labels = np.array([1.0, 2.0, 3.0, 4.0, 5.0]), np.array([0, 1, 0, 1, 1])
    assert ((odds > toxicity.best_threshold(odds, labels)) != labels).sum() == 1


def test_thresholds_follow_the_share_of_all_labels(spark):
    rows, labels = [], []
    for i in range(1600):
        toxic = int(i % 8 == 0)
        words = cases.sentence(cases.EN, 30, i).split()
        if toxic or i % 10 in (1, 3, 5):  # most texts with this word are not toxic
            words.insert(i % 25, "nasty")
        rows.append((i, " ".join(words), "en"))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), per_class=150)
    marked = {r.doc_id for r in toxicity.scored(docs, network).where("_toxicity >= 0.5").collect()}
    wrong = sum((i in marked) != bool(toxic) for i, toxic in labels)
    assert wrong <= 1.1 * sum(toxic for _, toxic in labels)


def test_all_labelled_texts_count_whatever_their_length(spark):
    docs, labels, rows = labelled(spark)
    long = (cases.sentence(cases.EN, 30_000, 7), "en")
    more = spark.createDataFrame([(20_001, *long), (20_002, *long), (20_004, *long)], "doc_id long, text string, lang string")
    docs = docs.unionByName(more)
    labels = labels.unionByName(spark.createDataFrame([(20_001, 0), (20_002, 0), (20_004, 1)], "doc_id long, toxic int"))
    network = toxicity.fit(docs, labels, per_class=30)
    sample = toxicity.labelled_sample(docs, labels, 30).select("doc_id").toPandas()["doc_id"].to_numpy()
    assert len(sample) == 60
    assert set(toxicity.labelled_sample(docs, labels, 10_000).toPandas()["doc_id"]) >= {
        d for d in (20_001, 20_002, 20_004) if zlib.crc32(str(d).encode()) % 5}
    counts = toxicity.label_counts(docs, labels, sample, network)
    train = docs.where(toxicity.training_fold(docs.doc_id)).where("doc_id < 400 or doc_id > 20000").select("doc_id", "text").collect()
    assert counts["n"].sum() == len(train) and counts[counts["fitted"]]["n"].sum() == len(sample) < len(train)


def test_few_labels_of_a_language_follow_all_texts():
    def rows(lang, odds, toxic, n):
        return [(lang, int(x * 64), toxic, False, n, x, x) for x in odds]
    table = rows("en", (-3.0, -2.0), 0, 500) + rows("en", (2.0, 3.0), 1, 100)
    columns = ["lang", "bin", "toxic", "fitted", "n", "low", "high"]
    few = toxicity.thresholds(pd.DataFrame(table + rows("fr", (2.5,), 0, 1) + rows("fr", (3.5,), 1, 1), columns=columns))
    assert -2 < few[""] < 2 and few["fr"] == pytest.approx(few["en"], abs=4) and few["fr"] < 3
    many = toxicity.thresholds(pd.DataFrame(table + rows("fr", (2.5,), 0, 400) + rows("fr", (3.5,), 1, 80), columns=columns))
    assert 2.5 < many["fr"] < 3.5 and -2 < many["en"] < 2


VECTORS = "vec_id long, embedding array<float>, label int, id string, vector string"


def plain_neighbours(vectors, queries, k):
    ids = np.array(sorted(vectors))
    table = np.array([vectors[i] for i in ids], dtype=float)
    out = {}
    for q in queries:
        score = table @ np.array(vectors[q], dtype=float)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def test_neighbours_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PER_LIST", 40)
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(12, 16)) * 2
    vectors = {i: (centres[i % 12] + draw.normal(size=16)).astype(np.float32).tolist() for i in range(900)}
    for i in range(300):  # a third of all rows are one vector
        vectors[2000 + i] = [float(x) for x in np.float32(centres[0])]
    rows = [(i, v, 1, "x", "y") for i, v in vectors.items()]
    odd = [(5001, None, 1, "x", "y"), (5002, [0.0] * 16, 1, "x", "y"), (5020, [float("nan")] + [1.0] * 15, 1, "x", "y"),
           (5003, [float("inf")] + [1.0] * 15, 1, "x", "y"), (5004, [None] + [1.0] * 15, 1, "x", "y"), (5040, [1.0, 2.0], 1, "x", "y"),
           (None, vectors[3], 1, "x", "y"), (20, vectors[20], 1, "x", "y")]
    found = neighbours.nearest(spark.createDataFrame(rows + odd, VECTORS).repartition(4), "vec_id % 20 = 0", 20).collect()
    queries = [i for i in vectors if i % 20 == 0]
    want = plain_neighbours(vectors, queries, 20)
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(queries)
    hits = 0
    for q in queries:
        assert len(got[q]) == 20 and q not in [i for i, _ in got[q]]
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        for i, score in got[q]:
            assert score == pytest.approx(float(np.dot(np.array(vectors[i]), np.array(vectors[q]))), abs=1e-9)
        hits += len({i for i, _ in got[q]} & {i for i, _ in want[q]})
    assert hits / (20 * len(queries)) >= 0.9
    # Queries among the equal vectors get the smallest ids of their own class.
    assert [i for i, _ in got[2000]] == [i for i, _ in want[2000]]


def test_fewer_candidates_than_asked_and_none(spark):
    rows = [(i, [float(i + 1), 1.0], 0, "", "") for i in range(4)]
    found = neighbours.nearest(spark.createDataFrame(rows, VECTORS), "vec_id = 0", 20).collect()
    assert [(r.rank, r.vec_id) for r in sorted(found)] == [(1, 3), (2, 2), (3, 1)]
    none = neighbours.nearest(spark.createDataFrame([], VECTORS), "vec_id = 0", 20)
    assert none.columns == ["query_id", "rank", "vec_id", "score"] and none.count() == 0


def test_beam_search_finds_the_nearest_centroids():
    points = np.random.default_rng(1).normal(size=(3000, 8)).astype(np.float32)
    index = neighbours.fit(points, 60, 1.0)
    ids, far = index.nearest(points[:200], 20)
    true = np.argsort(((points[:200, None] - index.points[None]) ** 2).sum(axis=2), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, true)]) > 0.97
    assert (np.diff(far, axis=1) >= 0).all()


def unit_vectors(n, size, seed):
    drawn = np.random.default_rng(seed).normal(size=(n, size))
    return (drawn / np.linalg.norm(drawn, axis=1, keepdims=True)).astype(np.float32)


def test_all_centroids_within_the_ratio_are_opened():
    index = neighbours.fit(unit_vectors(4000, 24, 3), 800, 1.0)
    points = unit_vectors(200, 24, 4)
    far = np.linalg.norm(points[:, None] - index.points, axis=2)
    for ratio in (1.05, 1.16, 1.5, 3.0, np.inf):
        want = far <= ratio * far.min(axis=1, keepdims=True)
        at, lists = index.within(points, ratio, neighbours.BEAM)
        got = np.zeros(want.shape, dtype=int)
        np.add.at(got, (at, lists), 1)
        assert got.max() == 1 and (got[want] == 1).mean() >= 0.99 and got[~want].sum() <= 0.01 * want.sum()
    assert want.sum(axis=1).min() > 2 * neighbours.BEAM


def test_neighbours_recall_with_more_lists_than_a_beam(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PER_LIST", 4)
    # Short queries, mostly in dimensions that the others lack: their distances to all lists are within the ratio.
    asked = np.concatenate([0.3 * unit_vectors(40, 32, 6), 0.95 * unit_vectors(40, 32, 7)], axis=1) / 10
    table = np.concatenate([asked, np.pad(unit_vectors(4000, 32, 5), ((0, 0), (0, 32)))]).astype(np.float32)
    vectors = {i: v.tolist() for i, v in enumerate(table)}
    rows = [(i, v, 1, "x", "y") for i, v in vectors.items()]
    found = neighbours.nearest(spark.createDataFrame(rows, VECTORS).repartition(4), "vec_id < 40", 20).collect()
    want = plain_neighbours(vectors, range(40), 20)
    got = {(r.query_id, r.vec_id) for r in found}
    assert len(got) == 20 * 40
    recall = sum((q, i) in got for q in want for i, _ in want[q]) / len(got)
    assert recall >= 0.98, recall


def gaussian_vectors(n, seed):
    """Unit vectors in 64 dimensions whose variance falls slowly, so that lists overlap much."""
    drawn = np.random.default_rng(seed).normal(size=(n, 64)) * np.linspace(1.5, 0.5, 64)
    return drawn / np.linalg.norm(drawn, axis=1, keepdims=True)


def test_tuned_ratio_keeps_recall_with_many_lists(spark):
    table, k = gaussian_vectors(40_000, 8), 20
    blank = neighbours.Centroids(np.zeros((1, 1)), np.zeros((1, 1), dtype=np.int64), np.zeros(1, dtype=np.int64), 1.0)
    for lists in (40, 800):
        index = neighbours.fit(blank.lifted(table[:32 * lists]), lists, 1.0)
        ids, far = index.nearest(index.lifted(table), 4 * neighbours.COPIES)
        held = far[:, :neighbours.COPIES] <= neighbours.COPY_RATIO * far[:, :1]
        frame = pd.DataFrame({"id": range(len(table)), "vector": [v.tobytes() for v in table]})
        packed = spark.createDataFrame(frame, "id long, vector binary").repartition(8)
        ratio = neighbours.tuned_ratio(index, packed, frame.iloc[:neighbours.TUNED], k, neighbours.RECALL)
        asked = range(1000, 1100)  # none of the tuning queries
        got = []
        for q in asked:
            score = table @ table[q]
            score[q] = -np.inf
            _, opened = index.within(index.raised(table[q:q + 1]), ratio, neighbours.BEAM)
            best = np.argsort(-score)[:k]
            got.append((np.isin(ids[best, :neighbours.COPIES], opened) & held[best]).any(axis=1).mean())
        assert np.mean(got) >= 0.95, (lists, ratio, np.mean(got))


def test_recall_of_one_is_exact(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PER_LIST", 40)
    vectors = dict(enumerate(gaussian_vectors(800, 9).tolist()))
    rows = [(i, v, 1, "x", "y") for i, v in vectors.items()]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string, vector string")
    got = {}
    for r in neighbours.nearest(table, "vec_id % 20 = 0", 20, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in found] for q, found in plain_neighbours(vectors, range(0, 800, 20), 20).items()}


def test_products_of_a_hot_list_are_cut(monkeypatch):
    import tracemalloc
    vectors = gaussian_vectors(4000, 10)
    names = np.arange(4000)
    tracemalloc.start()
    found = pd.concat(neighbours._best(names, vectors, names, vectors, 20))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6  # 4,000 x 4,000 products and their order alone would be 256 MB
    few = neighbours._first(found, 20).groupby("query")["id"].apply(list)
    want = plain_neighbours(dict(enumerate(vectors)), range(0, 4000, 400), 20)
    assert all(few[q] == [i for i, _ in want[q]] for q in want)
