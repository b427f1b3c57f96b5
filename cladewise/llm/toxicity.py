"""Toxicity of whole texts by a convolutional classifier trained in numpy.

A word is embedded as the sum of two hashed vectors: of the word and of its
first letters, so that forms of one stem share what was learned.  Filters of
widths 1, 2 and 3 run over the words, each filter keeps its greatest response
in the text (max pooling), and a linear layer gives the log-odds.  Thresholds
are calibrated per language on labelled texts that the weights have not seen;
the language is itself predicted from the text, and the score is shifted so
that 0.5 is the threshold.

The fit uses at most ``PER_CLASS`` labelled texts of each class, whole, drawn by a
hash of the doc_id, and leaves a quarter of them out; the driver holds four bytes
for each word of the others.  Thresholds rest on every other labelled text of the
training fold, whole: they are scored in tasks and counted by language, label and
bin of the log-odds.  Counts are weighted so that each class has its share of all
labelled texts, fitted ones included.  A language's counts are taken together with
the counts of all texts, scaled to ``PRIOR`` texts, so a language with few labelled
texts follows all texts and one with many follows its own.  Where one class has no
text outside the fit, thresholds rest on the fitted texts too.  Scores are given for
every text, whole, whatever its length.

Defined cases: a null or empty text has no words and takes the score of the
bias; several labels of one document count as toxic if any says so; where
nothing was labelled, or one class only, every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.llm import language_id
from cladewise.llm.common import bitmap, by_size, give_back, map_runs, may_hold, runs, small_batches, training_fold
from cladewise.session import written

PER_CLASS = 5_000
BUCKETS, STEMS, STEM_LETTERS, DIM, FILTERS, WIDTHS = 1 << 15, 1 << 15, 5, 12, 16, (1, 2, 3)
STEPS, BATCH, RATE = 1_000, 32, 0.08
CACHED_WORDS, JUDGED_BYTES = 100_000, 1_000_000
BINS, FARTHEST, PRIOR, LABEL_SLOTS = 64, 64.0, 100.0, 1 << 19


def word_code(word: str) -> int:
    """The two embedding rows of a word in one number."""
    return xxhash.xxh64_intdigest(word) % BUCKETS * STEMS + xxhash.xxh64_intdigest(word[:STEM_LETTERS], 1) % STEMS


def embedding_rows(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return codes // STEMS, BUCKETS + codes % STEMS


class WordCodes:
    """Texts as codes of their words; words already met are kept."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.codes = np.zeros(0, dtype=np.int32)

    def of_words(self, distinct: list[str], codes: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """The codes of each text of ``language_id.split_words``."""
        if len(self.known) > CACHED_WORDS:
            self.known, self.codes = {}, self.codes[:0]
        if fresh := [w for w in distinct if w not in self.known]:
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
            self.codes = np.concatenate([self.codes, np.array([word_code(w) for w in fresh], dtype=np.int32)])
        at = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        blank = distinct.index("") if "" in distinct else -1
        for a, b in zip(bounds, bounds[1:]):
            own = codes[a:b]
            yield self.codes[at[own[own != blank]]]

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        for run in by_size(texts):
            yield from self.of_words(*language_id.split_words([texts[i] for i in run]))


@dataclass
class Network:
    """Weights; ``project`` and ``pool`` are the forward pass that training and scoring share."""

    embed: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width * DIM, FILTERS)
    shift: np.ndarray
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)  # language -> log-odds; "" for any other
    profiles: language_id.Profiles | None = None

    @classmethod
    def fresh(cls, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        return cls(
            rng.normal(0, 0.1, (BUCKETS + STEMS, DIM)).astype(np.float32),
            {w: rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS},
            np.zeros(n, dtype=np.float32), rng.normal(0, 0.3, n).astype(np.float32), 0.0,
        )

    def responses(self, vectors: np.ndarray, width: int) -> np.ndarray:
        """Filter responses at each place where ``width`` words fit; a shorter text is padded with zeros."""
        parts = self.filters[width].reshape(width, DIM, FILTERS)
        if len(vectors) < width:
            vectors = np.concatenate([vectors, np.zeros((width - len(vectors), DIM), dtype=vectors.dtype)])
        n = len(vectors) - width + 1
        return sum(vectors[j:j + n] @ parts[j] for j in range(width))

    def pool(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greatest responses of a text, the places where they stand, and the word vectors."""
        whole, stem = embedding_rows(codes)
        vectors = self.embed[whole] + self.embed[stem]
        best, where = [], []
        for width in WIDTHS:
            r = self.responses(vectors, width)
            at = r.argmax(axis=0)
            best.append(r[at, np.arange(FILTERS)])
            where.append(at)
        return np.concatenate(best), np.concatenate(where), vectors

    def log_odds(self, codes: np.ndarray) -> float:
        if not len(codes):
            return self.bias
        best, _, _ = self.pool(codes)
        return float(np.maximum(best + self.shift, 0) @ self.out + self.bias)


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> Network:
    """Adagrad over shuffled batches; only the places that won the pooling carry a gradient."""
    net = Network.fresh(seed)
    rng = np.random.default_rng(seed)
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    sums = {k: np.full_like(v, 1e-6) for k, v in (("embed", net.embed), ("shift", net.shift), ("out", net.out))}
    filter_sums = {w: np.full_like(f, 1e-6) for w, f in net.filters.items()}
    bias_sum = 1e-6
    for _ in range(-(-STEPS * BATCH // len(texts))):
        order = rng.permutation(len(texts))
        for start in range(0, len(order), BATCH):
            batch = [i for i in order[start:start + BATCH] if len(texts[i])]
            if not batch:
                continue
            d_out, d_shift, d_bias = np.zeros_like(net.out), np.zeros_like(net.shift), 0.0
            d_filters = {w: np.zeros_like(f) for w, f in net.filters.items()}
            touched, slopes = [], []
            for i in batch:
                best, where, vectors = net.pool(texts[i])
                hidden = np.maximum(best + net.shift, 0)
                odds = float(hidden @ net.out + net.bias)
                error = weight[i] * (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels[i]) / len(batch)
                d_out += error * hidden
                d_bias += error
                through = error * net.out * (hidden > 0)
                d_shift += through
                for k, width in enumerate(WIDTHS):
                    own = slice(k * FILTERS, (k + 1) * FILTERS)
                    parts = net.filters[width].reshape(width, DIM, FILTERS)
                    for j in range(width):
                        place = where[own] + j
                        inside = place < len(vectors)
                        g, p = through[own][inside], place[inside]
                        d_filters[width][j * DIM:(j + 1) * DIM, inside] += vectors[p].T * g
                        slope = parts[j][:, inside].T * g[:, None]
                        for rows in embedding_rows(texts[i][p]):
                            touched.append(rows)
                            slopes.append(slope)
            touched, slopes = np.concatenate(touched), np.concatenate(slopes)
            rows, place = np.unique(touched, return_inverse=True)
            gradient = np.zeros((len(rows), DIM), dtype=np.float32)
            np.add.at(gradient, place, slopes)
            sums["embed"][rows] += gradient**2
            net.embed[rows] -= RATE * gradient / np.sqrt(sums["embed"][rows])
            for w, f in net.filters.items():
                filter_sums[w] += d_filters[w] ** 2
                f -= RATE * d_filters[w] / np.sqrt(filter_sums[w])
            for name, value, gradient in (("out", net.out, d_out), ("shift", net.shift, d_shift)):
                sums[name] += gradient**2
                value -= RATE * gradient / np.sqrt(sums[name])
            bias_sum += d_bias**2
            net.bias -= float(RATE * d_bias / np.sqrt(bias_sum))
    return net


def best_cut(low: np.ndarray, high: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The log-odds at which the least weight of labels is wrong; the middle of the widest such gap.

    Bins ascend; each has its least and greatest log-odds and the weights of its labels.
    """
    wrong = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(clean[::-1])[::-1], [0]])
    below, above = np.concatenate([[low[0] - 2], high]), np.concatenate([low, [high[-1] + 2]])
    gaps = above - below
    gaps[wrong > wrong.min() + 1e-9 * (toxic.sum() + clean.sum())] = -1
    at = int(np.argmax(gaps))
    return float((below[at] + above[at]) / 2)


def best_threshold(odds: np.ndarray, labels: np.ndarray) -> float:
    """``best_cut`` of single texts."""
    order = np.argsort(odds, kind="stable")
    odds, labels = odds[order], labels[order]
    return best_cut(odds, odds, (labels == 1).astype(float), (labels == 0).astype(float))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the training fold, one row per document."""
    return (
        labels.where("toxic is not null and doc_id is not null").where(training_fold(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """At most ``per_class`` labelled texts of either class, of the training fold: doc_id, text, lang, toxic."""
    marked = training_labels(labels)
    order = [F.xxhash64("doc_id", F.lit(11)), F.col("doc_id")]
    # Two top lists of bounded length.
    chosen = marked.where("toxic = 1").orderBy(*order).limit(per_class).unionByName(
        marked.where("toxic = 0").orderBy(*order).limit(per_class)
    )
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", "text", lang.alias("lang")).where("text is not null")
    return texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def _coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = WordCodes()
    for batch in batches:
        codes = [c.astype("<i4").tobytes() for c in words.texts(batch["text"].tolist())]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "codes": codes})


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network | None:
    """The classifier, or None where one of the classes has no labelled text.

    Texts become word codes in tasks; the driver gets four bytes a word.
    """
    sample = written(labelled_sample(docs, labels, per_class), "labelled")
    profiles = language_id.learn(sample)
    known = sample.select("doc_id", "toxic", "text")
    frame = map_runs(known, _coded, "doc_id long, toxic int, codes binary").toPandas().sort_values("doc_id")
    y = frame["toxic"].to_numpy(dtype=np.int64)
    if len(np.unique(y)) < 2:
        return None
    texts = [np.frombuffer(c, dtype="<i4") for c in frame["codes"]]
    apart = np.array([xxhash.xxh64_intdigest(str(d), 5) % 4 == 0 for d in frame["doc_id"]])
    if len(np.unique(y[~apart])) < 2 or len(np.unique(y[apart])) < 2:
        apart = np.zeros(len(y), dtype=bool)
    net = train([t for t, a in zip(texts, apart) if not a], y[~apart])
    net.profiles = profiles
    net.thresholds = thresholds(label_counts(docs, labels, frame["doc_id"].to_numpy()[~apart], net))
    return net


def judged(net: Network, batches: Iterator[pa.Array]) -> Iterator[tuple[list[float], list[str]]]:
    """Log-odds and predicted languages of batches of texts, which are split into words once for both."""
    words, identifier = WordCodes(), language_id.Identifier(net.profiles)
    for batch in batches:
        odds, langs = [], []
        for part in runs(batch, JUDGED_BYTES):
            split = language_id.split_words([x or "" for x in part.to_pylist()])
            langs += [lang for lang, _, _ in identifier.of_words(*split)]
            odds += [net.log_odds(codes) for codes in words.of_words(*split)]
            del split
        yield odds, langs
    del words, identifier
    give_back()


def label_counts(docs: DataFrame, labels: DataFrame, fitted: np.ndarray, net: Network) -> pd.DataFrame:
    """Labelled texts of the training fold, counted by lang, bin of the log-odds, toxic and fitted.

    ``fitted`` names the documents that the fit used.  Documents without a label are left out by a bitmap before they are scored, and texts are not shuffled.
    The driver gets at most languages x 2 * ``BINS`` * ``FARTHEST`` x 4 rows.
    """
    spark = docs.sparkSession
    small_batches(spark)

    @F.arrow_udf("odds double, lang string")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for odds, langs in judged(net, batches):
            yield pa.StructArray.from_arrays([pa.array(odds, pa.float64()), pa.array(langs, pa.string())], ["odds", "lang"])

    marked = training_labels(labels)
    texts = docs.where("text is not null and doc_id is not null").select("doc_id", "text")
    texts = may_hold(texts, F.col("doc_id").cast("long"), bitmap(marked, F.col("doc_id").cast("long"), LABEL_SLOTS), LABEL_SLOTS)
    found = texts.select("doc_id", judge("text").alias("_judged"))
    found = written(found.select("doc_id", "_judged.odds", "_judged.lang"), "judged")
    used = F.broadcast(spark.createDataFrame(pd.DataFrame({"doc_id": fitted, "fitted": True})))
    level = F.floor(F.greatest(F.least("odds", F.lit(FARTHEST)), F.lit(-FARTHEST)) * BINS).alias("bin")
    return (
        found.join(marked, "doc_id").join(used, "doc_id", "left")
        .groupBy("lang", level, "toxic", F.coalesce("fitted", F.lit(False)).alias("fitted"))
        .agg(F.count("*").alias("n"), F.min("odds").alias("low"), F.max("odds").alias("high"))
        .toPandas().sort_values(["lang", "bin", "toxic", "fitted"])
    )


def thresholds(counts: pd.DataFrame) -> dict[str, float]:
    """The threshold of each language, shrunk towards that of all texts, and of all texts under ""."""
    outside = counts[~counts["fitted"]]
    if outside["toxic"].nunique() < 2:
        outside = counts
    # What the fit took of a class is made up for by the others of that class.
    weight = (counts.groupby("toxic")["n"].sum() / outside.groupby("toxic")["n"].sum()).rename("weight")
    outside = outside.join(weight, on="toxic")
    outside["toxic_weight"] = outside["n"] * outside["weight"] * (outside["toxic"] == 1)
    outside["clean_weight"] = outside["n"] * outside["weight"] * (outside["toxic"] == 0)
    weights = ["toxic_weight", "clean_weight"]
    prior = outside.copy()
    prior[weights] *= PRIOR / prior[weights].to_numpy().sum()

    def cut(own: pd.DataFrame) -> float:
        bins = own.groupby("bin").agg({"low": "min", "high": "max", "toxic_weight": "sum", "clean_weight": "sum"})
        return best_cut(*(bins[c].to_numpy() for c in bins.columns))

    return {"": cut(outside), **{lang: cut(pd.concat([own, prior])) for lang, own in outside.groupby("lang")}}


def scored(docs: DataFrame, net: Network | None, text: Column | None = None) -> DataFrame:
    """``docs`` with a double column ``_toxicity`` (0 to 1, toxic from 0.5); other columns are untouched."""
    if net is None:
        return docs.withColumn("_toxicity", F.lit(0.0))
    text = F.col("text") if text is None else text
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        base = net.thresholds[""]
        for odds, langs in judged(net, batches):
            above = np.array([x - net.thresholds.get(lang, base) for x, lang in zip(odds, langs)], dtype=np.float64)
            yield pa.array(1 / (1 + np.exp(-np.clip(above, -30, 30))), pa.float64())

    return docs.withColumn("_toxicity", score(text))
