"""Quality of whole texts by a factorisation machine trained in numpy.

A text is a sparse vector x of three kinds of inputs:

* its words, hashed to ``BUCKETS``: log(1 + occurrences), scaled to length 1;
* statistics of its structure (``STATISTICS``), each as a point between two of
  ``KNOTS`` neighbouring knots, so that any curve of the statistic can be learned;
* metadata: columns the caller names, one hashed input per column and value
  (whole numbers by their number of binary digits).

The log-odds are ``bias + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``.  The pair
sum costs one pass over the inputs, for it equals half of
``sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2``.

The fit uses at most ``PER_CLASS`` labelled texts of each class, drawn by a hash
of the doc_id; the driver holds at most ``2 * PER_CLASS`` texts of ``BUCKETS +
STRUCTURE`` inputs of 6 bytes each (590 MB if every text had words in all
buckets; about 2 KB a text on prose).  Each class weighs as much as it has
labelled texts in the whole training fold, so 0.5 keeps its meaning whatever the
sample took.  Texts are read whole, for the fit and for the scores; a task needs
about 40 bytes for each byte of its longest text, 2 MB at least.

Defined cases: a null text equals an empty one, which has no words and statistics
of 0; null metadata is no input; several labels of one document count as good if
any says so; labels that are null, or of a null doc_id, are not read; a doc_id
with several texts is learned from the one with the least digest.  Where nothing
was labelled every score is 0.5, where one class was, its label.  Repeated rows
are scored each; an empty table gives no rows; columns of the input are untouched,
also any with a name of this operator's but ``_quality``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.llm.common import give_back, map_runs, runs, small_batches
from cladewise.session import written

PER_CLASS = 3_000
BUCKETS, META, RANK = 1 << 14, 1 << 8, 8
STEPS, BATCH, RATE, DECAY = 1_000, 64, 0.05, 1e-4

#: Statistics of a text, each between 0 and 1.
STATISTICS = (
    "upper", "digit", "white", "symbol", "mark", "wide", "words", "distinct", "most", "word_length", "lines", "distinct_lines",
)
KNOTS = 9
STRUCTURE = len(STATISTICS) * KNOTS
INPUTS = BUCKETS + STRUCTURE + META

#: Classes of bytes: 1 A-Z, 2 digits, 3 white space, 4 symbols, 5 other ASCII punctuation, 6 beyond ASCII, 0 the rest.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = 5
_CLASS[[ord(c) for c in "#$%&*+<=>@^_|~\\"]] = 4
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[9:14] = _CLASS[32] = 3
_CLASS[128:] = 6

_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so that powers never vanish
_LOW = np.uint64(32)


def training_fold(doc_id: Column) -> Column:
    """True for documents that the classifier may learn from: crc32(doc_id as text) mod 3 is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A good hash of 64-bit numbers (wrapping arithmetic)."""
    x = (x ^ (x >> _LOW)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> _LOW)


def _hashed_runs(data: np.ndarray, apart: np.ndarray, owner_of: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of bytes between separators (and text bounds): (hash, owner, length) of each run.

    ``before`` marks the first byte of each text.  A run's hash is a polynomial in its bytes.
    """
    inside = ~apart
    first = inside.copy()
    first[1:] &= apart[:-1] | before[1:]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    here = np.arange(len(data), dtype=np.int32)
    place = here - np.maximum.accumulate(np.where(first, here, 0))
    powers = np.cumprod(np.full(int(place.max()) + 1, _STEP, dtype=np.uint64))
    terms = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * powers[place], np.uint64(0))
    return _mixed(np.add.reduceat(terms, start)), owner_of[start].astype(np.int64), np.add.reduceat(inside.astype(np.int64), start)


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over the bytes of each text."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


@dataclass
class Sparse:
    """Rows of inputs: row i has the inputs ``at[bounds[i]:bounds[i + 1]]`` with their ``value``."""

    at: np.ndarray
    value: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.bounds))

    def rows(self, wanted: np.ndarray) -> Sparse:
        size = np.diff(self.bounds)[wanted]
        ends = np.cumsum(size)
        take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.bounds[wanted] - (ends - size), size)
        return Sparse(self.at[take], self.value[take], np.concatenate([[0], ends]))


def _stacked(row: np.ndarray, at: np.ndarray, value: np.ndarray, n: int) -> Sparse:
    order = np.argsort(row, kind="stable")
    return Sparse(at[order], value[order], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]))


def inputs(texts: pa.Array, meta: list[list[int]] | None = None) -> Sparse:
    """The inputs of texts; ``meta`` has the hashed metadata of each."""
    n = len(texts)
    encoded = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(encoded.buffers()[1], dtype=np.int64)[encoded.offset:encoded.offset + n + 1]
    bounds = offsets - offsets[0]
    held = encoded.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[offsets[0]:offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    size = np.diff(bounds)
    owner = np.repeat(np.arange(n, dtype=np.int32), size)
    before = np.zeros(len(data) + 1, dtype=bool)
    before[bounds[:-1]] = True
    before = before[:len(data)]
    kind = _CLASS[data]

    word, of, length = _hashed_runs(data, kind == 3, owner, before)
    words = np.bincount(of, minlength=n)
    key = of * BUCKETS + (word % np.uint64(BUCKETS)).astype(np.int64)
    slot, times = np.unique(key, return_counts=True)
    text, at = slot // BUCKETS, slot % BUCKETS
    value = np.log1p(times)
    value /= np.sqrt(np.bincount(text, weights=value**2, minlength=n))[text]
    # Distinct words of a text: equal hashes of one text.
    same, counts = _distinct(of, word)
    distinct = np.bincount(same, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, same, counts)
    line, line_of, _ = _hashed_runs(data, data == 10, owner, before)
    lines = np.bincount(line_of, minlength=n)
    distinct_lines = np.bincount(_distinct(line_of, line)[0], minlength=n)

    facts = np.stack([
        _share(_per_text(kind == 1, bounds), size), _share(_per_text(kind == 2, bounds), size),
        _share(_per_text(kind == 3, bounds), size), _share(_per_text(kind == 4, bounds), size),
        _share(_per_text(kind == 5, bounds), size), _share(_per_text(kind == 6, bounds), size),
        np.log1p(words) / 16, _share(distinct, words), _share(most, words),
        _share(np.bincount(of, weights=length, minlength=n), words) / 32,
        np.log1p(lines) / 16, _share(distinct_lines, lines),
    ], axis=1)
    # Shares are mostly small: their roots are spread better over the knots.
    spot = np.sqrt(np.clip(facts, 0, 1)) * (KNOTS - 1)
    low = np.minimum(spot.astype(np.int64), KNOTS - 2)
    knot = BUCKETS + np.arange(len(STATISTICS)) * KNOTS + low
    part = spot - low
    rows = np.repeat(np.arange(n), len(STATISTICS))
    parts = [(text, at, value), (rows, knot.ravel(), (1 - part).ravel()), (rows, knot.ravel() + 1, part.ravel())]
    if meta:
        tags = [(i, BUCKETS + STRUCTURE + code % META) for i, codes in enumerate(meta) for code in codes]
        if tags:
            where, codes = np.array(tags, dtype=np.int64).T
            parts.append((where, codes, np.ones(len(codes))))
    row, at, value = (np.concatenate(x) for x in zip(*parts))
    return _stacked(row, at, value.astype(np.float32), n)


def _distinct(of: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The owners of distinct (owner, code) pairs, and how often each pair occurs."""
    order = np.lexsort((code, of))
    of, code = of[order], code[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (code[1:] != code[:-1])
    first = np.flatnonzero(new)
    return of[first], np.diff(np.append(first, len(of)))


@dataclass
class Machine:
    """Weights of the inputs, their factors (INPUTS, RANK) and the bias."""

    weight: np.ndarray
    factor: np.ndarray
    bias: float

    def sums(self, x: Sparse) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of the rows, and the sums of their factors."""
        row, n = x.row, len(x)
        scaled = self.factor[x.at] * x.value[:, None]
        total = np.stack([np.bincount(row, weights=scaled[:, f], minlength=n) for f in range(RANK)], axis=1)
        squares = np.bincount(row, weights=(scaled**2).sum(axis=1), minlength=n)
        linear = np.bincount(row, weights=self.weight[x.at] * x.value, minlength=n)
        return self.bias + linear + ((total**2).sum(axis=1) - squares) / 2, total

    def log_odds(self, x: Sparse) -> np.ndarray:
        return self.sums(x)[0]


def train(x: Sparse, labels: np.ndarray, share: float, seed: int = 1) -> Machine:
    """Adagrad over shuffled batches; class 1 has the weight ``share`` in the whole sample, class 0 the rest."""
    rng = np.random.default_rng(seed)
    net = Machine(np.zeros(INPUTS), rng.normal(0, 0.05, (INPUTS, RANK)), float(np.log(share / (1 - share))))
    weight = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean()))
    weight_sum, factor_sum, bias_sum = np.full(INPUTS, 1e-6), np.full((INPUTS, RANK), 1e-6), 1e-6
    for _ in range(-(-STEPS * BATCH // len(x))):
        order = rng.permutation(len(x))
        for start in range(0, len(order), BATCH):
            batch = order[start:start + BATCH]
            own = x.rows(batch)
            odds, total = net.sums(own)
            error = weight[batch] * (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels[batch]) / len(batch)
            used, place = np.unique(own.at, return_inverse=True)
            through = error[own.row] * own.value
            d_weight = np.bincount(place, weights=through) + DECAY * net.weight[used]
            slope = through[:, None] * (total[own.row] - net.factor[own.at] * own.value[:, None])
            d_factor = np.stack([np.bincount(place, weights=slope[:, f]) for f in range(RANK)], axis=1)
            d_factor += DECAY * net.factor[used]
            weight_sum[used] += d_weight**2
            factor_sum[used] += d_factor**2
            net.weight[used] -= RATE * d_weight / np.sqrt(weight_sum[used])
            net.factor[used] -= RATE * d_factor / np.sqrt(factor_sum[used])
            bias_sum += error.sum() ** 2
            net.bias -= float(RATE * error.sum() / np.sqrt(bias_sum))
    return net


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the training fold, one row per document."""
    return (
        labels.where("quality is not null and doc_id is not null").where(training_fold(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    )


def labelled_sample(docs: DataFrame, marked: DataFrame, metadata: list[str], per_class: int = PER_CLASS) -> DataFrame:
    """At most ``per_class`` labelled documents of either class: doc_id, text, the metadata and quality."""
    order = [F.xxhash64("doc_id", F.lit(17)), F.col("doc_id")]
    chosen = marked.where("quality = 1").orderBy(*order).limit(per_class).unionByName(
        marked.where("quality = 0").orderBy(*order).limit(per_class)
    )
    known = docs.where("doc_id is not null").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), _meta(metadata).alias("_meta"))
    texts = known.join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class rows
    least = texts.groupBy("doc_id").agg(F.min_by(F.struct("text", "_meta", "quality"), F.xxhash64("text", "_meta")).alias("_row"))
    return least.select("doc_id", "_row.*")


def _meta(metadata: list[str]) -> Column:
    """Named values as strings; whole numbers by their number of binary digits, so that near values share an input."""
    if not metadata:
        return F.array().cast("array<string>")
    values = []
    for name in metadata:
        column = F.col(f"`{name}`")
        digits = F.when(column.cast("long").isNotNull(), F.length(F.bin(column.cast("long"))).cast("string"))
        values.append(F.concat(F.lit(f"{name}="), F.coalesce(digits, column.cast("string"))))
    return F.array_compact(F.array(*values))


def _codes(meta: list[list[str]]) -> list[list[int]]:
    return [[xxhash.xxh64_intdigest(x) for x in own or []] for own in meta]


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        x = inputs(pa.array(batch["text"], pa.large_string()), _codes([list(m) for m in batch["_meta"]]))
        cut = [slice(a, b) for a, b in zip(x.bounds, x.bounds[1:])]
        yield pd.DataFrame({
            "doc_id": batch["doc_id"], "quality": batch["quality"],
            "at": [x.at[c].astype("<u2").tobytes() for c in cut], "value": [x.value[c].astype("<f4").tobytes() for c in cut],
        })


def fit(docs: DataFrame, labels: DataFrame, metadata: list[str] = (), per_class: int = PER_CLASS) -> Machine | float:
    """The classifier; where a class has no labelled text, the one score that all texts get."""
    metadata = list(metadata)
    marked = written(training_labels(labels), "quality-labels")
    sample = written(labelled_sample(docs, marked, metadata, per_class), "quality-sample")
    frame = map_runs(sample, _sampled, "doc_id long, quality int, at binary, value binary").toPandas().sort_values("doc_id")
    y = frame["quality"].to_numpy(dtype=np.int64)
    if len(np.unique(y)) < 2:
        return float(y[0]) if len(y) else 0.5
    sizes = [len(v) // 4 for v in frame["value"]]
    x = Sparse(
        np.frombuffer(b"".join(frame["at"]), dtype="<u2").astype(np.int64),
        np.frombuffer(b"".join(frame["value"]), dtype="<f4"), np.concatenate([[0], np.cumsum(sizes)]),
    )
    share = marked.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    return train(x, y, float(share))


def scored(docs: DataFrame, machine: Machine | float, metadata: list[str] = ()) -> DataFrame:
    """``docs`` with a double column ``_quality`` (0 to 1, good from 0.5)."""
    if isinstance(machine, float):
        return docs.withColumn("_quality", F.lit(machine))
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, meta in batches:
            found = []
            at = 0
            for part in runs(texts):
                codes = _codes(meta.slice(at, len(part)).to_pylist())
                at += len(part)
                odds = machine.log_odds(inputs(part, codes))
                found.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
            yield pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
        give_back()

    return docs.withColumn("_quality", score(F.coalesce("text", F.lit("")), _meta(list(metadata))))
