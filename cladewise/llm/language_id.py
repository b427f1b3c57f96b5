"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams (one to three letters of words padded
with a space) of a language by rank.  A document's own most frequent n-grams
are ranked the same way; the out-of-place distance to a profile is the sum of
the differences of rank, with the profile's length for an n-gram that it lacks.
The language of least distance is predicted.

Profiles count all n-grams of all learning documents.  Each task counts its
distinct words per language and sends sums, so that frequent words are added up
before the shuffle; the profiles themselves are languages x ``PROFILE`` rows.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as
is every text where nothing was learned; ``letters`` tells the two apart.  Ties between n-grams go to the one
that is smaller as a packed number, ties between languages to the smaller name.
The score is 1 minus the least distance over the greatest possible one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.llm.common import by_size, give_back, interned, map_runs, rows_of, runs, small_batches

PROFILE = 400
UNKNOWN = "und"
CACHED_WORDS = 100_000


def packed_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 1-, 2- and 3-grams of words (not empty) padded with spaces, word by word, and their number per word.

    A gram is packed with 21 bits a character; the bare space is left out.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), dtype="<u4").astype(np.int64)
    space = points == 32
    word = np.cumsum(space) - 1  # of a character, and of the space before it
    two = (points[:-1] << 21) | points[1:]
    middle = ~space[1:-1]
    three = ((two[:-1] << 21) | points[2:])[middle]
    flat = np.concatenate([points[~space], two, three])
    owner = np.concatenate([word[~space], word[:-1], word[1:-1][middle]])
    return flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def split_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words (runs of letters, lower case), their places in the texts, bounds of the texts.

    The empty word stands for what lies outside of words.
    """
    lower = pc.utf8_lower(pa.array(texts, pa.large_string()))
    return interned(pc.split_pattern_regex(lower, r"[^\p{L}]+"))


def _gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, text) -> (lang, gram, n): sums over the distinct words that a task has met."""
    words: dict[str, Counter] = {}

    def drain() -> Iterator[pd.DataFrame]:
        for lang, counter in words.items():
            if not counter:
                continue
            expanded, sizes = packed_grams(list(counter))
            weights = np.repeat(np.fromiter(counter.values(), np.int64, len(counter)), sizes)
            grams, place = np.unique(expanded, return_inverse=True)
            yield pd.DataFrame({"lang": lang, "gram": grams, "n": np.bincount(place, weights=weights).astype(np.int64)})
        words.clear()

    for batch in batches:
        for lang, some in batch.groupby("lang"):
            texts = some["text"].tolist()
            for run in by_size(texts):
                distinct, codes, _ = split_words([texts[i] for i in run])
                counts = np.bincount(codes, minlength=len(distinct)).tolist()
                seen = words.setdefault(lang, Counter())
                for word, n in zip(distinct, counts):
                    if word:
                        seen[word] += n
        if sum(map(len, words.values())) > CACHED_WORDS:
            yield from drain()
    yield from drain()


@dataclass(frozen=True)
class Profiles:
    """Languages and, for each n-gram of any profile (ascending), its rank in each language."""

    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int


def learn(docs: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles of the non-null ``lang`` values over all texts of ``docs``."""
    texts = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    counts = map_runs(texts, _gram_counts, "lang string, gram long, n long")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # The profiles: languages x size rows.
    rows = total.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size).toPandas()
    langs = sorted(rows["lang"].unique())
    grams = np.unique(rows["gram"].to_numpy(dtype=np.int64))
    ranks = np.full((len(langs), len(grams)), -1, dtype=np.int64)
    at = np.searchsorted(grams, rows["gram"].to_numpy(dtype=np.int64))
    ranks[rows["lang"].map(langs.index).to_numpy(dtype=np.int64), at] = rows["rank"].to_numpy(dtype=np.int64) - 1
    return Profiles(langs, grams, ranks, size)


class Identifier:
    """Predictions of one Python worker; the n-grams of words it has met are kept, as numbers from 0."""

    def __init__(self, profiles: Profiles) -> None:
        self.profiles = profiles
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.grams = np.zeros(0, np.int64)  # by number
        self.order = np.zeros(0, np.int64)  # numbers by ascending gram

    def number(self, grams: np.ndarray) -> np.ndarray:
        """The numbers of packed n-grams; new ones get the next numbers."""
        distinct, place = np.unique(grams, return_inverse=True)
        old = self.grams[self.order]
        at = np.searchsorted(old, distinct)
        have = np.zeros(len(distinct), dtype=bool)
        have[at < len(old)] = old[at[at < len(old)]] == distinct[at < len(old)]
        numbers = np.empty(len(distinct), dtype=np.int64)
        numbers[have] = self.order[at[have]]
        numbers[~have] = len(self.grams) + np.arange(int((~have).sum()))
        self.grams = np.concatenate([self.grams, distinct[~have]])
        self.order = np.argsort(self.grams, kind="stable")
        self.place = np.empty(len(self.order), dtype=np.int64)
        self.place[self.order] = np.arange(len(self.order))
        p = self.profiles
        at = np.minimum(np.searchsorted(p.grams, self.grams), max(len(p.grams) - 1, 0))
        self.ranks = np.where(p.grams[at] == self.grams, p.ranks[:, at], -1) if len(p.grams) else p.ranks
        return numbers[place]

    def learn(self, words: list[str]) -> None:
        found, sizes = packed_grams([w for w in words if w])
        size = np.zeros(len(words), dtype=np.int64)
        size[[i for i, w in enumerate(words) if w]] = sizes
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.flat = np.concatenate([self.flat, self.number(found).astype(np.int32)])
        self.size = np.concatenate([self.size, size])
        self.start = np.cumsum(self.size) - self.size

    def one(self, numbers: np.ndarray) -> tuple[str, float]:
        p = self.profiles
        if not len(numbers) or not p.langs:
            return UNKNOWN, 0.0
        counts = np.bincount(numbers)
        found = np.flatnonzero(counts)
        # Most frequent first, of equal counts the smaller n-gram.
        key = (int(counts.max()) - counts[found]) * len(self.grams) + self.place[found]
        if len(key) > p.size:
            top = np.argpartition(key, p.size - 1)[:p.size]
            found, key = found[top], key[top]
        top = found[np.argsort(key)]
        ranks = self.ranks[:, top]
        distance = np.where(ranks >= 0, np.abs(ranks - np.arange(len(top))), p.size).sum(axis=1)
        best = int(np.argmin(distance))
        return p.langs[best], 1.0 - float(distance[best]) / (p.size * len(top))

    def of_words(self, distinct: list[str], codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[str, float, bool]]:
        """Language, score and whether there is a letter, for each text of ``split_words``."""
        if len(self.known) > CACHED_WORDS or len(self.grams) > CACHED_WORDS:
            self.forget()
        if fresh := [w for w in distinct if w not in self.known]:
            self.learn(fresh)
        at = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        for a, b in zip(bounds, bounds[1:]):
            numbers = rows_of(self.flat, self.start, self.size, at[codes[a:b]])
            yield *self.one(numbers), len(numbers) > 0

    def many(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Languages, scores, and whether the text has a letter."""
        texts = [t or "" for t in texts]
        found = [x for run in by_size(texts) for x in self.of_words(*split_words([texts[i] for i in run]))]
        return [x[0] for x in found], [x[1] for x in found], [x[2] for x in found]


def identified(docs: DataFrame, profiles: Profiles, text: Column | None = None) -> DataFrame:
    """``docs`` with a struct column ``_language`` (lang, score, letters); other columns are untouched."""
    text = F.col("text") if text is None else text
    small_batches(docs.sparkSession)

    @F.arrow_udf("lang string, score double, letters boolean")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        identifier = Identifier(profiles)
        for batch in batches:
            langs, scores, letters = [], [], []
            for part in runs(batch):
                some = identifier.many(part.to_pylist())
                langs += some[0]
                scores += some[1]
                letters += some[2]
            columns = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(letters, pa.bool_())]
            yield pa.StructArray.from_arrays(columns, ["lang", "score", "letters"])
        del identifier
        give_back()

    return docs.withColumn("_language", predict(text))
