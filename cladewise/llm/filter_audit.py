"""How filters act together: every order of them, from survivors of every subset of them.

With k filters there are 2^k subsets.  A document's truth table is one word: bit S
is set where the document survives all filters of subset S.  Adding words up by
position gives the survivors of every subset, and any order of the filters only
walks along subsets, so one pass over the documents answers all k! orders.

Positions are counted by carry-save adders: three words of one weight become a
word of sums and a word of carries (of twice the weight), without a counter a bit,
until at most two words of each weight are left.  A word that stands for n
documents enters at the weights of n's binary digits.

1. Each row gets its failures as bits, its part and labels, and a digest of its text.
   The texts go no further; equal (digest, doc_id, part, labels) collapse.
2. Copies of a text fail the same filters but the one on repetition: they become
   one row per (digest, part, labels) with the smallest doc_id.  A hot group of
   copies has no more rows than there are parts and labels.
3. Tasks count words by part and labels; the counts are summed by part.

Defined cases: a null text equals an empty one and a null part an empty string; a
null doc_id is no doc_id: such a row repeats nothing, is repeated by nothing and has
no labels; rows with the same doc_id and text don't repeat each other, and each
counts; several labels of one document count as 1 if any says so; null labels are
no labels.  An empty table has no parts and so no rows.  Texts are read whole, of
any length.  Columns other than those named, also any with a name that is used
here, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.llm.common import text_or_empty
from cladewise.session import written

#: Fixed values of the rules.
FILTERS = "ABCDE"
SPACE, LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = r"[\x20\x09-\x0D]+", 200, 50, 2, r"[#$%&*|]"
REPEATS = 1 << FILTERS.index("E")
SUBSETS = 1 << len(FILTERS)
KEYS_HELD = 4_096


def failures(text: Column) -> Column:
    """Bits of the filters on the text alone: A short, B repetitive words, C upper case, D symbols."""
    words = F.array_remove(F.split(text, SPACE), "")
    # Inside a function of arrays the words are a variable: the text is split once for both counts.
    few = F.transform(F.array(words), lambda w: F.when(F.size(w) < LEAST_WORDS, 1).otherwise(0) + F.when(
        100 * F.size(F.array_distinct(w)).cast("long") < DISTINCT_PERCENT * F.size(w).cast("long"), 2).otherwise(0))[0]
    upper = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return (few + F.when(100 * upper > UPPER_PERCENT * F.length(text).cast("long"), 4).otherwise(0)
            + F.when(text.rlike(SYMBOLS), 8).otherwise(0)).cast("int")


def survival_word(failed: Column) -> Column:
    """The truth table: bit S is set where no filter of subset S failed."""
    table = [sum(1 << s for s in range(SUBSETS) if not s & mask) for mask in range(SUBSETS)]
    return F.element_at(F.array(*[F.lit(x).cast("long") for x in table]), failed + 1)


def positional_counts(words: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each of the ``SUBSETS`` positions is set, words counted ``times`` each, by carry-save adders."""
    words, times = words.astype(np.uint32), times.astype(np.int64)
    total, weight = np.zeros(SUBSETS, dtype=np.int64), 0
    carried: list[np.ndarray] = []
    while len(words) or carried:
        mine = np.concatenate([*carried, words[(times >> weight) & 1 == 1]])
        carried = []
        while len(mine) > 2:
            third = len(mine) // 3
            a, b, c = mine[:third], mine[third:2 * third], mine[2 * third:3 * third]
            either = a ^ b
            carried.append((a & b) | (c & either))
            mine = np.concatenate([either ^ c, mine[3 * third:]])
        for word in mine:
            total += ((int(word) >> np.arange(SUBSETS)) & 1) << weight
        weight += 1
        left = times >> weight > 0
        words, times = words[left], times[left]
    return total


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, good, toxic, word, n) -> (part, good, toxic, survivors of each subset)."""
    held: dict[tuple, np.ndarray] = {}

    def drain() -> pa.RecordBatch:
        keys = list(held)
        out = pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()),
            pa.array([k[2] for k in keys], pa.bool_()), pa.array([held[k].tolist() for k in keys], pa.list_(pa.int64())),
        ], ["part", "good", "toxic", "survivors"])
        held.clear()
        return out

    for batch in batches:
        frame = batch.to_pandas()
        for key, own in frame.groupby(["part", "good", "toxic"], sort=False):
            held[key] = held.get(key, 0) + positional_counts(own["word"].to_numpy(), own["n"].to_numpy())
        if len(held) > KEYS_HELD:
            yield drain()
    if held:
        yield drain()


def judged(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Documents as (part, good, toxic, failed, n): counts of rows with the same failures."""
    read = docs.select(
        F.col("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        failures(text_or_empty()).alias("failed"), F.sha2(text_or_empty(), 256).alias("digest"),
    )
    marks = (
        labels.where("doc_id is not null").groupBy("doc_id")
        .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
             F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
        .select(F.col("doc_id").cast("string").alias("key"), "good", "toxic")
    )
    # Rows without a doc_id meet no label; a key of their own text keeps them apart.
    keyed = read.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none "), F.col("digest"))))
    counted = keyed.groupBy("key", "doc_id", "digest", "part", "failed").agg(F.count("*").alias("n"))
    rows = counted.join(marks, "key", "left").select(
        "digest", "doc_id", "part", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"), "failed", "n")
    # The rows of the smallest doc_id of a group: only they, and rows without one, may be no repetition.
    groups = written(
        rows.groupBy("digest", "part", "good", "toxic", "failed").agg(
            F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
            F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")),
        "copies")
    several = groups.groupBy("digest").agg(F.min("first.doc_id").alias("least"), F.count("*").alias("rows"))
    # Groups of one row need no join; the others have at most a row a part and labels.
    known = groups.join(several.where("rows > 1").select("digest", "least"), "digest", "left")
    least = F.coalesce("least", F.col("first.doc_id"))
    free = F.col("unnamed") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    both = F.array(
        F.struct(F.col("failed").alias("failed"), free.alias("n")),
        F.struct(F.col("failed").bitwiseOR(F.lit(REPEATS)).alias("failed"), (F.col("n") - free).alias("n")),
    )
    return known.select("part", "good", "toxic", F.inline(F.filter(both, lambda x: x["n"] > 0)))


def survivors(rows: DataFrame) -> DataFrame:
    """Per part: ``alive``, ``alive_good`` and ``alive_toxic``, the survivors of each subset (arrays by subset)."""
    words = rows.select("part", "good", "toxic", survival_word(F.col("failed")).alias("word"), "n")
    counted = words.mapInArrow(_counted, "part string, good boolean, toxic boolean, survivors array<long>")

    def summed(name: str, take: Column | None) -> Column:
        each = [F.col("survivors")[s] for s in range(SUBSETS)]
        return F.array(*[F.sum(x if take is None else F.when(take, x).otherwise(0)) for x in each]).alias(name)

    return counted.groupBy("part").agg(
        summed("alive", None), summed("alive_good", F.col("good")), summed("alive_toxic", F.col("toxic")))


def orders(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """Every order and step: (order, step, number of the step's filter, subset applied before it)."""
    found = []
    for order in permutations(filters):
        before = 0
        for step, name in enumerate(order, 1):
            number = filters.index(name)
            found.append(("".join(order), step, number, before))
            before |= 1 << number
    return found


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    alive = survivors(judged(docs, labels, part))
    whole, filters = SUBSETS - 1, range(len(FILTERS))

    def lost(name: str, before: Column, bit: Column) -> Column:
        return F.col(name)[before] - F.col(name)[before.bitwiseOR(bit)]

    # Before a filter stand the filters of S, in any order, behind it the others: |S|! (k - 1 - |S|)! orders.
    shares = F.array(*[
        sum((F.lit(factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())) * lost("alive", F.lit(s), F.lit(1 << f))
             for s in range(SUBSETS) if not s >> f & 1), F.lit(0).cast("long"))
        for f in filters])
    # k! * k constants, whatever the input.
    names, steps, numbers, before = (F.lit(list(x)) for x in zip(*orders()))
    table = F.arrays_zip(names.alias("filter_order"), steps.alias("step"), numbers.alias("_filter"), before.alias("_before"))
    each = alive.withColumn("_shares", shares).select(
        "*", F.inline(table).alias("filter_order", "step", "_filter", "_before"))
    at = F.call_function("shiftleft", F.lit(1), F.col("_filter"))
    rest = F.lit(whole).bitwiseXOR(at)
    removed = lost("alive", F.col("_before"), at)
    return each.select(
        "part", "filter_order", "step", F.col("alive")[F.col("_before").bitwiseOR(at)].alias("kept"), removed.alias("removed"),
        (lost("alive", F.lit(0), at) - removed).alias("redundant"), lost("alive", rest, at).alias("unique_fails"),
        lost("alive_good", F.col("_before"), at).alias("good_lost"),
        lost("alive_toxic", F.col("_before"), at).alias("toxic_lost"), F.col("_shares")[F.col("_filter")].alias("shapley"),
    )
