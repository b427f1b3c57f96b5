"""Similarity self-join on sets of word n-grams by Jaccard similarity, and its components.

Filter and verify.  The n-grams of a document are ordered rarest first; two sets
that are similar enough must share one of their first n-grams (prefix filter),
have similar sizes (length filter), leave enough n-grams behind the first that
they share (positional filter), and may not differ too much in how their n-grams
spread over ``PARTS`` hash ranges (suffix filter: a lower bound of the Hamming
distance).  Each pair that is left is verified once on whole sets.

How it keeps its size.
* Equal sets are one class; only one member of it is joined.
* Rarity comes from counts over all documents: tasks send the n-grams that they
  meet at least twice, and the ``FREQUENT`` most frequent ones order the sets.
  The bound holds for any input; n-grams beyond it count as rare, which costs
  candidates, never links.
* A component is found without listing the pairs inside it.  In each posting
  list the entry nearest to the front is its hub; members are compared with hubs
  first, best candidates of each component after that, and only then every
  pair whose documents are still in different components.
* Texts are never shuffled: sets are made anew where the texts are read, for the
  few documents that candidates name, recognised by a bitmap of bounded size.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  Defined cases: with fewer
words than n the whole sequence is one n-gram; null or empty texts have no
n-grams and link with nothing; rows that repeat a doc_id are one document, which
links by any of its texts; rows without a doc_id link with nothing and have no
component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.llm.common import bitmap, by_size, components, interned, map_runs, may_hold, text_or_empty
from cladewise.session import written

FREQUENT, CHUNK, PARTS, ROUNDS = 1 << 20, 2_000_000, 128, 2
_ODD = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Rule:
    """Sets of ``words``-grams link where 100 * intersection >= ``percent`` * union."""

    words: int = 5
    percent: int = 80

    def alone(self, n: int) -> bool:
        """Whether a set of n can link only with an equal one."""
        return 100 * n < self.percent * (n + 1)

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def overlap(self, n: Column, m: Column) -> Column:
        """Least intersection of linked sets of sizes n and m."""
        return F.ceil(F.lit(self.percent).cast("long") * (n + m) / F.lit(100 + self.percent)).cast("int")


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def sets_of(texts: list[str], words: int) -> Iterator[np.ndarray]:
    """The n-gram set of each text as an ascending array of 64-bit hashes."""
    powers = [np.uint64(pow(_ODD, i + 1, 1 << 64)) for i in range(words)]
    for run in by_size(texts):
        lower = pc.ascii_lower(pa.array([texts[i] for i in run], pa.large_string()))
        distinct, codes, bounds = interned(pc.ascii_split_whitespace(lower))
        hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
        blank = distinct.index("") if "" in distinct else -1
        for a, b in zip(bounds, bounds[1:]):
            own = codes[a:b]
            h = hashed[own[own != blank]] if blank >= 0 else hashed[own]
            if not len(h):
                yield np.zeros(0, dtype=np.uint64)
                continue
            width = min(words, len(h))
            n = len(h) - width + 1
            total = np.full(n, width, dtype=np.uint64)
            for i in range(width):
                total = total + h[i:i + n] * powers[i]
            yield np.unique(_mixed(total))


def _summaries(rule: Rule) -> object:
    """Rows of two kinds: a document with its set's size and signature, or an n-gram and its count in the task."""

    def counted(parts: list[np.ndarray]) -> pd.DataFrame:
        values = np.sort(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate([starts, [len(values)]]))
        often = counts > 1
        return pd.DataFrame({
            "kind": 1, "key": values[starts[often]].view(np.int64), "count": counts[often], "a": 0, "b": 0,
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for batch in batches:
            out = []
            for doc, grams in zip(batch["doc_id"].astype("Int64"), sets_of(batch["text"].tolist(), rule.words)):
                data = grams.tobytes()
                out.append((
                    0, doc, len(grams), int(np.uint64(xxhash.xxh3_64_intdigest(data, 1)).view(np.int64)),
                    int(np.uint64(xxhash.xxh3_64_intdigest(data, 2)).view(np.int64)),
                ))
                parts.append(grams)
                held += len(grams)
                if held > CHUNK:
                    yield counted(parts)
                    parts, held = [], 0
            frame = pd.DataFrame(out, columns=["kind", "key", "count", "a", "b"])
            frame["key"] = frame["key"].astype("Int64")
            yield frame
        yield counted(parts)

    return run


def frequent(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams (ascending) and their counts: at most ``most``, of (key, count) sums."""
    total = counts.groupBy("key").agg(F.sum("count").alias("count")).where("count > 2")
    total = written(total, "frequencies")
    level = F.floor(F.log2(F.col("count")) * 8).cast("int")
    # A few hundred levels of frequency: take as many of the highest as fit.
    levels = sorted(((r["level"], r["n"]) for r in total.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = None, 0
    for at, n in levels:
        if held + n > most:
            break
        least, held = at, held + n
    if least is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    frame = total.where(level >= least).toPandas()
    keys = frame["key"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], frame["count"].to_numpy(dtype=np.int64)[order]


def _prefixes(rule: Rule, shared: object) -> object:
    """(doc_id, text) -> (id, n, tokens of the prefix rarest first, spread of the set over hash ranges)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = shared.value
        for batch in batches:
            out = []
            for doc, grams in zip(batch["doc_id"], sets_of(batch["text"].tolist(), rule.words)):
                n = len(grams)
                if not n or rule.alone(n):
                    continue
                weight = np.zeros(n, dtype=np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                    weight = np.where(keys[at] == grams, counts[at], 0)
                first = grams[np.argsort(weight, kind="stable")[:rule.prefix(n)]]
                spread = np.minimum(np.bincount((grams >> np.uint64(57)).astype(np.int64), minlength=PARTS), 255)
                out.append((doc, n, first.view(np.int64), spread.astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["id", "n", "tokens", "spread"])

    return run


def _near(rule: Rule) -> object:
    """Suffix filter over (a, b, n_a, n_b, spread_a, spread_b): pairs that may link, with their distance bound."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, m = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
            left = np.frombuffer(b"".join(batch["spread_a"]), dtype=np.uint8).reshape(-1, PARTS).astype(np.int16)
            right = np.frombuffer(b"".join(batch["spread_b"]), dtype=np.uint8).reshape(-1, PARTS).astype(np.int16)
            apart = np.abs(left - right).sum(axis=1)
            least = -(-rule.percent * (n + m) // (100 + rule.percent))
            keep = apart <= n + m - 2 * least
            yield pd.DataFrame({"a": batch["a"][keep], "b": batch["b"][keep], "apart": apart[keep].astype(np.int32)})

    return run


class _Join:
    """The tables of one join: prefixes of class members, posting lists that hold several entries."""

    def __init__(self, docs: DataFrame, members: DataFrame, rule: Rule, hot: tuple[np.ndarray, np.ndarray]) -> None:
        spark = docs.sparkSession
        self.rule, self.docs = rule, docs
        self.tested: DataFrame | None = None
        shared = spark.sparkContext.broadcast(hot)
        prefixes = map_runs(docs, _prefixes(rule, shared), "id long, n int, tokens array<long>, spread binary")
        self.sets = written(prefixes.join(members, "id", "left_semi"), "prefixes")
        entries = self.sets.select("id", "n", F.posexplode("tokens").alias("pos", "token"))
        # The hub of a list: the entry nearest to the front of its set.
        hubs = entries.groupBy("token").agg(
            F.count("*").alias("_n"), F.min(F.struct("pos", "id", "n")).alias("hub")
        ).where("_n > 1").select("token", "hub")
        self.lists = written(entries.join(hubs, "token"), "lists")

    def candidates(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, n_a, pos_a, b, n_b, pos_b) of shared tokens -> pairs that pass all filters, with their bound."""
        need = self.rule.overlap(F.col("n_a"), F.col("n_b"))
        pairs = pairs.where((F.col("pos_a") <= F.col("n_a") - need) & (F.col("pos_b") <= F.col("n_b") - need))
        swap = F.col("a") > F.col("b")
        one = {c: F.when(swap, F.col(f"{c}_b" if c else "b")).otherwise(F.col(f"{c}_a" if c else "a")) for c in ("", "n", "pos")}
        two = {c: F.when(swap, F.col(f"{c}_a" if c else "a")).otherwise(F.col(f"{c}_b" if c else "b")) for c in ("", "n", "pos")}
        pairs = pairs.select(
            one[""].alias("a"), two[""].alias("b"), one["n"].alias("n_a"), two["n"].alias("n_b"),
            one["pos"].alias("pos_a"), two["pos"].alias("pos_b"),
        )
        # The first n-gram that both have stands at the least place in both.
        first = pairs.groupBy("a", "b", "n_a", "n_b").agg(F.min("pos_a").alias("pos_a"), F.min("pos_b").alias("pos_b"))
        behind = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
        first = first.where(behind >= need).drop("pos_a", "pos_b")
        if self.tested is not None:
            first = first.join(self.tested, ["a", "b"], "left_anti")
        spread = self.sets.select("id", "n", "spread")
        for side in ("a", "b"):
            named = spread.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("spread").alias(f"spread_{side}"))
            first = first.join(named, [side, f"n_{side}"])
        return written(first.mapInPandas(_near(self.rule), "a long, b long, apart int"), "candidates")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, verified on whole sets."""
        pairs = written(pairs.select("a", "b").distinct(), "pairs")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        rule = self.rule

        def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                sets = [x.view(np.int64) for x in sets_of(batch["text"].tolist(), rule.words)]
                yield pd.DataFrame({"id": batch["doc_id"], "grams": sets})

        texts = may_hold(self.docs, F.col("doc_id"), written(bitmap(named, F.col("id")), "named"))
        # A document that repeats is made once for each of its different sets.
        sets = map_runs(texts, make, "id long, grams array<long>").join(named, "id", "left_semi")
        sets = written(sets.withColumn("_h", F.xxhash64("grams")).dropDuplicates(["id", "_h"]).drop("_h"), "sets")
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("grams").alias(f"set_{side}")), side)
        both = F.size(F.array_intersect("set_a", "set_b"))
        either = F.size("set_a") + F.size("set_b") - both
        return written(pairs.where(100 * both.cast("long") >= rule.percent * either.cast("long")).select("a", "b"), "links")

    def labelled(self, labels: DataFrame | None) -> DataFrame:
        """The lists with the component of each entry and of its hub."""
        if labels is None:
            return self.lists.withColumn("label", F.col("id")).withColumn("hub_label", F.col("hub.id"))
        own = labels.select(F.col("node").alias("id"), F.col("component").alias("label"))
        hubs = labels.select(F.col("node").alias("_hub"), F.col("component").alias("hub_label"))
        out = self.lists.join(own, "id", "left").withColumn("label", F.coalesce("label", "id"))
        out = out.withColumn("_hub", F.col("hub.id")).join(hubs, "_hub", "left")
        return out.withColumn("hub_label", F.coalesce("hub_label", "_hub")).drop("_hub")

    def with_hub(self, lists: DataFrame) -> DataFrame:
        other = lists.where("label <> hub_label")
        return other.select(
            F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"),
            F.col("hub.id").alias("b"), F.col("hub.n").alias("n_b"), F.col("hub.pos").alias("pos_b"),
        )

    def across(self, lists: DataFrame) -> DataFrame:
        """Every pair of a list whose documents are in different components.

        Entries outside of the list's largest component meet all others; those
        inside it never meet each other.
        """
        sizes = lists.groupBy("token", "label").agg(F.count("*").alias("_n"))
        main = sizes.groupBy("token").agg(F.max(F.struct("_n", "label"))["label"].alias("main"), F.count("*").alias("_k"))
        lists = lists.select("token", "id", "n", "pos", "label").join(main.where("_k > 1").select("token", "main"), "token")
        lists = written(lists, "mixed")
        one = lists.where("label <> main").select(
            "token", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), F.col("label").alias("label_a"))
        two = lists.select(
            "token", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"),
            F.col("label").alias("label_b"), "main")
        need = self.rule.overlap(F.col("n_a"), F.col("n_b"))
        apart = (F.col("label_a") != F.col("label_b")) & ((F.col("label_b") == F.col("main")) | (F.col("a") < F.col("b")))
        fits = (F.col("pos_a") <= F.col("n_a") - need) & (F.col("pos_b") <= F.col("n_b") - need)
        behind = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
        ahead = F.least("pos_a", "pos_b")
        return one.join(two, "token").where(apart & fits & (behind + ahead >= need))


def linked_components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links reach)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    summary = written(
        map_runs(texts, _summaries(rule), "kind int, key long, count long, a long, b long"), "summaries"
    )
    rows = summary.where("kind = 0").select(F.col("key").alias("doc_id"), F.col("count").alias("n_shingles"), "a", "b")
    hot = frequent(summary.where("kind = 1").select("key", "count"))
    filled = rows.where("doc_id is not null and n_shingles > 0")
    classes = written(
        filled.groupBy("n_shingles", "a", "b").agg(F.min("doc_id").alias("id")), "classes"
    )
    join = _Join(texts.where("doc_id is not null"), classes.select("id"), rule, hot)

    # Each document with its nearest hub, then the best candidates of each component, then all that is left.
    nearest = Window.partitionBy("of").orderBy("apart", "b", "a")
    found = join.candidates(join.with_hub(join.labelled(None)))
    sides = found.select("a", "b", "apart", F.explode(F.array("a", "b")).alias("of"))
    links = join.links(sides.withColumn("_n", F.row_number().over(nearest)).where("_n = 1"))
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = written(components(edges), "labels")
    for _ in range(ROUNDS):
        found = join.candidates(join.with_hub(join.labelled(labels)))
        named = found
        for side in ("a", "b"):
            own = labels.select(F.col("node").alias(side), F.col("component").alias(f"label_{side}"))
            named = named.join(own, side, "left").withColumn(f"label_{side}", F.coalesce(f"label_{side}", side))
        sides = named.select("a", "b", "apart", F.explode(F.array("label_a", "label_b")).alias("of"))
        links = join.links(sides.withColumn("_n", F.row_number().over(nearest)).where("_n <= 2"))
        if links.isEmpty():
            break
        edges = labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(
            links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        labels = written(components(edges), "labels")
    links = join.links(join.candidates(join.across(join.labelled(labels))))
    edges = labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(
        links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # Rows without n-grams take keys of their own, so that none gathers them.
    own = F.when(F.col("n_shingles") == 0, F.xxhash64("doc_id")).otherwise(F.col("a"))
    rows = rows.withColumn("a", own).join(classes, ["n_shingles", "a", "b"], "left").drop("a", "b")
    # A doc_id that repeats with different texts links its classes.
    several = rows.groupBy("doc_id").agg(F.min("id").alias("u"), F.max("id").alias("v")).where("u <> v").select("doc_id")
    same = rows.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    labels = written(components(edges.unionByName(same.where("v is not null"))), "labels")
    out = rows.join(labels.withColumnRenamed("node", "id"), "id", "left")
    return out.select("doc_id", "n_shingles", F.when(
        F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id")).alias("component_id"))


def representatives(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The documents that stay: the smallest doc_id of each component, and rows without a doc_id."""
    groups = linked_components(docs, rule)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id()).alias("_id"))
    rows = rows.withColumn("_id", F.when(F.col("_row.doc_id").isNotNull(), F.col("_id")))
    return rows.join(gone.withColumnRenamed("doc_id", "_id"), "_id", "left_anti").select("_row.*")
