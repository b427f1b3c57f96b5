"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Vectors x are lifted to (x, sqrt(M^2 - |x|^2)), M the greatest norm, so that the
largest inner product with a query is the least Euclidean distance to it.
Centroids are fitted on a bounded sample by k-means with a penalty on full
clusters.  Every vector goes to the posting list of its nearest centroid and, if
it stands near a boundary, to up to ``COPIES`` lists at almost the same distance.
Centroids are found by beam search in a graph of their neighbours, which each
task holds in memory.  A query opens the lists whose centroids are at most a
ratio times as far as the nearest, however many they are: where a beam of
``BEAM`` is full of such centroids, all others are looked at too.

The ratio is measured on the table itself.  ``TUNED`` queries, drawn by a hash,
find their exact neighbours in one scan of all vectors; a neighbour needs the
ratio at which the first of its lists opens, and the ratio taken opens a list of
``recall`` of these neighbours.  So it follows the number of lists and the shape
of the vectors.  ``recall`` 1 opens every list, which is the exact search.

Equal vectors are one class, indexed once; its ``k`` + 1 smallest ids stand for
it, which is exact, for no query needs more.  Lists are put together to bins and
bins cut into blocks of bounded size, and the queries of a bin meet each of its
blocks list by list, so a list that draws a third of all vectors or queries is
many small groups; a task multiplies at most ``CELLS`` numbers at a time.

Defined cases: vectors that are null, zero, hold null or non-finite components,
have no id or another length than the most frequent one take no part.  Rows
that repeat an id count once, with the least vector.  An empty table, and one
where no row is a query, have no neighbours.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladewise.session import written

PER_LIST, MAX_LISTS, SAMPLE_PER_LIST, ROUNDS = 256, 2048, 32, 8
COPIES, COPY_RATIO = 2, 1.03
BEAM, DEGREE = 256, 24
RECALL, TUNED = 0.985, 256
BLOCK, CELLS = 16_384, 4_000_000


@dataclass(frozen=True)
class Centroids:
    """Centroids and the graph that is searched for them."""

    points: np.ndarray
    graph: np.ndarray  # neighbours of each, nearest first; padded with itself
    entries: np.ndarray
    scale: float

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.scale**2 - (vectors**2).sum(axis=1), 0))
        return np.concatenate([vectors, rest[:, None]], axis=1).astype(np.float32)

    def raised(self, queries: np.ndarray) -> np.ndarray:
        """Queries at norm ``scale``, with nothing in the added dimension."""
        unit = queries / np.linalg.norm(queries, axis=1, keepdims=True) * self.scale
        return np.concatenate([unit, np.zeros((len(unit), 1))], axis=1).astype(np.float32)

    def nearest(self, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search: places of the nearest centroids and their distances, ascending; inf where fewer were met."""
        n, c = len(points), len(self.points)
        rows = np.arange(n)[:, None]
        beam = min(beam, c)
        seen = np.zeros((n, c), dtype=bool)
        ids = np.broadcast_to(self.entries, (n, len(self.entries))).copy()
        seen[rows, ids] = True
        far = np.linalg.norm(points[:, None, :] - self.points[ids], axis=2)
        done = np.zeros(ids.shape, dtype=bool)
        while True:
            open_far = np.where(done, np.inf, far)
            step = np.argsort(open_far, axis=1)[:, :4]
            best = np.take_along_axis(open_far, step, axis=1)
            if not np.isfinite(best).any():
                break
            np.put_along_axis(done, step, True, axis=1)
            # A row with fewer open centroids looks at its first again, which is known already.
            fresh = self.graph[np.where(np.isfinite(best), np.take_along_axis(ids, step, axis=1), ids[:, :1])]
            fresh = np.sort(fresh.reshape(n, -1), axis=1)
            new = ~seen[rows, fresh]
            new[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
            seen[rows, fresh] = True
            width = int(new.sum(axis=1).max())
            if width:
                order = np.argsort(~new, axis=1, kind="stable")[:, :width]
                fresh, new = np.take_along_axis(fresh, order, axis=1), np.take_along_axis(new, order, axis=1)
                more = np.linalg.norm(points[:, None, :] - self.points[fresh], axis=2)
                more[~new] = np.inf
                ids, far = np.concatenate([ids, fresh], axis=1), np.concatenate([far, more], axis=1)
                done = np.concatenate([done, ~new], axis=1)
            order = np.argsort(far, axis=1, kind="stable")[:, :beam]
            ids, far, done = (np.take_along_axis(x, order, axis=1) for x in (ids, far, done))
        return ids, far

    def within(self, points: np.ndarray, ratio: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the point, place of the centroid) for centroids at most ``ratio`` times as far as the nearest.

        A beam whose worst centroid is beyond the ratio holds them.  Where it is
        not, the point is compared with every centroid.
        """
        if not np.isfinite(ratio):
            rows, lists = np.indices((len(points), len(self.points)))
            return rows.ravel(), lists.ravel()
        ids, far = self.nearest(points, beam)
        near = far <= ratio * far[:, :1]
        full = near.all(axis=1) & (ids.shape[1] < len(self.points))
        at, column = np.nonzero(near & ~full[:, None])
        rows, lists = [at], [ids[at, column]]
        full = np.flatnonzero(full)
        for start in range(0, len(full), 64):
            some = full[start:start + 64]
            far = np.linalg.norm(points[some, None, :] - self.points, axis=2)
            at, place = np.nonzero(far <= ratio * far.min(axis=1, keepdims=True))
            rows.append(some[at])
            lists.append(place)
        return np.concatenate(rows), np.concatenate(lists)


def balanced_kmeans(points: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """k-means whose assignment adds to a cluster's distance what it holds above the mean size."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), k, replace=False)].astype(np.float32)
    push = np.zeros(k, dtype=np.float32)
    squares = (points**2).sum(axis=1)
    for _ in range(rounds):
        owner, gap = np.empty(len(points), dtype=np.int64), 0.0
        for i in range(0, len(points), 2048):
            some = points[i:i + 2048]
            d = squares[i:i + 2048, None] - 2 * some @ centres.T + (centres**2).sum(axis=1)
            owner[i:i + 2048] = (d + push).argmin(axis=1)
            gap += float(np.maximum(d.min(axis=1), 0).sum())
        size = np.bincount(owner, minlength=k)
        order = np.argsort(owner, kind="stable")
        starts = np.cumsum(size) - size
        full = size > 0
        centres[full] = np.add.reduceat(points[order], starts[full], axis=0) / size[full, None]
        push += (0.1 * gap / len(points) * (size * k / len(points) - 1)).astype(np.float32)
    return centres


def fit(points: np.ndarray, lists: int, scale: float) -> Centroids:
    """Centroids of the sampled ``points`` (lifted), and their neighbour graph."""
    centres = balanced_kmeans(points, min(lists, len(points)))
    c = len(centres)
    degree = min(DEGREE, c - 1)
    graph = np.empty((c, 2 * degree + 1), dtype=np.int64)
    reverse: list[list[int]] = [[] for _ in range(c)]
    for i in range(c):
        d = ((centres - centres[i]) ** 2).sum(axis=1)
        near = np.argsort(d, kind="stable")
        near = near[near != i][:degree]
        graph[i, 0], graph[i, 1:degree + 1] = i, near
        for j in near:
            reverse[j].append(i)
    for i in range(c):  # edges back, so that every centroid can be reached
        back = (reverse[i] + [i] * degree)[:degree]
        graph[i, degree + 1:] = back
    return Centroids(centres, graph, np.unique(np.linspace(0, c - 1, min(c, 16)).astype(np.int64)), scale)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<f8").reshape(len(column), -1)


def _assigned(index: Centroids) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 512):
                some = batch.iloc[start:start + 512]
                points = index.lifted(_matrix(some["vector"]))
                ids, far = index.nearest(points, 4 * COPIES)
                at, column = np.nonzero(far[:, :COPIES] <= COPY_RATIO * far[:, :1])
                out = some.iloc[at].copy()
                out["list"] = ids[at, column]
                yield out

    return run


def _opened(index: Centroids, ratio: float) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 512):
                some = batch.iloc[start:start + 512]
                at, lists = index.within(index.raised(_matrix(some["vector"])), ratio, BEAM)
                out = some.iloc[at].copy()
                out["list"] = lists
                yield out

    return run


def _best(q_id: np.ndarray, q: np.ndarray, v_id: np.ndarray, v: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """(query, id, place in ``v``, score): the k best of ``v`` for each query, itself left out, and a few more for ties."""
    take = min(k + 8, len(v))
    step = max(1, CELLS // max(len(v), take * v.shape[1]))
    for start in range(0, len(q), step):
        some, names = q[start:start + step], q_id[start:start + step]
        near = some @ v.T
        near[names[:, None] == v_id[None, :]] = -np.inf
        top = np.argpartition(near, len(v) - take, axis=1)[:, len(v) - take:]
        at, column = np.nonzero(np.isfinite(np.take_along_axis(near, top, axis=1)))
        found = top[at, column]
        # summed over the pair alone, so that equal vectors get equal scores wherever they stand
        yield pd.DataFrame({"query": names[at], "id": v_id[found], "at": found, "score": (some[at] * v[found]).sum(axis=1)})


def _first(found: pd.DataFrame, k: int) -> pd.DataFrame:
    found = found.sort_values(["query", "score", "id"], ascending=[True, False, True])
    return found[found.groupby("query").cumcount() < k]


def _searched(k: int) -> object:
    """For each query of a block its k best classes over the lists that it opened, by the exact inner product."""

    def run(key: tuple, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": [], "id": [], "score": []}).astype({"query": "int64", "id": "int64", "score": "float64"})]
        lists = dict(tuple(block.groupby("list")))
        for name, asked in queries.groupby("list"):
            if name in lists:
                own = lists[name]
                found = _best(asked["id"].to_numpy(), _matrix(asked["vector"]), own["id"].to_numpy(), _matrix(own["vector"]), k)
                out += [part[["query", "id", "score"]] for part in found]
        return _first(pd.concat(out).drop_duplicates(["query", "id"]), k)

    return run


def _scanned(q_id: np.ndarray, q: np.ndarray, k: int) -> object:
    """The k best classes of a task for each of a few queries, with their vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            names, vectors = batch["id"].to_numpy(), batch["vector"].to_numpy()
            for part in _best(q_id, q, names, _matrix(batch["vector"]), k) if len(batch) else ():
                part["vector"] = vectors[part.pop("at").to_numpy()]
                held = part if held is None else pd.concat([held, part])
            held = held if held is None else _first(held, k)
        if held is not None:
            yield held

    return run


def needed_ratios(index: Centroids, queries: np.ndarray, neighbours: np.ndarray) -> np.ndarray:
    """For each pair of a query and a neighbour of it, the ratio from which on the query opens a list that holds the neighbour."""
    out = []
    for start in range(0, len(queries), 256):
        raised = index.raised(queries[start:start + 256])
        ids, far = index.nearest(index.lifted(neighbours[start:start + 256]), 4 * COPIES)
        held = far[:, :COPIES] <= COPY_RATIO * far[:, :1]
        to_all = np.linalg.norm(raised[:, None, :] - index.points, axis=2)
        to_own = np.where(held, np.take_along_axis(to_all, ids[:, :COPIES], axis=1), np.inf).min(axis=1)
        out.append(to_own / np.maximum(to_all.min(axis=1), 1e-12))
    return np.concatenate(out)


def tuned_ratio(index: Centroids, packed: DataFrame, queries: pd.DataFrame, k: int, recall: float) -> float:
    """The least opening ratio that reaches ``recall`` of the exact k neighbours of the given queries (at most ``TUNED``).

    The driver gets one row of k per query.
    """
    if recall >= 1 or len(index.points) == 1:
        return np.inf
    q_id, q = queries["id"].to_numpy(), _matrix(queries["vector"])
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = packed.mapInPandas(_scanned(q_id, q, k), "query long, id long, score double, vector binary")
    found = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).select("query", "vector").toPandas()
    if found.empty:
        return np.inf
    place = pd.Series(np.arange(len(q_id)), index=q_id)
    needed = np.sort(needed_ratios(index, q[place[found["query"]].to_numpy()], _matrix(found["vector"])))
    # A little above the ratio that was measured, for distances are summed in another order elsewhere.
    return float(needed[int(np.ceil(recall * len(needed))) - 1]) * (1 + 1e-5)


def valid_vectors(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector array<double>) of the rows that take part, one per id."""
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    sound = (
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    rows = rows.where(F.coalesce(sound, F.lit(False)))
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vector") == (length["n"] if length else 0))
    return written(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")


def nearest(table: DataFrame, is_query: str, k: int = 20, recall: float = RECALL) -> DataFrame:
    """The k rows of largest inner product for each row that ``is_query`` (SQL over vec_id) picks.

    Columns query_id, rank, vec_id, score; ties go to the smaller vec_id.
    ``recall`` is what the opened lists hold of the neighbours of the tuning queries; 1 searches all lists.
    """
    spark = table.sparkSession
    rows = valid_vectors(table)
    classes = written(
        rows.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
        .select("id", "n", F.expr("aggregate(vector, 0D, (a, x) -> a + x * x)").alias("square"), "vector"), "classes",
    )
    facts = classes.agg(F.count("*"), F.max(F.sqrt("square"))).first()
    number, scale = int(facts[0]), float(facts[1] or 1.0)
    lists = max(1, min(MAX_LISTS, number // PER_LIST))
    # The sample that the centroids are fitted on: bounded by MAX_LISTS * SAMPLE_PER_LIST vectors.
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(lists * SAMPLE_PER_LIST).select("vector").toPandas()
    vectors = np.array(sample["vector"].tolist(), dtype=np.float64)
    if not len(vectors):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blank = Centroids(np.zeros((1, 1)), np.zeros((1, 1), dtype=np.int64), np.zeros(1, dtype=np.int64), scale)
    index = fit(blank.lifted(vectors), lists, scale)

    def to_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "vector": [np.asarray(v, dtype="<f8").tobytes() for v in batch["vector"]]})

    packed = classes.select("id", "vector").mapInPandas(to_bytes, "id long, vector binary")
    asked = rows.where(is_query).join(classes.select(F.col("id"), "vector"), "vector").select("vec_id", "id")
    asked = written(asked, "asked")
    with_list = "id long, vector binary, list int"
    postings = written(packed.mapInPandas(_assigned(index), with_list), "postings")
    wanted = asked.select("id").distinct()
    queries = written(packed.join(wanted, "id", "left_semi"), "queries")
    tuning = queries.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(TUNED).toPandas()
    ratio = tuned_ratio(index, packed, tuning, k, recall) if len(tuning) else np.inf
    opened = written(queries.mapInPandas(_opened(index, ratio), with_list), "opened")

    # Neighbouring numbers of lists form a bin of about BLOCK vectors; a query gets k rows of a bin, not of each list.
    in_bin = F.floor(F.col("list") / F.lit(max(1, BLOCK // (2 * PER_LIST)))).cast("int").alias("bin")

    def blocks(of: DataFrame, name: str) -> DataFrame:
        """Blocks per bin: one row per bin, at most MAX_LISTS."""
        return of.groupBy(in_bin).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias(name))

    sizes = F.broadcast(written(blocks(postings, "v_blocks").join(blocks(opened, "q_blocks"), "bin"), "blocks"))

    def dealt(of: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one block of its own kind, once for each block of the other."""
        out = of.select("*", in_bin).join(sizes, "bin").withColumn(own, F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    keys = ["bin", "v_blocks", "q_blocks"]
    found = (
        dealt(opened, "q_blocks", "v_blocks").groupBy(*keys)
        .cogroup(dealt(postings, "v_blocks", "q_blocks").groupBy(*keys))
        .applyInPandas(_searched(k), "query long, id long, score double")
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = (
        found.groupBy("query", "id").agg(F.max("score").alias("score"))
        .withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")
    )
    own = wanted.join(classes, "id").select(F.col("id").alias("query"), "id", F.col("square").alias("score"))
    found = written(found.unionByName(own), "found")
    # The smallest ids of the classes that hold several rows.
    several = rows.join(classes.where("n > 1").select("id", "vector"), "vector").select("id", "vec_id")
    first = Window.partitionBy("id").orderBy("vec_id")
    several = several.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1).drop("_n")
    named = found.join(several, "id", "left").withColumn("vec_id", F.coalesce("vec_id", "id"))
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= k + 1)
    answers = asked.select(F.col("vec_id").alias("query_id"), F.col("id").alias("query")).join(
        named.select("query", "vec_id", "score"), "query"
    ).where("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        answers.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
