"""The trie of all conversations' prefixes: who shares which first turns, and what sharing saves.

A conversation is a path of turns, a turn 16 bytes of the SHA-256 of its role and
text; a node is a distinct sequence of first turns.  Conversations are ordered by
(path, conv_id) and cut into shards at splitters drawn from them.  Two keys of
different shards have a splitter between them, so a node with members in several
shards is a prefix of a splitter.  The trie of the splitters' paths, the skeleton,
is therefore all that shards share:

1. splitters come from a hash sample of bounded size; the skeleton goes to every task;
2. each shard is read once in order, with one open node a level.  A node that is
   no prefix of the shard's two splitters is finished there; for the others the
   shard gives partial sums (members, smallest member, finished children, leaves
   and savings below them) and the ends among its own members;
3. partial sums are reduced by skeleton node, and sums over subtrees follow from
   the deepest level up, over the skeleton alone;
4. a second reading of each shard's nodes, parents first, gives each its parent.

A hot conversation, first turn or path is cut by conv_id like any other run of
keys.  Memory of a task grows with the longest conversation, not with a shard or a
node.  A SHA-256 has no partial sums: the ends of a skeleton node are hashed by one
task, which reads them as joined text in blocks of ``BLOCK`` bytes.

Bounds: at most ``SHARDS`` shards; splitters of at most ``SPLITTER_TURNS`` turns (of
longer conversations equal ones stay in one shard, whole); so a skeleton of at most
``SHARDS * SPLITTER_TURNS`` nodes, 8 MB of paths.  A conversation is one row, of
some 24 bytes a turn.

Defined cases: rows without a conv_id belong to no conversation; null role or text
is empty; turns are ordered by turn (null first), ties by role, then by the SHA-256
of the text, so repeated rows are repeated turns; a conversation without turns ends
at the root; without any conversation there is no root and no row.  Long texts are
only read for their digest and words.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cladewise.llm.common import small_batches
from cladewise.session import written

KEY, WORD = 16, r"[^\x20\x09-\x0D]+"
SHARDS, SHARD_TURNS, PER_SHARD, SPLITTER_TURNS = 2_048, 1 << 20, 16, 256
BLOCK, OUT_ROWS = 1 << 16, 4_096
EVERY, HEADS = 20, 4  # a rebuilt conversation takes up to HEADS - 1 turns of the one at the last multiple of EVERY

NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string"
)
_PIECES = (
    "kind int, shard int, seq long, node long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, words long, ends string"
)
LOCAL, PARTIAL, ENDS = 0, 1, 2


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (key, words)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"), role.alias("role"), F.unhex(F.sha2(text, 256)).alias("tie"),
            F.unhex(F.substring(key, 1, 2 * KEY)).alias("key"), F.regexp_count(text, F.lit(WORD)).alias("words"),
        ).alias("entry"),
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    return ordered.select("conv_id", F.transform("entries", lambda e: F.struct(e["key"].alias("key"), e["words"].alias("words"))).alias("turns"))


def rebuilt(convs: DataFrame, every: int = EVERY, heads: int = HEADS) -> DataFrame:
    """Conversations whose first h turns are those of the one at the last multiple of ``every``; h is a hash of conv_id."""
    convs = written(convs, "conversations")
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    sources = convs.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("_source"), F.slice("turns", 1, heads - 1).alias("_head"))
    none = F.array().cast(convs.schema["turns"].dataType)
    return (
        convs.withColumn("_source", F.col("conv_id") - F.col("conv_id") % every).join(sources, "_source", "left")
        .select("conv_id", F.concat(
            F.slice(F.coalesce("_head", none), F.lit(1), shared.cast("int")),
            F.slice("turns", (shared + 1).cast("int"), F.greatest(F.size("turns"), F.lit(1))),
        ).alias("turns"))
    )


@dataclass
class Skeleton:
    """Splitters (path, conv_id) in order; the nodes of the trie of their paths, numbered from the root, 0."""

    splitters: list[tuple[bytes, int]]
    nodes: list[list[int]]  # of each splitter, by depth
    parent: np.ndarray
    depth: np.ndarray

    @classmethod
    def of(cls, splitters: list[tuple[bytes, int]]) -> Skeleton:
        known: dict[tuple[int, bytes], int] = {}
        parent, depth, nodes = [-1], [0], []
        for path, _ in splitters:
            own = [0]
            for at in range(0, len(path), KEY):
                edge = own[-1], path[at:at + KEY]
                if edge not in known:
                    known[edge] = len(parent)
                    parent.append(own[-1])
                    depth.append(len(own))
                own.append(known[edge])
            nodes.append(own)
        return cls(splitters, nodes, np.array(parent), np.array(depth))

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.splitters, (path, conv_id))

    def bounds(self, shard: int) -> list[tuple[bytes, list[int]]]:
        """Paths and nodes of the splitters on both sides of a shard (the root alone, at the ends)."""
        sides = [i for i in (shard - 1, shard) if 0 <= i < len(self.splitters)]
        return [(self.splitters[i][0], self.nodes[i]) for i in sides] or [(b"", [0])]


def common_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """The number of first turns that two paths share; ``known`` of them are known to be."""
    most = min(len(a), len(b)) // KEY
    while known < most and a[known * KEY:(known + 1) * KEY] == b[known * KEY:(known + 1) * KEY]:
        known += 1
    return known


class Open:
    """A node whose members are being read."""

    __slots__ = ("node", "words", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "hash", "ends", "held", "blocks")

    def __init__(self, node: int, words: int) -> None:
        self.node, self.words = node, words
        self.conv_id, self.n_convs, self.n_children, self.n_leaves, self.saved = None, 0, 0, 0, 0
        self.hash, self.ends, self.held, self.blocks = None, [], 0, 0

    def meets(self, conv_id: int, n: int) -> None:
        self.n_convs += n
        if self.conv_id is None or conv_id < self.conv_id:
            self.conv_id = conv_id


class Shard:
    """One reading of a shard in order of (path, conv_id); rows for ``_PIECES`` gather in ``out``."""

    def __init__(self, number: int, skeleton: Skeleton, out: list[tuple]) -> None:
        self.number, self.out, self.seq = number, out, 0
        self.sides = skeleton.bounds(number)
        self.path, self.stack = b"", [Open(0, 0)]

    def add(self, path: bytes, conv_id: int, words: list[int]) -> None:
        if path != self.path:
            shared = common_turns(path, self.path)
            self.close(shared)
            side = [(common_turns(path, other), nodes) for other, nodes in self.sides]
            for depth in range(shared + 1, len(path) // KEY + 1):
                node = next((nodes[depth] for reach, nodes in side if depth <= reach), -1)
                self.stack.append(Open(node, words[depth - 1]))
            self.path = path
        top = self.stack[-1]
        top.meets(conv_id, 1)
        if top.node < 0:
            if top.hash is None:
                top.hash = hashlib.sha256(str(conv_id).encode())
            else:
                top.hash.update(b",%d" % conv_id)
        else:
            text = str(conv_id)
            top.ends.append(text)
            top.held += len(text) + 1
            if top.held >= BLOCK:
                self.flush(top)

    def flush(self, top: Open) -> None:
        if top.ends:
            self.out.append((ENDS, self.number, top.blocks, top.node, *[None] * 7, ",".join(top.ends)))
            top.ends, top.held, top.blocks = [], 0, top.blocks + 1

    def close(self, depth: int) -> None:
        """Finish the open nodes deeper than ``depth``."""
        while len(self.stack) > depth + 1:
            done, up = self.stack.pop(), self.stack[-1]
            up.meets(done.conv_id, done.n_convs)
            if done.node >= 0:
                self.partial(done)
                continue
            done.saved += (done.n_convs - 1) * done.words
            done.n_leaves = done.n_leaves or 1
            up.n_children += 1
            up.n_leaves += done.n_leaves
            up.saved += done.saved
            ends = (done.hash or hashlib.sha256()).hexdigest()
            self.out.append((LOCAL, self.number, self.seq, up.node if up.node >= 0 else None, done.conv_id, len(self.stack),
                             done.n_convs, done.n_children, done.n_leaves, done.saved, None, ends))
            self.seq += 1

    def partial(self, done: Open) -> None:
        self.flush(done)
        self.out.append((PARTIAL, self.number, None, done.node, done.conv_id, None, done.n_convs, done.n_children,
                         done.n_leaves, done.saved, done.words, None))

    def finish(self) -> None:
        self.close(0)
        self.partial(self.stack[0])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _choose(sample: list[tuple[bytes, int]], shards: int) -> list[tuple[bytes, int]]:
    """Every so many-th key of the sorted sample, distinct."""
    sample = sorted(sample)
    return sorted({sample[len(sample) * i // shards] for i in range(1, shards)}) if sample else []


def trie(convs: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of ``convs`` (conv_id unique, turns): the columns ``NODES``."""
    spark = convs.sparkSession
    small_batches(spark)
    paths = written(convs.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "")).alias("path"),
        F.transform("turns", lambda t: t["words"].cast("int")).alias("words"),
    ), "paths")
    rows, turns = paths.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    if not rows:
        return spark.createDataFrame([], NODES)
    if shards is None:
        shards = min(SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS)))
    share = 1 << 30
    drawn = paths.where(F.size("words") <= SPLITTER_TURNS).where(
        F.pmod(F.xxhash64("conv_id"), F.lit(share)) < F.lit(min(share, PER_SHARD * shards * share // rows + 1)))
    # About PER_SHARD keys a shard, of bounded length.
    skeleton = Skeleton.of(_choose([(bytes(r.path), r.conv_id) for r in drawn.select("path", "conv_id").collect()], shards))
    shared = spark.sparkContext.broadcast(skeleton)
    pieces = written(_sharded(paths, shared, shards).mapInArrow(_reader(shared), _PIECES), "pieces")

    finished = _skeleton_rows(pieces, skeleton)
    first = np.zeros(len(skeleton.parent), dtype=np.int64)
    first[finished["node"].to_numpy()] = finished["conv_id"].to_numpy()
    local = pieces.where(F.col("kind") == LOCAL).repartitionById(shards, F.col("shard"))
    local = local.sortWithinPartitions("shard", F.desc("seq")).mapInArrow(_parents(spark.sparkContext.broadcast(first)), NODES)
    top = finished.assign(parent_conv_id=[
        None if p < 0 else int(first[p]) for p in skeleton.parent[finished["node"].to_numpy()]])
    names = [f.name for f in StructType.fromDDL(NODES)]
    top_rows = [tuple(None if v is None or v != v else v if isinstance(v, str) else int(v) for v in r)
                for r in top[names].astype(object).itertuples(index=False)]
    return spark.createDataFrame(top_rows, NODES).unionByName(local)


def _sharded(paths: DataFrame, shared, shards: int) -> DataFrame:
    """Rows in the task of their shard, in order."""
    types = "conv_id long, path binary, words array<int>, shard int"

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skeleton = shared.value
        for batch in batches:
            found = [skeleton.shard(p, c) for p, c in zip(batch["path"].to_pylist(), batch["conv_id"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*batch.schema.names, "shard"])

    cut = paths.select("conv_id", "path", "words").mapInArrow(numbered, types)
    return cut.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")


def _reader(shared):
    schema = to_arrow_schema(StructType.fromDDL(_PIECES))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        shard = None
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("shard", "path", "conv_id", "words"))
            for number, path, conv_id, words in zip(*columns):
                if shard is None or shard.number != number:
                    if shard is not None:
                        shard.finish()
                    shard = Shard(number, shared.value, out)
                shard.add(path, conv_id, words)
                if len(out) >= OUT_ROWS:
                    yield _batch(out, schema)
                    out.clear()
        if shard is not None:
            shard.finish()
            yield _batch(out, schema)

    return read


def _skeleton_rows(pieces: DataFrame, skeleton: Skeleton) -> pd.DataFrame:
    """The nodes of the skeleton, by reduction of the shards' partial sums; at most as many rows as it has nodes."""
    sums = pieces.where(F.col("kind") == PARTIAL).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("words").alias("words"),
    ).toPandas().sort_values("node").reset_index(drop=True)
    blocks = pieces.where(F.col("kind") == ENDS).select("node", "shard", "seq", "ends")
    ends = blocks.repartition("node").sortWithinPartitions("node", "shard", "seq").mapInArrow(_hashed, "node long, ends_sha256 string")
    sums = sums.merge(ends.toPandas(), on="node", how="left")
    sums["ends_sha256"] = sums["ends_sha256"].fillna(hashlib.sha256().hexdigest())

    nodes = sums["node"].to_numpy()
    parent = skeleton.parent[nodes]
    place = np.full(len(skeleton.parent), -1)
    place[nodes] = np.arange(len(nodes))
    children, leaves, saved = (sums[c].to_numpy().astype(np.int64).copy() for c in ("n_children", "n_leaves", "saved_tokens"))
    np.add.at(children, place[parent[parent >= 0]], 1)
    leaves[children == 0] = 1
    saved += (sums["n_convs"].to_numpy() - 1) * sums["words"].to_numpy()
    depth = skeleton.depth[nodes]
    for level in range(int(depth.max()), 0, -1):
        own = np.flatnonzero(depth == level)
        np.add.at(leaves, place[parent[own]], leaves[own])
        np.add.at(saved, place[parent[own]], saved[own])
    return sums.assign(depth=depth, n_children=children, n_leaves=leaves, saved_tokens=saved)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's blocks of ends, which come in order."""
    node, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([node], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["node", "ends_sha256"])

    for batch in batches:
        for at, ends in zip(batch["node"].to_pylist(), batch["ends"].to_pylist()):
            if at == node:
                digest.update(b"," + ends.encode())
            else:
                if node is not None:
                    yield row()
                node, digest = at, hashlib.sha256(ends.encode())
    if node is not None:
        yield row()


def _parents(first):
    """Finished nodes, deepest last: the parent of a node is the last one read a level above, or a skeleton node."""
    schema = to_arrow_schema(StructType.fromDDL(NODES))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_nodes: list[int] = []
        for batch in batches:
            parents = []
            for node, conv_id, depth in zip(*(batch[c].to_pylist() for c in ("node", "conv_id", "depth"))):
                if len(open_nodes) <= depth:
                    open_nodes += [0] * (depth + 1 - len(open_nodes))
                parents.append(open_nodes[depth - 1] if node is None else int(first.value[node]))
                open_nodes[depth] = conv_id
            named = {"parent_conv_id": pa.array(parents, pa.int64()), "ends_sha256": batch["ends"]}
            yield pa.RecordBatch.from_arrays(
                [named[f.name] if f.name in named else batch[f.name] for f in schema], schema=schema)

    return read
