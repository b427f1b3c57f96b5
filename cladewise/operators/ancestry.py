"""Ancestry over forests of any depth, by pointer doubling.

Every doubling loop below runs about log2(depth) rounds of equi-joins; each round is
written to the shared folder, so a comb of thousands of levels costs a dozen
rounds and a balanced tree of billions of cells about six.  Nothing ever lists
all (ancestor, descendant) pairs except where that is the answer asked for.

Large forests are peeled first: their tips leave round by round while a round takes
at least a quarter of the nodes, so that all rounds together move a few times the
nodes, and only the core that is left is doubled.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.functions.asof import bracket
from cladewise.functions.ranking import number_rows, running_total
from cladewise.functions.sampling import explode_range
from cladewise.session import discard, shuffled, written  # noqa: F401  callers take ``written`` from here too

#: Forests with more nodes are peeled down to at most as many; more wanted rows than ``FEW`` are not broadcast.
PEEL, FEW = 200_000, 250_000
#: Forests with at most ``WHOLE`` nodes are indexed whole; of larger ones only the ways of at most ``WANTED`` nodes.
WHOLE, WANTED = 200_000, 1_000_000


class LineageCycle(ValueError):
    """The parent links never reach a root."""


def _to_ancestor(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join of ``near.up`` to ``far.node``, which is unique.

    In late rounds most nodes point near a root, so a few keys hold most rows of
    the left side; adaptive execution splits such partitions.
    """
    return left.alias("near").join(right.alias("far"), F.col("near.up") == F.col("far.node"), "left")


def few(rows: DataFrame) -> DataFrame:
    """A written table of narrow rows, broadcast while it is known to be small."""
    return F.broadcast(rows) if rows.count() <= FEW else rows.hint("merge")


def _peel(state: DataFrame, rows: int, sums: list[str], carry: list[str], label: str) -> tuple[DataFrame, list[DataFrame]] | None:
    """Core of a forest and the layers of tips taken off before, outermost first.

    ``state`` is a written table ``node, up`` with the columns ``sums``, which tips
    hand to their parents as they leave, and ``carry``.  None for small forests and
    for those with a repeated node or a parent that is not in the table.
    """
    if rows <= PEEL:
        return None
    names = [*sums, *carry]
    merged = [F.max("up").alias("up"), *[F.sum(n).cast(state.schema[n].dataType).alias(n) for n in sums],
              *[F.first(n, True).alias(n) for n in carry], F.sum("_children").alias("_children")]

    def handed(tips: DataFrame, children: int, given: list[str]) -> DataFrame:
        return tips.where("up is not null").select(F.col("up").alias("node"), *given, F.lit(children).cast("long").alias("_children"))

    own = state.select("node", "up", *names, F.lit(0).cast("long").alias("_children"), F.lit(1).alias("_rows"))
    left = shuffled(own.unionByName(handed(state, 1, []), True).groupBy("node").agg(*merged, F.sum("_rows").alias("_rows")), label)
    if not left.where("_rows is null or _rows > 1").isEmpty():
        discard(left)
        return None
    left, layers = left.drop("_rows"), []
    while rows > PEEL:
        gone = left.where("_children = 0").count()
        if 4 * gone < rows:
            break
        tips = left.where("_children = 0").drop("_children")
        rest = left.where("_children > 0").unionByName(handed(tips, -1, sums), True)
        layers.append(tips)
        left, rows = shuffled(rest.groupBy("node").agg(*merged), label), rows - gone
    return left.drop("_children"), layers


def layers_with_sums(inner: DataFrame, leaves: DataFrame, sums: list[str], label: str) -> tuple[DataFrame, list[DataFrame]] | None:
    """Inner nodes of a large forest by the round in which they leave, with sums over all nodes below them.

    ``inner`` has ``node, up``, the columns ``sums`` (own values) and anything else, which is carried along;
    ``leaves`` has the parents of the leaves as ``node`` and the leaves' ``sums``.  The layers' rows are done and
    have ``children``, the number of links to the node; the core (first result) holds sums of what was peeled
    below it.  None for small forests, a repeated or null node, or a parent that is not in ``inner``.
    """
    rows = inner.count()
    if rows <= PEEL:
        return None
    kept = [c for c in inner.columns if c not in ("node", "up", *sums)]
    kinds = {n: inner.schema[n].dataType for n in sums}
    zero = {n: F.lit(0).cast(kinds[n]) for n in sums}

    def one(name: str) -> Column:
        return F.lit(1).cast("long").alias(name)

    linked = inner.where("up is not null").select(F.col("up").alias("node"), one("children"), one("_open"))
    under = leaves.select("node", *sums, one("children"))
    per = linked.unionByName(under, True).groupBy("node").agg(
        F.sum("children").alias("children"), F.sum("_open").alias("_open"), *[F.sum(n).cast(kinds[n]).alias(f"_{n}") for n in sums])

    def added(name: str) -> Column:
        return (F.coalesce(name, zero[name]) + F.coalesce(f"_{name}", zero[name])).cast(kinds[name]).alias(name)

    # the window finds the rows where the join put them
    full = shuffled(inner.join(per, "node", "left").select(
        "node", "up", *kept, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("children", "_open")],
        F.count(F.lit(1)).over(Window.partitionBy("node")).alias("_rows"), *[added(n) for n in sums]), label)
    links = linked.count() + under.count()
    if (not full.where("node is null or _rows > 1").isEmpty()) or full.agg(F.sum("children")).first()[0] != links:
        discard(full)
        return None
    left, layers = full.drop("_rows"), []
    while rows > PEEL:
        tips = left.where("_open = 0")
        gone = tips.count()
        if 4 * gone < rows:
            break
        given = tips.where("up is not null").groupBy(F.col("up").alias("node")).agg(
            F.count(F.lit(1)).alias("_gone"), *[F.sum(n).cast(kinds[n]).alias(f"_{n}") for n in sums])
        rest = left.where("_open > 0").join(given, "node", "left").select(
            "node", "up", *kept, "children", (F.col("_open") - F.coalesce("_gone", F.lit(0))).alias("_open"), *[added(n) for n in sums])
        layers.append(tips.drop("_open"))
        left, rows = shuffled(rest, label), rows - gone
    return left.drop("_open"), layers


def down_the_layers(core: DataFrame, layers: list[DataFrame], payload: list[str], combine: Callable[[str], Column],
                    label: str) -> list[DataFrame]:
    """Fold payload columns from the roots down layers of ``layers_with_sums``: written tables, the core's first.

    All have ``node, up``; other columns stay.  ``combine`` is that of ``_doubling``; a node joins its parent once.
    """
    folded = _doubling(core.select("node", "up", *payload), payload, combine, label, True).select("node", *payload)
    done = [shuffled(core.drop(*payload).join(folded, "node"), label)]
    for rows in reversed(layers):
        over = reduce(DataFrame.unionByName, [d.select("node", *payload) for d in done]).hint("merge")
        other = [c for c in rows.columns if c not in payload]
        below = _to_ancestor(rows, over).select(
            *[F.col(f"near.{c}") for c in other],
            *[F.when(F.col("near.up").isNull(), F.col(f"near.{n}")).otherwise(combine(n)).alias(n) for n in payload])
        done.append(shuffled(below, label))
    return done


def _doubling(links: DataFrame, payload: list[str], combine: Callable[[str], Column], label: str, strict: bool) -> DataFrame:
    """Follow ``up`` to the root for every node, folding payload columns on the way.

    ``links`` holds ``node, up`` and the payload; in round k ``up`` is the
    2^k-th ancestor.  ``combine(name)`` folds ``near.name`` with ``far.name``.
    A parent that is not a node is an error, or (not ``strict``) the root.
    """
    absent = F.col("near.up")
    if strict:
        absent = F.raise_error(F.concat(F.lit("the parent "), F.col("near.up").cast("string"), F.lit(" is not in the table")))
    state = shuffled(links.withColumn("root", F.when(F.col("up").isNull(), F.col("node"))), label)
    rows = state.count()
    peeled = _peel(state, rows, [], ["root", *payload], label)
    if peeled:
        core, layers = peeled
        done = [_doubling_whole(core, core.count(), payload, combine, label, absent)]
        for tips in reversed(layers):
            below = _to_ancestor(tips, reduce(DataFrame.unionByName, done)).select(
                F.col("near.node"), F.coalesce("near.root", "far.root").alias("root"),
                *[F.when(F.col("near.up").isNull(), F.col(f"near.{name}")).otherwise(combine(name)).alias(name) for name in payload])
            done.append(shuffled(below.select("node", *payload, "root"), label))
        discard(state)
        return reduce(DataFrame.unionByName, done).hint("merge")
    return _doubling_whole(state, rows, payload, combine, label, absent)


def _doubling_whole(state: DataFrame, rows: int, payload: list[str], combine: Callable[[str], Column], label: str,
                    absent: Column) -> DataFrame:
    """The doubling rounds on a written table ``node, up, root`` and payload."""
    for _ in range(math.ceil(math.log2(max(rows, 1) + 1)) + 2):
        active = state.where(F.col("up").isNotNull())
        if active.isEmpty():
            return state.select("node", *payload, "root")
        moved = _to_ancestor(active, state).select(
            F.col("near.node"), F.col("far.up"),
            F.when(F.col("far.node").isNull(), absent).otherwise(F.col("far.root")).alias("root"),
            *[combine(name).alias(name) for name in payload],
        )
        before, state = state, shuffled(state.where(F.col("up").isNull()).unionByName(moved), label)
        discard(before)
    raise LineageCycle("parent links form a cycle")


def cycle_members(nodes: DataFrame, node: str = "node_id", parent: str = "parent_node_id") -> DataFrame:
    """Nodes that lie on a cycle of parent links: ``cycle`` (its smallest node) and ``node``.

    Doubling drops every node whose way reaches a root, or a parent that is not in the table.  What is left
    runs in a cycle or towards one; after more steps than there are nodes left, all ways end on cycles and
    hit each of their nodes.  The least node passed on the way then names the cycle.  Nodes that only lead
    to a cycle are not members.  A repeated node follows its smallest parent.
    """
    links = nodes.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("up"))
    state = shuffled(links.where(F.col("up").isNotNull()).withColumn("least", F.col("node")), "cycles")
    steps, left = 1, state.count()
    while left and steps < 2 * left:
        moved = state.alias("near").join(state.alias("far"), F.col("near.up") == F.col("far.node")).select(
            "near.node", "far.up", F.least("near.least", "far.least").alias("least"))
        before, state = state, shuffled(moved, "cycles")
        discard(before)
        steps, left = 2 * steps, state.count()
    ends = state.select(F.col("up").alias("node")).distinct()
    return state.join(ends, "node", "left_semi").select(F.col("least").alias("cycle"), F.col("node").alias(node))


def numbered(nodes: DataFrame, node: str, parent: str, keep: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Nodes with whole-number ids ``node_no, parent_no`` next to their names.

    Long runs of joins on text ids cost more than one pass that replaces them.
    The numbers are written down with the names, so they never change.  A parent
    that is not in the table is an error, or (not ``strict``) leaves its children
    as roots; ``lineage.node_violations`` lists such nodes.
    """
    keep = keep or []
    if node == "node_no":
        return nodes.select(node, parent, *keep)
    if nodes.schema[node].dataType.typeName() == "long":
        return nodes.select(node, parent, *keep, F.col(node).alias("node_no"), F.col(parent).alias("parent_no"))
    base = shuffled(nodes.select(node, parent, *keep).withColumn("node_no", F.monotonically_increasing_id()), "ids")
    parents = base.select(F.col(node).alias(parent), F.col("node_no").alias("parent_no"))
    joined = base.join(parents, parent, "left")
    if strict:
        lost = F.col(parent).isNotNull() & F.col("parent_no").isNull()
        joined = joined.withColumn("parent_no", F.when(lost, F.raise_error(F.concat(
            F.lit("the parent "), F.col(parent).cast("string"), F.lit(" is not in the table")))).otherwise(F.col("parent_no")))
    return shuffled(joined, "numbered")


def root_paths(nodes: DataFrame, node: str = "node_id", parent: str = "parent_node_id",
               sums: dict[str, str] | None = None, strict: bool = True) -> DataFrame:
    """Per node its root, depth in edges and sums of columns over the way to the root.

    ``sums`` maps output names to value columns; a node's own value counts.
    A parent that is not in the table is an error, or (not ``strict``) the root.
    """
    sums = sums or {}
    links = nodes.select(
        F.col(node).alias("node"), F.col(parent).alias("up"),
        F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("depth"),
        *[F.col(column).alias(name) for name, column in sums.items()],
    )
    done = _doubling(links, ["depth", *sums],
                     lambda n: F.col(f"near.{n}") + F.coalesce(F.col(f"far.{n}"), F.lit(0)), "paths", strict)
    return done.withColumnRenamed("node", node)


def lift_table(nodes: DataFrame, node: str = "node_id", parent: str = "parent_node_id") -> DataFrame:
    """Binary-lifting table ``node, level, ancestor``: the 2^level-th ancestor (L4)."""
    level = shuffled(nodes.where(F.col(parent).isNotNull()).select(
        F.col(node).alias("node"), F.col(parent).alias("ancestor")), "lift")
    levels, limit = [], math.ceil(math.log2(max(level.count(), 1) + 1)) + 2
    for step in range(limit):
        levels.append(level.select("node", F.lit(step).alias("level"), "ancestor"))
        level = shuffled(level.alias("a").join(level.alias("b"), F.col("a.ancestor") == F.col("b.node")).select(
            F.col("a.node"), F.col("b.ancestor")), "lift")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)
    raise LineageCycle("parent links form a cycle")


def subtree_sums(nodes: DataFrame, values: dict[str, Column], node: str = "node_id",
                 parent: str = "parent_node_id") -> DataFrame:
    """Sum of each value over a node and all its descendants.

    In round k a node holds the sum over descendants nearer than 2^k and hands
    it to its 2^k-th ancestor.  Only sums are shuffled, so a root with a billion
    descendants is as cheap as any other node.
    """
    names = list(values)
    state = shuffled(nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"),
                                 *[v.alias(n) for n, v in values.items()]), "subtree")
    rows = state.count()
    peeled = _peel(state, rows, names, [], "subtree")
    done = []
    if peeled:
        discard(state)
        state, layers = peeled
        rows, done = state.count(), [tips.drop("up") for tips in layers]
    for _ in range(math.ceil(math.log2(max(rows, 1) + 1)) + 2):
        active = state.where(F.col("up").isNotNull())
        if active.isEmpty():
            return reduce(DataFrame.unionByName, [state.drop("up"), *done]).withColumnRenamed("node", node).hint("merge")
        handed = active.groupBy(F.col("up").alias("node")).agg(*[F.sum(n).alias(f"_{n}") for n in names])
        moved = _to_ancestor(state, state.select("node", "up")).select(
            F.col("near.node").alias("node"), F.col("far.up").alias("up"), *[F.col(f"near.{n}").alias(n) for n in names])
        before, state = state, shuffled(
            moved.join(handed, "node", "left").select(
                "node", "up",
                *[(F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0))).cast(state.schema[n].dataType).alias(n)
                  for n in names],
            ), "subtree")
        discard(before)
    raise LineageCycle("parent links form a cycle")


def chain_index(nodes: DataFrame, node: str = "node_id", parent: str = "parent_node_id",
                time: str | None = None, paths: bool = True) -> DataFrame:
    """Ancestry index: every node with the heavy chains its root path runs through.

    A chain follows the child with the most descendants, so a root path meets at
    most log2(nodes) chains however deep the tree is.  Per node the table holds
    its chain, its place in the chain, its depth, the number of its root, and
    ``path``: for each chain from the root downwards, the place where the path
    leaves it.  Two
    nodes' most recent common ancestor then follows from their two rows alone.

    Paths take log2(nodes) entries a node.  Without ``paths`` the table holds
    ``exit`` instead, on the first node of a chain: the chain and place that it
    hangs from; paths are then put together for wanted nodes only.
    """
    ids = numbered(nodes, node, parent, [time] if time else [])
    sizes = subtree_sums(ids, {"_size": F.lit(1).cast("long")}, "node_no", "parent_no").withColumnRenamed("node_no", "node")
    base = ids.select(F.col("node_no").alias("node"), F.col("parent_no").alias("parent")).join(sizes, "node")
    heavy = base.where(F.col("parent").isNotNull()).groupBy("parent").agg(
        F.max_by("node", F.struct("_size", "node")).alias("node")).select("node", F.lit(True).alias("_heavy"))
    placed = shuffled(base.join(heavy, "node", "left").select(
        "node", "parent", F.when(F.col("_heavy"), F.col("parent")).alias("_along")), "chains")
    places = root_paths(placed, "node", "_along").select(
        "node", F.col("root").alias("chain"), F.col("depth").alias("place"))

    heads = placed.where(F.col("_along").isNull()).select(F.col("node").alias("chain"), F.col("parent").alias("exit"))
    exits = places.select(F.col("node").alias("exit"), F.col("chain").alias("up"), F.col("place").alias("_at"))
    hops = heads.join(exits, "exit", "left")
    names = ids.select(*dict.fromkeys([node, "node_no"]), *([F.col(time).alias("time")] if time else []))
    if paths:
        ways = _ways(hops).select(F.col("node").alias("chain"), F.col("root").alias("root_no"), "path")
        full = places.join(ways, "chain").select(
            F.col("node").alias("node_no"), F.col("root_no").alias("root"), "chain", "place",
            F.concat("path", F.array(F.struct("chain", "place"))).alias("path"))
        depth = F.aggregate("path", F.lit(-1).cast("long"), lambda total, hop: total + hop["place"] + 1)
        named = full.withColumn("depth", depth).join(names, "node_no")
    else:
        hops = shuffled(hops, "hops")
        above = _doubling(hops.select(F.col("chain").alias("node"), "up", F.coalesce(F.col("_at") + 1, F.lit(0)).alias("_above")), ["_above"],
                          lambda n: F.col(f"near.{n}") + F.coalesce(F.col(f"far.{n}"), F.lit(0)), "ways", True)
        chains = hops.select("chain", F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("chain"), F.col("_at").alias("place"))).alias("_exit")).join(
            above.select(F.col("node").alias("chain"), "root", "_above"), "chain")
        named = places.join(chains, "chain").select(
            F.col("node").alias("node_no"), "root", "chain", "place", F.when(F.col("place") == 0, F.col("_exit")).alias("exit"),
            (F.col("_above") + F.col("place")).alias("depth")).join(names, "node_no")
    return shuffled(named if node == "node_no" else named.drop("node_no"), "index")


def _ways(hops: DataFrame) -> DataFrame:
    """Per chain (``node``) the places at which its way from the root leaves chains, and its ``root`` chain.

    ``hops`` has ``chain``, ``up`` (the chain it hangs from, null for roots) and ``_at`` (the place there).
    """
    links = hops.select(
        F.col("chain").alias("node"), "up",
        F.when(F.col("up").isNull(), F.array().cast("array<struct<chain:bigint,place:bigint>>")).otherwise(
            F.array(F.struct(F.col("up").alias("chain"), F.col("_at").alias("place")))).alias("path"))
    return _doubling(links, ["path"], lambda n: F.when(F.col(f"far.{n}").isNull(), F.col(f"near.{n}")).otherwise(
        F.concat(F.col(f"far.{n}"), F.col(f"near.{n}"))), "ways", True)


def above(nodes: DataFrame, wanted: DataFrame, node: str = "node_id", parent: str = "parent_node_id") -> DataFrame:
    """The part of a forest that lies on the ways from wanted nodes to their roots.

    For few wanted nodes in a large forest: each round reads the nodes against a broadcast list of at most
    ``WANTED`` ids, and moves only the rows on the ways, at most the wanted nodes times their depth.  Relations
    of wanted nodes are the same in the part as in the whole.  Small forests, many wanted nodes (also a quarter of
    the forest) and ways of more than 8 log2(nodes) steps leave the forest whole.  ``nodes`` should be a written table.
    """
    rows = nodes.count()
    if rows <= WHOLE:
        return nodes
    front = written(wanted.select(node).where(F.col(node).isNotNull()).distinct(), "front")
    left, ways, passed = front.count(), [], [front]
    if left > WANTED or 4 * left > rows:
        return nodes
    for _ in range(8 * math.ceil(math.log2(rows))):
        if not left:
            return reduce(DataFrame.unionByName, ways).hint("merge") if ways else nodes.limit(0)
        # small files: one for about 100,000 rows
        ways.append(written(nodes.join(F.broadcast(front), node, "left_semi").coalesce(1 + left // 100_000), "ways"))
        up = ways[-1].where(F.col(parent).isNotNull()).select(F.col(parent).alias(node)).distinct()
        for seen in passed:
            up = up.join(seen, node, "left_anti")
        front = written(up.coalesce(1 + left // 100_000), "front")
        passed, left = _merged([*passed, front], node), front.count()
    return nodes


def _merged(tables: list[DataFrame], node: str) -> list[DataFrame]:
    """Lists of passed nodes, put together once there are eight, so that plans stay short."""
    return tables if len(tables) < 8 else [written(reduce(DataFrame.unionByName, tables), "passed")]


def _heads(index: DataFrame) -> DataFrame:
    return index.where("place = 0").select("chain", F.col("exit.chain").alias("up"), F.col("exit.place").alias("_at"))


def _with_paths(picked: DataFrame, index: DataFrame) -> DataFrame:
    """Written rows of an index without paths, with theirs.

    Few rows climb from chain to chain, at most log2(nodes) times; for many the ways of all chains are built.
    """
    chains = written(picked.select("chain").distinct(), "chains")
    if chains.count() > FEW:
        hops = _heads(index)
    else:
        heads, seen = written(_heads(index), "heads"), []
        while not chains.isEmpty():
            seen.append(written(heads.join(F.broadcast(chains), "chain"), "hops"))
            chains = written(seen[-1].where("up is not null").select(F.col("up").alias("chain")).distinct(), "chains")
        if not seen:
            return picked.withColumn("path", F.array(F.struct("chain", "place")))
        hops = reduce(DataFrame.unionByName, seen).distinct()
    ways = _ways(hops).select(F.col("node").alias("chain"), F.col("path").alias("_way"))
    return shuffled(picked.join(ways, "chain").withColumn("path", F.concat("_way", F.array(F.struct("chain", "place")))).drop("_way"), "paths")


def common_ancestor(pairs: DataFrame, index: DataFrame, a: str, b: str, node: str = "node_id",
                    carry: list[str] | None = None) -> DataFrame:
    """Most recent common ancestor of many pairs (core of L5).

    Adds ``same_founder``, ``mrca`` (null across founders), ``mrca_depth``,
    ``depth_a``/``depth_b`` and, for every name in ``carry``, ``<name>_a``,
    ``<name>_b`` and ``mrca_<name>`` taken from the index.
    """
    carry = carry or []
    known = index
    if "path" not in index.columns:
        pairs = shuffled(pairs, "pairs")
        ends = pairs.select(F.col(a).alias(node)).unionByName(pairs.select(F.col(b).alias(node)))
        known = on_the_way(index, ends, node, carry)

    def side(tag: str, key: str) -> DataFrame:
        return known.select(
            F.col(node).alias(key), F.col("root").alias(f"_root_{tag}"), F.col("path").alias(f"_path_{tag}"),
            F.col("depth").alias(f"depth_{tag}"), *[F.col(c).alias(f"{c}_{tag}") for c in carry])

    both = pairs.join(side("a", a), a).join(side("b", b), b)
    both = both.withColumn("_meet", meeting_place("_path_a", "_path_b")).drop("_path_a", "_path_b")
    both = both.select("*", (F.col("_root_a") == F.col("_root_b")).alias("same_founder")).drop("_root_a", "_root_b")
    return _met(both, index, {node: "mrca", "depth": "mrca_depth", **{c: f"mrca_{c}" for c in carry}}, known is not index)


def on_the_way(index: DataFrame, wanted: DataFrame, node: str = "node_id", carry: list[str] | None = None) -> DataFrame:
    """Rows of wanted nodes in an index without paths, with their ``path``."""
    ends = written(wanted.select(node).distinct(), "ends")
    picked = index.select(*dict.fromkeys([node, "root", "chain", "place", "depth", *(carry or [])])).join(few(ends), node)
    return _with_paths(shuffled(picked, "picked"), index)


def meeting_place(a: str, b: str) -> Column:
    """Chain and place at which two paths part, null across roots."""
    meets = F.filter(
        F.zip_with(a, b, lambda x, y: F.when(
            x["chain"] == y["chain"],
            F.struct(x["chain"].alias("chain"), F.least(x["place"], y["place"]).alias("place")))),
        lambda hop: hop.isNotNull())
    # chains shared from the root on form a prefix; its last entry is the meeting point
    return F.try_element_at(meets, F.lit(-1))


def _met(rows: DataFrame, index: DataFrame, names: dict[str, str], small: bool) -> DataFrame:
    """Rows with columns of the node at their ``_meet`` by new names; ``small`` looks up the places that occur alone."""
    both, spots_of = rows.select("*", F.col("_meet.chain").alias("_chain"), F.col("_meet.place").alias("_place")).drop("_meet"), index
    if small:
        both = shuffled(both, "met")
        spots_of = index.join(few(written(both.select(F.col("_chain").alias("chain"), F.col("_place").alias("place")).where(
            "chain is not null").distinct(), "spots")), ["chain", "place"])
    spots = spots_of.select(
        F.col("chain").alias("_chain"), F.col("place").alias("_place"), *[F.col(c).alias(n) for c, n in names.items()])
    return both.join(spots, ["_chain", "_place"], "left").drop("_chain", "_place")


def depth_first(tips: DataFrame, keys: list[str], order: str, index: DataFrame, far: str, node: str = "node_id") -> DataFrame:
    """Nodes of a tree a group in depth-first order, and where each meets the next one.

    Adds ``dfs`` (places from 0; a node stands ahead of its descendants), ``far`` of the node and, of its common
    ancestor with the next node, ``gap_depth`` and ``gap_far``: null for the last node and across roots.  Two nodes
    meet in the highest node of the gaps between them.  Nodes may repeat; ``order`` (which may be equal for
    rows that differ in nothing) breaks ties.  ``index`` is without paths and has ``far``.
    """
    known = on_the_way(index, tips, node, [far]).select(node, "path", F.col(far).alias("far"))
    placed = number_rows(tips.join(known, node), keys, ["path", order], "_no").withColumn("dfs", F.col("_no") - 1).drop("_no")
    placed = shuffled(placed, "depth_first")
    following = placed.select(*keys, (F.col("dfs") - 1).alias("dfs"), F.col("path").alias("_next"))
    both = placed.join(following, [*keys, "dfs"], "left").withColumn("_meet", meeting_place("path", "_next")).drop("path", "_next")
    return shuffled(_met(both, index, {"depth": "gap_depth", far: "gap_far"}, True), "gaps")


def pair_relations(pairs: DataFrame, index: DataFrame, a: str = "node_a", b: str = "node_b",
                   founder_time: float = 0.0, node: str = "node_id") -> DataFrame:
    """MRCA, its time, age, patristic and division distance of node pairs.

    The MRCA time is the *end* of the MRCA segment.  Pairs from different
    founders meet at the earliest founder birth; their MRCA and division
    distance stay null.  The index must carry ``time`` = segment end.
    """
    found = common_ancestor(pairs, index, a, b, node, ["time"])
    when_met = F.when(F.col("same_founder"), F.col("mrca_time")).otherwise(F.lit(float(founder_time)))
    distance = F.col("time_a") + F.col("time_b") - 2 * when_met
    return found.select(
        *pairs.columns, F.col("mrca").alias("mrca_node_id"), "same_founder", when_met.alias("mrca_time"),
        (distance / 2).alias("mrca_age"), distance.alias("patristic_distance"),
        F.when(F.col("same_founder"), F.col("depth_a") + F.col("depth_b") - 2 * F.col("mrca_depth"))
        .alias("division_distance"),
    )


def ancestor_at(queries: DataFrame, index: DataFrame, at: str, time: str = "time", node: str = "node_id",
                name: str = "ancestor") -> DataFrame:
    """Ancestor at a time: the highest node on the way to ``node``, itself included, whose ``time`` is behind ``at``.

    ``index`` is a ``chain_index`` with ``time``, which never falls from a parent to its child.  Where a segment
    ends at its ``time`` this is the segment that was open at ``at``; null where the node itself ends before.
    A way leaves at most log2(nodes) chains, so the chain of the answer follows from the times at which it
    leaves them; inside the chain the place is the first time behind ``at``, an as-of lookup of distinct
    (chain, time) pairs.  One index answers any number of times.
    """
    if "path" in index.columns:
        ways = index.where("place = 0").select("chain", F.slice("path", F.lit(1), F.size("path") - 1).alias("path"))
    else:
        ways = _ways(_heads(index)).select(F.col("node").alias("chain"), "path")
    heads = ways.select("chain", F.posexplode("path").alias("_no", "_hop"))
    hops = heads.select("chain", "_no", F.col("_hop.chain").alias("_up"), F.col("_hop.place").alias("_place"))
    left = index.select(F.col("chain").alias("_up"), F.col("place").alias("_place"), F.col(time).alias("_left"))
    ways = shuffled(hops.join(left, ["_up", "_place"]).groupBy("chain").agg(
        F.sort_array(F.collect_list(F.struct("_no", "_left", "_up"))).alias("_ways")), "ways")  # at most log2(nodes) each
    own = index.select(F.col(node), F.col("chain").alias("_chain"), F.col(time).alias("_time"))
    asked = queries.join(own, node, "left").join(ways.withColumnRenamed("chain", "_chain"), "_chain", "left")
    asked = asked.withColumn("_at", F.col(at).cast("double"))
    passed = F.try_element_at(F.filter("_ways", lambda w: w["_left"] > F.col("_at")), F.lit(1))
    asked = shuffled(asked.withColumn("_on", F.coalesce(passed["_up"], F.when(F.col("_time") > F.col("_at"), F.col("_chain")))).drop(
        "_ways", "_chain", "_time"), "asked")
    # of several nodes at one time the highest counts
    places = index.select(F.col("chain").alias("_on"), F.col(time).cast("double").alias("_at"), (-F.col("place")).alias("_high"),
                          F.col(node).alias("_node"))
    spots = bracket(asked.where("_on is not null").select("_on", "_at").distinct(), places, ["_on"], "_at", None, "_found")
    found = asked.join(spots.select("_on", "_at", F.col("_found._node").alias(name)), ["_on", "_at"], "left")
    return found.drop("_on", "_at")


def ancestor_closure(nodes: DataFrame, wanted: DataFrame, node: str = "node_id",
                     parent: str = "parent_node_id") -> DataFrame:
    """All (node, ancestor, steps) rows of the wanted nodes, the node itself at 0 steps.

    The rows are the depths of the wanted nodes added up; queries that only need
    inheritance should use ``tip_intervals`` instead.
    """
    lifts = lift_table(nodes, node, parent)
    reach = nodes.join(wanted.select(node).distinct(), node, "left_semi").select(
        F.col(node).alias("node"), F.col(node).alias("ancestor"), F.lit(0).cast("long").alias("steps"))
    top = lifts.agg(F.max("level")).first()[0]
    for level in range((top if top is not None else -1) + 1):
        jump = lifts.where(F.col("level") == level).select(
            F.col("node").alias("ancestor"), F.col("ancestor").alias("_next"))
        moved = reach.join(jump, "ancestor").select(
            "node", F.col("_next").alias("ancestor"), (F.col("steps") + F.lit(2**level)).alias("steps"))
        reach = shuffled(reach.unionByName(moved), "closure")
    return reach.withColumnRenamed("node", node)


def tip_intervals(nodes: DataFrame, sampled: DataFrame, child_order: str, node: str = "node_id",
                  parent: str = "parent_node_id") -> DataFrame:
    """Per node: number of sampled descendants and their first place in depth-first order.

    A node's sampled descendants are exactly the places
    ``first_place .. first_place + tips - 1``.  Children follow ``child_order``
    (unique among siblings).  Places come from prefix sums over siblings added
    up along the root path, not from walking the tree.
    """
    marked = nodes.join(sampled.select(F.col(node)).distinct().withColumn("_tip", F.lit(1).cast("long")), node, "left")
    ids = numbered(marked.withColumn("_own", F.coalesce("_tip", F.lit(0)).cast("long")), node, parent, [child_order, "_own"])
    counts = shuffled(subtree_sums(ids, {"tips": F.col("_own")}, "node_no", "parent_no"), "tips")
    # a sampled inner node takes the first place of its own interval
    own = ids.select("node_no", "parent_no", child_order, "_own").join(counts, "node_no")
    siblings = shuffled(own.withColumn("_family", F.coalesce(F.col("parent_no"), F.lit(-1))), "siblings")
    ahead = running_total(siblings, ["_family"], [child_order], F.col("tips"), "_upto")
    parents = own.select(F.col("node_no").alias("parent_no"), F.col("_own").alias("_parent_own"))
    steps = ahead.join(parents, "parent_no", "left").withColumn(
        "_before", F.col("_upto") - F.col("tips") + F.coalesce(F.col("_parent_own"), F.lit(0)))
    placed = root_paths(steps, "node_no", "parent_no", {"first_place": "_before"})
    return counts.join(placed.select("node_no", "first_place"), "node_no").join(
        ids.select("node_no", node), "node_no").select(node, "tips", "first_place")


def event_cells(events: DataFrame, intervals: DataFrame, sampled: DataFrame, node: str = "node_id",
                cell: str = "cell_id") -> DataFrame:
    """Every event with each sampled cell that inherits it, as long COO rows.

    An event on a node is carried by exactly that node's sampled descendants:
    a run of places.  Long runs are cut in blocks before they are listed, so a
    founder event does not land on one task.
    """
    runs = events.join(intervals.where("tips > 0"), node)
    places = explode_range(runs, "tips", "_step")
    tips = sampled.select(node, cell).join(intervals.select(node, "first_place"), node).select(
        cell, F.col("first_place").alias("_place"))
    return places.withColumn("_place", F.col("first_place") + F.col("_step")).drop("_step", "tips", "first_place").join(
        tips, "_place").drop("_place")


def union_events(tables: dict[str, DataFrame], order: dict[str, list[str]], intervals: DataFrame,
                 node: str = "node_id") -> DataFrame:
    """One manifest of all modalities' events with ids and descendant counts."""
    parts = []
    for modality, events in tables.items():
        numbered = number_rows(events, [], order[modality], "modality_event_row")
        digits = F.greatest(F.lit(8), F.length(F.col("modality_event_row").cast("string")))
        parts.append(numbered.select(
            F.concat(F.lit(f"{modality}_event_"),
                     F.lpad(F.col("modality_event_row").cast("string"), digits, F.lit("0"))).alias("event_id"),
            F.lit(modality).alias("modality"), "modality_event_row", *events.columns))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.join(intervals.select(node, F.col("tips").alias("descendant_terminal_cells")), node, "left").withColumn(
        "descendant_terminal_cells", F.coalesce("descendant_terminal_cells", F.lit(0).cast("long")))


def terminal_genotypes(events: DataFrame, intervals: DataFrame, sampled: DataFrame, keys: list[str], value: str,
                       order: list[str], node: str = "node_id", cell: str = "cell_id") -> DataFrame:
    """State each sampled cell ends with: of the events at a place, the nearest above the cell wins.

    Of several events on one node the last in ``order`` counts.  ``intervals``
    has ``depth`` besides ``tips`` and ``first_place``.  The intervals of a
    place's events are nested, so opening and closing boundaries cut the cells
    into runs with one innermost event each; only those runs are listed, and the
    rows stay near the events and the results however deep events are nested.
    """
    last = events.groupBy(*keys, node).agg(F.max_by(value, F.struct(*order)).alias("_state"))
    held = last.join(intervals.where("tips > 0").select(node, "tips", "first_place", "depth"), node)
    # at one place closings come before openings, the deeper closing and the shallower opening first
    edges = held.select(*keys, F.inline(F.array(
        F.struct(F.col("first_place").alias("_at"), F.lit(1).alias("_turn"), F.col("depth").alias("_rank"), F.col("_state")),
        F.struct((F.col("first_place") + F.col("tips")).alias("_at"), F.lit(-1).alias("_turn"),
                 (-F.col("depth")).alias("_rank"), F.lit(None).cast(last.schema["_state"].dataType).alias("_state")))))
    along = ["_at", "_turn", "_rank"]
    leveled = running_total(edges, keys, along, F.col("_turn").cast("long"), "_level")
    placed = shuffled(running_total(leveled, keys, along, F.lit(1).cast("long"), "_no"), "boundaries")
    following = placed.select(*keys, (F.col("_no") - 1).alias("_no"), F.col("_at").alias("_until"))
    # after a closing, the event that opened the level last is the innermost again
    same_level = Window.partitionBy(*keys, "_level").orderBy("_no").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.last(F.when(F.col("_turn") == 1, F.struct(F.col("_state").alias("v"))), True).over(same_level)
    active = placed.where("_level > 0").withColumn("_active", opened).join(following, [*keys, "_no"])
    run = active.select(*keys, "_at", F.col("_active.v").alias(value), (F.col("_until") - F.col("_at")).alias("_cells"))
    listed = explode_range(run.where("_cells > 0"), "_cells", "_step")
    tips = sampled.select(node, cell).join(intervals.select(node, "first_place"), node).select(
        cell, F.col("first_place").alias("_place"))
    return listed.withColumn("_place", F.col("_at") + F.col("_step")).join(tips, "_place").select(cell, *keys, value)


def unknown_tips(wanted: DataFrame, nodes: DataFrame, node: str = "node_id") -> DataFrame:
    """Requested tips that the forest does not hold; any row is an error for the caller."""
    return wanted.select(node).distinct().join(nodes.select(node), node, "left_anti")


def prune(nodes: DataFrame, kept: DataFrame, node: str = "node_id", parent: str = "parent_node_id") -> DataFrame:
    """Forest restricted to kept tips and their ancestors."""
    flags = nodes.join(kept.select(node).distinct().withColumn("_kept", F.lit(1).cast("long")), node, "left")
    counts = subtree_sums(flags, {"_tips": F.coalesce(F.col("_kept"), F.lit(0)).cast("long")}, node, parent)
    return nodes.join(counts.where("_tips > 0").select(node), node, "left_semi")


def collapse_unary(nodes: DataFrame, length: str, node: str = "node_id",
                   parent: str = "parent_node_id", keep_root: bool = False) -> DataFrame:
    """Remove inner nodes with one child, adding their lengths to the edge below.

    A root with one child is dropped as well unless ``keep_root``; the node that
    becomes the root then keeps the length of the removed way.
    """
    children = nodes.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(node)).agg(
        F.count(F.lit(1)).alias("_children"))
    marked = nodes.join(children, node, "left")
    unary = F.coalesce(F.col("_children") == 1, F.lit(False))
    if keep_root:
        unary = unary & F.col(parent).isNotNull()
    marked = shuffled(marked.select(node, parent, F.col(length).alias("_length"), unary.alias("_unary")), "unary")
    # a unary node points past itself, every other node stops the way up
    way = marked.select(node, F.when(F.col("_unary"), F.col(parent)).alias("_next"),
                        F.when(F.col("_unary"), F.col("_length")).otherwise(F.lit(0.0)).alias("_extra"), "_unary")
    ways = root_paths(way, node, "_next", {"_extra": "_extra"}).select(
        F.col(node).alias(parent), F.col("root").alias("_stop"), "_extra")
    stops = marked.select(F.col(node).alias("_stop"), F.col("_unary").alias("_stop_unary"))
    kept = marked.where(~F.col("_unary")).join(ways, parent, "left").join(stops, "_stop", "left")
    return kept.select(
        node, F.when(~F.coalesce(F.col("_stop_unary"), F.lit(True)), F.col("_stop")).alias(parent),
        (F.col("_length") + F.coalesce("_extra", F.lit(0.0))).alias(length))


def repair_lengths(edges: DataFrame, length: str, minimum: float) -> DataFrame:
    """Lengths that are not positive become ``minimum``; ``repaired`` marks them."""
    good = F.coalesce(F.col(length) > 0, F.lit(False)) & ~F.isnan(length)
    return edges.withColumn("repaired", ~good).withColumn(
        length, F.when(good, F.col(length)).otherwise(F.lit(float(minimum))))


def nearest_sampled_edge(tips: DataFrame, cells: DataFrame, index: DataFrame, node: str = "node_id") -> DataFrame:
    """Sampled cell on the tip's own edge or the nearest ancestral edge holding one.

    ``cells`` has ``edge`` (the node below the edge), ``cell`` and ``depth``; the
    deepest cell of an edge stands for it.  The nearest sampled edge above every
    node is found by doubling over links that stop at sampled edges.
    """
    best = cells.groupBy(F.col("edge").alias(node)).agg(F.max_by("cell", F.struct("depth", "cell")).alias("cell"))
    linked = index.join(best, node, "left")
    way = linked.select(node, F.when(F.col("cell").isNull(), F.col("parent_node_id")).alias("_next"))
    stop = root_paths(way, node, "_next").select(node, F.col("root").alias("_edge"), F.col("depth").alias("edges_up"))
    found = tips.select(node).join(stop, node).join(best.withColumnRenamed(node, "_edge"), "_edge", "left")
    return found.select(
        node, F.when(F.col("cell").isNotNull(), F.col("_edge")).alias("edge"), "cell",
        F.when(F.col("cell").isNull(), "unassigned").when(F.col("edges_up") == 0, "terminal_edge")
        .otherwise("ancestor_edge").alias("assignment"))


def shared_assignments(assigned: DataFrame, key: str) -> DataFrame:
    """Rows whose assigned profile is used more than once."""
    repeated = assigned.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")
    return assigned.join(repeated, key)
