"""The driver's tables seen as lineage-recording inputs (see FIXTURES.md section 4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.operators import ancestry, lineage
from cladewise.session import shuffled

_KEPT: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame], write: bool = True) -> DataFrame:
    """A derived table written once per session and input folder.

    ``write=False`` is for builders whose result is a written table already.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _KEPT:
        _KEPT[key] = shuffled(build(), name) if write else build()
    return _KEPT[key]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def divisions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "cast(o_orderkey + 1 as double) as time", "o_orderkey as seq",
        "o_orderkey div 2 as parent_id", "o_orderkey + 4 as daughter_id")


def end_time(spark: SparkSession, sf: str) -> float:
    return float(table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0] + 11)


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return kept(spark, sf, "nodes", lambda: lineage.build_lineage(divisions(spark, sf), end_time(spark, sf)))


def node_paths(spark: SparkSession, sf: str) -> DataFrame:
    return kept(spark, sf, "node_paths", lambda: ancestry.root_paths(
        nodes(spark, sf), sums={"root_distance": "branch_length"}))


def ancestry_index(spark: SparkSession, sf: str) -> DataFrame:
    return kept(spark, sf, "ancestry_index", lambda: ancestry.chain_index(nodes(spark, sf), time="end_time", paths=False), write=False)


def index_above(spark: SparkSession, sf: str, name: str, wanted: DataFrame) -> DataFrame:
    """The index of the ways of wanted nodes alone, where they are few in a large forest."""
    whole = nodes(spark, sf)

    def build():
        part = ancestry.above(whole, wanted)
        return ancestry_index(spark, sf) if part is whole else ancestry.chain_index(part, time="end_time", paths=False)
    return kept(spark, sf, f"{name}_index", build, write=False)


def ways_above(spark: SparkSession, sf: str, name: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node_paths`` and ``distance_index`` of the ways of wanted nodes alone, where they are few in a large forest."""
    whole = nodes(spark, sf)
    part = kept(spark, sf, f"{name}_ways", lambda: ancestry.above(whole, wanted), write=False)
    if part is whole:
        return node_paths(spark, sf), distance_index(spark, sf)
    paths = kept(spark, sf, f"{name}_paths", lambda: ancestry.root_paths(part, sums={"root_distance": "branch_length"}))
    index = kept(spark, sf, f"{name}_distance_index", lambda: ancestry.chain_index(part, paths=False).join(
        paths.select("node_id", "root_distance"), "node_id"))
    return paths, index


def distance_index(spark: SparkSession, sf: str) -> DataFrame:
    """The index with the distance from the root."""
    return kept(spark, sf, "distance_index", lambda: ancestry_index(spark, sf).join(
        node_paths(spark, sf).select("node_id", "root_distance"), "node_id"))


def sampled_tips(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that were collected: their order is finished."""
    return lineage.terminal_cells(nodes(spark, sf)).join(
        table(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr("cast(o_orderkey as string) as cell_id"),
        "cell_id", "left_semi")


def urgent_tips(spark: SparkSession, sf: str) -> DataFrame:
    """Tips wanted in a pruned forest: cells of urgent orders."""
    return nodes(spark, sf).where("is_terminal").join(
        table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").selectExpr("cast(o_orderkey as string) as cell_id"),
        "cell_id", "left_semi")


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    ordered = nodes(spark, sf).selectExpr(
        "node_id", "parent_node_id",
        "case when parent_node_id is null then cast(cell_id as bigint) when segment > 0 then 0 else 1 end as child_no")
    return kept(spark, sf, "intervals", lambda: ancestry.tip_intervals(
        ordered, sampled_tips(spark, sf), "child_no"))


def mutation_events(spark: SparkSession, sf: str) -> DataFrame:
    """Barcode events placed on the last segment of a cell of the forest."""
    last = nodes(spark, sf).where("is_terminal").selectExpr("cast(cell_id as bigint) as node_key", "node_id", "segment")
    events = table(spark, sf, "lineitem").selectExpr(
        "l_suppkey % 5 as integration", "l_partkey % 50 as position",
        "cast(1 + l_partkey % 4 as double) as allele", "l_orderkey as node_key", "l_linenumber as seq",
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return events.join(last, "node_key").selectExpr(
        "integration", "position", "allele",
        "node_key", "seq", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        # events of even sequence sit on the first segment of the cell, so inner nodes carry some
        "case when seq % 2 = 0 then concat(node_key, ':0') else node_id end as node_id")


def observations(spark: SparkSession, sf: str) -> DataFrame:
    keyed = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey div 8 as cell", "concat('u', l_partkey % 5) as unit", "(l_partkey div 5) % 8 as site",
        "case when l_returnflag='A' then '1' when l_returnflag='R' then '0' "
        "when l_linestatus='O' then '+' else '?' end as state",
        "md5(concat(l_orderkey,'|',l_linenumber,'|',l_partkey,'|',l_suppkey)) as k")
    return keyed.groupBy("cell", "unit", "site").agg(F.min_by("state", F.concat("k", "state")).alias("state"))


def dense_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Cell x unit x site calls with few gaps: the last unit site is often missing."""
    keyed = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey div 8 as cell", "concat('u', l_partkey % 3) as unit", "(l_partkey div 3) % 6 as site",
        "case when l_returnflag='A' then '1' when l_returnflag='R' then '0' else '?' end as state",
        "md5(concat(l_orderkey,'|',l_linenumber,'|',l_partkey,'|',l_suppkey)) as k")
    return keyed.where("state <> '?'").groupBy("cell", "unit", "site").agg(F.min_by("state", F.concat("k", "state")).alias("state"))


def molecules(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as mol", "l_linenumber as target",
        "case when l_returnflag='N' then '0' else concat(l_returnflag, l_suppkey % 4) end as call",
    ).groupBy("mol", "target").agg(F.min("call").alias("call"))


def genomes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey div 8 as cell", "l_linenumber as genome", "l_partkey % 50 as position",
        "cast(1 + l_suppkey % 4 as double) as allele").distinct()


def cells_xyz(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id as cell", "label as founder", "cast(embedding[0] as double) * 1000.0 as x",
        "cast(embedding[1] as double) * 1000.0 as y", "cast(embedding[2] as double) * 1000.0 as z")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "c_mktsegment as system", "n_regionkey as seed", "c_custkey % 4 as tier", "c_custkey as replicate",
        "greatest(0, c_acctbal) / 10000.0 as normalized_rf")


TREES = {("near", "truth"): 1, ("near", "estimate"): 7, ("far", "truth"): 1, ("far", "estimate"): 11}


def tree_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Two pairs of trees over all orders: binary, with the tips dealt out differently.

    Node k hangs below (k-1)/2; nodes without a child are tips.  Tip labels are
    dealt by a multiplier, 1 for the truth.
    """
    n = table(spark, sf, "orders").count()
    inner, tips = n // 2, n - n // 2
    deals = F.explode(F.array(*[F.struct(F.lit(p).alias("pair"), F.lit(r).alias("role"), F.lit(m).alias("deal"))
                                for (p, r), m in TREES.items()])).alias("t")
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), deals).select("node", "t.*")
    label = F.when(F.col("node") >= inner, F.lit(inner) + ((F.col("node") - inner) * F.col("deal")) % tips)
    length = F.lit(1.0) + (F.col("node") * 13 % 7) / 10
    # tips end together, so that the trees are ultrametric down to the last split
    return base.select(
        "pair", "role", "node",
        F.concat_ws("/", "pair", "role", "node").alias("key"),
        F.when(F.col("node") > 0, F.concat_ws("/", "pair", "role", F.floor((F.col("node") - 1) / 2).cast("string"))).alias("parent_key"),
        label.alias("label"), F.when(F.col("node") == 0, 0.0).otherwise(length).alias("length"))


SQL_TREES = """n_ as (select count(*) as n, count(*)//2 as h from orders),
deal(pair, role, deal) as (values ('near','truth',1),('near','estimate',7),('far','truth',1),('far','estimate',11)),
tn as (select pair, role, o_orderkey as node, pair||'/'||role||'/'||o_orderkey as key,
  case when o_orderkey>0 then pair||'/'||role||'/'||((o_orderkey-1)//2) end as parent_key,
  case when o_orderkey>=h then h+((o_orderkey-h)*deal)%(n-h) end as label, case when o_orderkey=0 then 0.0 else 1.0+((o_orderkey*13)%7)/10 end as length
  from orders, n_, deal)"""
SQL_TREE_UP = SQL_TREES + """,
tup as (select key, label, length, key as anc, parent_key as nxt, 0 as steps from tn
  union all select t.key, t.label, t.length, p.key, p.parent_key, steps+1 from tup t join tn p on p.key=t.nxt)"""


# The same views in the SQL of the checks.
SQL_LOG = """log as (select cast(o_orderkey+1 as double) as time, o_orderkey as seq, o_orderkey//2 as p, o_orderkey+4 as d,
  row_number() over (order by o_orderkey) as event_no,
  row_number() over (partition by o_orderkey//2 order by o_orderkey) as nth from orders)"""
SQL_NODES = SQL_LOG + """,
seg as (select p as cell, nth as segment, 'continuing_parent' as opened_as, time as birth, event_no as opening,
    p||':'||(nth-1) as parent_node_id from log
  union all select d, 0, 'new_daughter', time, event_no, p||':'||(nth-1) from log
  union all select distinct p, 0, 'founder', 0.0, null, null from log where p not in (select d from log)),
nodes as (select seg.cell||':'||seg.segment as node_id, cast(seg.cell as varchar) as cell_id, seg.segment,
    seg.parent_node_id, seg.birth as birth_time,
    coalesce(c.time, (select max(o_orderkey)+11 from orders)) as end_time,
    coalesce(c.time, (select max(o_orderkey)+11 from orders)) - seg.birth as branch_length,
    coalesce(c.event_no, seg.opening) as division_event, seg.opened_as, c.event_no is null as is_terminal
  from seg left join log c on c.p = seg.cell and c.nth = seg.segment+1)"""
SQL_UP = SQL_NODES + """,
up as (select node_id, node_id as anc, parent_node_id as nxt, 0 as steps from nodes
  union all select up.node_id, n.node_id, n.parent_node_id, up.steps+1 from up join nodes n on n.node_id = up.nxt)"""
SQL_PATHS = SQL_NODES + """,
down as (select node_id, node_id as root, 0 as depth, branch_length as dist from nodes where parent_node_id is null
  union all select n.node_id, d.root, d.depth+1, d.dist+n.branch_length from nodes n join down d on n.parent_node_id=d.node_id)"""
SQL_EVENTS = """last_seg as (select cast(cell_id as bigint) as node_key, node_id from nodes where is_terminal),
events_ as (select l_suppkey%5 as integration, l_partkey%50 as position, cast(1+l_partkey%4 as double) as allele,
   l_orderkey as node_key, l_linenumber as seq, l_partkey, l_suppkey, l_quantity, l_extendedprice,
   case when l_linenumber%2=0 then l_orderkey||':0' else n.node_id end as node_id
   from lineitem join last_seg n on n.node_key = l_orderkey)"""
SQL_OBS = """obs as (select cell,unit,site,min_by(state,k||state) as state from (select l_orderkey//8 as cell,
 'u'||(l_partkey%5) as unit, (l_partkey//5)%8 as site,
 case when l_returnflag='A' then '1' when l_returnflag='R' then '0' when l_linestatus='O' then '+' else '?' end as state,
 md5(l_orderkey||'|'||l_linenumber||'|'||l_partkey||'|'||l_suppkey) as k from lineitem) group by 1,2,3)"""
SQL_DENSE = """obs as (select cell,unit,site,min_by(state,k||state) as state from (select l_orderkey//8 as cell,
 'u'||(l_partkey%3) as unit, (l_partkey//3)%6 as site,
 case when l_returnflag='A' then '1' when l_returnflag='R' then '0' else '?' end as state,
 md5(l_orderkey||'|'||l_linenumber||'|'||l_partkey||'|'||l_suppkey) as k from lineitem) where state<>'?' group by 1,2,3)"""
SQL_MOL = """mols as (select l_orderkey as mol, l_linenumber as target,
 min(case when l_returnflag='N' then '0' else l_returnflag||(l_suppkey%4) end) as call from lineitem group by 1,2)"""
SQL_GENOMES = """genomes as (select distinct l_orderkey//8 as cell, l_linenumber as genome, l_partkey%50 as position,
 cast(1+l_suppkey%4 as double) as allele from lineitem)"""
SQL_XYZ = """xyz as (select vec_id as cell, label as founder, cast(embedding[1] as double)*1000.0 as x,
 cast(embedding[2] as double)*1000.0 as y, cast(embedding[3] as double)*1000.0 as z from embeddings)"""
SQL_SCORES = """scores as (select c_mktsegment as system, n_regionkey as seed, c_custkey%4 as tier, c_custkey as replicate,
 greatest(0,c_acctbal)/10000.0 as normalized_rf from customer join nation on c_nationkey=n_nationkey)"""


def sql_uniform(seed: str, key: str) -> str:
    """The repeatable uniform draw in the SQL of the checks."""
    return f"(('0x'||substr(md5('{seed}|'||{key}),1,12))::bigint / 281474976710656.0)"
