"""Checked queries: division logs, forests and ancestry."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladewise.operators import ancestry, lineage, partial_states as ps
from cladewise.plans import views as v
from cladewise.plans.registry import SQL, query
from cladewise.session import scratch_path

_NODE_COLUMNS = ("node_id, cell_id, segment, parent_node_id, birth_time, end_time, branch_length, "
                 "division_event, opened_as, is_terminal")


@query("event_resolved_lineage", "L1 W1 O1", f"with {v.SQL_NODES} select {_NODE_COLUMNS} from nodes")
def _(spark, sf):
    return lineage.build_lineage(v.divisions(spark, sf), v.end_time(spark, sf))


@query("lineage_with_quiet_founders", "L1 S5", f"""with {v.SQL_NODES}
select {_NODE_COLUMNS} from nodes
union all select c||':0', cast(c as varchar), 0, null, 0.0, m, m, null, 'founder', true
from (select distinct (select max(o_orderkey) from orders) + 5 + c_custkey as c, (select max(o_orderkey)+11 from orders) as m
      from customer)""")
def _(spark, sf):
    top = v.table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0]
    quiet = v.table(spark, sf, "customer").select(
        (F.col("c_custkey") + F.lit(top + 5)).alias("cell_id"))
    return lineage.build_lineage(v.divisions(spark, sf), v.end_time(spark, sf), founders=quiet)


_BROKEN = """broken as (select case when o_orderkey%89=0 then null else cast(o_orderkey+1 as double) end as time,
  o_orderkey as seq,
  case when o_orderkey%83=0 then cast(o_orderkey//2 as varchar)||'.5' else cast(o_orderkey//2 as varchar) end as parent_id,
  case when o_orderkey%97=0 then cast(o_orderkey//2 as varchar) when o_orderkey%101=0 then cast(o_orderkey+3 as varchar)
       when o_orderkey%79=0 then '-'||o_orderkey when o_orderkey%103=0 then cast(o_orderkey//3 as varchar)
       else cast(o_orderkey+4 as varchar) end as daughter_id from orders),
plain as (select time, seq,
  case when try_cast(parent_id as double)>=0 and try_cast(parent_id as double)%1=0
       then cast(cast(parent_id as bigint) as varchar) end as parent,
  case when try_cast(daughter_id as double)>=0 and try_cast(daughter_id as double)%1=0
       then cast(cast(daughter_id as bigint) as varchar) end as daughter from broken)"""


@query("division_log_checks", "P1 P2 S4", f"""with {_BROKEN}
select seq, 'time' as rule from plain where time is null or time<0
union all select seq, 'parent_id' from plain where parent is null
union all select seq, 'daughter_id' from plain where daughter is null
union all select seq, 'own_daughter' from plain where parent=daughter
union all select seq, 'born_twice' from plain where daughter in
  (select daughter from plain where daughter is not null group by 1 having count(*)>1)
union all select a.seq, 'already_existed' from plain a join (
  select parent, min(struct_pack(t:=time, s:=seq)) as f from
   (select parent, coalesce(time,-1) as time, seq from plain where parent is not null) group by 1) b
  on b.parent=a.daughter where b.f < struct_pack(t:=coalesce(a.time,-1), s:=a.seq)""")
def _(spark, sf):
    broken = v.table(spark, sf, "orders").selectExpr(
        "case when o_orderkey % 89 = 0 then null else cast(o_orderkey + 1 as double) end as time",
        "o_orderkey as seq",
        "case when o_orderkey % 83 = 0 then concat(o_orderkey div 2, '.5') "
        "else cast(o_orderkey div 2 as string) end as parent_id",
        "case when o_orderkey % 97 = 0 then cast(o_orderkey div 2 as string) "
        "when o_orderkey % 101 = 0 then cast(o_orderkey + 3 as string) "
        "when o_orderkey % 79 = 0 then concat('-', o_orderkey) "
        "when o_orderkey % 103 = 0 then cast(o_orderkey div 3 as string) "
        "else cast(o_orderkey + 4 as string) end as daughter_id")
    return lineage.division_violations(broken)


@query("node_table_checks", "P3", f"""with {v.SQL_NODES},
bad as (select node_id, case when division_event%61=0 then parent_node_id||'x' else parent_node_id end as parent_node_id,
   case when division_event%67=0 then birth_time-1000 else birth_time end as birth_time, end_time,
   case when division_event%71=0 then -branch_length else branch_length end as branch_length from nodes)
select node_id, 'negative_branch' as rule from bad where branch_length<0
union all select node_id, 'ends_before_birth' from bad where end_time<birth_time
union all select a.node_id, 'parent_missing' from bad a where a.parent_node_id is not null
   and not exists(select 1 from bad b where b.node_id=a.parent_node_id)
union all select a.node_id, 'born_before_parent' from bad a join bad b on a.parent_node_id=b.node_id
   where a.birth_time<b.birth_time""")
def _(spark, sf):
    bad = v.nodes(spark, sf).selectExpr(
        "node_id",
        "case when division_event % 61 = 0 then concat(parent_node_id, 'x') else parent_node_id end as parent_node_id",
        "case when division_event % 67 = 0 then birth_time - 1000 else birth_time end as birth_time", "end_time",
        "case when division_event % 71 = 0 then -branch_length else branch_length end as branch_length")
    return lineage.node_violations(bad)


@query("sequential_node_labels", "L1 F10", f"""with {v.SQL_NODES}
select node_id, 'node_'||lpad(cast(row_number() over (order by birth_time, node_id) as varchar), 6, '0') as node_label
from nodes""")
def _(spark, sf):
    return lineage.sequential_labels(v.nodes(spark, sf)).select("node_id", "node_label")


@query("terminal_cells", "L1", f"""with {v.SQL_NODES}
select 'cell_'||cell_id as sample_id, cell_id, node_id, birth_time, end_time, branch_length from nodes where is_terminal""")
def _(spark, sf):
    return lineage.terminal_cells(v.nodes(spark, sf))


@query("active_cells_at_checkpoints", "J3", f"""with {v.SQL_NODES},
typed as (select *, 'type'||(cast(cell_id as bigint)%3) as cell_type from nodes),
cp(time) as (values (0.0),(50.0),(400.0),(900.0),(1200.0)),
types as (select distinct cell_type from typed),
n as (select cp.time, t.cell_type,
  (select count(*) from typed x where x.cell_type=t.cell_type and x.birth_time<=cp.time
     and (cp.time<x.end_time or x.is_terminal)) as active_cells
  from cp cross join types t)
select cast(n.time as double) as time, cell_type, active_cells, sum(active_cells) over (partition by n.time)::bigint as total_active_cells,
  (select count(*) from typed x where x.birth_time<=n.time) as total_nodes,
  (select count(*) from log where log.time<=n.time) as population_events from n""")
def _(spark, sf):
    typed = v.nodes(spark, sf).withColumn("cell_type", F.expr("concat('type', cast(cell_id as bigint) % 3)"))
    return lineage.active_at_checkpoints(typed, [0.0, 50.0, 400.0, 900.0, 1200.0])


@query("appended_checkpoints", "J3", f"select time, cell_type, active_cells from ({SQL['active_cells_at_checkpoints']})")
def _(spark, sf):
    times, folder = [0.0, 50.0, 400.0, 900.0, 1200.0], scratch_path(spark, "states")
    log = v.nodes(spark, sf).select(F.expr("concat('type', cast(cell_id as bigint) % 3)").alias("cell_type"), F.inline(F.array(
        F.struct(F.col("birth_time").alias("opened_at"), F.lit(None).cast("double").alias("closed_at")),
        F.struct(F.lit(None).cast("double").alias("opened_at"), F.when(~F.col("is_terminal"), F.col("end_time")).alias("closed_at")))))
    log = log.withColumn("moment", F.coalesce("opened_at", "closed_at")).where("moment is not null")
    kept = ps.Summary(["cell_type"], ps.checkpoint_counts(times))
    for name, days in (("early", "moment <= 400"), ("late", "moment > 400"), ("late", "moment > 400")):
        kept.append(log.where(days), folder, name)
    return ps.active_from_states(kept.stored(spark, folder), ["cell_type"], times)


@query("open_segments_at_checkpoints", "J3", f"""with recursive {v.SQL_UP},
tip as (select node_id from nodes join orders on cast(o_orderkey as varchar)=cell_id where is_terminal and o_orderstatus='F'),
q as (select node_id, t::double as t from tip, (values (0.0),(50.0),(400.0),(900.0),(1200.0),(100000000.0)) c(t)),
f as (select q.node_id, t, arg_max(up.anc, up.steps) as anc from q join up using(node_id) join nodes n on n.node_id=up.anc and n.end_time>t group by 1,2)
select node_id, t as time, anc as segment from q left join f using(node_id, t)""")
def _(spark, sf):
    tips = v.sampled_tips(spark, sf).select("node_id", F.explode(F.array(*[
        F.lit(t) for t in (0.0, 50.0, 400.0, 900.0, 1200.0, 1e8)])).alias("time_"))
    found = ancestry.ancestor_at(tips, v.ancestry_index(spark, sf), "time_", "time", "node_id", "segment")
    return found.withColumnRenamed("time_", "time").select("node_id", "time", "segment")


_LOOPED = "case when o_orderkey=1 then 5 when o_orderkey=12 then 25 when o_orderkey=7 then 7 when o_orderkey>0 then {half} end"


@query("cycle_members", "P3 L2", f"""with recursive n as (select o_orderkey as node, {_LOOPED.format(half='o_orderkey//2')} as parent from orders),
w as (select node, parent as cur from n where parent is not null union select w.node, n.parent from w join n on n.node=w.cur where n.parent is not null),
c as (select node from w where node=cur), m as (select w.node, min(w.cur) as cycle from w join c using(node) group by 1)
select cycle, node from m""")
def _(spark, sf):
    looped = v.table(spark, sf, "orders").selectExpr("o_orderkey as node", f"{_LOOPED.format(half='o_orderkey div 2')} as parent")
    return ancestry.cycle_members(looped, "node", "parent")


@query("founder_clone_summary", "L2 L3", f"""with recursive {v.SQL_PATHS}
select d.root, count(*) as terminal_cells, max(depth) as max_depth, round(avg(depth),6) as mean_depth
from down d join nodes n using(node_id) where is_terminal group by 1""")
def _(spark, sf):
    paths = v.node_paths(spark, sf).select("node_id", "root", "depth")
    return paths.join(v.nodes(spark, sf).where("is_terminal").select("node_id"), "node_id").groupBy("root").agg(
        F.count(F.lit(1)).alias("terminal_cells"), F.max("depth").alias("max_depth"),
        F.round(F.avg("depth"), 6).alias("mean_depth"))


@query("node_depth_and_root", "L2 L3 L14", f"with recursive {v.SQL_PATHS} select node_id, root, depth, dist as root_distance from down")
def _(spark, sf):
    return ancestry.root_paths(v.nodes(spark, sf), sums={"root_distance": "branch_length"})


@query("ancestor_lift_table", "L4", f"""with recursive {v.SQL_UP}
select node_id as node, cast(log2(steps) as int) as level, anc as ancestor from up
where steps in (1,2,4,8,16,32,64,128)""")
def _(spark, sf):
    return ancestry.lift_table(v.nodes(spark, sf))


def _pairs(spark, sf):
    last = v.nodes(spark, sf).where("is_terminal").selectExpr("cast(cell_id as bigint) as k", "node_id")
    orders = v.table(spark, sf, "orders")
    n = orders.count()
    drawn = orders.selectExpr("o_orderkey as pair", f"(o_orderkey * 31) % {n} as ka", f"(o_orderkey * 17 + 5) % {n} as kb")
    return drawn.join(last.selectExpr("k as ka", "node_id as node_a"), "ka").join(
        last.selectExpr("k as kb", "node_id as node_b"), "kb").select("pair", "node_a", "node_b")


_MRCA = f"""{v.SQL_UP}, last_seg as (select cast(cell_id as bigint) as node_key, node_id from nodes where is_terminal),
pairs as (select o_orderkey as pair, a.node_id as node_a, b.node_id as node_b from orders
  join last_seg a on a.node_key=(o_orderkey*31)%(select count(*) from orders) join last_seg b on b.node_key=(o_orderkey*17+5)%(select count(*) from orders)),
want as (select distinct node_a, node_b from pairs),
upx as (select up.* from up where node_id in (select node_a from want union select node_b from want)),
met as (select p.node_a, p.node_b, arg_min(x.anc, x.steps) as mrca, min(x.steps+y.steps) as dd
  from want p join upx x on x.node_id=p.node_a join upx y on y.node_id=p.node_b and y.anc=x.anc group by 1,2)"""


@query("pair_mrca", "L5", f"""with recursive {_MRCA}
select pair, p.node_a, p.node_b, mrca as mrca_node_id, mrca is not null as same_founder,
  case when mrca is null then 0.0 else m.end_time end as mrca_time,
  (a.end_time+b.end_time-2*coalesce(m.end_time,0))/2 as mrca_age,
  a.end_time+b.end_time-2*coalesce(m.end_time,0) as patristic_distance, dd as division_distance
from pairs p left join met on met.node_a=p.node_a and met.node_b=p.node_b
left join nodes m on m.node_id=mrca join nodes a on a.node_id=p.node_a join nodes b on b.node_id=p.node_b""")
def _(spark, sf):
    return ancestry.pair_relations(_pairs(spark, sf), v.ancestry_index(spark, sf))


@query("cophenetic_pairs", "L15", f"""with recursive {_MRCA},
dn as (select node_id, branch_length as d from nodes where parent_node_id is null
  union all select n.node_id, dn.d+n.branch_length from nodes n join dn on n.parent_node_id=dn.node_id)
select pair, p.node_a, p.node_b, a.d+b.d-2*m.d as path_length
from pairs p join met on met.node_a=p.node_a and met.node_b=p.node_b
join dn m on m.node_id=mrca join dn a on a.node_id=p.node_a join dn b on b.node_id=p.node_b""")
def _(spark, sf):
    index = v.distance_index(spark, sf)
    return ancestry.common_ancestor(_pairs(spark, sf), index, "node_a", "node_b", carry=["root_distance"]).where(
        "same_founder").selectExpr("pair", "node_a", "node_b",
                                   "root_distance_a + root_distance_b - 2 * mrca_root_distance as path_length")


@query("ancestor_closure", "L6", f"""with recursive {v.SQL_UP} select up.node_id, anc as ancestor, steps from up join nodes n using(node_id)
where n.is_terminal and n.cell_id in (select cast(o_orderkey as varchar) from orders where o_orderpriority='1-URGENT')""")
def _(spark, sf):
    return ancestry.ancestor_closure(v.nodes(spark, sf), v.urgent_tips(spark, sf))


_SAMPLED = f"""{v.SQL_NODES},
ranked as (select node_id, parent_node_id, case when parent_node_id is null then cast(cell_id as bigint)
   when segment>0 then 0 else 1 end as child_no from nodes),
walk as (select node_id, [child_no] as path from ranked where parent_node_id is null
  union all select r.node_id, list_append(w.path, r.child_no) from ranked r join walk w on r.parent_node_id=w.node_id),
sampled as (select node_id, cell_id, row_number() over (order by path)-1 as place from nodes join walk using(node_id)
  where is_terminal and cell_id in (select cast(o_orderkey as varchar) from orders where o_orderstatus='F')),
up as (select node_id, node_id as anc, parent_node_id as nxt from nodes
  union all select up.node_id, n.node_id, n.parent_node_id from up join nodes n on n.node_id=up.nxt)"""


@query("sampled_descendant_intervals", "L7 W5", f"""with recursive {_SAMPLED}
select anc as node_id, count(*) as tips, min(place) as first_place from up join sampled using(node_id) group by 1""")
def _(spark, sf):
    return v.intervals(spark, sf).where("tips > 0")


@query("event_cell_inheritance", "L8", f"""with recursive {_SAMPLED}, {v.SQL_EVENTS}
select node_key, seq, integration, position, s.cell_id, count(*) as copies
from events_ e join up on up.anc=e.node_id join sampled s on s.node_id=up.node_id group by all""")
def _(spark, sf):
    events = v.mutation_events(spark, sf).select("node_key", "seq", "integration", "position", "node_id")
    return ancestry.event_cells(events, v.intervals(spark, sf), v.sampled_tips(spark, sf)).groupBy(
        "node_key", "seq", "integration", "position", "cell_id").agg(F.count(F.lit(1)).alias("copies"))


_MOD_ORDER = ["node_key", "seq", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query("modality_event_manifest", "L9 O5", f"""with recursive {_SAMPLED}, {v.SQL_EVENTS},
counts as (select anc as node_id, count(*) as n from up join sampled using(node_id) group by 1),
b as (select 'barcode' as modality, row_number() over (order by {', '.join(_MOD_ORDER)}) as r,
   node_id, integration, position, null::varchar as alternate from events_ where integration<3),
m as (select 'mito' as modality, row_number() over (order by {', '.join(_MOD_ORDER)}) as r, node_id,
   null::bigint as integration, position, ['A','G','C','T'][cast(allele as int)] as alternate from events_ where integration>=3),
u as (select * from b union all select * from m)
select modality||'_event_'||lpad(cast(r as varchar),8,'0') as event_id, modality, r as modality_event_row,
  u.node_id, integration, position, alternate, coalesce(n,0) as descendant_terminal_cells
from u left join counts on counts.node_id=u.node_id""")
def _(spark, sf):
    events = v.mutation_events(spark, sf)
    barcode = events.where("integration < 3").select("node_id", "integration", "position", *_MOD_ORDER)
    mito = events.where("integration >= 3").withColumn(
        "alternate", F.expr("element_at(array('A','G','C','T'), cast(allele as int))")).select(
        "node_id", "position", "alternate", *_MOD_ORDER)
    return ancestry.union_events({"barcode": barcode, "mito": mito}, {"barcode": _MOD_ORDER, "mito": _MOD_ORDER},
                                 v.intervals(spark, sf)).select(
        "event_id", "modality", "modality_event_row", "node_id", "integration", "position", "alternate",
        "descendant_terminal_cells")


@query("terminal_genotypes", "L10 R1", f"""with recursive {_SAMPLED}, {v.SQL_EVENTS},
above as (select node_id, node_id as anc, parent_node_id as nxt, 0 as steps from nodes
  union all select above.node_id, n.node_id, n.parent_node_id, steps+1 from above join nodes n on n.node_id=above.nxt)
select s.cell_id, integration, position, arg_max(allele, struct_pack(a:=-steps, b:=seq, c:=allele)) as allele
from events_ e join above up on up.anc=e.node_id join sampled s on s.node_id=up.node_id group by all""")
def _(spark, sf):
    events = v.mutation_events(spark, sf).select("seq", "integration", "position", "allele", "node_id")
    placed = v.intervals(spark, sf).join(v.node_paths(spark, sf).select("node_id", "depth"), "node_id")
    return ancestry.terminal_genotypes(events, placed, v.sampled_tips(spark, sf), ["integration", "position"], "allele", ["seq", "allele"])


@query("pruned_forest", "L11 T4 J10", f"""with recursive {v.SQL_UP}
select node_id, parent_node_id from nodes where node_id in (select anc from up join nodes n on n.node_id=up.node_id
 where n.is_terminal and n.cell_id in (select cast(o_orderkey as varchar) from orders where o_orderpriority='1-URGENT'))""")
def _(spark, sf):
    wanted = v.urgent_tips(spark, sf)
    return ancestry.prune(v.nodes(spark, sf), wanted).select("node_id", "parent_node_id")


@query("unknown_sampled_tips", "L11 J11 O6", f"""with {v.SQL_NODES}
select distinct c_custkey*13||':0' as node_id from customer where c_custkey*13||':0' not in (select node_id from nodes)""")
def _(spark, sf):
    wanted = v.table(spark, sf, "customer").selectExpr("concat(c_custkey * 13, ':0') as node_id")
    return ancestry.unknown_tips(wanted, v.nodes(spark, sf))


@query("collapsed_unary_nodes", "L12 T4", f"""with recursive {v.SQL_UP},
p as (select node_id, parent_node_id, branch_length from nodes where node_id in (select anc from up join nodes n on n.node_id=up.node_id
 where n.is_terminal and n.cell_id in (select cast(o_orderkey as varchar) from orders where o_orderpriority='1-URGENT'))),
k as (select parent_node_id as node_id, count(*) as c from p where parent_node_id is not null group by 1),
f as (select p.*, coalesce(k.c,0)=1 as un from p left join k using(node_id)),
walk as (select node_id, parent_node_id as at, branch_length as len from f where not un
  union all select w.node_id, f.parent_node_id, w.len+f.branch_length from walk w join f on f.node_id=w.at where f.un)
select node_id, w.at as parent_node_id, w.len as branch_length from walk w left join f on f.node_id=w.at
where w.at is null or not f.un""".replace("left join f on f.node_id=w.at", "left join f g on g.node_id=w.at").replace(
    "w.at is null or not f.un", "w.at is null or not g.un").replace("select node_id, w.at", "select w.node_id, w.at"))
def _(spark, sf):
    wanted = v.urgent_tips(spark, sf)
    pruned = ancestry.prune(v.nodes(spark, sf), wanted)
    return ancestry.collapse_unary(pruned, "branch_length")


@query("repaired_branches", "L13", f"""with {v.SQL_NODES}, b as (select node_id, branch_length - 20 as branch_length from nodes)
select node_id, not (branch_length > 0) as repaired, case when branch_length>0 then branch_length else 0.001 end as branch_length from b""")
def _(spark, sf):
    shifted = v.nodes(spark, sf).selectExpr("node_id", "branch_length - 20 as branch_length")
    return ancestry.repair_lengths(shifted, "branch_length", 0.001)


@query("nearest_sampled_edges", "L16 W6", f"""with recursive {v.SQL_UP},
cells as (select node_id as edge, cell_id as cell, division_event%9 as depth from nodes where branch_length>=200
  union all select node_id, 'z'||cell_id, division_event%7 from nodes where branch_length>=400),
best as (select edge, arg_max(cell, struct_pack(a:=depth, b:=cell)) as cell from cells group by 1),
hit as (select up.node_id, arg_min(struct_pack(e:=anc, c:=cell, s:=steps), steps) as h from up join best on best.edge=up.anc group by 1)
select n.node_id, h.e as edge, h.c as cell, case when h is null then 'unassigned' when h.s=0 then 'terminal_edge' else 'ancestor_edge' end as assignment
from nodes n left join hit using(node_id) where n.is_terminal""")
def _(spark, sf):
    nodes = v.nodes(spark, sf)
    cells = nodes.where("branch_length >= 200").selectExpr(
        "node_id as edge", "cell_id as cell", "division_event % 9 as depth").unionByName(
        nodes.where("branch_length >= 400").selectExpr(
            "node_id as edge", "concat('z', cell_id) as cell", "division_event % 7 as depth"))
    return ancestry.nearest_sampled_edge(nodes.where("is_terminal"), cells, nodes)


@query("shared_profile_assignments", "L17", """with a as (select c_custkey as tip, case when c_custkey%9=0 then null else floor(c_acctbal/10) end as profile from customer)
select tip, profile, uses from a join (select profile, count(*) as uses from a where profile is not null group by 1 having count(*)>1) using(profile)""")
def _(spark, sf):
    assigned = v.table(spark, sf, "customer").selectExpr(
        "c_custkey as tip", "case when c_custkey % 9 = 0 then null else cast(floor(c_acctbal / 10) as double) end as profile")
    return ancestry.shared_assignments(assigned, "profile")


@query("survivor_states", "L18 W9", f"""with recursive {v.SQL_PATHS}
select n.cell_id, p.cell_id as parent_cell_id, depth as generation, depth/(select max(depth) from down)::double as pseudotime,
 n.birth_time, n.end_time from nodes n join down d on d.node_id=n.node_id left join nodes p on p.node_id=n.parent_node_id where n.is_terminal""")
def _(spark, sf):
    return lineage.survivor_states(v.nodes(spark, sf), v.node_paths(spark, sf).withColumnRenamed("depth", "generation"))


@query("lineage_text_depth", "L19 L20", """select c_custkey, case when c_custkey%10=0 then 0
 else len(string_split(repeat('1_', c_custkey%6)||'0','_'))-1 end as depth,
 case when c_custkey%10=0 then 0 else c_nationkey%4+1 end as neighbours from customer""")
def _(spark, sf):
    text = v.table(spark, sf, "customer").selectExpr(
        "c_custkey",
        "case when c_custkey % 10 = 0 then '' else concat(repeat('1_', cast(c_custkey % 6 as int)), '0') end as lineage",
        "case when c_custkey % 10 = 0 then ' ' else concat('7', repeat(';8', c_nationkey % 4)) end as neighbours")
    return text.select("c_custkey", lineage.depth_from_lineage_text(F.col("lineage")).alias("depth"),
                       lineage.neighbour_count(F.col("neighbours")).alias("neighbours"))


@query("ground_truth_edges", "L21", """with c as (select cast(o_orderkey+4 as varchar) as node, cast(o_orderkey//2 as varchar) as parent from orders
 union all select cast(x as varchar), null from range(4) t(x)),
e as (select node, coalesce(parent,'root') as parent from c)
select node, parent, node not in (select parent from c where parent is not null) as is_tip from e""")
def _(spark, sf):
    log = v.divisions(spark, sf)
    founders = log.select(F.col("parent_id").alias("node")).distinct().join(
        log.select(F.col("daughter_id").alias("node")), "node", "left_anti").withColumn("parent", F.lit(None).cast("long"))
    cells = log.selectExpr("daughter_id as node", "parent_id as parent").unionByName(founders)
    return lineage.ground_truth_edges(cells, "node", "parent")
