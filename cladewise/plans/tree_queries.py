"""Checked queries: comparison of tree pairs and distances between cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladewise.functions.sampling import uniform_int
from cladewise.operators import ancestry, nearest_cells as nc, trees as tr
from cladewise.plans import views as v
from cladewise.plans.registry import SQL, query
from cladewise.plans.spatial_queries import sql_ranked


def _r(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _trees(spark, sf):
    return v.kept(spark, sf, "trees", lambda: v.tree_nodes(spark, sf))


def _table(spark, sf):
    return v.kept(spark, sf, "tree_table", lambda: tr.tree_table(_trees(spark, sf)), write=False)


def _links(spark, sf):
    """The tree table for cuts, without the clades' sums in large forests."""
    return v.kept(spark, sf, "tree_links", lambda: tr.tree_table(_trees(spark, sf), with_clades=False), write=False)


def _clades(spark, sf):
    return tr.clades(_table(spark, sf))


def _index(spark, sf):
    return v.kept(spark, sf, "tree_index", lambda: tr.draws_index(_trees(spark, sf), lambda: _table(spark, sf)), write=False)


def _labels(spark, sf):
    return v.kept(spark, sf, "tree_labels", lambda: tr.shared_labels(_trees(spark, sf)), write=False)


# the key of a clade in SQL: its sorted tip labels as one text digest
_CLADES = f"""{v.SQL_TREE_UP},
sets as (select anc as key, count(*) as size, md5(string_agg(label::varchar, ',' order by label)) as k, min(label) as lo, sum(label)::bigint as tip_sum from tup where label is not null group by 1),
dist as (select t.key, sum(p.length) as d from tup t join tn p on p.key=t.anc group by 1),
tot as (select pair, role, count(*) as tips, min(label) as first_tip from tn where label is not null group by 1,2),
cl as (select tn.pair, tn.role, tn.key, size, k, lo, tip_sum, d as split_time, tips, first_tip from tn join sets using(key) join dist using(key) join tot on tot.pair=tn.pair and tot.role=tn.role where label is null),
ck as (select * from cl where size>=2 and size<tips)"""


@query("clade_sizes_and_times", "T1 L14", f"with recursive {_CLADES} select pair, role, key, size, round(split_time,6) as split_time from ck")
def _(spark, sf):
    return _r(tr.clade_keys(_clades(spark, sf)).select("pair", "role", "key", "size", "split_time"))


_ROOTED = f"""{_CLADES}, m as (select pair, k, count(*) filter (role='truth') as t, count(*) filter (role='estimate') as e from ck group by 1,2),
rs as (select pair, sum(t)::bigint as truth_clades, sum(e)::bigint as estimate_clades, count(*) filter (t>0 and e>0) as shared_clades from m group by 1)"""


@query("rooted_tree_scores", "T2 J17 O6", f"""with recursive {_ROOTED} select *, round(1-2*shared_clades/(truth_clades+estimate_clades),6) as rooted_rf,
 round(shared_clades/estimate_clades,6) as clade_precision, round(shared_clades/truth_clades,6) as clade_recall from rs""")
def _(spark, sf):
    return _r(tr.rooted_scores(_table(spark, sf)))


@query("unrooted_rf", "T3", f"""with recursive {_CLADES}, alltips as (select pair, role, list(label order by label) as ls from tn where label is not null group by 1,2),
sp as (select distinct cl.pair, cl.role, case when cl.lo<>cl.first_tip then cl.k else
   (select md5(string_agg(x.label::varchar, ',' order by x.label)) from tn x where x.pair=cl.pair and x.role=cl.role and x.label is not null
      and not exists(select 1 from tup t where t.anc=cl.key and t.label=x.label)) end as k
  from cl where size>=2 and tips-size>=2),
m as (select pair, k, count(*) as n from sp group by 1,2)
select pair, round(count(*) filter (n=1)/sum(n),6) as unrooted_rf from m group by 1""")
def _(spark, sf):
    return _r(tr.unrooted_rf(_table(spark, sf)))


@query("shared_tip_trees", "T4 L11 L12", """with t as (select 'p'||(o_custkey%10) as pair, o_orderkey as label from orders where o_orderstatus<>'O')
select pair, role, label from t, (values ('truth'),('estimate')) r(role) where pair in (select pair from t group by 1 having count(*)>=3)""")
def _(spark, sf):
    """The estimate lacks the tips of open orders, so the truth is cut down to the others."""
    base = v.table(spark, sf, "orders").selectExpr("o_orderkey as label", "concat('p', o_custkey % 10) as pair", "o_custkey % 40 as mid", "o_orderstatus as status").withColumn(
        "role", F.explode(F.array(F.lit("truth"), F.lit("estimate")))).where("not (role = 'estimate' and status = 'O')")
    tips = base.selectExpr("pair", "role", "concat(pair, role, 't', label) as key", "concat(pair, role, 'm', mid) as parent_key", "label", "1.0D as length")
    mids = base.select("pair", "role", "mid").distinct().selectExpr(
        "pair", "role", "concat(pair, role, 'm', mid) as key", "concat(pair, role, 'root') as parent_key", "cast(null as bigint) as label", "2.0D as length")
    roots = base.select("pair", "role").distinct().selectExpr(
        "pair", "role", "concat(pair, role, 'root') as key", "cast(null as string) as parent_key", "cast(null as bigint) as label", "0.0D as length")
    cut = tr.shared_tip_trees(tips.unionByName(mids).unionByName(roots))
    return cut.where("label is not null").select("pair", "role", "label")


def _draw_sql(i, seed):
    return f"1+cast(floor({v.sql_uniform(seed + str(i), 'pair' + chr(124)*2 + chr(39) + chr(124) + chr(39) + chr(124)*2 + 'draw')}*n) as bigint)"


_LAB = """lab as (select pair, label, row_number() over (partition by pair order by label) as no from tn where role='truth' and label is not null),
cnt as (select pair, count(*) as n from lab group by 1)"""
_DEPTH = "dep as (select key, max(steps) as d from tup group by 1), tipk as (select pair, role, label, key from tn where label is not null)"


def _meet(couples, size, seed, samples):
    draws = ", ".join(f"{_draw_sql(i, seed)} as n{i}" for i in range(size))
    distinct = " and ".join(f"n{i}<>n{j}" for i in range(size) for j in range(i + 1, size))
    joins = " ".join(f"join lab l{i} on l{i}.pair=d.pair and l{i}.no=d.n{i}" for i in range(size))
    tips = ", ".join(f"l{i}.label as t{i}" for i in range(size))
    rows = " union all ".join(f"select pair, draw, '{r}' as role, {c} as couple, t{a} as a, t{b} as b from dt" for r in ("truth", "estimate")
                              for c, (a, b) in enumerate(couples))
    return f"""dr as (select pair, draw, n, {draws} from cnt, range(0,{samples}) x(draw)),
dt as (select d.pair, d.draw, {tips} from dr d {joins} where {distinct}), w as ({rows}),
xa as materialized (select w.pair, w.draw, w.role, w.couple, p.anc from w join tipk x on x.pair=w.pair and x.role=w.role and x.label=w.a join tup p on p.key=x.key),
ya as materialized (select w.pair, w.draw, w.role, w.couple, p.anc from w join tipk x on x.pair=w.pair and x.role=w.role and x.label=w.b join tup p on p.key=x.key),
mt as (select pair, draw, role, couple, max(dep.d) as d from xa join ya using(pair, draw, role, couple, anc) join dep on dep.key=anc group by 1,2,3,4),
wd as (select pair, draw, role, {', '.join(f'max(d) filter (couple={c}) as d{c}' for c in range(len(couples)))} from mt group by 1,2,3)"""


def _triplet_sql(seed):
    return f"""with recursive {v.SQL_TREE_UP}, {_LAB}, {_DEPTH}, {_meet([(0, 1), (0, 2), (1, 2)], 3, seed, tr.DRAWS)},
vd as (select pair, draw, role, case when greatest(d0,d1,d2)>least(d0,d1,d2) then case when d0=greatest(d0,d1,d2) then 0 when d1=greatest(d0,d1,d2) then 1 else 2 end end as v from wd)
select t.pair, round(avg((t.v=e.v)::int),6) as triplet_agreement from vd t join vd e on e.pair=t.pair and e.draw=t.draw and t.role='truth' and e.role='estimate' where t.v is not null and e.v is not null group by 1"""


@query("triplet_agreement", "T5 L5", _triplet_sql("3"))
def _(spark, sf):
    return _r(tr.triplet_agreement(_labels(spark, sf), _index(spark, sf), "3"))


def _ordering_sql(seed):
    return f"""with recursive {v.SQL_TREE_UP}, {_LAB}, {_DEPTH}, {_meet([(0, 1), (2, 3)], 4, seed, tr.DRAWS)},
vd as (select pair, draw, role, case when d0<>d1 then sign(d0-d1) end as v from wd)
select t.pair, round(avg((t.v=e.v)::int),6) as ordering_agreement from vd t join vd e on e.pair=t.pair and e.draw=t.draw and t.role='truth' and e.role='estimate' where t.v is not null and e.v is not null group by 1"""


@query("ordering_agreement", "T6 L5", _ordering_sql("5"))
def _(spark, sf):
    return _r(tr.ordering_agreement(_labels(spark, sf), _index(spark, sf), "5"))


def _cophenetic_sql(seed):
    return f"""with recursive {v.SQL_TREE_UP}, {_LAB}, tipk as (select pair, role, label, key from tn where label is not null),
dist as (select t.key, sum(p.length) as d from tup t join tn p on p.key=t.anc group by 1),
dr as (select pair, i as no, 1+cast(floor({v.sql_uniform(seed + 'a', "pair||'|'||i")}*n) as bigint) as x, 1+cast(floor({v.sql_uniform(seed + 'b', "pair||'|'||i")}*(n-1)) as bigint) as y0 from cnt, range(0,{tr.DRAWS}) r(i)),
dt as (select d.pair, d.no, a.label as a, b.label as b from (select *, y0+(y0>=x)::int as y from dr) d join lab a on a.pair=d.pair and a.no=least(x,y) join lab b on b.pair=d.pair and b.no=greatest(x,y)),
w as (select dt.*, r as role from dt, (values ('truth'),('estimate')) z(r)),
xa as materialized (select w.pair, w.no, w.role, p.key, p.anc from w join tipk x on x.pair=w.pair and x.role=w.role and x.label=w.a join tup p on p.key=x.key),
ya as materialized (select w.pair, w.no, w.role, p.key, p.anc from w join tipk x on x.pair=w.pair and x.role=w.role and x.label=w.b join tup p on p.key=x.key),
mt as (select xa.pair, xa.no, xa.role, xa.key as kx, ya.key as ky, max(m.d) as m from xa join ya on ya.pair=xa.pair and ya.no=xa.no and ya.role=xa.role and ya.anc=xa.anc join dist m on m.key=xa.anc group by all),
wd as (select pair, no, max(round(a.d+b.d-2*m,9)) filter (role='truth') as t, max(round(a.d+b.d-2*m,9)) filter (role='estimate') as e from mt join dist a on a.key=kx join dist b on b.key=ky group by 1,2)
select pair, count(*) as pairs, round(corr(rl,rr),6) as cophenetic_spearman from {sql_ranked('wd', 'pair', 't', 'e')} group by 1"""


#: All pairs of tips: two tips meet where their ways come from different children; equal pairs of distances are counted.
_COPHENETIC = f"""with recursive {v.SQL_TREE_UP},
tipk as (select pair, role, label, key, (row_number() over (partition by pair, role order by label))::int as no from tn where label is not null
  and (pair, label) in (select pair, label from tn where label is not null group by 1,2 having count(distinct role)=2)),
dist as (select t.key, sum(p.length) as d from tup t join tn p on p.key=t.anc group by 1),
wy as materialized (select k.pair, k.role, k.no, t.anc, t.nxt, d.d from tipk k join tup t on t.key=k.key join dist d on d.key=k.key),
mt as (select x.pair, x.role, least(x.no,y.no)::bigint*2147483648+greatest(x.no,y.no) as two, round(x.d+y.d-2*m.d,9) as far
  from wy x join wy y on x.nxt=y.nxt and x.anc<y.anc join dist m on m.key=x.nxt),
cnt as materialized (select t.pair, t.far as t, e.far as e, count(*) as n from mt t join mt e on e.pair=t.pair and e.two=t.two where t.role='truth' and e.role='estimate' group by 1,2,3),
rt as (select pair, t, sum(sum(n)) over (partition by pair order by t)-(sum(n)-1)/2.0 as x from cnt group by 1,2),
re as (select pair, e, sum(sum(n)) over (partition by pair order by e)-(sum(n)-1)/2.0 as y from cnt group by 1,2),
mo as (select pair, sum(n)::double as n, sum(n*x)/sum(n) as mx, sum(n*y)/sum(n) as my from cnt join rt using(pair, t) join re using(pair, e) group by 1)
select pair, sum(cnt.n)::bigint as pairs, round(sum(cnt.n*(x-mx)*(y-my))/sqrt(sum(cnt.n*(x-mx)*(x-mx))*sum(cnt.n*(y-my)*(y-my))),6) as cophenetic_spearman
from cnt join rt using(pair, t) join re using(pair, e) join mo using(pair) group by 1"""


@query("cophenetic_spearman", "T7 L15 X8", _COPHENETIC)
def _(spark, sf):
    index = v.kept(spark, sf, "tip_index", lambda: tr.tip_index(_table(spark, sf)), write=False)
    return _r(tr.cophenetic_spearman(_labels(spark, sf), index, None, "all"))


@query("adjusted_rand_index", "T8 T9", """with l as (select c_nationkey as tree_label, c_mktsegment as cluster, c_custkey%2 as half from customer),
c as (select half, tree_label, cluster, count(*)::double as n from l group by 1,2,3),
s as (select half, sum(n*(n-1)/2) as s, sum(n)::bigint as tips from c group by 1),
a as (select half, sum(n*(n-1)/2) as a from (select half, tree_label, sum(n) as n from c group by 1,2) group by 1),
b as (select half, sum(n*(n-1)/2) as b from (select half, cluster, sum(n) as n from c group by 1,2) group by 1)
select half, tips, round((s-a*b/(tips*(tips-1)/2))/((a+b)/2-a*b/(tips*(tips-1)/2)),6) as adjusted_rand from s join a using(half) join b using(half)""")
def _(spark, sf):
    return _r(tr.adjusted_rand(v.table(spark, sf, "customer").selectExpr(
        "c_nationkey as tree_label", "c_mktsegment as cluster", "c_custkey % 2 as half"), ["half"], "tree_label", "cluster"))


@query("lineage_cluster_contingency", "T9", "select c_nationkey as lineage, c_mktsegment as cluster, count(*) as n from customer group by 1,2")
def _(spark, sf):
    return tr.contingency(v.table(spark, sf, "customer").selectExpr("c_nationkey as lineage", "c_mktsegment as cluster"),
                          [], "lineage", "cluster")


def _cut_sql(groups):
    return f"""with recursive {v.SQL_TREES},
tdn as (select key, length as d from tn where parent_key is null union all select c.key, p.d+c.length from tn c join tdn p on c.parent_key=p.key),
dist as (select key, round(d,9) as d from tdn),
ch as (select parent_key as key, count(*)-1 as gain from tn where parent_key is not null group by 1),
st as (select pair, role, d, sum(gain) as gain from tn join dist using(key) join ch using(key) group by 1,2,3),
gr as (select *, sum(gain) over (partition by pair, role order by d) as b from st),
ct as (select pair, role, groups, min(d) as cut from gr, (select unnest({list(groups)!r}) as groups) where b+1>=groups group by 1,2,3),
past as (select tn.key, tn.parent_key, groups, d>cut as crossed from tn join dist using(key) join ct using(pair, role)),
walk as (select key, groups, case when crossed then key end as top from past where parent_key is null
  union all select c.key, c.groups, coalesce(w.top, case when c.crossed then c.key end) from past c join walk w on c.parent_key=w.key and c.groups=w.groups),
cutg as (select tn.pair, tn.role, groups, tn.label, top as "group" from tn join walk using(key) where tn.label is not null and top is not null)"""


@query("tree_cut_groups", "T10", _cut_sql([12]) + ' select pair, role, label, "group" from cutg')
def _(spark, sf):
    return tr.cut_trees(_links(spark, sf), 12).select("pair", "role", "label", "group")


_ARI = _cut_sql(tr.CLONES) + """, both_ as (select t.pair, t.groups, t."group" as g, e."group" as h from cutg t join cutg e on e.pair=t.pair and e.groups=t.groups and e.label=t.label and t.role='truth' and e.role='estimate'),
c as (select pair, groups, g, h, count(*)::double as n from both_ group by all),
s as (select pair, groups, sum(n*(n-1)/2) as s, sum(n) as tips from c group by 1,2),
a as (select pair, groups, sum(n*(n-1)/2) as a from (select pair, groups, g, sum(n) as n from c group by 1,2,3) group by 1,2),
b as (select pair, groups, sum(n*(n-1)/2) as b from (select pair, groups, h, sum(n) as n from c group by 1,2,3) group by 1,2),
ari as (select pair, groups, case when (a+b)/2=a*b/(tips*(tips-1)/2) then 1.0 else (s-a*b/(tips*(tips-1)/2))/((a+b)/2-a*b/(tips*(tips-1)/2)) end as v
  from s join a using(pair, groups) join b using(pair, groups))
select pair, """ + ", ".join(f"round(max(v) filter (groups={k}),6) as clone_ari_k{k}" for k in tr.CLONES) + " from ari group by 1"


@query("clone_agreement", "T8 T10 T13", _ARI)
def _(spark, sf):
    return _r(tr.clone_agreement(_links(spark, sf), tr.CLONES))


_ERA = f"""{_CLADES}, q as (select pair, role, quantile_cont(round(split_time,9),0.25) as q1, quantile_cont(round(split_time,9),0.5) as q2, quantile_cont(round(split_time,9),0.75) as q3 from ck group by 1,2),
era as (select ck.*, round(split_time,9) as st, case when round(split_time,9)<=q1 then 'earliest' when round(split_time,9)<=q2 then 'early' when round(split_time,9)<=q3 then 'late' else 'latest' end as era from ck join q on q.pair=ck.pair and q.role=ck.role)"""


def _keys(spark, sf):
    return tr.clade_keys(_clades(spark, sf)).withColumn("split_time", F.round("split_time", 9))


@query("clade_recall_by_era", "T11 X14", f"""with recursive {_ERA} select t.pair, t.era, count(*) as clades, round(avg((e.k is not null)::int),6) as recall
from era t left join (select distinct pair, k from ck where role='estimate') e on e.pair=t.pair and e.k=t.k where t.role='truth' group by 1,2""")
def _(spark, sf):
    return _r(tr.recall_by_era(_keys(spark, sf)))


@query("era_description", "T12", f"""with recursive {_ERA} select pair, role, era, count(*) as clades, round(min(st),6) as split_time_min, round(max(st),6) as split_time_max, min(size) as size_min, max(size) as size_max,
 quantile_cont(size,0.5) as size_median from era group by 1,2,3""")
def _(spark, sf):
    return _r(tr.era_description(_keys(spark, sf)))


@query("era_means", "T12", f"""with recursive {_ERA}, e as (select pair, role, era, count(*) as n, min(st) as lo, max(st) as hi, quantile_cont(size,0.5) as m from era group by 1,2,3)
select role, era, count(*) as seeds, round(avg(n),6) as mean_clades, round(avg(lo),6) as mean_split_time_min, round(avg(hi),6) as mean_split_time_max, round(avg(m),6) as mean_clade_size_median from e group by 1,2""")
def _(spark, sf):
    return _r(tr.era_means(tr.era_description(_keys(spark, sf)), ["role"]))


#: As ``unrooted_rf``, a split named by the sum of hashes of its side without the first tip.
_SPLITS = f"""with recursive {_CLADES}, hs as (select anc as key, sum(hash(label)::hugeint) as h from tup where label is not null group by 1),
whole as (select pair, role, sum(hash(label)::hugeint) as h from tn where label is not null group by 1,2),
sp as (select distinct cl.pair, cl.role, case when cl.lo<>cl.first_tip then hs.h else whole.h-hs.h end as k
  from cl join hs using(key) join whole on whole.pair=cl.pair and whole.role=cl.role where size>=2 and tips-size>=2),
m as (select pair, k, count(*) as n from sp group by 1,2)
select pair, round(count(*) filter (n=1)/sum(n),6) as unrooted_rf from m group by 1"""
_SCORES = f"""with r as materialized ({SQL['rooted_tree_scores']}), u as materialized ({_SPLITS}), t as materialized ({_triplet_sql('7t')}),
o as materialized ({_ordering_sql('7o')}), c as materialized ({_cophenetic_sql('7c')}), k as materialized ({_ARI})
select pair, truth_clades, estimate_clades, shared_clades, rooted_rf, clade_precision, clade_recall, unrooted_rf,
 triplet_agreement, ordering_agreement, pairs as drawn_pairs, cophenetic_spearman, {', '.join(f'clone_ari_k{k}' for k in tr.CLONES)}
from r left join u using(pair) left join t using(pair) left join o using(pair) left join c using(pair) left join k using(pair)"""


@query("tree_pair_scores", "T13", _SCORES)
def _(spark, sf):
    return _r(tr.score_pairs(_trees(spark, sf), "7"))


def _characters(spark, sf):
    return v.table(spark, sf, "lineitem").selectExpr("l_orderkey div 4 as cell", "l_partkey % 40 as feature", "l_quantity as q").groupBy(
        "cell", "feature").agg(F.min("q").alias("value"))


_CHAR = "ch as (select l_orderkey//4 as cell, l_partkey%40 as feature, min(l_quantity) as value from lineitem group by 1,2)"


def _wanted(spark, sf):
    orders = v.table(spark, sf, "orders")
    cells = (orders.agg(F.max("o_orderkey")).first()[0] or 0) // 4 + 1
    return orders.select(F.expr("o_orderkey div 4").alias("cell_a"), uniform_int(2, cells, "o_orderkey").alias("cell_b")).where(
        "cell_a < cell_b").distinct()


_WANT = f"wt as (select distinct o_orderkey//4 as cell_a, cast(floor({v.sql_uniform('2', 'o_orderkey')}*(select max(o_orderkey)//4+1 from orders)) as bigint) as cell_b from orders where o_orderkey//4<cast(floor({v.sql_uniform('2', 'o_orderkey')}*(select max(o_orderkey)//4+1 from orders)) as bigint))"


@query("manhattan_cell_distance", "T14", f"""with {_CHAR}, {_WANT}, g as (select cell_a, cell_b, f as feature from wt, range(0,40) r(f))
select cell_a, cell_b, round(sum(abs(coalesce(a.value,0)-coalesce(b.value,0)))/40,6) as distance from g left join ch a on a.cell=cell_a and a.feature=g.feature left join ch b on b.cell=cell_b and b.feature=g.feature group by 1,2""")
def _(spark, sf):
    return _r(tr.manhattan_pairs(_characters(spark, sf), _wanted(spark, sf), F.lit(40)))


@query("jaccard_cell_distance", "T15", f"""with {_CHAR}, {_WANT}, b_ as (select cell, list(feature) as l from ch where value>10 group by 1)
select cell_a, cell_b, round(1-len(list_intersect(a.l,b.l))/nullif(len(list_distinct(list_concat(a.l,b.l))),0),6) as distance from wt join b_ a on a.cell=cell_a join b_ b on b.cell=cell_b""")
def _(spark, sf):
    binary = _characters(spark, sf).withColumn("value", (F.col("value") > 10).cast("double"))
    return _r(tr.jaccard_pairs(binary, _wanted(spark, sf)).join(
        binary.where("value > 0").selectExpr("cell as cell_a").distinct(), "cell_a", "left_semi").join(
        binary.where("value > 0").selectExpr("cell as cell_b").distinct(), "cell_b", "left_semi"))


def _inherited(spark, sf):
    """Characters of sampled cells: the mutation events that they inherit."""
    def build():
        events = v.mutation_events(spark, sf).selectExpr("node_id", "xxhash64(node_key, seq, l_partkey, l_suppkey) as feature")
        carried = ancestry.event_cells(events, v.intervals(spark, sf), v.sampled_tips(spark, sf).select("node_id", "cell_id"))
        return carried.selectExpr("cast(cell_id as bigint) as cell", "feature", "1.0D as value").distinct()
    return v.kept(spark, sf, "inherited", build)


@query("nearest_cells_by_jaccard", "T15")
def _(spark, sf):
    return _r(nc.nearest_by_jaccard(_inherited(spark, sf), 5))


@query("nearest_cells_by_manhattan", "T14")
def _(spark, sf):
    characters = _inherited(spark, sf)
    features = characters.agg(F.count_distinct("feature").alias("n")).select("n").scalar()
    return _r(nc.nearest_by_manhattan(characters, 5, features, 32.0, tables=20), 12)


@query("expression_correlation", "T16 T17", f"""with {_CHAR}, {_WANT}, nm as (select cell, feature, ln(1+10000*value/sum(value) over (partition by cell)) as value from ch),
g as (select cell_a, cell_b, f as feature from wt, range(0,40) r(f))
select cell_a, cell_b, round(corr(ln(1+coalesce(a.value,0)),ln(1+coalesce(b.value,0))),6) as correlation from g left join nm a on a.cell=cell_a and a.feature=g.feature left join nm b on b.cell=cell_b and b.feature=g.feature group by 1,2""")
def _(spark, sf):
    normal = tr.log_normalised(_characters(spark, sf))
    genes = _characters(spark, sf).agg(F.count_distinct("feature").alias("n")).select("n").scalar()
    return _r(tr.expression_correlation(normal, _wanted(spark, sf), genes))


@query("expression_against_path_distance", "T16 L15 X8", f"""with recursive {v.SQL_UP}, {_CHAR}, {_WANT}, nm as (select cell, feature, ln(1+10000*value/sum(value) over (partition by cell)) as value from ch),
g as (select cell_a, cell_b, f as feature from wt, range(0,40) r(f)),
co as materialized (select cell_a, cell_b, round(corr(ln(1+coalesce(a.value,0)),ln(1+coalesce(b.value,0))),9) as correlation from g left join nm a on a.cell=cell_a and a.feature=g.feature left join nm b on b.cell=cell_b and b.feature=g.feature group by 1,2),
dist as (select up.node_id, sum(b.branch_length) as d from up join nodes b on b.node_id=up.anc group by 1),
tip as (select cast(cell_id as bigint) as cell, node_id from nodes where is_terminal),
wn as materialized (select cell_a, cell_b, x.node_id as na, y.node_id as nb from wt join tip x on x.cell=cell_a join tip y on y.cell=cell_b),
xa as materialized (select cell_a, cell_b, na, nb, up.anc from wn join up on up.node_id=na),
ya as materialized (select cell_a, cell_b, up.anc from wn join up on up.node_id=nb),
lc as (select cell_a, cell_b, na, nb, max(k.d) as k from xa join ya using(cell_a, cell_b, anc) join dist k on k.node_id=anc group by 1,2,3,4),
pd as (select cell_a, cell_b, round(x.d+y.d-2*k,9) as path_distance from lc join dist x on x.node_id=na join dist y on y.node_id=nb),
j as (select correlation, path_distance from co join pd using(cell_a, cell_b) where correlation is not null)
select count(*) as pairs, round(corr(rl,rr),6) as spearman from {sql_ranked('j', '', 'correlation', 'path_distance')}""")
def _(spark, sf):
    normal, wanted = tr.log_normalised(_characters(spark, sf)), _wanted(spark, sf)
    genes = _characters(spark, sf).agg(F.count_distinct("feature").alias("n")).select("n").scalar()
    correlations = tr.expression_correlation(normal, wanted, genes).withColumn("correlation", F.round("correlation", 9))
    tips = v.nodes(spark, sf).where("is_terminal").selectExpr("cast(cell_id as bigint) as cell", "node_id")
    index = v.distance_index(spark, sf)
    named = wanted.join(tips.selectExpr("cell as cell_a", "node_id as node_a"), "cell_a").join(
        tips.selectExpr("cell as cell_b", "node_id as node_b"), "cell_b")
    met = ancestry.common_ancestor(named, index, "node_a", "node_b", carry=["root_distance"]).where("same_founder")
    distances = met.select("cell_a", "cell_b", F.round(
        F.col("root_distance_a") + F.col("root_distance_b") - 2 * F.col("mrca_root_distance"), 9).alias("path_distance"))
    return _r(tr.correlation_against_distance(correlations, distances))


@query("same_inputs", "T18", "select lang, source, count(distinct md5(text))=1 as same_content from documents group by 1,2")
def _(spark, sf):
    return tr.same_inputs(v.table(spark, sf, "documents"), ["lang", "source"], "text")
