"""Checked queries: sections, capture arrays, spatial-lineage correlograms."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cladewise.functions import bins
from cladewise.operators import ancestry, pair_bins as pb, spatial as sp, tip_pairs as tp
from cladewise.operators.tables import in_large_groups
from cladewise.plans import views as v
from cladewise.plans.registry import query

BASIS = sp.plane_basis((0.2, 0.3, 0.9))
OFFSETS = {"s1": -60.0, "s2": 0.0, "s3": 75.0}
THICKNESS, PITCH, DIAMETER, ROWS, PER_ROW = 90.0, 40.0, 40.0, 24, 24
BREAKS = [0.0, 40.0, 90.0, 160.0, 260.0, float("inf")]
RECENT = [400.0, 690.5]
CAP = 700


def _r(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _sections(spark, sf):
    cells = v.cells_xyz(spark, sf)
    return sp.slice_cells(cells, BASIS, sp.centroid(cells), OFFSETS, THICKNESS)


def _array(spark):
    return sp.capture_array(spark, list(OFFSETS), PITCH, ROWS, PER_ROW, 10.0, (3.0, -2.0))


def _assigned(spark, sf):
    return v.kept(spark, sf, "assigned", lambda: sp.assign_spots(_sections(spark, sf), _array(spark), DIAMETER))


def _captured(spark, sf):
    """Captured cells with the lineage tip of the same number."""
    tips = v.nodes(spark, sf).where("is_terminal").selectExpr("cast(cell_id as bigint) as cell", "node_id")
    return _assigned(spark, sf).where("captured").join(tips, "cell")


def _thinned(spark, sf):
    carry = ["node_id", "x", "y", "z", "plane_u", "plane_v", "spot_id", "spot_u", "spot_v"]

    def build():
        return pb.stratified_pairs(_captured(spark, sf), ["slice_id"], "cell", carry, ["plane_u", "plane_v"], BREAKS, CAP, 2)
    return sp.pair_distances(v.kept(spark, sf, "drawn_pairs", build))


def _index(spark, sf):
    """Ancestry of the captured cells."""
    return v.index_above(spark, sf, "captured", _captured(spark, sf).select("node_id"))


def _related(spark, sf):
    def build():
        return ancestry.pair_relations(_thinned(spark, sf), _index(spark, sf), "node_id_a", "node_id_b")
    return v.kept(spark, sf, "related_pairs", build)


def _null(spark, sf):
    pairs = _related(spark, sf).select("slice_id", "cell_a", "cell_b", "distance_bin")
    shuffled = sp.permuted_pairs(pairs, _captured(spark, sf), ["slice_id"], "cell", "node_id", 3, 5)
    return sp.permutation_null(ancestry.pair_relations(
        shuffled, _index(spark, sf), "permuted_a", "permuted_b"), ["slice_id"], RECENT)


def _dot(axis):
    a, b, c = BASIS[axis]
    return f"((x-cx)*{a!r} + (y-cy)*{b!r} + (z-cz)*{c!r})"


_ANGLE = 10 * math.pi / 180
_OFFSET_ROWS = ", ".join(f"('{k}', {o!r}::double)" for k, o in OFFSETS.items())
_LABELS = bins.labels(BREAKS)


def _bin_sql(value, breaks, names, right=False):
    parts = []
    for i, (lo, hi) in enumerate(zip(breaks, breaks[1:])):
        upper = "" if math.isinf(hi) else f" and {value} {'<=' if right else '<'} {hi!r}"
        lower = f"{value} {'>' if right and i else '>='} {lo!r}"
        parts.append(f"when {lower}{upper} then '{names[i]}'")
    return "case " + " ".join(parts) + " end"


def _drawn_sql(cells, group, coords, breaks, names, cap, seed, right=False, of=""):
    """Tables crv{of}, num{of} (pairs with their number in the bin) and thin{of} (with the drawn ones' place ``rn``)."""
    sets = [f"least(floor(({c}-lo{i})/side*65536.0),65535)::bigint as q{i}" for i, c in enumerate(coords)]
    bits = "+".join(f"(((q{i}>>z)&1)<<({len(coords)}*z+{i}))" for i in range(len(coords)))
    far = "sqrt(" + "+".join(f"(a.{c}-b.{c})*(a.{c}-b.{c})" for c in coords) + ")"
    keyed = f"{group}||'|'||" if group != "0" else ""
    extents = [f"max({c})-min({c})" for c in coords]
    return f"""ext{of} as (select {group} as g, {', '.join(f'min({c}) as lo{i}' for i, c in enumerate(coords))}, greatest({', '.join(extents)}) as side from {cells} group by 1),
grd{of} as (select c.*, {group} as g, {', '.join(sets)} from {cells} c join ext{of} e on e.g={group}),
crv{of} as (select *, row_number() over (partition by g order by list_sum([{bits} for z in range(16)]), cell)-1 as p from grd{of}),
num0{of} as (select a.g, a.cell as one, b.cell as two, a.p as pa, b.p as pb, {far} as d from crv{of} a join crv{of} b on a.g=b.g and a.p<b.p),
num1{of} as (select *, {_bin_sql('d', breaks, list(range(len(breaks) - 1)), right).replace("'", "")} as bin from num0{of}),
num{of} as (select *, {'case bin ' + ' '.join(f"when {i} then '{n}'" for i, n in enumerate(names)) + ' end'} as distance_bin, count(*) over w as candidate_pairs,
  row_number() over (w order by pa//{pb.LEAF}, pb//{pb.LEAF}, pa, pb)-1 as m from num1{of} where bin is not null window w as (partition by g, bin)),
riv{of} as (select distinct g, bin, candidate_pairs, case when candidate_pairs>{4 * cap}
    then cast(floor({v.sql_uniform(str(seed), keyed.replace(group, 'g') + "bin||'|'||j")}*candidate_pairs) as bigint) else j end as m
  from (select distinct g, bin, candidate_pairs, unnest(range(least(candidate_pairs,{4 * cap}))) as j from num{of})),
pck{of} as (select *, row_number() over (partition by g, bin order by md5('{seed}|pick|'||{keyed.replace(group, 'g')}bin||'|'||m), m) as rn from riv{of}),
thin{of} as (select num{of}.*, rn from num{of} join pck{of} using(g, bin, m) where rn<={cap})"""


_SEC = f"""{v.SQL_XYZ}, ctr as (select avg(x) as cx, avg(y) as cy, avg(z) as cz from xyz),
off(slice_id, slice_offset) as (values {_OFFSET_ROWS}),
proj as (select xyz.*, {_dot('u')} as plane_u, {_dot('v')} as plane_v, {_dot('normal')} as plane_w from xyz, ctr),
sec as (select proj.*, slice_id, slice_offset, plane_w-slice_offset as distance_from_midplane from proj join off
  on abs(plane_w-slice_offset)<={THICKNESS / 2!r})"""
_SPOTS = f"""lat as (select r as array_row, 2*w+r%2 as array_col from range({ROWS}) a(r), range({PER_ROW}) b(w)),
raw as (select array_row, array_col, array_col*{PITCH / 2!r}-(select (min(array_col)+max(array_col))/2 from lat)*{PITCH / 2!r} as ru,
  array_row*{PITCH * math.sqrt(3) / 2!r}-{(ROWS - 1) * PITCH * math.sqrt(3) / 4!r} as rv from lat),
spots as (select slice_id, array_row::int as array_row, array_col::int as array_col, slice_id||'_r'||lpad(array_row::varchar,2,'0')||'_c'||lpad(array_col::varchar,3,'0') as spot_id,
  {math.cos(_ANGLE)!r}*ru-{math.sin(_ANGLE)!r}*rv+3.0 as spot_u, {math.sin(_ANGLE)!r}*ru+{math.cos(_ANGLE)!r}*rv-2.0 as spot_v from raw, off)"""
_ASG = f"""{_SEC}, {_SPOTS},
near as (select c.cell, c.slice_id, arg_min(struct_pack(spot_id:=spot_id, array_row:=array_row, array_col:=array_col, spot_u:=spot_u, spot_v:=spot_v,
   d:=sqrt((spot_u-plane_u)*(spot_u-plane_u)+(spot_v-plane_v)*(spot_v-plane_v))),
   (spot_u-plane_u)*(spot_u-plane_u)+(spot_v-plane_v)*(spot_v-plane_v)) as s
  from sec c join spots using(slice_id) group by 1,2),
asg as (select sec.*, s.d<={DIAMETER / 2!r} as captured, case when s.d<={DIAMETER / 2!r} then s.spot_id end as spot_id,
  case when s.d<={DIAMETER / 2!r} then s.spot_u end as spot_u, case when s.d<={DIAMETER / 2!r} then s.spot_v end as spot_v,
  case when s.d<={DIAMETER / 2!r} then s.array_row end as array_row, case when s.d<={DIAMETER / 2!r} then s.array_col end as array_col,
  case when s.d<={DIAMETER / 2!r} then s.d end as distance_to_spot_center
  from sec join near using(cell, slice_id))"""
_REL = f"""{v.SQL_UP}, {_ASG},
cap as (select asg.*, n.node_id, n.end_time from asg join nodes n on n.is_terminal and cast(n.cell_id as bigint)=asg.cell where captured),
{_drawn_sql('cap', 'slice_id', ['plane_u', 'plane_v'], BREAKS, _LABELS, CAP, 2)},
prs as (select a.slice_id, a.cell as cell_a, b.cell as cell_b, a.node_id as node_a, b.node_id as node_b, a.spot_id as spot_a, b.spot_id as spot_b,
  distance_bin, candidate_pairs, sqrt((a.plane_u-b.plane_u)**2+(a.plane_v-b.plane_v)**2) as distance_2d, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) as distance_3d,
  sqrt((a.spot_u-b.spot_u)**2+(a.spot_v-b.spot_v)**2) as spot_distance, a.spot_id=b.spot_id as same_spot
  from thin join cap a on a.slice_id=g and a.cell=least(one,two) join cap b on b.slice_id=g and b.cell=greatest(one,two)),
capn as (select distinct node_id, end_time from cap),
upc as (select up.* from up join capn using(node_id)),
lca as (select x.node_id as na, y.node_id as nb, arg_min(x.anc, x.steps) as mrca, min(x.steps+y.steps) as dd from upc x join upc y on x.anc=y.anc group by 1,2),
lc as (select a.node_id as na, b.node_id as nb, mrca, dd, mrca is not null as same_founder, a.end_time+b.end_time-2*coalesce(m.end_time,0) as pd
  from capn a cross join capn b left join lca on lca.na=a.node_id and lca.nb=b.node_id left join nodes m on m.node_id=mrca),
rel as (select t.*, dd as division_distance, same_founder, pd as patristic_distance, pd/2 as mrca_age from prs t join lc on lc.na=t.node_a and lc.nb=t.node_b)"""
_GRID = f"grid as (select distinct slice_id, l as distance_bin, i-1 as bin_no from cap, (select unnest({_LABELS!r}) as l, unnest(range(1,{len(_LABELS) + 1})) as i))"


def _recent_sql(tail=""):
    return ", ".join(f"avg((mrca_age<={t!r})::int) as recent_mrca_le_{bins.suffix(t)}_fraction{tail}" for t in RECENT)


_COR = f"""{_REL}, {_GRID},
cor as (select slice_id, distance_bin, max(candidate_pairs) as candidate_pairs, count(*) as evaluated_pairs, avg(distance_2d) as mean_distance_2d,
 avg(distance_3d) as mean_distance_3d, avg(mrca_age) as mean_mrca_age, avg(patristic_distance) as mean_patristic_distance,
 avg(division_distance) as mean_division_distance, avg(same_founder::int) as same_founder_fraction, avg(same_spot::int) as same_spot_fraction,
 {_recent_sql()}, quantile_cont(mrca_age,0.5) as median_mrca_age from rel group by 1,2),
corg as (select g.slice_id, g.distance_bin, g.bin_no, c.* exclude(slice_id, distance_bin) replace(coalesce(candidate_pairs,0) as candidate_pairs, coalesce(evaluated_pairs,0) as evaluated_pairs)
 from grid g left join cor c on c.slice_id=g.slice_id and c.distance_bin=g.distance_bin)"""
_NULL = """pos as (select slice_id, cell, row_number() over (partition by slice_id order by cell) as rk from cap),
perm as (select p as permutation, slice_id, node_id, row_number() over (partition by slice_id, p order by md5('5|'||p||'|'||cell), cell) as rk from cap, range(1,4) t(p)),
dealt as (select perm.permutation, perm.slice_id, pos.cell, perm.node_id from perm join pos using(slice_id, rk)),
nul0 as (select r.slice_id, r.distance_bin, a.permutation, avg(pd/2) as m, """ + ", ".join(
    f"avg((pd/2<={t!r})::int) as f{i}" for i, t in enumerate(RECENT)) + """ from rel r join dealt a on a.slice_id=r.slice_id and a.cell=r.cell_a
  join dealt b on b.slice_id=r.slice_id and b.cell=r.cell_b and b.permutation=a.permutation join lc on lc.na=a.node_id and lc.nb=b.node_id group by all),
nul as (select slice_id, distance_bin, avg(m) as null_mean_mrca_age, """ + ", ".join(
    f"avg(f{i}) as recent_mrca_le_{bins.suffix(t)}_fraction_null" for i, t in enumerate(RECENT)) + " from nul0 group by 1,2)"


def _round_sql(columns):
    return ", ".join(f"round({c},6) as {c}" for c in columns)


_COR_DOUBLES = ["mean_distance_2d", "mean_distance_3d", "mean_mrca_age", "mean_patristic_distance", "mean_division_distance",
                "same_founder_fraction", "same_spot_fraction", "median_mrca_age",
                *[f"recent_mrca_le_{bins.suffix(t)}_fraction" for t in RECENT]]


@query("section_slices", "P5 P6 V7", f"with {_SEC} select cell, slice_id, {_round_sql(['plane_u', 'plane_v', 'plane_w', 'distance_from_midplane'])} from sec")
def _(spark, sf):
    return _r(_sections(spark, sf).select("cell", "slice_id", "plane_u", "plane_v", "plane_w", "distance_from_midplane"))


@query("nearest_spot_capture", "J4 S20", f"with {_ASG} select cell, slice_id, captured, spot_id, array_row, array_col, {_round_sql(['distance_to_spot_center'])} from asg")
def _(spark, sf):
    return _r(_assigned(spark, sf).select("cell", "slice_id", "captured", "spot_id", "array_row", "array_col",
                                          "distance_to_spot_center"))


@query("spot_occupancy", "J4 S20 V8 F16", f"""with {_ASG}, n as (select spot_id, count(*) as n from asg where captured group by 1)
select spot_id, 'SIM-'||slice_id||'-r'||lpad(array_row::varchar,2,'0')||'-c'||lpad(array_col::varchar,3,'0') as barcode, coalesce(n,0) as n_cells, (n is not null)::int as in_tissue,
 round(spot_u*{BASIS['u'][0]!r}+spot_v*{BASIS['v'][0]!r}+cx+slice_offset*{BASIS['normal'][0]!r},6) as x,
 round(spot_u*{BASIS['u'][1]!r}+spot_v*{BASIS['v'][1]!r}+cy+slice_offset*{BASIS['normal'][1]!r},6) as y,
 round(spot_u*{BASIS['u'][2]!r}+spot_v*{BASIS['v'][2]!r}+cz+slice_offset*{BASIS['normal'][2]!r},6) as z
from spots left join n using(spot_id) join off using(slice_id), ctr""")
def _(spark, sf):
    used = sp.spot_occupancy(_array(spark), _assigned(spark, sf))
    return _r(sp.spot_positions(used, BASIS, sp.centroid(v.cells_xyz(spark, sf)), OFFSETS).select(
        "spot_id", "barcode", "n_cells", "in_tissue", "x", "y", "z"))


@query("stratified_cell_pairs", "V1 V2 J5 J6 V11", f"""with recursive {_REL} select slice_id, cell_a, cell_b, distance_bin, candidate_pairs, same_spot,
 {_round_sql(['distance_2d', 'distance_3d', 'spot_distance'])} from rel""")
def _(spark, sf):
    return _r(_thinned(spark, sf).select("slice_id", "cell_a", "cell_b", "distance_bin", "candidate_pairs", "same_spot",
                                         "distance_2d", "distance_3d", "spot_distance"))


@query("sampled_cell_pairs", "J5", f"""with {v.SQL_XYZ}, n as (select count(*) as n from xyz), rk as (select cell, row_number() over (order by cell) as r from xyz),
d as (select i as pair_no, 1+cast(floor({v.sql_uniform('9a', 'i')}*n) as bigint) as x, 1+cast(floor({v.sql_uniform('9b', 'i')}*(n-1)) as bigint) as y0
  from n, range(0,400) t(i)), e as (select pair_no, x, y0+(y0>=x)::int as y from d)
select pair_no, a.cell as cell_a, b.cell as cell_b, 'uniform_pairs_with_replacement' as sampling_mode, n*(n-1)//2 as total_pairs
from e join rk a on a.r=least(x,y) join rk b on b.r=greatest(x,y), n""")
def _(spark, sf):
    return sp.cell_pairs(v.cells_xyz(spark, sf), [], "cell", [], 9, 400).select(
        "pair_no", "cell_a", "cell_b", "sampling_mode", "total_pairs")


@query("lineage_correlogram", "V3 V7 L5", f"with recursive {_COR} select slice_id, distance_bin, bin_no, candidate_pairs, evaluated_pairs, {_round_sql(_COR_DOUBLES)} from corg")
def _(spark, sf):
    return _r(sp.correlogram(_related(spark, sf), ["slice_id"], _LABELS, RECENT, _captured(spark, sf)))


@query("permutation_null", "V5", f"with recursive {_REL}, {_NULL} select slice_id, distance_bin, " + _round_sql(
    ["null_mean_mrca_age", *[f"recent_mrca_le_{bins.suffix(t)}_fraction_null" for t in RECENT]]) + " from nul")
def _(spark, sf):
    return _r(_null(spark, sf))


def _contrast(spark, sf):
    observed = sp.correlogram(_related(spark, sf), ["slice_id"], _LABELS, RECENT, _captured(spark, sf))
    return v.kept(spark, sf, "contrast", lambda: sp.contrast_with_null(observed, _null(spark, sf), ["slice_id"], RECENT))


_CONTRAST = f"""{_COR}, {_NULL}, con as (select c.*, nul.* exclude(slice_id, distance_bin), null_mean_mrca_age-mean_mrca_age as mrca_age_reduction, """ + ", ".join(
    f"case when recent_mrca_le_{s}_fraction_null>0 then recent_mrca_le_{s}_fraction/recent_mrca_le_{s}_fraction_null "
    f"when recent_mrca_le_{s}_fraction_null<=0 and recent_mrca_le_{s}_fraction>0 then 'inf'::double end as recent_mrca_le_{s}_fraction_enrichment"
    for s in map(bins.suffix, RECENT)) + " from corg c left join nul on nul.slice_id=c.slice_id and nul.distance_bin=c.distance_bin)"
_CON_DOUBLES = ["mean_mrca_age", "null_mean_mrca_age", "mrca_age_reduction",
                *[f"recent_mrca_le_{bins.suffix(t)}_fraction_enrichment" for t in RECENT]]


@query("correlogram_against_null", "V3 V5 J8 F6", f"with recursive {_CONTRAST} select slice_id, distance_bin, evaluated_pairs, {_round_sql(_CON_DOUBLES)} from con")
def _(spark, sf):
    return _r(_contrast(spark, sf).select("slice_id", "distance_bin", "evaluated_pairs", *_CON_DOUBLES))


@query("enrichment_curves", "V10 V17", f"""with recursive {_CONTRAST} select slice_id, distance_bin, 'observed' as curve, round(mean_mrca_age,6) as value from con
union all select slice_id, distance_bin, 'null', round(null_mean_mrca_age,6) from con
union all select slice_id, distance_bin, 'enrichment', round(recent_mrca_le_400_fraction_enrichment,6) from con""")
def _(spark, sf):
    return _r(sp.observed_and_null_curves(_contrast(spark, sf), ["slice_id", "distance_bin"], {
        "observed": "mean_mrca_age", "null": "null_mean_mrca_age", "enrichment": "recent_mrca_le_400_fraction_enrichment"}))


@query("replicate_pooling", "V9 X23 O4", f"""with recursive {_CONTRAST}, r as (select case when slice_id='s3' then 'r2' else 'r1' end as replicate, * from con),
a as (select replicate, distance_bin, count(*) as slices, sum(candidate_pairs) as candidate_pairs, sum(evaluated_pairs) as evaluated_pairs,
  avg(mean_mrca_age) as m, avg(mrca_age_reduction) as d from r group by 1,2)
select distance_bin, count(*) as replicates, count(*) filter (evaluated_pairs>0) as replicates_with_pairs, sum(slices)::bigint as slices, sum(candidate_pairs)::bigint as candidate_pairs,
 sum(evaluated_pairs)::bigint as evaluated_pairs, round(avg(m),6) as mean_mrca_age_mean, round(stddev_samp(m),6) as mean_mrca_age_sd, round(stddev_samp(m)/sqrt(count(m)),6) as mean_mrca_age_se,
 round(avg(d),6) as mrca_age_reduction_mean, round(stddev_samp(d),6) as mrca_age_reduction_sd, round(stddev_samp(d)/sqrt(count(d)),6) as mrca_age_reduction_se from a group by 1""")
def _(spark, sf):
    from cladewise.operators.tables import numeric_columns
    slices = _contrast(spark, sf).withColumn("replicate", F.when(F.col("slice_id") == "s3", "r2").otherwise("r1")).select(
        "replicate", "distance_bin", "candidate_pairs", "evaluated_pairs", "mean_mrca_age", "mrca_age_reduction")
    metrics = numeric_columns(slices, ["candidate_pairs", "evaluated_pairs"])
    return _r(sp.two_stage_means(slices, ["replicate", "distance_bin"], ["distance_bin"],
                                 ["candidate_pairs", "evaluated_pairs"], metrics, having="evaluated_pairs"))


_EDGES, _SPOT_NAMES = sp.spot_pair_breaks(PITCH)
_SPOTPAIR = f"""{_REL}, spx as (select slice_id, least(spot_a,spot_b) as spot_first, greatest(spot_a,spot_b) as spot_second, avg(spot_distance) as spot_distance,
 count(*) as contributing_cell_pairs, avg(mrca_age) as mean_mrca_age, avg(patristic_distance) as mean_patristic_distance, avg(division_distance) as mean_division_distance,
 avg(same_founder::int) as same_founder_fraction, quantile_cont(mrca_age,0.5) as median_mrca_age from rel group by 1,2,3),
spb as (select *, {_bin_sql('spot_distance', _EDGES, _SPOT_NAMES)} as distance_bin from spx)"""
_SPD = ["spot_distance", "mean_mrca_age", "mean_patristic_distance", "mean_division_distance", "same_founder_fraction", "median_mrca_age"]


@query("spot_pair_lineage", "V4", f"with recursive {_SPOTPAIR} select slice_id, spot_first, spot_second, contributing_cell_pairs, distance_bin, {_round_sql(_SPD)} from spb")
def _(spark, sf):
    return _r(sp.spot_pair_table(_related(spark, sf), ["slice_id"], PITCH))


@query("spot_pair_summary", "V4", f"""with recursive {_SPOTPAIR}, g as (select distinct slice_id, l as distance_bin, i as bin_no from spb, (select unnest({_SPOT_NAMES!r}) as l, unnest(range(0,{len(_SPOT_NAMES)})) as i)),
s as (select slice_id, distance_bin, count(*) as spot_pairs, sum(contributing_cell_pairs) as contributing_cell_pairs, avg(spot_distance) as spot_distance, avg(mean_mrca_age) as mean_mrca_age,
 avg(mean_patristic_distance) as mean_patristic_distance, avg(mean_division_distance) as mean_division_distance, avg(same_founder_fraction) as same_founder_fraction,
 quantile_cont(median_mrca_age,0.5) as median_mrca_age from spb group by 1,2)
select g.slice_id, g.distance_bin, bin_no, coalesce(spot_pairs,0) as spot_pairs, coalesce(contributing_cell_pairs,0)::bigint as contributing_cell_pairs, {_round_sql(_SPD)}
from g left join s on s.slice_id=g.slice_id and s.distance_bin=g.distance_bin""")
def _(spark, sf):
    return _r(sp.spot_pair_summary(sp.spot_pair_table(_related(spark, sf), ["slice_id"], PITCH), ["slice_id"], PITCH))


@query("replicate_pooling_spots", "V9", f"""with recursive {_SPOTPAIR}, g as (select distinct slice_id, l as distance_bin from spb, (select unnest({_SPOT_NAMES!r}) as l)),
s as (select slice_id, distance_bin, count(*) as spot_pairs, sum(contributing_cell_pairs) as contributing_cell_pairs, avg(mean_mrca_age) as m, quantile_cont(median_mrca_age,0.5) as d from spb group by 1,2),
r as (select case when g.slice_id='s3' then 'r2' else 'r1' end as replicate, g.distance_bin, coalesce(spot_pairs,0) as spot_pairs, coalesce(contributing_cell_pairs,0) as contributing_cell_pairs, m, d
  from g left join s on s.slice_id=g.slice_id and s.distance_bin=g.distance_bin),
a as (select replicate, distance_bin, count(*) as slices, sum(spot_pairs) as spot_pairs, sum(contributing_cell_pairs) as contributing_cell_pairs, avg(m) as m, avg(d) as d from r group by 1,2)
select distance_bin, count(*) as replicates, count(*) filter (spot_pairs>0) as replicates_with_pairs, sum(slices)::bigint as slices, sum(spot_pairs)::bigint as spot_pairs, sum(contributing_cell_pairs)::bigint as contributing_cell_pairs,
 round(avg(m),6) as mean_mrca_age_mean, round(stddev_samp(m),6) as mean_mrca_age_sd, round(stddev_samp(m)/sqrt(count(m)),6) as mean_mrca_age_se,
 round(avg(d),6) as median_mrca_age_mean, round(stddev_samp(d),6) as median_mrca_age_sd, round(stddev_samp(d)/sqrt(count(d)),6) as median_mrca_age_se from a group by 1""")
def _(spark, sf):
    spots = sp.spot_pair_summary(sp.spot_pair_table(_related(spark, sf), ["slice_id"], PITCH), ["slice_id"], PITCH)
    slices = spots.withColumn("replicate", F.when(F.col("slice_id") == "s3", "r2").otherwise("r1")).select(
        "replicate", "distance_bin", "spot_pairs", "contributing_cell_pairs", "mean_mrca_age", "median_mrca_age")
    return _r(sp.two_stage_means(slices, ["replicate", "distance_bin"], ["distance_bin"], ["spot_pairs", "contributing_cell_pairs"],
                                 ["mean_mrca_age", "median_mrca_age"], having="spot_pairs"))


def sql_ranked(table, keys, left, right):
    """Average ranks of two columns in the SQL of the checks."""
    part = f"partition by {keys}" if keys else ""

    def rank(c):
        own = f"partition by {keys}, {c}" if keys else f"partition by {c}"
        return f"rank() over ({part} order by {c}) + (count(*) over ({own})-1)/2.0"
    return f"(select {keys + ', ' if keys else ''}{rank(left)} as rl, {rank(right)} as rr from {table} where {left} is not null and {right} is not null)"


@query("slice_overview", "V6 X8", f"""with recursive {_REL}, c as (select slice_id, count(*) as section_cells, count(*) filter (captured) as captured_cells from asg group by 1),
o as (select slice_id, avg(n) as a, count(*) as b from (select slice_id, spot_id, count(*) as n from asg where captured group by 1,2) group by 1),
s as (select slice_id, count(*) as n, case when count(*)>=3 then corr(rl, rr) end as s from {sql_ranked('rel', 'slice_id', 'distance_2d', 'mrca_age')} group by 1)
select slice_id, section_cells, captured_cells, captured_cells*(captured_cells-1)/2 as possible_pairs, coalesce(n,0) as evaluated_pairs, round(s,6) as spearman_distance_vs_mrca,
 round(coalesce(a,0),6) as mean_cells_per_occupied_spot, coalesce(b,0) as occupied_spots, round(captured_cells/section_cells,6) as capture_fraction
from c left join o using(slice_id) left join s using(slice_id)""")
def _(spark, sf):
    return _r(sp.slice_overview(_assigned(spark, sf), _related(spark, sf), ["slice_id"]))


@query("section_statistics", "V12 X8", f"""with recursive {_REL},
b as (select slice_id, count(*) as plotted_pairs, count(*) filter (same_spot) as within_spot_pairs, avg(mrca_age) filter (same_spot) as within_spot_mean_mrca from rel group by 1),
s as (select slice_id, corr(rl, rr) as s from {sql_ranked('rel', 'slice_id', 'distance_2d', 'mrca_age')} group by 1),
d as (select slice_id, corr(rl, rr) as d from {sql_ranked('rel', 'slice_id', 'distance_2d', 'division_distance')} group by 1)
select slice_id, plotted_pairs, within_spot_pairs, round(within_spot_mean_mrca,6) as within_spot_mean_mrca, round(s,6) as spearman_distance_vs_mrca, round(d,6) as spearman_distance_vs_divisions
from b left join s using(slice_id) left join d using(slice_id)""")
def _(spark, sf):
    return _r(sp.section_statistics(_related(spark, sf), ["slice_id"]))


@query("same_spot_pairs", "V17", f"with recursive {_REL} select slice_id, cell_a, cell_b, round(mrca_age,6) as mrca_age from rel where same_spot")
def _(spark, sf):
    return _r(_related(spark, sf).where("same_spot").select("slice_id", "cell_a", "cell_b", "mrca_age"))


_FB = [0.0, 100.0, 200.0, 300.0, 1000.0]
_FL = bins.labels(_FB, True)
_XYZ = ["x", "y", "z"]


_FOUNDER = f"""{v.SQL_XYZ}, pr as (select a.cell as cell_a, b.cell as cell_b, a.founder as fa, b.founder as fb, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) as d
  from xyz a join xyz b on a.cell<b.cell), bn as (select *, {_bin_sql('d', _FB, bins.labels(_FB, True), True)} as distance_bin from pr),
pos as (select cell, row_number() over (order by cell) as rk from xyz),
perm as (select p, founder, row_number() over (partition by p order by md5('4|'||p||'|'||cell), cell) as rk from xyz, range(1,3) t(p)),
dealt as (select p, cell, founder from perm join pos using(rk)),
nul as (select avg(s) as s from (select a.p, avg((a.founder=b.founder)::int) as s from pr join dealt a on a.cell=cell_a join dealt b on b.cell=cell_b and b.p=a.p group by 1)),
btw as (select distance_bin, count(*) as pairs, avg(d) as mean_distance, avg((fa=fb)::int) as same_founder_fraction, (select s from nul) as null_same_founder_fraction
 from bn where distance_bin is not null group by 1)"""


@query("same_founder_by_distance", "V13 J7", f"with {_FOUNDER} select distance_bin, pairs, {_round_sql(['mean_distance', 'same_founder_fraction', 'null_same_founder_fraction'])} from btw")
def _(spark, sf):
    found = pb.same_founder_by_distance(v.cells_xyz(spark, sf), [], "cell", "founder", _XYZ, _FB, None, 4)
    return _r(found.drop("evaluated_pairs"))


@query("same_founder_of_drawn_pairs", "V13 J5", f"""with {v.SQL_XYZ}, n as (select count(*) as n from xyz), rk as (select *, row_number() over (order by cell) as r from xyz),
d as (select i as pair_no, 1+cast(floor({v.sql_uniform('4a', 'i')}*n) as bigint) as x, 1+cast(floor({v.sql_uniform('4b', 'i')}*(n-1)) as bigint) as y0 from n, range(0,3000) t(i)),
e as (select pair_no, least(x, y0+(y0>=x)::int) as i, greatest(x, y0+(y0>=x)::int) as j from d),
pr as (select a.cell as cell_a, b.cell as cell_b, a.founder as fa, b.founder as fb, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) as d from e join rk a on a.r=i join rk b on b.r=j),
bn as (select *, {_bin_sql('d', _FB, _FL, True)} as distance_bin from pr),
perm as (select p, founder, row_number() over (partition by p order by md5('4|'||p||'|'||cell), cell) as rk from xyz, range(1,3) t(p)),
dealt as (select p, cell, perm.founder from perm join rk on perm.rk=rk.r),
nul as (select avg(s) as s from (select a.p, avg((a.founder=b.founder)::int) as s from pr join dealt a on a.cell=cell_a join dealt b on b.cell=cell_b and b.p=a.p group by 1))
select distance_bin, count(*) as pairs, round(avg(d),6) as mean_distance, round(avg((fa=fb)::int),6) as same_founder_fraction, round((select s from nul),6) as null_same_founder_fraction
from bn where distance_bin is not null group by 1""")
def _(spark, sf):
    return _r(sp.same_founder_by_distance(v.cells_xyz(spark, sf), [], "cell", "founder", _FB, 2, 4, 3000))


_ORG = f"""{v.SQL_XYZ}, o as (select *, cell%4 as organoid from xyz), pr as (select a.organoid, a.cell as cell_a, b.cell as cell_b, a.founder as fa, b.founder as fb, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) as d
  from o a join o b on a.cell<b.cell and a.organoid=b.organoid), bn as (select *, {_bin_sql('d', _FB, bins.labels(_FB, True), True)} as distance_bin from pr),
g as (select organoid, distance_bin, count(*) as pairs, avg(d) as mean_distance, avg((fa=fb)::int) as v from bn where distance_bin is not null group by 1,2)
select distance_bin, count(*) as groups, sum(pairs)::bigint as pairs, round(avg(mean_distance),6) as mean_distance, round(avg(v),6) as value,
 round(avg(v)-1.96*stddev_samp(v)/sqrt(count(*)),6) as lower, round(avg(v)+1.96*stddev_samp(v)/sqrt(count(*)),6) as upper from g group by 1"""


@query("same_founder_bin_summary", "V15 X1", f"with {_ORG}")
def _(spark, sf):
    cells = v.cells_xyz(spark, sf).withColumn("organoid", F.col("cell") % 4)
    per = pb.same_founder_by_distance(cells, ["organoid"], "cell", "founder", _XYZ, _FB, None, 4, permutations=1)
    error = F.stddev_samp("same_founder_fraction") / F.sqrt(F.count(F.lit(1)).cast("double"))
    value = F.avg("same_founder_fraction")
    return _r(per.groupBy("distance_bin").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("pairs").alias("pairs"), F.avg("mean_distance").alias("mean_distance"),
        value.alias("value"), (value - 1.96 * error).alias("lower"), (value + 1.96 * error).alias("upper")))


def _within_clones(spark, sf):
    """Every pair of cells of a clone with at least eight, each with its lineage tip and place."""
    tips = v.nodes(spark, sf).where("is_terminal").selectExpr("cast(cell_id as bigint) as cell", "node_id")
    cells = v.kept(spark, sf, "clone_tips", lambda: v.cells_xyz(spark, sf).join(tips, "cell"))
    paths, index = v.ways_above(spark, sf, "clones", cells.select("node_id"))
    large = in_large_groups(cells.join(paths.select("node_id", "root"), "node_id"), ["root"], 8)
    return tp.WithinClones(large, ["root"], "cell", _XYZ, index)


_CLONE = f"""{v.SQL_UP}, {v.SQL_XYZ},
dist as (select up.node_id, sum(b.branch_length) as d from up join nodes b on b.node_id=up.anc group by 1),
m0 as (select xyz.*, n.node_id, d.d, r.anc as root from xyz join nodes n on n.is_terminal and cast(n.cell_id as bigint)=xyz.cell join dist d on d.node_id=n.node_id
  join up r on r.node_id=n.node_id and r.nxt is null),
m as (select * from m0 where root in (select root from m0 group by 1 having count(*)>=8)),
upc as (select up.* from up join m using(node_id)),
lca as (select x.node_id as na, y.node_id as nb, arg_min(x.anc, x.steps) as mrca from upc x join upc y on x.anc=y.anc group by 1,2),
pr as (select a.root, a.cell as cell_a, b.cell as cell_b, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) as spatial, a.d+b.d-2*k.d as lineage
  from m a join m b on a.root=b.root and a.cell<b.cell join lca on na=a.node_id and nb=b.node_id join dist k on k.node_id=mrca),
okay as (select root from pr group by 1 having count(*)>=10 and stddev_pop(lineage)>0)"""


#: Permutations behind the null of a clone, as published.
_PERMUTATIONS = 20


@query("within_clone_space_and_lineage", "V14 L15 X8", f"""with recursive {_CLONE},
obs_ as (select root, count(*) as pairs, corr(rl,rr) as spearman from {sql_ranked('pr', 'root', 'spatial', 'lineage')} group by 1),
pos as (select root, cell, row_number() over (partition by root order by cell) as rk from m),
perm as (select p, root, x, y, z, row_number() over (partition by root, p order by md5('6|'||p||'|'||cell), cell) as rk from m, range(1,{_PERMUTATIONS + 1}) t(p)),
dealt as (select p, root, cell, x, y, z from perm join pos using(root, rk)),
pp as (select pr.root, a.p, pr.root||'#'||a.p as rp, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) as spatial, lineage from pr join dealt a on a.cell=cell_a join dealt b on b.cell=cell_b and b.p=a.p),
pn as (select split_part(rp,'#',1) as root, avg(s) as null_mean, stddev_samp(s) as null_sd from (select rp, corr(rl,rr) as s from {sql_ranked('pp', 'rp', 'spatial', 'lineage')} group by 1) group by 1)
select root, pairs, round(spearman,6) as spearman, round(null_mean,6) as null_mean, round(null_sd,6) as null_sd from obs_ join okay using(root) left join pn using(root)""")
def _(spark, sf):
    return _r(_within_clones(spark, sf).correlation(_PERMUTATIONS, 6))


@query("within_clone_bins", "V14", f"""with recursive {_CLONE}, bn as (select pr.*, {_bin_sql('spatial', _FB, _FL, True)} as distance_bin from pr join okay using(root))
select root, distance_bin, count(*) as pairs, round(avg(spatial),6) as mean_distance, round(avg(lineage),6) as mean_lineage_distance from bn where distance_bin is not null group by 1,2""")
def _(spark, sf):
    return _r(_within_clones(spark, sf).distance_bins(_FB))


@query("projection_distortion", "V18", f"""with recursive {_REL} select cast(least(floor(distance_2d/20.0),24) as int) as bin_x, cast(least(floor((distance_3d-distance_2d)/8.0),24) as int) as bin_y, count(*) as pairs
from rel group by 1,2""")
def _(spark, sf):
    return sp.projection_distortion(_related(spark, sf), 25, 500.0, 200.0)


@query("rescaled_positions", "P16 V16", f"""with {v.SQL_XYZ}, a as (select min(x) as lo, max(x) as hi from xyz), b as (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer)
select cell, round(b.lo+(x-a.lo)/(a.hi-a.lo)*(b.hi-b.lo),6) as scaled_x, round((b.lo+b.hi)/2,6) as scaled_constant, round(sqrt(x*x+y*y+z*z),6) as radius from xyz, a, b""")
def _(spark, sf):
    cells = v.cells_xyz(spark, sf).withColumn("constant", F.lit(3.0))
    ref = v.table(spark, sf, "customer")
    scaled = sp.min_max_rescale(cells, "x", ref, "c_acctbal", "scaled_x")
    scaled = sp.min_max_rescale(scaled, "constant", ref, "c_acctbal", "scaled_constant")
    return _r(scaled.select("cell", "scaled_x", "scaled_constant", sp.radius().alias("radius")))
