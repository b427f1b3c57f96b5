"""Checked queries: recorder features of observations and molecules."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladewise.functions import bins
from cladewise.operators import observations as ob, partial_states as ps
from cladewise.plans import views as v
from cladewise.plans.registry import SQL, query
from cladewise.session import scratch_path


def _rounded(df, keep=()):
    return df.select(*[F.round(c, 8).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def _typed(obs):
    return obs.withColumn("edited", ob.typed_state(F.col("state"))).drop("state")


_TYPED = "typed as (select cell,unit,site,case state when '0' then 0 when '1' then 1 end as edited from obs)"
_TALLY = f"""{v.SQL_OBS}, tally as (select unit, site, count(*) filter (state='0') as unedited, count(*) filter (state='1') as edited,
 count(*) filter (state='?') as uncalled, count(*) filter (state='+') as not_captured, 0 as unexpected,
 count(*) filter (state in ('0','1')) as observed,
 count(*) filter (state='1')/nullif(count(*) filter (state in ('0','1')),0) as editing_rate,
 count(*) filter (state in ('0','1'))/(select count(distinct cell) from obs) as observed_fraction from obs group by 1,2),
t as (select *, coalesce(editing_rate>=0.5,false) as retained, 1-pow(1-editing_rate,1/30) as per_division_rate from tally)"""


def _tally(spark, sf):
    return ob.position_tally(v.observations(spark, sf), 0.5, 30)


@query("position_editing_rates", "A1 A2 P18", f"with {_TALLY} select * replace (round(editing_rate,8) as editing_rate, round(observed_fraction,8) as observed_fraction, round(per_division_rate,8) as per_division_rate) from t")
def _(spark, sf):
    return _rounded(_tally(spark, sf))


@query("per_division_rate_assumptions", "A2", f"""with {_TALLY}
select cast(g as double) as generations, round(quantile_cont(1-pow(1-editing_rate,1/g),0.5),8) as median_rate, count(*) as positions
from t, (values (20),(25),(30),(35),(40)) x(g) where retained and editing_rate<0.95 group by 1""")
def _(spark, sf):
    return _rounded(ob.rate_assumptions(_tally(spark, sf), [20, 25, 30, 35, 40]))


@query("rate_distribution_summary", "A3 W8", f"""with {_TALLY}
select retained, count(*) as positions, round(avg(editing_rate),8) as mean, round(quantile_cont(editing_rate,0.25),8) as q25,
 round(quantile_cont(editing_rate,0.5),8) as median, round(quantile_cont(editing_rate,0.75),8) as q75,
 round(min(editing_rate),8) as min, round(max(editing_rate),8) as max, round(avg((editing_rate>=0.99)::int),8) as saturated,
 round(avg((editing_rate<0.95)::int),8) as identifiable, round(avg((editing_rate<0.01)::int),8) as low
from t where editing_rate is not null group by 1""")
def _(spark, sf):
    return _rounded(ob.rate_distribution(_tally(spark, sf), ["retained"]))


@query("dropout_accounting", "A4", f"""with {_TALLY}
select round(sum(uncalled)/(count(*)*(select count(distinct cell) from obs)),8) as uncalled_share,
 round(sum(not_captured)/(count(*)*(select count(distinct cell) from obs)),8) as not_captured_share,
 quantile_cont(observed,0.5) filter (retained) as median_observed_kept,
 quantile_cont(observed,0.5) filter (not retained) as median_observed_dropped from t""")
def _(spark, sf):
    cells = v.observations(spark, sf).agg(F.count_distinct("cell").alias("n")).select("n").scalar()
    return _rounded(ob.dropout_accounting(_tally(spark, sf), cells))


@query("threshold_sensitivity", "J12", f"""with {_TALLY}
select cast(x as double) as threshold, count(*) filter (editing_rate>=x) as kept, count(*) filter (editing_rate<x) as dropped,
 round(avg(editing_rate) filter (editing_rate>=x),8) as mean_rate_kept
from t, (values (0.0),(0.3),(0.45),(0.5),(0.55),(0.9)) y(x) where editing_rate is not null group by 1""")
def _(spark, sf):
    return _rounded(ob.threshold_sensitivity(_tally(spark, sf), [0.0, 0.3, 0.45, 0.5, 0.55, 0.9]))


@query("site_editing_rate", "A5 P7", f"""with {v.SQL_OBS}, {_TYPED}
select unit, site, round(sum(edited)/nullif(count(edited),0),8) as rate, count(edited) as observed from typed group by 1,2""")
def _(spark, sf):
    return _rounded(ob.site_rates(_typed(v.observations(spark, sf)), ["unit", "site"]))


@query("cell_edit_burden", "A6", f"""with {v.SQL_OBS}, {_TYPED}
select cell, coalesce(sum(edited),0)::bigint as edits, count(edited) as observed,
 round(sum(edited)/nullif(count(edited),0),8) as edited_fraction from typed group by 1""")
def _(spark, sf):
    return _rounded(ob.cell_burden(_typed(v.observations(spark, sf)), ["cell"]))


@query("nonzero_burden", "A8 P8", f"""with {v.SQL_GENOMES}
select cell, count(*) filter (allele<>1) as edits, round(count(*) filter (allele<>1)/(select count(distinct position) from genomes),8) as edit_fraction
from genomes group by 1""")
def _(spark, sf):
    g = v.genomes(spark, sf).selectExpr("cell", "position", "allele - 1 as value")
    width = g.agg(F.count_distinct("position").alias("n")).select("n").scalar()
    return _rounded(ob.nonzero_burden(g, width))


_DIVERSITY = f"""{v.SQL_DENSE}, {_TYPED},
width as (select unit, count(distinct site) as w from typed group by 1),
cap as (select unit, cell from typed join width using(unit) where edited is not null group by unit, cell, w having count(*)/w>=0.5),
units as (select unit, count(*) as cells from cap group by 1 having count(*)>=10),
block as (select typed.* from typed join cap using(unit,cell) where edited is not null),
sites as (select unit, site, cells from block join units using(unit) group by unit, site, cells having count(*)=cells),
enough as (select unit, cells, count(*) as sites from sites group by all having count(*)>={{min_sites}}),
al as (select b.unit, string_agg(edited::varchar,'' order by b.site) as k from block b join sites s on s.unit=b.unit and s.site=b.site
   join enough e on e.unit=b.unit group by b.unit, cell),
sh as (select unit, k, count(*) as n from al group by 1,2),
div as (select unit, cells, sites, count(*) as alleles, -sum(n/cells*ln(n/cells)) as entropy, max(n/cells) as top_allele_fraction,
  -sum(n/cells*ln(n/cells))/ln(cells) as normalised_entropy from sh join enough using(unit) group by unit, cells, sites)"""


@query("allele_diversity", "A7 F2", f"""with {_DIVERSITY.format(min_sites=3)} select unit, cells, sites, alleles, round(entropy,8) as entropy,
 round(top_allele_fraction,8) as top_allele_fraction, round(normalised_entropy,8) as normalised_entropy from div""")
def _(spark, sf):
    return _rounded(ob.allele_diversity(_typed(v.dense_observations(spark, sf)), min_sites=3))


def _drawn_sql(table, key, order, wanted, seed):
    """The table ``picked``: distinct numbers of the rows of each key, drawn as the library draws them."""
    return f"""nbr as (select *, row_number() over (partition by {key} order by {order})-1 as m, count(*) over (partition by {key}) as t from {table}),
riv as (select distinct {key}, case when t>{4 * wanted} then cast(floor({v.sql_uniform(str(seed), f"{key}||'|'||j")}*t) as bigint) else j end as m
  from (select distinct {key}, t, unnest(range(least(t,{4 * wanted}))) as j from nbr)),
pck as (select *, row_number() over (partition by {key} order by md5('{seed}|pick|'||{key}||'|'||m), m) as r from riv),
picked as (select nbr.* from nbr join pck using({key}, m) where r<={wanted})"""


_PAIRS = f"""{v.SQL_DENSE}, {_TYPED},
inf as (select unit, site from typed group by 1,2 having count(edited)>=20 and sum(edited)>0 and sum(edited)<count(edited)),
cand as (select case when a.unit=b.unit then 'within' else 'between' end as stratum, a.unit as ua, a.site as sa, b.unit as ub, b.site as sb
  from inf a join inf b on (a.unit,a.site)<(b.unit,b.site)),
{_drawn_sql('cand', "stratum", 'ua, sa, ub, sb', 40, 7)},
gam as (select stratum, ua, sa, ub, sb, count(*) filter (x.edited=0 and y.edited=0) as n00, count(*) filter (x.edited=0 and y.edited=1) as n01,
  count(*) filter (x.edited=1 and y.edited=0) as n10, count(*) filter (x.edited=1 and y.edited=1) as n11,
  corr(x.edited,y.edited) as c, count(*) as n
  from picked join typed x on x.unit=ua and x.site=sa join typed y on y.unit=ub and y.site=sb and y.cell=x.cell
  where x.edited is not null and y.edited is not null group by all),
pstat as (select stratum, count(*) as pairs, round(avg((n00>0 and n01>0 and n10>0 and n11>0)::int) filter (n>=20),8) as incompatible_fraction,
 round(avg(abs(c)) filter (n>=20),8) as mean_abs_association from gam group by 1)"""


@query("pair_statistics", "A9 J5", f"with {_PAIRS} select * from pstat")
def _(spark, sf):
    return _rounded(ob.pair_statistics(_typed(v.dense_observations(spark, sf)), 40, 7))


_WIDE = _PAIRS.replace(v.SQL_DENSE, """obs as (select cell,unit,site,min_by(state,k||state) as state from (select l_orderkey//64 as cell,
 'u'||(l_partkey%4) as unit, (l_partkey//4)%30 as site, case when l_returnflag='A' then '1' when l_returnflag='R' then '0' else '?' end as state,
 md5(l_orderkey||'|'||l_linenumber||'|'||l_partkey||'|'||l_suppkey) as k from lineitem) where state<>'?' group by 1,2,3)""")


@query("pair_statistics_wide", "A9", f"with {_WIDE} select * from pstat")
def _(spark, sf):
    keyed = v.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey div 64 as cell", "concat('u', l_partkey % 4) as unit", "(l_partkey div 4) % 30 as site",
        "case when l_returnflag='A' then '1' when l_returnflag='R' then '0' else '?' end as state",
        "md5(concat(l_orderkey,'|',l_linenumber,'|',l_partkey,'|',l_suppkey)) as k")
    calls = keyed.where("state <> '?'").groupBy("cell", "unit", "site").agg(F.min_by("state", F.concat("k", "state")).alias("state"))
    return _rounded(ob.pair_statistics(_typed(calls), 40, 7))


@query("excess_association", "A10", f"""with {_PAIRS} select 'recording' as dataset,
 round(max(mean_abs_association) filter (stratum='within')-max(mean_abs_association) filter (stratum='between'),6) as excess_association from pstat""")
def _(spark, sf):
    stats = ob.pair_statistics(_typed(v.dense_observations(spark, sf)), 40, 7).withColumn("dataset", F.lit("recording"))
    return ob.excess_association(stats, ["dataset"]).withColumn("excess_association", F.round("excess_association", 6))


_UNIT = f"""{_DIVERSITY.format(min_sites=5)},
inf as (select unit, site from typed group by 1,2 having count(edited)>=20 and sum(edited)>0 and sum(edited)<count(edited)),
okay as (select unit from inf group by 1 having count(*)>=4),
cand as (select 'within|'||a.unit as stratum, a.unit, a.site as sa, b.site as sb from inf a join inf b on a.unit=b.unit and a.site<b.site join okay on okay.unit=a.unit),
{_drawn_sql('cand', 'stratum', 'sa, sb', 10, 7)},
gam as (select c.unit, sa, sb, count(distinct (x.edited, y.edited)) as g, corr(x.edited,y.edited) as c, count(*) as n
  from picked c join typed x on x.unit=c.unit and x.site=sa join typed y on y.unit=c.unit and y.site=sb and y.cell=x.cell
  where x.edited is not null and y.edited is not null group by all),
pst as (select unit, avg((g=4)::int) filter (n>=20) as incompatible_fraction, avg(abs(c)) filter (n>=20) as mean_abs_association from gam group by 1),
rt as (select unit, site, sum(edited)/nullif(count(edited),0) as rate, count(edited) as o from typed group by 1,2),
nc as (select count(distinct cell) as n from obs),
ce as (select unit, cell, sum(edited) as e, count(edited) as o from typed group by 1,2),
f1 as (select unit, count(*) as sites, sum(o) as so, avg(rate) as m, quantile_cont(rate,0.5) as md, avg((rate>=0.99)::int) as s from rt group by 1),
f2 as (select unit, sum(e) as e, sum(e/greatest(o,1)) as f from ce group by 1),
feat as (select f1.unit, dense_rank() over (order by f1.unit) as unit_index, f1.sites, round(so/(f1.sites*n),8) as observed_fraction,
 round(m,8) as site_rate_mean, round(md,8) as site_rate_median, round(s,8) as site_rate_saturated, round(e/n,8) as edits_per_cell_mean,
 round(f/n,8) as edited_fraction, alleles, round(normalised_entropy,8) as normalised_entropy, round(top_allele_fraction,8) as top_allele_fraction,
 round(incompatible_fraction,8) as incompatible_fraction, round(mean_abs_association,8) as mean_abs_association
 from f1 join f2 using(unit) cross join nc left join div using(unit) left join pst using(unit))"""


def _features(spark, sf):
    obs = v.dense_observations(spark, sf)
    return ob.unit_features(_typed(obs), obs, 10, 7)


@query("unit_feature_vectors", "A11", f"with {_UNIT} select * from feat")
def _(spark, sf):
    return _rounded(_features(spark, sf))


@query("metric_spread_over_units", "A13", f"""with {_UNIT}, long as (unpivot (select site_rate_mean, edits_per_cell_mean,
  alleles::double as alleles, mean_abs_association from feat) on * into name metric value value)
select metric, count(*) as n, round(avg(value),6) as mean, round(stddev_samp(value),6) as sd, round(stddev_samp(value)/nullif(abs(avg(value)),0),6) as cv,
 round(min(value),6) as min, round(max(value),6) as max from long where value is not null group by 1""")
def _(spark, sf):
    spread = ob.metric_spread(_features(spark, sf), [], [
        "site_rate_mean", "edits_per_cell_mean", "alleles", "mean_abs_association"])
    return spread.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "cv", "min", "max")])


@query("captured_entries_low_tail", "A31", f"""with {_UNIT}, d as (select *, case when unit='u2' then 'simulated' else 'real' end as dataset, 300 as n_cells from feat)
select unit, dataset, round(observed_fraction*sites*n_cells,4) as captured,
 coalesce(dataset='real' and (normalised_entropy<(select quantile_cont(normalised_entropy,0.15) from d where dataset='real')
  or edits_per_cell_mean<(select quantile_cont(edits_per_cell_mean,0.15) from d where dataset='real')), false) as low_tail from d""")
def _(spark, sf):
    d = _rounded(_features(spark, sf)).withColumn(
        "dataset", F.when(F.col("unit") == "u2", "simulated").otherwise("real")).withColumn("n_cells", F.lit(300))
    return ob.captured_entries(d, "n_cells").select("unit", "dataset", F.round("captured", 4).alias("captured"), "low_tail")


@query("lowest_rate_units", "A14 O3", f"""with {_TALLY} select unit, site, round(editing_rate,8) as editing_rate from t where editing_rate is not null
 order by editing_rate, unit, site limit 5""")
def _(spark, sf):
    scored = _tally(spark, sf).where("editing_rate is not null").select("unit", "site", "editing_rate")
    return _rounded(ob.lowest(scored, ["editing_rate", "unit", "site"], 5))


@query("dataset_summary", "A12", f"""with {v.SQL_DENSE}, {_TYPED.replace("typed as (select cell", "typed0 as (select cell")},
typed as (select 'd'||(cell%2) as dataset, * from typed0),
width as (select dataset, unit, count(distinct site) as w from typed group by 1,2),
cap as (select dataset, unit, cell from typed join width using(dataset,unit) where edited is not null group by dataset, unit, cell, w having count(*)/w>=0.5),
units as (select dataset, unit, count(*) as cells from cap group by all having count(*)>=10),
block as (select typed.* from typed join cap using(dataset,unit,cell) where edited is not null),
sites as (select dataset, unit, site, cells from block join units using(dataset,unit) group by dataset, unit, site, cells having count(*)=cells),
enough as (select dataset, unit, cells, count(*) as sites from sites group by all having count(*)>=5),
al as (select b.dataset, b.unit, string_agg(edited::varchar,'' order by b.site) as k from block b join sites s on s.dataset=b.dataset and s.unit=b.unit and s.site=b.site
   join enough e on e.unit=b.unit and e.dataset=b.dataset group by b.dataset, b.unit, cell),
sh as (select dataset, unit, k, count(*) as n from al group by all),
div as (select dataset, unit, cells, sites, count(*) as alleles, max(n/cells) as top, -sum(n/cells*ln(n/cells))/ln(cells) as ne from sh join enough using(dataset,unit) group by dataset, unit, cells, sites),
dv as (select dataset, round(avg(cells),8) as comparable_cells, round(avg(sites),8) as comparable_sites, round(avg(alleles),8) as alleles_per_unit,
  round(avg(ne),8) as normalised_entropy, round(avg(top),8) as top_allele_fraction from div group by 1),
rt as (select dataset, unit, site, sum(edited)/nullif(count(edited),0) as rate from typed group by all),
r as (select dataset, round(avg(rate),8) as site_rate_mean, round(quantile_cont(rate,0.5),8) as site_rate_median, round(avg((rate>=0.99)::int),8) as site_rate_saturated from rt group by 1),
e as (select dataset, round(avg(x),8) as edits_per_cell_mean, round(stddev_samp(x),8) as edits_per_cell_sd from (select dataset, cell, coalesce(sum(edited),0) as x from typed group by all) group by 1)
select * from r join e using(dataset) left join dv using(dataset)""")
def _(spark, sf):
    obs = v.dense_observations(spark, sf).withColumn("dataset", F.expr("concat('d', cell % 2)"))
    return _rounded(ob.dataset_summary(_typed(obs), obs))


@query("molecule_statistics", "A15", f"""with {v.SQL_MOL}, c as (select mol, call, count(*) as n from mols group by 1,2)
select mol, count(*) as distinct_calls, coalesce(max(n) filter (call<>'0'),0) as span, coalesce(sum(n) filter (call<>'0'),0)::bigint as edited from c group by 1""")
def _(spark, sf):
    return ob.molecule_statistics(v.molecules(spark, sf))


_MSTAT = f"""{v.SQL_MOL}, c as (select mol, call, count(*) as n from mols group by 1,2),
ms as (select mol, count(*) as distinct_calls, coalesce(max(n) filter (call<>'0'),0) as span, coalesce(sum(n) filter (call<>'0'),0)::bigint as edited from c group by 1)"""


@query("span_histogram", "A15 W7", f"""with {_MSTAT}, h as (select l as level, (select count(*) from ms where span=l) as n from range(0,9) t(l))
select level, n, round(n/sum(n) over (),8) as share from h""")
def _(spark, sf):
    stats = ob.molecule_statistics(v.molecules(spark, sf))
    from cladewise.operators.tables import share_of_total
    return _rounded(share_of_total(ob.level_histogram(stats, "span", list(range(9))), "n", [], "share"))


_SPECTRUM = f"""c as (select target, call, count(*) as n, sum(count(*)) over (partition by target) as t from mols group by 1,2),
spec as (select target, count(*) as distinct_alleles, round(-sum(n/t*ln(n/t)),8) as entropy, round(max(n/t),8) as top_fraction,
 arg_max(call, struct_pack(a:=n, b:=-ascii(call), d:=-ascii(call[2]))) as top_allele,
 round(case when count(*)>1 then -sum(n/t*ln(n/t))/ln(count(*)) else 0 end,8) as normalised_entropy from c group by 1)"""


@query("allele_spectrum", "A16", f"with {v.SQL_MOL}, {_SPECTRUM} select * from spec")
def _(spark, sf):
    return _rounded(ob.allele_spectrum(v.molecules(spark, sf)))


_TPAIRS = f"""tp as (select a.target as target_a, b.target as target_b, b.target-a.target as gap, count(*) filter (a.call<>'0' and b.call<>'0') as n11,
 count(*) filter (a.call<>'0' and b.call='0') as n10, count(*) filter (a.call='0' and b.call<>'0') as n01,
 count(*) filter (a.call='0' and b.call='0') as n00, count(*) filter (a.call<>'0' and a.call=b.call) as same_call
 from mols a join mols b on a.mol=b.mol and a.target<b.target group by all),
tpp as (select *, (n11::double*n00-n10::double*n01)/nullif(sqrt((n11+n10)::double*(n01+n00)*(n11+n01)*(n10+n00)),0) as phi, same_call/nullif(n11,0) as same_given_both from tp)"""
_TARGETS = [1, 2, 3, 4, 5, 6, 7]


@query("target_pair_contingency", "A17 J9", f"with {v.SQL_MOL}, {_TPAIRS} select * replace (round(phi,8) as phi, round(same_given_both,8) as same_given_both) from tpp")
def _(spark, sf):
    return _rounded(ob.target_pairs(v.molecules(spark, sf), _TARGETS))


@query("pair_means_by_gap", "A18", f"with {v.SQL_MOL}, {_TPAIRS} select gap, round(avg(phi),8) as phi, round(avg(same_given_both),8) as same_given_both from tpp group by 1")
def _(spark, sf):
    return _rounded(ob.pair_means_by_gap(ob.target_pairs(v.molecules(spark, sf), _TARGETS), []))


_TWO = """two as (select case when mol%2=0 then 'real' else 'simulated' end as dataset, * from mols)"""


_MATCHED = f"""{v.SQL_MOL}, {_TWO}, cd as (select dataset, mol, target, case when call like 'R%' then '-1' else call end as call from two where dataset='real'),
c as (select dataset, mol, call, count(*) as n from two group by all), cc as (select mol, call, count(*) as n from cd group by all),
ms as (select dataset, mol, count(*) as d, coalesce(max(n) filter (call<>'0'),0) as s from c group by all),
mc as (select 'real_collapsed' as dataset, mol, count(*) as d, coalesce(max(n) filter (call<>'0'),0) as s from cc group by all),
mm as (select * from ms union all select * from mc),
tr as (select dataset, target, avg((call<>'0')::int) as rate, count(distinct call) as da from two group by all),
sp as (select dataset, target, count(*) as k, case when count(*)>1 then (ln(sum(n))-sum(n*ln(n))/sum(n))/ln(count(*)) else 0 end as e
  from (select dataset, target, call, count(*) as n from two group by all) group by 1,2),
tp as (select a.dataset, b.target-a.target as gap, count(*) filter (a.call<>'0' and b.call<>'0') as n11, count(*) filter (a.call<>'0' and b.call='0') as n10,
  count(*) filter (a.call='0' and b.call<>'0') as n01, count(*) filter (a.call='0' and b.call='0') as n00, count(*) filter (a.call<>'0' and a.call=b.call) as same_call
  from two a join two b on a.mol=b.mol and a.target<b.target group by a.dataset, a.target, b.target),
pp as (select *, (n11::double*n00-n10::double*n01)/nullif(sqrt((n11+n10)::double*(n01+n00)*(n11+n01)*(n10+n00)),0) as phi, same_call/nullif(n11,0) as sb from tp)"""


@query("recorder_comparison_long", "A19 O4", f"""with {_MATCHED}
select 'per-target editing rate' as feature, target as level, dataset, round(rate,8) as value from tr
union all select 'distinct calls per molecule', d, dataset, round(count(*)/sum(count(*)) over (partition by dataset),8) from mm group by d, dataset
union all select 'largest shared span', s, dataset, round(count(*)/sum(count(*)) over (partition by dataset),8) from mm group by s, dataset
union all select 'distinct alleles per target', target, dataset, da from tr
union all select 'normalised entropy per target', target, dataset, round(e,8) from sp
union all select 'pairwise phi', gap, dataset, round(phi,8) from pp
union all select 'P(same allele | both edited)', gap, dataset, round(sb,8) from pp""")
def _(spark, sf):
    from cladewise.operators.comparison import long_comparison
    two = _two(spark, sf)
    return _rounded(long_comparison(two, "dataset", _rescored(two).withColumn("dataset", F.lit("real_collapsed")), _TARGETS))


_TARGETS = [1, 2, 3, 4, 5, 6, 7]


def _two(spark, sf):
    return v.molecules(spark, sf).withColumn("dataset", F.when(F.col("mol") % 2 == 0, "real").otherwise("simulated"))


def _rescored(two):
    """The real molecules with all calls of one kind as one state."""
    from cladewise.operators.comparison import rescored
    return rescored(two.where("dataset = 'real'"), F.col("call").startswith("R"))


@query("recorder_comparison_headline", "A19", f"""with {_MATCHED},
ma as (select 'real' as dataset, d, s from mc union all select dataset, d, s from ms where dataset='simulated'),
h as (select dataset, 'mean per-target editing rate' as metric, avg(rate) as x from tr group by 1
 union all select dataset, 'spread of per-target rate', max(rate)-min(rate) from tr group by 1
 union all select dataset, 'mean distinct calls per molecule', avg(d) from ms group by 1
 union all select dataset, 'molecules with no edited target', avg((s=0)::int) from ms group by 1
 union all select dataset, 'molecules where one event spans >= 4 targets', avg((s>=4)::int) from ms group by 1
 union all select dataset, 'median distinct alleles per target', quantile_cont(da,0.5) from tr group by 1
 union all select dataset, 'mean distinct calls, real re-scored as the simulator encodes', avg(d) from ma group by 1
 union all select dataset, 'one event spans >= 7 targets, matched encoding', avg((s>=7)::int) from ma group by 1
 union all select dataset, 'mean normalised entropy per target', avg(e) from sp group by 1
 union all select dataset, 'mean pairwise phi between targets', avg(phi) from pp group by 1
 union all select dataset, 'P(same allele | both edited)', sum(same_call)/sum(n11) from pp group by 1)
select metric, round(max(x) filter (dataset='real'),8) as real, round(max(x) filter (dataset='simulated'),8) as simulated,
 round(max(x) filter (dataset='simulated')/nullif(max(x) filter (dataset='real'),0),6) as ratio from h group by 1""")
def _(spark, sf):
    from cladewise.operators.comparison import headline
    two = _two(spark, sf)
    found = headline(two, "dataset", matched=_rescored(two), targets=_TARGETS)
    return found.select("metric", F.round("real", 8).alias("real"), F.round("simulated", 8).alias("simulated"),
                        F.round("ratio", 6).alias("ratio"))


@query("wide_molecules", "A20", f"""with {v.SQL_GENOMES}, g as (select cell, genome as unit, position, max(allele) as allele from genomes where position in (3,11,19,27) group by all)
select cell, unit, coalesce(max(allele) filter (position=3),0) as c1, coalesce(max(allele) filter (position=11),0) as c2,
 coalesce(max(allele) filter (position=19),0) as c3, coalesce(max(allele) filter (position=27),0) as c4 from g group by 1,2""")
def _(spark, sf):
    g = v.genomes(spark, sf).groupBy("cell", F.col("genome").alias("unit"), "position").agg(F.max("allele").alias("allele"))
    wide = ob.wide_molecules(g, [3, 11, 19, 27])
    return wide.select("cell", "unit", *[F.col("calls")[i].alias(f"c{i + 1}") for i in range(4)])


@query("calibration_sweep", "A21", f"""with {v.SQL_SCORES}, m as (select system, tier, avg(normalized_rf) as mean_rate from scores group by 1,2)
select system, tier, round(mean_rate,8) as mean_rate, round(abs(mean_rate-0.45),8) as distance,
 row_number() over (partition by system order by abs(mean_rate-0.45), tier)=1 as is_best from m""")
def _(spark, sf):
    return _rounded(ob.nearest_setting(v.scores(spark, sf), "tier", "normalized_rf", 0.45, ["system"]))


@query("span_distance", "A22", f"""with {_MSTAT}, h as (select 'c'||(mol%3) as candidate, span as level, count(*) as n from ms group by 1,2),
g as (select candidate, l as level, coalesce(n,0) as n from (select distinct candidate from h) cross join range(1,9) r(l) left join h using(candidate, level)),
rf as (select l as level, (select count(*) from ms where span=l) as n from range(1,9) t(l)),
s as (select g.candidate, g.level, g.n/sum(g.n) over (partition by g.candidate) as s from g), q as (select level, n/sum(n) over () as s from rf)
select candidate, round(sum(abs(s.s-q.s)),8) as l1_distance, round(sum(s.s) filter (s.level>=7),8) as span_ge7, round(sum(s.s) filter (s.level between 2 and 6),8) as span_2to6
from s join q using(level) group by 1""".replace("cross join range(1,9) r(l) left join h using(candidate, level)", "cross join range(1,9) r(level) left join h using(candidate, level)").replace("select candidate, l as level, coalesce", "select candidate, level, coalesce"))
def _(spark, sf):
    stats = ob.molecule_statistics(v.molecules(spark, sf))
    per = ob.level_histogram(stats.withColumn("candidate", F.expr("concat('c', mol % 3)")), "span", list(range(9)), ["candidate"])
    real = ob.level_histogram(stats, "span", list(range(9)))
    return _rounded(ob.span_distance(per, real, "candidate"))


@query("length_histogram", "A23 J7", """with b as (select l_extendedprice as len, case when l_extendedprice>0 and l_extendedprice<=1000 then 1 when l_extendedprice>1000 and l_extendedprice<=5000 then 2
 when l_extendedprice>5000 and l_extendedprice<=20000 then 3 when l_extendedprice>20000 and l_extendedprice<=60000 then 4 end as bin from lineitem)
select ['(0,1000]','(1000,5000]','(5000,20000]','(20000,60000]'][bin] as length_bin, count(*) as n,
 round(count(*)/(select count(*) from b where len<=60000),8) as share from b where bin is not null group by bin""")
def _(spark, sf):
    breaks = [0, 1000, 5000, 20000, 60000]
    items = v.table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("len"))
    within = items.where(F.col("len") <= breaks[-1]).agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    counts = items.withColumn("length_bin", bins.bin_label(F.col("len"), breaks, right=True, include_lowest=False)).where(
        "length_bin is not null").groupBy("length_bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / within, 8))


@query("outcome_rarefaction", "A24", f"""with {v.SQL_MOL}, o as (select mol, string_agg(target||':'||call, '|' order by target) as outcome from mols group by 1),
r as (select *, row_number() over (order by md5('2|'||mol), mol) as r from o)
select d as depth, (select count(distinct outcome) from r where r<=d) as distinct_outcomes from (values (25),(100),(250),(1000),(100000)) t(d)""")
def _(spark, sf):
    outcomes = v.molecules(spark, sf).groupBy("mol").agg(F.array_join(F.array_sort(F.collect_list(
        F.concat(F.col("target"), F.lit(":"), F.col("call")))), "|").alias("outcome"))
    return ob.rarefaction(outcomes, "outcome", "mol", [25, 100, 250, 1000, 100000], 2)


@query("distinct_states", "A25", f"""with {v.SQL_MOL} select cast(target as varchar) as scope, count(distinct call) as distinct_states from mols group by 1
 union all select 'molecule', count(distinct o) from (select mol, string_agg(target||':'||call, '|' order by target) as o from mols group by 1)""")
def _(spark, sf):
    return ob.distinct_states(v.molecules(spark, sf))


@query("informative_characters", "A26", f"""with {v.SQL_OBS}, {_TYPED}
select unit, site, count(edited)>=2 and sum(edited)>0 and sum(edited)<count(edited) as informative, count(distinct edited)>1 as variable
from typed group by 1,2""")
def _(spark, sf):
    typed = _typed(v.observations(spark, sf))
    every = typed.select("unit", "site").distinct()
    good = ob.informative_sites(typed, 2).withColumn("informative", F.lit(True))
    varied = ob.variable_characters(typed).select("unit", "site", F.lit(True).alias("variable"))
    return every.join(good, ["unit", "site"], "left").join(varied, ["unit", "site"], "left").na.fill(
        False, ["informative", "variable"])


@query("quantile_distance", "A27 A28", f"""with {v.SQL_SCORES}, ref as (select quantile_cont(normalized_rf, [x/100 for x in range(1,100)]) as q from scores where tier=0),
c as (select system, quantile_cont(normalized_rf, [x/100 for x in range(1,100)]) as q from scores where tier<>0 group by 1)
select system, round(list_sum([abs(c.q[i]-ref.q[i]) for i in range(1,100)])/99,8) as quantile_distance from c, ref""")
def _(spark, sf):
    s = v.scores(spark, sf)
    return _rounded(ob.quantile_distance(s.where("tier <> 0"), s.where("tier = 0"), "system", "normalized_rf"))


@query("configuration_match_summary", "A29 O4", f"""with {v.SQL_SCORES},
new as (select system as configuration, count(*) as positions, round(avg(normalized_rf),8) as site_rate_mean from scores where tier<>0 and seed<3 group by 1),
old as (select system as configuration, count(*) as positions, round(avg(normalized_rf),8) as site_rate_mean from scores where tier=1 group by 1
  union all select 'retired', count(*), round(avg(normalized_rf),8) from scores where tier=2),
ref as (select 'reference' as configuration, count(*) as positions, round(avg(normalized_rf),8) as site_rate_mean from scores where tier=0)
select * from ref union all select * from new union all select * from old where configuration not in (select configuration from new)""")
def _(spark, sf):
    s = v.scores(spark, sf)

    def summary(rows, name):
        return rows.groupBy(name.alias("configuration")).agg(
            F.count(F.lit(1)).alias("positions"), F.round(F.avg("normalized_rf"), 8).alias("site_rate_mean"))
    new = summary(s.where("tier <> 0 and seed < 3"), F.col("system"))
    old = summary(s.where("tier = 1"), F.col("system")).unionByName(summary(s.where("tier = 2"), F.lit("retired")))
    return summary(s.where("tier = 0"), F.lit("reference")).unionByName(ob.carry_over(old, new, "configuration"))


@query("growth_summary", "A30", f"""with recursive {v.SQL_PATHS}, r as (select d.root, depth as generation, (division_event%3=0)::int as edited from down d join nodes n using(node_id) where is_terminal),
a as (select root, count(*) as alive, quantile_cont(generation,0.5) as generation, avg(edited) as saturation from r group by 1)
select root, alive, generation, round(saturation,8) as saturation, round(pow(alive/2.0,1/generation),8) as growth_per_generation,
 round(1-pow(1-saturation,1/generation),8) as effective_rate from a""")
def _(spark, sf):
    tips = v.nodes(spark, sf).where("is_terminal").select(
        "node_id", F.expr("cast(division_event % 3 = 0 as int)").alias("edited"))
    runs = v.node_paths(spark, sf).select("node_id", "root", F.col("depth").cast("double").alias("generation")).join(tips, "node_id")
    return _rounded(ob.growth_summary(runs, ["root"], 2.0))


def _appended(spark, table, summary, key):
    """States of a table that arrives in three batches, the second of them twice."""
    folder = scratch_path(spark, "states")
    for name in (0, 1, 1, 2):
        summary.append(table.where(F.pmod(F.xxhash64(key), F.lit(3)) == name), folder, str(name))
    return summary.stored(spark, folder)


@query("appended_editing_rates", "A1 A2 P18", SQL["position_editing_rates"])
def _(spark, sf):
    obs = v.observations(spark, sf)
    kept = ps.Summary(["unit", "site"], ob.TALLY_CONDITIONS)
    cells = _appended(spark, obs, ps.Summary(["cell"]), "site").agg(F.count("cell").alias("n")).select("n").scalar()
    tally = _appended(spark, obs, kept, "cell").select("unit", "site", *[F.col(f"count_{c}").alias(c) for c in ob.TALLY_CONDITIONS])
    return _rounded(ob.tally_rates(tally, cells, 0.5, 30))


@query("sketched_distinct_states", "A25", f"""with d as ({SQL["distinct_states"]}) select scope, distinct_states, true as within_error from d where scope<>'molecule'""")
def _(spark, sf):
    molecules = v.molecules(spark, sf).select(F.col("target").cast("string").alias("scope"), "mol", "call")
    sketched = _appended(spark, molecules, ps.Summary(["scope"], distinct=["call"]), "mol")
    exact = molecules.groupBy("scope").agg(F.count_distinct("call").alias("distinct_states"))
    error = F.abs(ps.distinct_estimate("call") - F.col("distinct_states"))
    return sketched.join(exact, "scope").select(
        "scope", "distinct_states", (error <= 1 + 4 * 0.0163 * F.col("distinct_states")).alias("within_error"))


@query("sketched_rate_quantiles", "A3 A27 W8", f"""with {_TALLY}
select retained, count(*) as positions, p, true as within_error from t, (values (0.1),(0.25),(0.5),(0.75),(0.9)) x(p) where editing_rate is not null group by 1,3""")
def _(spark, sf):
    rates = _tally(spark, sf).where("editing_rate is not null").select("retained", "unit", "site", "editing_rate")
    sketched = _appended(spark, rates, ps.Summary(["retained"], quantiles=["editing_rate"]), "site")
    wanted = F.array(*[F.struct(F.lit(p).alias("p"), ps.quantile_estimate("editing_rate", p).alias("_cut")) for p in (0.1, 0.25, 0.5, 0.75, 0.9)])
    cuts = sketched.select("retained", F.inline(wanted))
    # the share of rows below the cut and up to it must enclose p, give or take the rank error
    shares = rates.join(F.broadcast(cuts), "retained").groupBy("retained", "p").agg(
        F.count("*").alias("positions"), F.avg((F.col("editing_rate") < F.col("_cut")).cast("int")).alias("_below"),
        F.avg((F.col("editing_rate") <= F.col("_cut")).cast("int")).alias("_upto"))
    slack = 0.01 + 1 / F.col("positions")
    return shares.select("retained", "positions", F.col("p").cast("decimal(3,2)").alias("p"),
                         ((F.col("_below") <= F.col("p") + slack) & (F.col("_upto") >= F.col("p") - slack)).alias("within_error"))
