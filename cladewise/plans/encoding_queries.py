"""Checked queries: character encodings, mitochondrial and ecDNA tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladewise.functions import scalars as fn
from cladewise.functions.sampling import uniform
from cladewise.operators import encodings as en, organelles as og
from cladewise.plans import views as v
from cladewise.plans.registry import query


def _r(df, digits=8):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _alleles(spark, sf):
    """One allele per cell, unit and position."""
    return v.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey div 8 as cell", "cast(1 + l_suppkey % 5 as int) as unit", "cast(1 + l_partkey % 12 as int) as position",
        "case l_partkey % 7 when 0 then -1.0D when 1 then 0.0D when 2 then 0.1D when 3 then 0.24D else cast(l_partkey % 7 - 3 as double) end as allele"
    ).groupBy("cell", "unit", "position").agg(F.max("allele").alias("allele"))


_AL = """al as (select cell, unit, position, max(allele) as allele from (select l_orderkey//8 as cell, cast(1+l_suppkey%5 as int) as unit, cast(1+l_partkey%12 as int) as position,
 case l_partkey%7 when 0 then -1.0 when 1 then 0.0 when 2 then 0.1 when 3 then 0.24 else l_partkey%7-3 end::double as allele from lineitem) group by 1,2,3)"""
_TXT = "case when allele%1=0 then cast(cast(allele as bigint) as varchar) else cast(allele as varchar) end"


@query("allele_matrix", "R1 F9", f"with {_AL} select cell, 'int_'||unit||'_pos_'||position as feature, allele as value from al where allele<>0 and position in (2,3,5,8)")
def _(spark, sf):
    return en.allele_matrix(_alleles(spark, sf), [2, 3, 5, 8])


@query("binary_score_matrix", "R2 P8 P10 F9", f"with {_AL} select cell, 'int_'||unit||'_pos_'||position as feature, 1.0::double as value, unit, position from al where allele<>0 and unit<=3")
def _(spark, sf):
    m = en.binary_matrix(en.allele_matrix(en.units_up_to(_alleles(spark, sf), 3)))
    return m.withColumn("unit", fn.feature_unit(F.col("feature"))).withColumn("position", fn.feature_position(F.col("feature")))


def _windows(spark, sf):
    return v.table(spark, sf, "nation").selectExpr(
        "cast(1 + n_nationkey div 7 as int) as target", "cast(n_nationkey % 7 + 1 as int) as listed",
        "cast(1 + (n_nationkey * 5) % 14 as int) as position")


_WIN = """win as (select cast(1+n_nationkey//7 as int) as target, cast(n_nationkey%7+1 as int) as listed, cast(1+(n_nationkey*5)%14 as int) as position from nation),
rkd as (select target, position, row_number() over (partition by target order by listed) as rank from win where position in (select position from al))"""


@query("window_bitmask", "R3", f"""with {_AL}, {_WIN} select cell, 'int_'||unit||'_target_'||target as feature, sum(1::bigint<<(rank-1))::bigint as value
from (select distinct cell, unit, position from al where allele<>0) join rkd using(position) group by 1, 2""")
def _(spark, sf):
    alleles = _alleles(spark, sf)
    return en.window_bitmask(alleles, en.ranked_windows(_windows(spark, sf), alleles))


@query("target_layout", "R4 R7", f"""with {_AL}, {_WIN}, t as (select target, string_agg(position::varchar, ';' order by rank) as logical_positions from rkd group by 1)
select unit, target, logical_positions, 'nonzero integer bitmask over logical_positions in listed order; 0=unedited' as encoding from t cross join (select distinct unit from al)""")
def _(spark, sf):
    alleles = _alleles(spark, sf)
    layout = en.target_layout(en.ranked_windows(_windows(spark, sf), alleles))
    spots = en.unit_target_layout(alleles.select("unit").distinct(), [(t, t) for t in range(1, 5)])
    return spots.join(layout, "target").select("unit", "target", "logical_positions", "encoding")


@query("one_hot_states", "R5", f"""with {_AL} select cell, 'int_'||unit||'_b'||position||'_'||['left','right','both'][1+cast(allele as int)%3] as feature, 1.0::double as value
from al where allele in (1,2,3)""")
def _(spark, sf):
    states = _alleles(spark, sf).where("allele in (0, 1, 2, 3)").selectExpr(
        "cell", "unit", "concat('b', position) as bit", "case when allele = 0 then 0 else 1 + cast(allele as int) % 3 end as state")
    return en.one_hot_states(states)


@query("characters_by_alphabet", "R6 U1", f"with {_AL} select cell, 'int_'||unit||'_pos_'||position as feature, case when unit%2=0 then allele else 1.0 end as value from al where allele<>0")
def _(spark, sf):
    registry = en.RecorderRegistry()
    registry.register("marks", lambda model: model["alphabet"] > 1, character_matrix=en.characters_by_alphabet)
    encode = registry.hook({"alphabet": 3}, "character_matrix")
    alleles = _alleles(spark, sf)
    return encode(alleles.select("cell", fn.feature_name(F.col("unit"), F.col("position")).alias("feature"),
                                 F.col("allele").alias("value"), F.when(F.col("unit") % 2 == 0, 3).otherwise(1).alias("alphabet")))


@query("unique_mutation_matrix", "R8", f"""with {_AL} select cell, concat_ws('_','bc',unit,position,{_TXT}) as feature, count(*)::double as value from al where allele<>0 group by 1,2
union all select cell, f, round(n/u,8) from (select cell, concat_ws('_','mt',position,{_TXT}) as f, count(*) as n from al where allele<>0 group by 1,2)
 join (select cell, count(distinct unit) as u from al group by 1) using(cell)""")
def _(spark, sf):
    alleles = _alleles(spark, sf)
    barcode = en.unique_mutation_matrix(alleles, "bc")
    mito = en.unique_mutation_matrix(alleles, "mt", alleles.select("cell", "unit"))
    return en.with_control_column(barcode, alleles.select("cell").distinct()).unionByName(_r(mito))


@query("fraction_threshold_variants", "P9", f"""with {_AL}, m as (select cell, f as feature, n/u as value from (select cell, concat_ws('_','mt',position,{_TXT}) as f, count(*) as n from al where allele<>0 group by 1,2)
 join (select cell, count(distinct unit) as u from al group by 1) using(cell))
select cell, feature, t::double as threshold, b as binary, round(case when b then 1.0 else value end,8) as value from m, (values (0.0),(0.3),(0.6)) x(t), (values (true),(false)) y(b) where value>=t""")
def _(spark, sf):
    alleles = _alleles(spark, sf)
    m = en.unique_mutation_matrix(alleles, "mt", alleles.select("cell", "unit"))
    return _r(en.threshold_variants(m, [0.0, 0.3, 0.6], [True, False]))


@query("reconstructed_sequences", "R9 S12 F7", f"""with {_AL}, ref as (select i as position, substr('AGCTTGCAAGTC', i, 1) as b from range(1,13) t(i)),
u as (select distinct cell, unit from al),
p as (select u.cell, u.unit, ref.position, case when allele is null or allele=0 then b when allele=-1 then '' when allele%1=0 then ['A','G','C','T'][cast(allele as int)]
  when allele=0.1 then b||'A' else b||'GT' end as piece from u cross join ref left join al on al.cell=u.cell and al.unit=u.unit and al.position=ref.position)
select cell, unit, string_agg(piece,'' order by position) as sequence from p group by 1,2""")
def _(spark, sf):
    alleles = _alleles(spark, sf)
    return en.sequences(alleles, alleles.select("cell", "unit").distinct(), "AGCTTGCAAGTC")


@query("masked_score_matrix", "R10", f"""with {_AL}, rec as (select distinct cell, unit from al where """ + v.sql_uniform('31', "cell||'|'||unit") + f""">=0.3), m as (select cell, unit, concat_ws('_',unit,position,{_TXT}) as feature, 1.0::double as value from al where allele<>0)
select m.* from m join rec using(cell,unit)
union all select c.cell, f.unit, f.feature, null from (select distinct cell from al) c cross join (select distinct unit, feature from m) f where (c.cell,f.unit) not in (select (cell,unit) from rec)""".replace(
    "(c.cell,f.unit) not in (select (cell,unit) from rec)", "not exists(select 1 from rec where rec.cell=c.cell and rec.unit=f.unit)"))
def _(spark, sf):
    alleles = _alleles(spark, sf)
    recovered = alleles.where(uniform(31, "cell", "unit") >= 0.3).select("cell", "unit").distinct()
    matrix = en.unique_mutation_matrix(alleles.withColumn("u", F.col("unit")), "bc").select(
        "cell", F.regexp_extract("feature", r"^bc_(\d+)_", 1).cast("int").alias("unit"),
        F.regexp_replace("feature", "^bc_", "").alias("feature"), "value")
    return en.mask_unrecovered(matrix, alleles, recovered)


@query("deletion_runs", "R11 W1", """with d as (select distinct l_orderkey//8 as cell, l_suppkey%5 as unit, l_partkey%40 as position from lineitem where l_returnflag='A'),
g as (select *, position-row_number() over (partition by cell, unit order by position) as run from d)
select cell, unit, max(position) as position, 'd'||count(*) as value from g group by cell, unit, run""")
def _(spark, sf):
    return en.deletion_runs(v.table(spark, sf, "lineitem").where("l_returnflag = 'A'").selectExpr(
        "l_orderkey div 8 as cell", "l_suppkey % 5 as unit", "l_partkey % 40 as position"))


@query("weighted_heteroplasmy_burden", "R12", f"""with {_AL}, m as (select cell, f as feature, n/u as value from (select cell, concat_ws('_','mt',position,{_TXT}) as f, count(*) as n from al where allele<>0 group by 1,2)
 join (select cell, count(distinct unit) as u from al group by 1) using(cell)), s as (select concat_ws('_','mt',p_partkey%12,p_partkey%4) as feature, max(p_size/10.0) as severity from part group by 1)
select cell, round(coalesce(sum(value*severity),0),8) as burden from m left join s using(feature) group by 1""")
def _(spark, sf):
    alleles = _alleles(spark, sf)
    m = en.unique_mutation_matrix(alleles, "mt", alleles.select("cell", "unit"))
    severity = v.table(spark, sf, "part").groupBy(F.expr("concat_ws('_', 'mt', p_partkey % 12, p_partkey % 4)").alias("feature")).agg(
        F.max(F.col("p_size") / 10.0).alias("severity"))
    return _r(en.weighted_burden(m, severity))


_SAMPLES = "rk as (select cell, row_number() over (order by md5('11|'||cell), cell) as sample_rank from (select distinct cell from al)), smp as (select cell, s as sample_size, sample_rank from rk, (values (20),(60),(150)) t(s) where sample_rank<=s)"


@query("nested_samples", "R15 W2", f"with {_AL}, {_SAMPLES} select * from smp")
def _(spark, sf):
    return en.nested_samples(en.sample_ranks(_alleles(spark, sf), 11), [20, 60, 150])


@query("condition_manifest", "R13 R14 P10 P11 F15", f"""with {_AL}, {_SAMPLES}, c as (select smp.sample_size, k as unit_count, al.* from al join smp using(cell), (values (1),(3),(5)) t(k) where unit<=k)
select 'comb_seed_004_n_'||lpad(sample_size::varchar,6,'0')||'_k_'||lpad(unit_count::varchar,3,'0') as condition_id, sample_size, unit_count, count(distinct unit||'_'||position) as columns, count(*) filter (allele<>0) as nonzeros, count(distinct cell) as cells_with_edits
from c group by all""")
def _(spark, sf):
    alleles = _alleles(spark, sf)
    samples = en.nested_samples(en.sample_ranks(alleles, 11), [20, 60, 150])
    matrix = alleles.withColumn("feature", fn.feature_name(F.col("unit"), F.col("position"))).withColumnRenamed("allele", "value")
    manifest = en.condition_manifest(en.condition_matrix(matrix, samples, [1, 3, 5]))
    return manifest.withColumn("condition_id", fn.condition_id(F.lit("comb"), F.lit(4), F.col("sample_size"), F.col("unit_count")))


@query("capacity_coverage", "R16 X25", """with d as (select p_brand as system, p_size%5+1 as targets_per_unit, 3 as units, p_retailprice as characters from part)
select system, targets_per_unit*units as targets, round(avg(characters),6) as mean_characters, round(100*avg(characters)/(targets_per_unit*units),6) as percent from d group by 1,2""".replace("group by 1,2", "group by system, targets_per_unit*units, targets_per_unit*units").replace("round(100*avg(characters)/(targets_per_unit*units),6)", "round(100*avg(characters)/any_value(targets_per_unit*units),6)"))
def _(spark, sf):
    design = en.capacity_design(v.table(spark, sf, "part").selectExpr(
        "p_brand as system", "p_size % 5 + 1 as targets_per_unit", "3 as units", "p_retailprice as characters"))
    return _r(en.character_coverage(design), 6)


_FR = f"""{v.SQL_GENOMES}, g as (select cell, count(distinct genome) as genomes from genomes group by 1),
fr as (select cell, position, allele, count(distinct genome) as variant_genomes, count(distinct genome)/any_value(genomes) as variant_fraction
 from genomes join g using(cell) group by 1,2,3)"""


def _fractions(spark, sf):
    g = v.genomes(spark, sf)
    return og.variant_fractions(g, g.groupBy("cell").agg(F.count_distinct("genome").alias("genomes")))


@query("mito_variant_fractions", "M1", f"with {_FR} select cell, position, allele, variant_genomes, round(variant_fraction,8) as variant_fraction from fr")
def _(spark, sf):
    return _r(_fractions(spark, sf))


@query("mito_burden", "M2", f"""with {_FR}, few as (select * from fr) select c.cell, count(few.cell) as variants, round(coalesce(sum(variant_fraction),0),8) as fraction_sum,
 round(coalesce(avg(variant_fraction),0),8) as fraction_mean, round(coalesce(max(variant_fraction),0),8) as fraction_max from (select distinct cell from genomes) c left join few using(cell) group by 1""")
def _(spark, sf):
    return _r(og.burden(_fractions(spark, sf), v.genomes(spark, sf)))


_PANEL = f"""{v.SQL_GENOMES}, ord as (select cell, genome, row_number() over (partition by cell order by md5('21|'||cell||'|'||genome), genome) as r from (select distinct cell, genome from genomes)),
pan as (select d as depth, cell, position, allele, count(distinct genome)/d as fraction from genomes join ord using(cell, genome), (values (1),(3),(6)) t(d) where r<=d group by 1,2,3,4)"""


def _panels(spark, sf):
    g = v.genomes(spark, sf)
    return og.depth_panels(g, og.genome_order(g, 21), [1, 3, 6])


@query("mito_depth_panels", "M3", f"with {_PANEL} select depth, cell, position, allele, round(fraction,8) as fraction from pan")
def _(spark, sf):
    return _r(_panels(spark, sf))


@query("mito_shared_universe", "M5", f"""with {_PANEL}, s as (select distinct l_orderkey//8 as cell from lineitem where l_quantity>=50 and l_discount>=0.1 and l_tax>=0.07),
u as (select distinct position, allele from pan where depth=6 and cell in (select cell from s))
select depth, cell, position, allele, round(fraction,8) as fraction from pan where cell in (select cell from s) and (position, allele) in (select (position, allele) from u)""".replace(
    "and (position, allele) in (select (position, allele) from u)", "and exists(select 1 from u where u.position=pan.position and u.allele=pan.allele)"))
def _(spark, sf):
    samples = v.table(spark, sf, "lineitem").where("l_quantity >= 50 and l_discount >= 0.1 and l_tax >= 0.07").selectExpr(
        "l_orderkey div 8 as cell").distinct()
    return _r(og.shared_universe(_panels(spark, sf), samples).select("depth", "cell", "position", "allele", "fraction"))


@query("mito_variant_manifest", "M4 F7 F9", f"""with {_AL}, s as (select distinct position, allele from al where allele<>0), ref as (select n_nationkey as position, nullif(substr('AGCTTGCAAGTCAGGTCCATTGCAG',n_nationkey,1),'') as reference from nation)
select 'mt_'||position||'_'||{_TXT} as feature, s.position, allele, reference, case when allele=-1 then '-' when allele%1=0 then ['A','G','C','T'][cast(allele as int)] when allele=0.1 then '+A' else '+G' end as alternate,
 '0=not_observed;1=observed' as encoding from s left join ref using(position)""")
def _(spark, sf):
    ref = v.table(spark, sf, "nation").selectExpr(
        "n_nationkey as position", "substring('AGCTTGCAAGTCAGGTCCATTGCAG', n_nationkey, 1) as reference")
    return og.variant_manifest(_alleles(spark, sf).where("allele <> 0"), ref)


def _haplotypes(spark, sf):
    return v.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey div 4 as cell", "l_suppkey % 4 as species", "l_suppkey % 4 < 3 and l_orderkey % 7 > 0 as labeled",
        "lpad(bin(l_partkey % 64), 6, '0') as haplotype", "cast(l_quantity as bigint) % 3 as count")


_HAP = """hap as (select l_orderkey//4 as cell, l_suppkey%4 as species, l_suppkey%4<3 and l_orderkey%7>0 as labeled, lpad(bin(l_partkey%64),6,'0') as haplotype,
 cast(l_quantity as bigint)%3 as count from lineitem)"""


@query("ecdna_cell_summary", "M6 F8", f"""with {_HAP}, h as (select *, length(replace(haplotype,'0','')) as e from hap) select cell, sum(count)::bigint as total_copies, coalesce(sum(count) filter (labeled),0)::bigint as labeled_copies, count(distinct species) as species,
 count(distinct species) filter (labeled) as labeled_species, round(coalesce(sum(e*count) filter (labeled)/nullif(sum(count) filter (labeled)*6,0),0),8) as edit_fraction from h group by 1""")
def _(spark, sf):
    return _r(og.ecdna_summary(_haplotypes(spark, sf), 6))


@query("ecdna_haplotypes", "M7 M9 F8", f"""with {_HAP}, m as (select n_nationkey as species, n_name as static_id from nation)
select cell, species, labeled, haplotype, sum(count)::bigint as count, static_id, length(replace(haplotype,'0','')) as edit_count from hap join m using(species) group by all""")
def _(spark, sf):
    manifest = v.table(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint) as species", "n_name as static_id")
    return og.haplotype_table(og.collapse_haplotypes(_haplotypes(spark, sf)), manifest)


@query("ecdna_copy_numbers", "M8", f"with {_HAP} select cell, cast(species as varchar) as feature, sum(count)::double as value from hap where labeled group by 1,2 having sum(count)>0")
def _(spark, sf):
    return og.copy_matrix(_haplotypes(spark, sf))


@query("ecdna_edited_fractions", "M8", f"""with {_HAP}, c as (select cell, species, sum(count) as n from hap where labeled group by 1,2),
e as (select cell, species, t as target, sum(count) as k from hap, range(1,7) x(t) where labeled and substr(haplotype,t::int,1)='1' group by 1,2,3)
select cell, species||'_'||target as feature, round(k/n,8) as value from e join c using(cell,species) where n>0 and k>0""")
def _(spark, sf):
    return _r(og.edited_fraction_matrix(_haplotypes(spark, sf), 6))


@query("variants_at_thresholds", "M10 J12", f"with {_FR} select t::double as threshold, cell, count(*) as variants from fr, (values (0.1),(0.2),(0.5)) x(t) where variant_fraction>=t group by 1,2")
def _(spark, sf):
    return og.variants_at_thresholds(_fractions(spark, sf), [0.1, 0.2, 0.5])


@query("variant_sharing", "M10 J18", f"""with {_FR}, p as (select position, allele, count(distinct cell) as cells, count(distinct cell%3) as founders from fr group by 1,2)
select count(*) as shared_variants, round(avg((founders=1)::int),8) as founder_private_share, max(founders) as max_founders from p where cells>=5""")
def _(spark, sf):
    founders = v.genomes(spark, sf).select("cell").distinct().withColumn("founder", F.col("cell") % 3)
    return _r(og.variant_sharing(_fractions(spark, sf), founders))


@query("cell_covariates", "J2 A8 M2 M6", f"""with {v.SQL_NODES}, {_AL}, {_HAP}, b as (select cell, count(*) filter (allele<>0) as edits from al group by 1),
e as (select cell, sum(count)::bigint as total_copies from hap group by 1)
select cast(n.cell_id as bigint) as cell, n.birth_time, coalesce(edits,0) as edits, coalesce(total_copies,0) as total_copies, d.static_id
from nodes n left join b on b.cell=cast(n.cell_id as bigint) left join e on e.cell=cast(n.cell_id as bigint)
left join (select n_nationkey as cell, n_name as static_id from nation) d on d.cell=cast(n.cell_id as bigint) where n.is_terminal""")
def _(spark, sf):
    tips = v.nodes(spark, sf).where("is_terminal").selectExpr("cast(cell_id as bigint) as cell", "birth_time")
    burden = _alleles(spark, sf).groupBy("cell").agg(F.count(F.when(F.col("allele") != 0, 1)).alias("edits"))
    copies = _haplotypes(spark, sf).groupBy("cell").agg(F.sum("count").alias("total_copies"))
    names = v.table(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint) as cell", "n_name as static_id")
    return og.covariates(tips, {"barcode": (burden, {"edits": 0}), "ecdna": (copies, {"total_copies": 0}),
                                "names": (names, {"static_id": None})})


@query("combined_modalities", "J16 J20", f"""with {_AL}, {_HAP}, u as (select cell, 'barcode' as modality, 'barcode:int_'||unit||'_pos_'||position as feature, allele as value from al where allele<>0
 union all select cell, 'ecdna', 'ecdna:'||species, sum(count)::double from hap where labeled group by cell, species having sum(count)>0) select * from u""")
def _(spark, sf):
    return og.modality_union({"barcode": en.allele_matrix(_alleles(spark, sf)), "ecdna": og.copy_matrix(_haplotypes(spark, sf))})


@query("modality_gaps", "J16 J11", f"""with {_AL}, {_HAP} select distinct cell, 'ecdna' as modality from hap where labeled and count>0 and cell not in (select cell from al where allele<>0)""")
def _(spark, sf):
    barcode = en.allele_matrix(_alleles(spark, sf))
    return og.modality_gaps({"ecdna": og.copy_matrix(_haplotypes(spark, sf))}, barcode.select("cell").distinct())


def _pool(spark, sf):
    return v.table(spark, sf, "supplier").selectExpr(
        "cast(s_suppkey + 1 as int) as pool_index", "s_name as guide_id", "greatest(0, s_acctbal) / 10000 as efficiency")


@query("guide_assignment", "J19", """with pool as (select s_suppkey+1 as pool_index, s_name as guide_id, greatest(0,s_acctbal)/10000 as efficiency from supplier),
t as (select p_partkey+1 as target_index from part)
select target_index, pool_index, guide_id, efficiency from t join pool on pool_index=(target_index-1)%(select count(*) from supplier)+1""")
def _(spark, sf):
    pool = _pool(spark, sf)
    targets = v.table(spark, sf, "part").selectExpr("p_partkey + 1 as target_index")
    return og.cyclic_assignment(targets, pool, pool.agg(F.count(F.lit(1)).alias("n")).select("n").scalar())


@query("guide_mark_blocks", "J19", """with pool as (select s_suppkey+1 as pool_index, s_name as guide_id, greatest(0,s_acctbal)/10000 as efficiency from supplier),
t as (select p_partkey+1 as target_index, m as mark_index from part, range(1,4) r(m)),
b as (select t.*, pool.* from t join pool on pool.pool_index=((target_index-1)*3+mark_index-1)%(select count(*) from supplier)+1)
select target_index, mark_index, guide_id, round(case when sum(efficiency) over (partition by target_index)>0 then efficiency/nullif(sum(efficiency) over (partition by target_index),0) else 1/3 end,8) as mark_probability from b""")
def _(spark, sf):
    pool = _pool(spark, sf)
    targets = v.table(spark, sf, "part").selectExpr("p_partkey + 1 as target_index")
    return _r(og.mark_blocks(targets, pool, pool.count(), 3).select("target_index", "mark_index", "guide_id", "mark_probability"))


@query("explicit_guide_assignment", "J19 J11", """with t as (select p_partkey+1 as target_index, 'Supplier#'||lpad((p_partkey%130)::varchar,9,'0') as guide_id from part)
select target_index, guide_id, guide_id in (select s_name from supplier) as known from t""")
def _(spark, sf):
    targets = v.table(spark, sf, "part").selectExpr("p_partkey + 1 as target_index", "concat('Supplier#', lpad(p_partkey % 130, 9, '0')) as guide_id")
    found, unknown = og.explicit_assignment(targets, _pool(spark, sf))
    return found.select("target_index", "guide_id", F.lit(True).alias("known")).unionByName(
        unknown.select("target_index", "guide_id", F.lit(False).alias("known")))
