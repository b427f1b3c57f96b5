"""Checked queries: files in and out, Newick, character exports, parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladewise.functions.scalars import newick_label
from cladewise.operators import encodings as en
from cladewise.plans import views as v
from cladewise.plans.encoding_queries import _AL, _alleles
from cladewise.plans.registry import SQL, query
from cladewise.session import scratch_path
from cladewise.sources import characters as ch, files as fi, newick as nw, parameters as pa


@query("division_log_round_trip", "S1 S2 S4", "select cast(o_orderkey+1 as double) as time, row_number() over (order by o_orderkey) as seq, cast(o_orderkey//2 as varchar) as parent_id, cast(o_orderkey+4 as varchar) as daughter_id from orders")
def _(spark, sf):
    path = scratch_path(spark, "divisions") + ".csv.gz"
    log = v.divisions(spark, sf).selectExpr("time as ` time `", "parent_id as `parent_ID `", "daughter_id as daughter_ID", "seq as extra")
    # many files of unequal size, in the order of their names
    uneven = log.repartitionByRange(7, F.sqrt("extra")).sortWithinPartitions("extra")
    fi.write_table(uneven, path)
    return fi.read_divisions(spark, path[:-3])


@query("tab_separated_round_trip", "S3", "select c_custkey, c_name, c_acctbal from customer")
def _(spark, sf):
    path = scratch_path(spark, "customers")
    fi.write_table(v.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path, "\t", compress=False)
    return fi.read_table(spark, path, "c_custkey bigint, c_name string, c_acctbal double", "\t")


@query("living_cell_ids", "S5 P1", "select distinct cast(o_custkey as varchar) as cell_id from orders where o_orderstatus<>'P'")
def _(spark, sf):
    cells = v.table(spark, sf, "orders").selectExpr(
        "concat(o_custkey, '.0') as ID", "case o_orderstatus when 'F' then ' TRUE' when 'O' then '1' else 'false' end as alive")
    return fi.cell_ids(cells, alive_only=True)


@query("symbol_matrix_source", "S6 P7", f"""with {v.SQL_OBS}, c as (select distinct cell from obs), f as (select distinct unit, site from obs)
select cast(c.cell as varchar) as cell, f.unit, f.site::int as site, coalesce(state,'+') as state from c cross join f left join obs on obs.cell=c.cell and obs.unit=f.unit and obs.site=f.site""")
def _(spark, sf):
    obs = v.observations(spark, sf).select("cell", F.concat_ws("-", "unit", "site").alias("feature"), F.col("state").alias("value"))
    features = [f"u{u}-{s}" for u in range(5) for s in range(8)]
    path = scratch_path(spark, "symbols")
    fi.write_table(fi.wide_matrix(obs, features, "+"), path)
    return fi.symbol_observations(fi.read_table(spark, path))


@query("score_matrix_source", "S7 S13 P8", f"""with {_AL}, f as (select unit as u, position as p from al where allele<>0 group by 1,2)
select cast(c.cell as varchar) as cell, 'int_'||u||'_pos_'||p as feature, (coalesce(allele,0)<>0)::int as value from (select distinct cell from al where allele<>0) c cross join f left join al on al.cell=c.cell and al.unit=u and al.position=p""")
def _(spark, sf):
    matrix = en.allele_matrix(_alleles(spark, sf))
    folder = scratch_path(spark, "matrices")
    matrix.write.parquet(f"{folder}/coo/scores")
    fi.convert_matrices(spark, f"{folder}/coo", f"{folder}/csv", ["scores"])
    return fi.score_observations(fi.read_table(spark, f"{folder}/csv/scores"), "cell")


def _tree_texts(spark, sf):
    tips = v.table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_custkey % 200 as tree", "o_orderstatus as g",
        "case when o_orderkey % 5 = 0 then concat(\"it's \", o_orderkey) else concat('c', o_orderkey) end as label", "o_orderkey % 7 + 0.5 as length")
    groups = tips.groupBy("tree", "g").agg(F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_list(
        F.concat(newick_label(F.col("label")), F.lit(":"), F.col("length").cast("string")))), ","), F.lit(")"), F.col("g"), F.lit(":1")).alias("t"))
    text = groups.groupBy("tree").agg(F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_list("t")), ", "), F.lit(")top;")).alias("newick"))
    return text


@query("parsed_newick", "S8 F11", """with o as (select o_orderkey, o_custkey%200 as tree, o_orderstatus as g, case when o_orderkey%5=0 then 'it''s '||o_orderkey else 'c'||o_orderkey end as label from orders)
select tree, label, cast(o_orderkey%7+0.5 as double) as length, g as parent_label, true as is_tip from o
union all select distinct tree, g, 1.0::double, 'top', false from o union all select distinct tree, 'top', null, null, false from o""")
def _(spark, sf):
    text = _tree_texts(spark, sf)
    edges = nw.parse_newick(text, "tree", "newick")
    parents = edges.selectExpr("tree", "node as parent", "label as parent_label")
    return edges.join(parents, ["tree", "parent"], "left").select("tree", "label", "length", "parent_label", "is_tip")


@query("newick_text_over_splits", "S8", f"select label, length, parent_label, is_tip from ({SQL['parsed_newick']})")
def _(spark, sf):
    path = scratch_path(spark, "trees")
    _tree_texts(spark, sf).select("newick").write.text(path)
    tokens = nw.read_tokens(spark, path).withColumn("tree", F.concat_ws("#", "file", "tree"))
    edges = nw.parse_tokens(tokens, "tree")
    parents = edges.selectExpr("tree", "node as parent", "label as parent_label")
    return edges.join(parents, ["tree", "parent"], "left").select("label", "length", "parent_label", "is_tip")


_WALK = f"""{v.SQL_NODES},
r as (select node_id, parent_node_id, cell_id, branch_length, case when parent_node_id is null then cast(cell_id as bigint) when segment>0 then 0 else 1 end as no from nodes),
w as (select node_id, [no] as path from r where parent_node_id is null union all select r.node_id, list_append(w.path, r.no) from r join w on r.parent_node_id=w.node_id),
inner_ as (select distinct parent_node_id as node_id from nodes where parent_node_id is not null),
ev as (select path as k, case when path[len(path)]<>(select min(no) from r x where x.parent_node_id is not distinct from r.parent_node_id) then ',' else '' end || case when i.node_id is not null then '(' else '' end as token
   from r join w using(node_id) left join inner_ i on i.node_id=r.node_id
 union all select list_append(path, 99999999), case when i.node_id is not null then ')' else '' end || ''''||r.node_id||''':'||cast(cast(branch_length as bigint) as varchar) from r join w using(node_id) left join inner_ i on i.node_id=r.node_id)"""


@query("newick_tokens", "S9 U3 F11 W5", f"""with recursive {_WALK.replace("(select min(no) from r x where x.parent_node_id is not distinct from r.parent_node_id)", "(case when r.parent_node_id is null then (select min(no) from r x where x.parent_node_id is null) else 0 end)")}
select row_number() over (order by k)-1 as place, token from ev""")
def _(spark, sf):
    nodes = v.nodes(spark, sf).selectExpr(
        "1 as tree", "node_id", "parent_node_id", "node_id as label", "branch_length",
        "case when parent_node_id is null then cast(cell_id as bigint) when segment > 0 then 0 else 1 end as child_no")
    tokens = nw.newick_tokens(nodes, "tree", "node_id", "parent_node_id", "label", "branch_length", "child_no")
    return tokens.select("place", "token")


@query("newick_round_trip", "S8 S9", f"with {v.SQL_NODES} select node_id as label, branch_length as length, parent_node_id as parent_label from nodes")
def _(spark, sf):
    nodes = v.nodes(spark, sf).selectExpr(
        "1 as tree", "node_id", "parent_node_id", "node_id as label", "branch_length",
        "case when parent_node_id is null then cast(cell_id as bigint) when segment > 0 then 0 else 1 end as child_no")
    tokens = nw.newick_tokens(nodes, "tree", "node_id", "parent_node_id", "label", "branch_length", "child_no")
    edges = nw.parse_tokens(nw.single_tokens(tokens), "tree")
    parents = edges.selectExpr("tree", "node as parent", "label as parent_label")
    return edges.join(parents, ["tree", "parent"], "left").select("label", "length", "parent_label")


_STATES = f"""{_AL}, m as (select cell, 'int_'||unit||'_pos_'||position as feature, case when allele=-1 then null else case when allele<>0 then 1 else 0 end end as value from al),
f as (select distinct feature from m), s as (select c.cell, string_agg(case when m.cell is not null and value is null then '?' else cast(coalesce(value,0) as varchar) end, '' order by f.feature) as st
 from (select distinct cell from m) c cross join f left join m on m.cell=c.cell and m.feature=f.feature group by 1)"""


def _matrix(spark, sf):
    return _alleles(spark, sf).select("cell", F.concat(F.lit("int_"), "unit", F.lit("_pos_"), "position").alias("feature"),
                                      F.when(F.col("allele") != -1, (F.col("allele") != 0).cast("double")).alias("value"))


@query("character_fasta", "S10", f"with {_STATES} select cell, '>'||cell||chr(10)||st as record from s")
def _(spark, sf):
    matrix = _matrix(spark, sf)
    return ch.fasta(matrix, matrix)


@query("relaxed_phylip", "S11", f"with {_STATES} select 0 as place, null as cell, (select count(*) from s)||' '||(select count(*) from f) as line union all select 1, cast(cell as varchar), cell||' '||st from s")
def _(spark, sf):
    matrix = _matrix(spark, sf)
    return ch.phylip(matrix, matrix)


@query("sequence_fasta", "S12 R9", f"""with {_AL}, ref as (select i as position, substr('AGCTTGCAAGTC', i, 1) as b from range(1,13) t(i)), u as (select distinct cell, unit from al),
p as (select u.cell, u.unit, ref.position, case when allele is null or allele=0 then b when allele=-1 then '' when allele%1=0 then ['A','G','C','T'][cast(allele as int)] when allele=0.1 then b||'A' else b||'GT' end as piece
 from u cross join ref left join al on al.cell=u.cell and al.unit=u.unit and al.position=ref.position)
select line from (select unnest(['>cell_'||cell||'_int_'||unit, string_agg(piece,'' order by position)]) as line from p group by cell, unit)""")
def _(spark, sf):
    alleles = _alleles(spark, sf)
    rows = en.sequences(alleles, alleles.select("cell", "unit").distinct(), "AGCTTGCAAGTC")
    records = ch.sequence_fasta(rows, F.concat_ws("_", F.lit("cell"), "cell", F.lit("int"), "unit"))
    path = scratch_path(spark, "fasta")
    ch.write_records(records, path, "record", ["record"])
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("files_with_provenance", "S14 O4", "select c_custkey, c_acctbal, c_mktsegment as system, cast(c_nationkey as varchar) as slice from customer")
def _(spark, sf):
    path = scratch_path(spark, "runs")
    cells = v.table(spark, sf, "customer").selectExpr("c_custkey", "c_acctbal", "c_mktsegment as system", "c_nationkey as slice")
    cells.repartition("system", "slice").write.partitionBy("system", "slice").option("header", True).csv(path)
    return fi.read_with_provenance(spark, f"{path}/*/*/*.csv", "c_custkey bigint, c_acctbal double", r"system=([^/]+)/slice=([^/]+)/", ["system", "slice"])


@query("property_manifest", "S15", "select count(*)::varchar as rows, sum(c_custkey)::bigint::varchar as key_sum, max(c_name) as last_name from customer")
def _(spark, sf):
    path = scratch_path(spark, "manifest")
    one = v.table(spark, sf, "customer").agg(F.count(F.lit(1)).cast("string").alias("rows"), F.sum("c_custkey").cast("string").alias("key_sum"), F.max("c_name").alias("last_name"))
    fi.write_manifest(one.unpivot([], ["rows", "key_sum", "last_name"], "property", "value").coalesce(1), path)
    return fi.read_manifest(spark, path).select(*[F.col("properties")[k].alias(k) for k in ("rows", "key_sum", "last_name")])


@query("result_files", "S16 X19", """with r as (select p_brand as brand, round(avg(p_size)/100,4) as rf from part group by 1) select brand, rf, 'params/'||brand||'.json' as parameters, 'stem: 0.5' as cell_rec_fracs, 'F' as binarize,
 round(1-rf,4) as accuracy, length(brand) as weight from r""")
def _(spark, sf):
    path = scratch_path(spark, "results")
    rows = v.table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.round(F.avg("p_size") / 100, 4).alias("rf"))
    files = rows.select(F.concat(F.lit("score_proc_time_1.5_samp_stem-0.5_B_F_"), F.regexp_replace("brand", "#", "-")).alias("run"),
                        F.concat(F.col("rf").cast("string"), F.lit("\nparams/"), "brand", F.lit(".json")).alias("value"))
    files.repartition("run").write.partitionBy("run").text(path)
    params = rows.select(F.concat(F.lit("params/"), "brand", F.lit(".json")).alias("parameters"), F.length("brand").alias("weight"))
    table = pa.result_table(fi.read_results(spark, f"{path}/*/*.txt"), params, F.col("file"))
    return table.select(F.regexp_extract("parameters", "params/(.*).json", 1).alias("brand"), "rf", "parameters", "cell_rec_fracs", "binarize",
                        F.round("accuracy", 4).alias("accuracy"), "weight")


@query("accuracy_heatmap", "X19 X20 X10", """select p_size%3 as units, round(avg(1-p_size/100.0) filter (p_partkey%2=0),6) as r0, round(avg(1-p_size/100.0) filter (p_partkey%2=1),6) as r1 from part group by 1""")
def _(spark, sf):
    t = v.table(spark, sf, "part").selectExpr("p_size % 3 as units", "concat('r', p_partkey % 2) as recovery", "1 - p_size / 100.0D as accuracy")
    return t.groupBy("units").pivot("recovery", ["r0", "r1"]).agg(F.round(F.avg("accuracy"), 6))


@query("snapshot_files", "S17", "select distinct p_size+0.5::double as time from part")
def _(spark, sf):
    path = scratch_path(spark, "snapshots")
    v.table(spark, sf, "part").selectExpr("concat(p_size, '.5') as time", "p_name as value").repartition("time").write.partitionBy("time").text(path)
    return fi.snapshots(spark, f"{path}/*/*.txt").select("time").distinct()


@query("guide_catalogue", "S18 F17", """with p as (select s_name as guide_id, 'ACGT' as edit_sequence, s_acctbal/10000 as efficiency from supplier union all select n_name, case when n_regionkey=1 then 'ACX' else 'gat' end, 0.5 from nation)
select guide_id, 'efficiency' as rule from p where not (efficiency between 0 and 1) union all select guide_id, 'edit_sequence' from p where edit_sequence='ACX'""")
def _(spark, sf):
    csv = v.table(spark, sf, "supplier").selectExpr("s_name as guide_id", "'ACGT' as edit_sequence", "s_acctbal / 10000 as efficiency", "'x' as description")
    path = scratch_path(spark, "pool")
    v.table(spark, sf, "nation").selectExpr("n_name as guide_id", "case when n_regionkey = 1 then 'ACX' else 'gat' end as edit_sequence", "0.5D as efficiency").write.json(path)
    pool = fi.guide_pool([csv, spark.read.schema("guide_id string, edit_sequence string, efficiency double").json(path)])
    return fi.guide_pool_problems(pool)


@query("synthetic_divisions", "S19", """with i as (select o_orderkey+1 as i, (select count(*) from orders)+1 as n from orders), t as (select i, n, bit_count(xor(i, i-1))-1 as tz from i),
b as (select i, i>>tz as m, floor(log2(i))::int+1 as level from t)
select 'comb' as shape, round(i*60.0/n,6) as time, i as seq, 1 as parent_id, i+1 as daughter_id from i
union all select 'balanced', round(level*60.0/((select max(level) from b)+1),6), i, case when m=1 then 1 else (m-1)//2+1 end, i+1 from b""")
def _(spark, sf):
    steps = v.table(spark, sf, "orders").selectExpr("o_orderkey + 1 as i")
    n = steps.count() + 1
    comb, balanced = (fi.synthetic_divisions(steps, n, s, 60.0).withColumn("shape", F.lit(s)) for s in ("comb", "balanced"))
    return comb.unionByName(balanced).withColumn("time", F.round("time", 6))


@query("stacked_endpoints", "S21 O4", "select o_orderpriority as endpoint_name, o_orderkey, o_totalprice from orders")
def _(spark, sf):
    path = scratch_path(spark, "endpoints")
    for index, part in enumerate(["O", "F", "P"]):
        v.table(spark, sf, "orders").where(F.col("o_orderstatus") == part).selectExpr(
            "o_orderpriority as endpoint_name", "o_orderkey", "o_totalprice").write.option("header", True).csv(f"{path}/endpoint_{index}")
    return fi.stack_endpoints(spark, path, "endpoint_name string, o_orderkey bigint, o_totalprice double")


@query("flattened_parameters", "F14 S16", """select p_partkey, 'num_cells' as name, cast(p_size as varchar) as value from part union all select p_partkey, 'cell_type_dict.cell_type_params.stem.cell_cycle_length', cast(p_size+1 as varchar) from part
union all select p_partkey, 'cell_type_dict.cell_type_params.prog.cell_cycle_length', cast(p_size+2 as varchar) from part
union all select p_partkey, 'cell_type_dict.uninduced_transition_matrix'||['progprog','progstem','stemprog','stemstem'][k], cast(p_size*k as varchar) from part, range(1,5) t(k)
union all select p_partkey, 'targets'||k, cast(p_size-k as varchar) from part, range(1,3) t(k) union all select p_partkey, 'single', p_type from part""")
def _(spark, sf):
    text = v.table(spark, sf, "part").selectExpr("p_partkey", """concat('{"num_cells":', p_size, ',"cell_type_dict":{"cell_type_params":{"stem":{"cell_cycle_length":', p_size + 1,
        '},"prog":{"cell_cycle_length":', p_size + 2, '}},"uninduced_transition_matrix":[[', p_size, ',', p_size * 2, '],[', p_size * 3, ',', p_size * 4, ']]},"targets":[', p_size - 1, ',', p_size - 2, '],"single":["', p_type, '"]}') as json""")
    return pa.name_transitions(pa.flatten_json(text, "p_partkey", "json"), "p_partkey")
