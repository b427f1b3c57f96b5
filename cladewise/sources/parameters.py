"""Parameter documents: nested JSON to flat keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.session import shuffled


def flatten_json(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Leaves of nested JSON as ``name, value`` rows with dotted names.

    Object fields are joined by dots.  The entries of an array, nested arrays
    included, are numbered in order behind the name, unless there is only one.
    Each round opens one level of all documents.
    """
    level = documents.select(F.col(key).alias("doc"), F.parse_json(text).alias("v"), F.lit("").alias("name"), F.array().cast("array<int>").alias("places"))
    leaves = []
    while True:
        kind = F.schema_of_variant("v")
        typed = shuffled(level.select("doc", F.to_json("v").alias("v"), "name", "places", kind.alias("kind")), "json").withColumn("v", F.parse_json("v"))
        nested = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
        leaves.append(typed.where(~nested).select("doc", "name", "places", F.expr("variant_get(v, '$', 'string')").alias("value")))
        deeper = typed.where(nested)
        if deeper.isEmpty():
            break
        deeper.createOrReplaceTempView("_json_level")
        level = documents.sparkSession.sql(
            "select l.doc, e.value as v, "
            "case when e.key is null then l.name when l.name = '' then e.key else concat(l.name, '.', e.key) end as name, "
            "case when e.key is null then array_append(l.places, e.pos) else l.places end as places "
            "from _json_level l, lateral variant_explode(l.v) e")
    found = reduce(DataFrame.unionByName, leaves)
    same = Window.partitionBy("doc", "name")  # entries of one array of one document
    numbered = found.withColumn("_no", F.row_number().over(same.orderBy("places"))).withColumn("_n", F.count(F.lit(1)).over(same))
    return numbered.select(F.col("doc").alias(key), F.when(F.col("_n") > 1, F.concat("name", F.col("_no").cast("string"))).otherwise(
        F.col("name")).alias("name"), "value", F.col("name").alias("base"), F.col("_no").alias("entry"))


def name_transitions(flat: DataFrame, key: str) -> DataFrame:
    """Numbered transition-matrix entries named by source and target type.

    Types are those with a cycle length, in order of name; entry k of the
    row-by-row matrix belongs to source (k-1) div n and target (k-1) mod n.
    """
    typed = flat.withColumn("_type", F.regexp_extract("name", r"^cell_type_dict\.cell_type_params\.(.+?)\.cell_cycle_length", 1))
    types = typed.where("_type <> ''").groupBy(key).agg(F.array_sort(F.collect_set("_type")).alias("_types"))
    matrix = F.col("base").rlike(r"^cell_type_dict\.(un)?induced_transition_matrix$")
    n = F.size("_types")
    source = F.element_at("_types", (F.floor((F.col("entry") - 1) / n) + 1).cast("int"))
    target = F.element_at("_types", (F.pmod(F.col("entry") - 1, n) + 1).cast("int"))
    named = flat.join(types, key, "left")
    wrong = named.where(matrix).groupBy(key, "base").agg((F.count(F.lit(1)) != F.pow(F.max(n), F.lit(2))).alias("_wrong"))
    checked = named.join(wrong, [key, "base"], "left")
    fail = F.raise_error(F.lit("transition entries do not match the cell types")).cast("string")
    return checked.select(key, F.when(~matrix, F.col("name")).when(F.col("_wrong"), fail).otherwise(
        F.concat("base", source, target)).alias("name"), "value")


def result_table(results: DataFrame, parameters: DataFrame, name: Column) -> DataFrame:
    """Result files with name fields, parameters and accuracy."""
    from cladewise.functions.scalars import result_name_fields

    fields = result_name_fields(name)
    parsed = results.select("*", *[c.alias(n) for n, c in fields.items()])
    return parsed.join(parameters, "parameters", "left").withColumn("accuracy", 1 - F.col("rf"))
