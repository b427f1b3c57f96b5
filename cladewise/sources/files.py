"""Delimited files, wide matrices, manifests and file discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.functions.ranking import number_rows
from cladewise.operators.lineage import plain_id
from cladewise.session import shuffled


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def resolve_table_path(spark: SparkSession, path: str, required: bool = True) -> str | None:
    """The plain or ``.gz`` form of a path, the compressed one first."""
    plain = path[:-3] if path.lower().endswith(".gz") else path
    for candidate in (plain + ".gz", plain):
        if path_exists(spark, candidate):
            return candidate
    if required:
        raise FileNotFoundError(f"neither {plain}.gz nor {plain} exists")
    return None


def clean_header(df: DataFrame) -> DataFrame:
    """Column names without byte-order mark and surrounding blanks."""
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def read_table(spark: SparkSession, path: str, schema: str | None = None, separator: str = ",",
               required: bool = True) -> DataFrame | None:
    """CSV or TSV with a header, compressed or not; an absent optional file gives None.

    Without a schema every column stays text.
    """
    found = resolve_table_path(spark, path, required)
    if found is None:
        return None
    reader = spark.read.option("header", True).option("sep", separator)
    return clean_header((reader.schema(schema) if schema else reader).csv(found))


def write_table(df: DataFrame, path: str, separator: str = ",", compress: bool = True) -> None:
    """CSV or TSV with a header, gzip unless told otherwise."""
    df.write.option("header", True).option("sep", separator).option(
        "compression", "gzip" if compress else "none").csv(path)


def read_divisions(spark: SparkSession, path: str) -> DataFrame:
    """Division log restricted to its three columns, with the input order as ``seq``.

    The order of rows is the order of the files' names and of the rows inside
    them; ``seq`` counts from 1 without gaps over all files.
    """
    found = resolve_table_path(spark, path)
    raw = spark.read.option("header", True).csv(found).select("*", "_metadata.file_path", "_metadata.file_block_start")
    raw = clean_header(raw)
    missing = [c for c in ("time", "parent_ID", "daughter_ID") if c not in raw.columns]
    if missing:
        raise ValueError(f"division log lacks {', '.join(missing)}")
    # the id only orders rows of one block, which one task reads from front to back
    placed = shuffled(raw.select(
        F.col("time").try_cast("double").alias("time"), F.col("parent_ID").alias("parent_id"),
        F.col("daughter_ID").alias("daughter_id"), F.col("file_path").alias("_file"),
        F.col("file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")), "log")
    numbered = number_rows(placed, [], ["_file", "_block", "_row"], "seq")
    return numbered.select("time", "seq", "parent_id", "daughter_id")


def truth_value(value: Column) -> Column:
    """true/false/1/0 text as a boolean; other text is an error."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("true", "1"), F.lit(True)).when(text.isin("false", "0"), F.lit(False)).otherwise(
        F.raise_error(F.lit("alive values must be true/false or 1/0")).cast("boolean"))


def cell_ids(cells: DataFrame, alive_only: bool = False) -> DataFrame:
    """Distinct plain ids of a cell table, of living cells if the table says so."""
    if "ID" not in cells.columns:
        raise ValueError("a cell table needs an ID column")
    if alive_only and "alive" in cells.columns:
        cells = cells.where(truth_value(F.col("alive")))
    return cells.select(plain_id(F.col("ID")).alias("cell_id")).distinct()


def long_matrix(wide: DataFrame, cell: str, columns: list[str] | None = None) -> DataFrame:
    """Wide matrix to (cell, feature, value) rows.

    All columns of a row go through one array, so thousands of columns stay one
    expression; feature names are looked up by place.
    """
    names = columns or [c for c in wide.columns if c != cell]
    header = F.array(*[F.lit(n) for n in names])
    return wide.select(F.col(cell).alias("cell"), F.posexplode(F.array(*[F.col(f"`{n}`") for n in names])).alias("_no", "value")).select(
        "cell", F.element_at(header, F.col("_no") + 1).alias("feature"), "value")


def symbol_observations(wide: DataFrame) -> DataFrame:
    """Four-symbol matrix to observations; headers are ``<barcode>-<site>``."""
    long = long_matrix(wide, wide.columns[0])
    return long.select("cell", F.regexp_replace("feature", r"-[0-9]+$", "").alias("unit"),
                       F.regexp_extract("feature", r"-([0-9]+)$", 1).cast("int").alias("site"), F.col("value").alias("state"))


def score_observations(wide: DataFrame, label: str | None = None) -> DataFrame:
    """Wide score matrix: label column dropped, any nonzero entry is 1."""
    cell = label or wide.columns[0]
    return long_matrix(wide, cell).withColumn("value", (F.col("value").cast("double") != 0).cast("int"))


def wide_matrix(matrix: DataFrame, features: list[str], fill=0) -> DataFrame:
    """COO rows to a wide table with the given columns."""
    wide = matrix.groupBy("cell").pivot("feature", features).agg(F.first("value"))
    return wide.na.fill(fill, features)


def _field(value: Column) -> Column:
    """A CSV field, quoted where it must be; Spark's reader takes a backslash as the escape of a quote."""
    escaped = F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"')
    return F.when(value.rlike(r'[",\\\r\n]') | (value == ""), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(value)


def wide_lines(matrix: DataFrame, fill: str = "0") -> DataFrame:
    """COO rows ``cell, feature, value`` as lines of a wide CSV: ``is_header, cell, line``.

    Features are numbered by name in Spark and a line is put together from the
    entries of its cell in that order, with fills for the gaps.  So no names
    reach the driver and the plan does not widen with the features; only the
    header line and the line of a cell are as long as the format makes them.
    Of repeated entries the least value stays; null values count as absent,
    null features and cells are left out.
    """
    named = matrix.where("feature is not null and cell is not null")
    features = shuffled(number_rows(
        named.select(F.lit(1).alias("_all"), F.col("feature").cast("string").alias("feature")).distinct(), ["_all"], ["feature"], "_at",
    ).select("feature", "_at"), "features")
    width = features.agg(F.coalesce(F.max("_at"), F.lit(0)).cast("int").alias("n")).select("n").scalar()
    entries = named.groupBy(F.col("cell").cast("string").alias("cell"), F.col("feature").cast("string").alias("feature")).agg(
        F.min("value").cast("string").alias("value")).join(features, "feature")
    rows = entries.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct(F.col("_at").cast("int").alias("at"), "value"))).alias("_row"))
    gap = F.lit("," + fill)
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("_row"), i - 1)["at"])
    parts = F.transform("_row", lambda x, i: F.concat(
        F.repeat(gap, x["at"] - before(i) - 1), F.lit(","), F.coalesce(_field(x["value"]), F.lit(fill))))
    line = F.concat(_field(F.col("cell")), F.array_join(parts, ""), F.repeat(gap, width - F.element_at("_row", -1)["at"]))
    names = features.agg(F.array_sort(F.collect_list(F.struct("_at", "feature"))).alias("_names"))
    header = F.concat(F.lit("cell"), F.array_join(F.transform("_names", lambda x: F.concat(F.lit(","), _field(x["feature"]))), ""))
    return rows.select(F.lit(False).alias("is_header"), "cell", line.alias("line")).unionByName(
        names.select(F.lit(True).alias("is_header"), F.lit(None).cast("string").alias("cell"), header.alias("line")))


def write_wide(matrix: DataFrame, path: str, files: int | None = None, fill: str = "0", compress: bool = True) -> None:
    """COO rows as a folder of wide CSV files, each with the header, which Spark's reader takes once per file."""
    lines = shuffled(wide_lines(matrix, fill), "wide")
    n = files or int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.when(F.col("is_header"), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(
        F.array(F.pmod(F.xxhash64("cell"), F.lit(n)).cast("int")))
    dealt = lines.withColumn("_part", F.explode(part)).repartitionById(n, F.col("_part"))
    dealt.sortWithinPartitions(F.desc("is_header"), "cell").select("line").write.option(
        "compression", "gzip" if compress else "none").text(path)


def convert_matrices(spark: SparkSession, source: str, target: str, names: list[str]) -> None:
    """Every matrix of a folder of COO Parquet tables to a CSV folder."""
    for name in names:
        write_wide(spark.read.parquet(f"{source}/{name}"), f"{target}/{name}")


def with_provenance(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Columns taken from the path of the file each row came from."""
    path = F.col("_metadata.file_path")
    return df.select("*", *[F.regexp_extract(path, pattern, i).alias(n) for i, n in enumerate(names, start=1)])


def read_with_provenance(spark: SparkSession, pattern_path: str, schema: str, pattern: str, names: list[str]) -> DataFrame:
    """All files under a path pattern with directory names as columns."""
    return with_provenance(spark.read.option("header", True).schema(schema).csv(pattern_path), pattern, names)


def snapshots(spark: SparkSession, pattern_path: str, pattern: str = r"time[_=]([0-9.]+)") -> DataFrame:
    """Files with the time their path names, in time order."""
    files = spark.read.format("binaryFile").load(pattern_path).select("path", "length")
    return files.withColumn("time", F.regexp_extract("path", pattern, 1).try_cast("double")).where("time is not null").orderBy("time", "path")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Key/value manifest as one map per file."""
    rows = spark.read.option("header", True).schema("property string, value string").csv(path)
    return rows.withColumn("_file", F.col("_metadata.file_path")).groupBy("_file").agg(
        F.map_from_entries(F.collect_list(F.struct("property", "value"))).alias("properties"))


def write_manifest(properties: DataFrame, path: str) -> None:
    properties.select("property", "value").write.option("header", True).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Two-line result files: value, then the path of the parameters."""
    text = spark.read.text(path, wholetext=True)
    lines = F.split(F.col("value"), "\n")
    return text.select(F.col("_metadata.file_path").alias("file"), F.trim(lines[0]).try_cast("double").alias("rf"),
                       F.trim(F.try_element_at(lines, F.lit(2))).alias("parameters"))


def stack_endpoints(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All per-endpoint tables of a folder as one."""
    return spark.read.option("header", True).option("recursiveFileLookup", True).schema(schema).csv(path)


def guide_pool(tables: list[DataFrame]) -> DataFrame:
    """Guide catalogue from CSV and JSON tables; absent fields are null."""
    from cladewise.operators.tables import union_all_columns

    fields = ["guide_id", "edit_sequence", "efficiency", "spacer_sequence", "pbs_sequence", "rtt_sequence", "description"]
    pool = union_all_columns(tables)
    return pool.select(*[F.col(f) if f in pool.columns else F.lit(None).cast("string").alias(f) for f in fields])


def guide_pool_problems(pool: DataFrame) -> DataFrame:
    """Guides that break a rule of the catalogue, with the rule."""
    checks = F.array(
        F.when(F.col("guide_id").isNull() | (F.trim("guide_id") == ""), F.lit("id_missing")),
        F.when(~F.coalesce(F.upper(F.trim("edit_sequence")).rlike("^[ACGT]+$"), F.lit(False)), F.lit("edit_sequence")),
        F.when(~F.coalesce(F.col("efficiency").between(0, 1), F.lit(False)), F.lit("efficiency")))
    by_row = pool.select("guide_id", F.explode(F.array_compact(checks)).alias("rule"))
    twice = pool.groupBy("guide_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("guide_id", F.lit("id_repeated").alias("rule"))
    return by_row.unionByName(twice)


def synthetic_divisions(steps: DataFrame, total: int, shape: str, duration: float) -> DataFrame:
    """Division log of a comb or balanced tree; ``steps`` counts ``i`` from 1.

    In a balanced log the cell of step i is read off i: with m = i without its
    trailing zeros, cell 1 divides when m = 1, else cell (m-1)/2+1.
    """
    i = F.col("i").cast("long")
    daughter = (i + 1).alias("daughter_id")
    if shape == "comb":
        return steps.select((i * duration / total).alias("time"), i.alias("seq"), F.lit(1).cast("long").alias("parent_id"), daughter)
    if shape != "balanced":
        raise ValueError("shape is comb or balanced")
    odd = F.expr("shiftright(i, cast(log2(i & -i) as int))")
    level = F.floor(F.log2(i.cast("double"))).cast("int") + 1
    top = steps.agg(F.max(level).alias("t")).select("t").scalar()
    return steps.withColumn("i", i).select(
        (level * duration / (top + 1)).alias("time"), i.alias("seq"),
        F.when(odd == 1, 1).otherwise((odd - 1) / 2 + 1).cast("long").alias("parent_id"), daughter)
