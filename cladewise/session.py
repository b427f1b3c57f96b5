"""Session helper for tests and benchmarks; on a cluster pass your own session."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "cladewise") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CLADEWISE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="cladewise-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    On a cluster a missing setting is an error: a folder chosen here would be on
    one machine's disk.  A local session runs in one process and may use a
    temporary folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cladewise-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    A written table survives the loss of executors and brings its real size to
    the next join, so Spark broadcasts it only when it is known to be small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame, label: str = "step") -> DataFrame:
    """``written`` for tables that grow with the input: joins with them shuffle both sides.

    Written files are packed, so a table of ids and paths takes a tenth of its rows' size there, and Spark
    would send rows of many times its threshold through the driver, once a round of a loop.  A side named
    by ``F.broadcast`` still is one.
    """
    return written(df, label).hint("merge")


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``written`` made, once its successor stands."""
    spark = table.sparkSession
    shared = shared_folder(spark)
    folders = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not path.toUri().getPath().startswith(re.sub(r"^\w+://?", "/", shared).replace("//", "/")):
            raise ValueError(f"{folder} is not in the shared folder")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
