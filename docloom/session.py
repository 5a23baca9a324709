"""Session settings the library is tuned for.

Operators never change the session they are given. This helper is for jobs and tests that start
their own session; on a cluster the caller's settings (executors, shuffle partitions,
``spark.checkpoint.dir``) win.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: Bytes of a field in a row in memory, other than the eight of a number.
WIDTHS = {"string": 32, "binary": 32, "array": 96, "map": 96, "struct": 96}


def build_session(
    app: str = "docloom",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """Start (or reuse) a session. ``master`` is only set for local runs."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master).config(
            "spark.driver.memory", os.environ.get("DOCLOOM_DRIVER_MEMORY", "8g")
        )
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``, removed when the session's JVM ends.

    A session on one machine (``local[...]``) that names none gets a folder of that machine, which all its
    tasks share. Anywhere else a missing setting is an error: executors would write to their own disks.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{os.path.abspath(tempfile.gettempdir())}"
    path = f"{shared.rstrip('/')}/docloom-{name}-{os.urandom(8).hex()}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    return path


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several branches use and read it back.

    Without this every branch would plan and compute it again. The table lives in the shared scratch
    folder, so a lost executor costs nothing but its running tasks, and the read-back plan is a plain
    scan with column pruning and size statistics.
    """
    spark = df.sparkSession
    folder = scratch_dir(spark, name)
    df.write.mode("overwrite").parquet(f"{folder}/table")
    out = spark.read.schema(df.schema).parquet(f"{folder}/table")
    out._scratch = folder
    return out


def joinable(df: DataFrame, name: str) -> DataFrame:
    """``materialized`` for a table that others join, so large that its files must not pass for a broadcast.

    Files of repeated values are a small part of what their rows take in memory, and Spark sees only the files. The rows
    are counted; beyond the session's broadcast threshold joins with the table are told to sort and merge.
    """
    out = materialized(df, name)
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    width = 16 + sum(WIDTHS.get(f.dataType.typeName(), 8) for f in out.schema.fields)
    if not 0 < limit < out.count() * width:
        return out
    told = out.hint("merge")
    told._scratch = out._scratch
    return told


def discard(*tables: DataFrame) -> None:
    """Remove the folders of results of ``materialized`` that nothing will read again, instead of at the session's end.

    Whatever was made of them must be materialized itself. Other DataFrames are left alone.
    """
    for df in tables:
        folder = getattr(df, "_scratch", None)
        if folder is not None:
            spark = df.sparkSession
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
