"""Session set-up and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "siftline", **conf) -> SparkSession:
    """A session with adaptive execution on. Pass ``master`` only for local runs;
    on a cluster spark-submit supplies it together with the sizing options."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors must share. A session of one
    machine without that setting (tests) gets a fresh temporary folder; elsewhere such a
    folder would be lost with its machine, so the setting is required."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="siftline-")


def cut_lineage(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` once as a table in the shared folder the cluster names in
    spark.checkpoint.dir and read it back. ``options`` are the writer's.

    Used where several branches need an expensive result: the plan is not computed once
    per branch, the copy survives lost executors, stays columnar and has a known size.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    path = f"{folder.rstrip('/')}/siftline-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_parts(df: DataFrame, column: str, parts: int) -> str:
    """Write ``df`` to a new folder below the shared one, in one folder ``column=value`` for each of about ``parts``
    values of ``column``, and return its path."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/siftline-{uuid.uuid4().hex}"
    df.repartition(parts, column).write.partitionBy(column).parquet(path)
    return path


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as the session setting spark.siftline.inputPartitions says;
    without it (on clusters, whose files have enough parts) ``df`` as it is."""
    wanted = df.sparkSession.conf.get("spark.siftline.inputPartitions", None)
    return df.repartition(int(wanted)) if wanted else df
