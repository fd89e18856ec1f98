"""Writers. Each takes rows that the operators prepared and a target folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import hypotheses as hy


def write_csv(ranked: DataFrame, path: str, project_id: str | None = None) -> None:
    """The CSV export in rank order, a folder per project. For one project (``project_id``)
    a report is written straight into ``path`` with a byte order mark at the head of each
    file, so that spreadsheets read Cyrillic."""
    if project_id is None:
        rows = hy.csv_rows(ranked, ["project_id"])
        (rows.repartitionByRange("project_id", "rank").sortWithinPartitions("project_id", "rank")
            .write.mode("overwrite").partitionBy("project_id").csv(path, header=True, escape='"'))
        return
    rows = hy.csv_rows(ranked.filter(F.col("project_id") == project_id))
    header = "\ufeff" + rows.columns[0]
    (rows.withColumnRenamed(rows.columns[0], header).repartitionByRange(F.col(f"`{header}`")).sortWithinPartitions(F.col(f"`{header}`"))
        .write.mode("overwrite").csv(path, header=True, escape='"'))


def write_json(ranked: DataFrame, path: str) -> None:
    """One object per hypothesis and line, a folder per project."""
    (hy.json_rows(ranked).repartitionByRange("project_id", "rank").sortWithinPartitions("project_id", "rank")
        .select("project_id", F.col("json").alias("value")).write.mode("overwrite").partitionBy("project_id").text(path))


def write_report(ranked: DataFrame, projects: DataFrame, path: str, weights: dict[str, float] | None = None, exported_at: str = "") -> None:
    """One JSON document for each project, a folder per project; its files in the order of their names are its lines."""
    (hy.report_lines(ranked, projects, weights, exported_at).repartitionByRange("project_id", "rank").sortWithinPartitions("project_id", "rank")
        .select("project_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("project_id").text(path))


def write_markdown(ranked: DataFrame, projects: DataFrame, path: str) -> None:
    """Header and blocks of every project in rank order, a folder per project."""
    totals = ranked.groupBy("project_id").agg(F.count(F.lit(1)).alias("total"))
    head = hy.markdown_header(projects, totals).select("project_id", F.lit(0).cast("long").alias("rank"), F.col("header").alias("block"))
    rows = head.unionByName(hy.markdown_blocks(ranked))
    (rows.repartitionByRange("project_id", "rank").sortWithinPartitions("project_id", "rank")
        .select("project_id", F.col("block").alias("value")).write.mode("overwrite").partitionBy("project_id").text(path))


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)


def replace_partitions(rows: DataFrame, path: str, key: str) -> None:
    """Overwrite only the partitions of ``key`` that occur in ``rows``; others stay. A
    repeated write gives the same table."""
    (rows.repartition(key, F.pmod(F.xxhash64(*rows.columns), F.lit(16)))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path))
