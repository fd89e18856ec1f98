"""Tables whose rows belong to documents and are replaced by document: merge on read.

A write appends two folders, ``rows/<version>`` with the new rows and ``documents/<version>`` with the ids of all documents
it replaces, also of those that now have no row. Nothing that was written before is read or written again. Ids are
written last, so a version counts once its ids are complete. A reader takes each document's rows from its newest
version. ``compact`` writes a version that holds the whole table; readers start from the newest such version, and
``expire`` deletes what lies before it. A table has one writer at a time and any number of readers.

The name of a version tells its number, whether it holds the whole table, and the writer's token. A write with a token that is already there
replaces that version, so a batch that is repeated leaves one copy.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True, order=True)
class Version:
    number: int
    whole: bool
    token: str

    @property
    def folder(self) -> str:
        return f"v{self.number:012d}-{'whole' if self.whole else 'part'}-{self.token}"


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def versions(spark: SparkSession, path: str, complete: bool = True) -> list[Version]:
    """The versions of the table below ``path`` in order; complete ones only, or all that were begun. Lists names alone:
    as many as there were writes since the last ``expire``."""
    system, folder = _file_system(spark, f"{path}/documents")
    if not system.exists(folder):
        return []
    out = []
    for status in system.listStatus(folder):
        name = status.getPath().getName()
        number, kind, token = name[1:].split("-", 2)
        if not complete or system.exists(_file_system(spark, f"{path}/documents/{name}/_SUCCESS")[1]):
            out.append(Version(int(number), kind == "whole", token))
    return sorted(out)


def _write(spark: SparkSession, path: str, version: Version, rows: DataFrame | None, documents: DataFrame) -> None:
    number = F.lit(version.number).cast("long")
    # a reader must not take this version for complete while a repeated write replaces its rows
    system, folder = _file_system(spark, f"{path}/documents/{version.folder}")
    system.delete(folder, True)
    if rows is not None:
        rows.withColumn("version", number).write.mode("overwrite").parquet(f"{path}/rows/{version.folder}")
    documents.select("document_id").distinct().withColumn("version", number).write.mode("overwrite").parquet(f"{path}/documents/{version.folder}")


def replace(rows: DataFrame | None, documents: DataFrame, path: str, token: str) -> None:
    """Replace the rows of ``documents`` (document_id) by ``rows`` (document_id, ...), also by none. ``token`` names the
    write: repeated with the same token it changes nothing."""
    spark = documents.sparkSession
    token = hashlib.sha256(token.encode()).hexdigest()[:16]
    there = versions(spark, path, complete=False)
    same = [v for v in there if v.token == token and not v.whole]
    version = same[0] if same else Version(max((v.number for v in there), default=0) + 1, False, token)
    _write(spark, path, version, rows, documents)


def _standing(spark: SparkSession, path: str) -> list[Version]:
    """The versions that a reader needs: from the newest whole one on."""
    there = versions(spark, path)
    start = max((i for i, v in enumerate(there) if v.whole), default=0)
    return there[start:]


def read(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table's rows with the columns of ``schema``; none if there is no table yet. Of the whole version only the
    documents that were replaced since are looked up, by an anti join whose small side is what was written since."""
    wanted = StructType.fromDDL(schema if isinstance(schema, str) else schema.simpleString())  # every column may be null
    standing = _standing(spark, path)

    def load(some: list[Version]) -> DataFrame | None:
        system = _file_system(spark, path)[0]
        folders = [f"{path}/rows/{v.folder}" for v in some]
        folders = [f for f in folders if system.exists(_file_system(spark, f)[1])]
        return spark.read.option("mergeSchema", "true").parquet(*folders) if folders else None

    def shaped(df: DataFrame) -> DataFrame:
        for field in wanted:
            if field.name not in df.columns:
                df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
        return df.select(*wanted.names).to(wanted)

    whole = load([v for v in standing[:1] if v.whole])
    parts = [v for v in standing if not v.whole]
    newer = load(parts)
    out = spark.createDataFrame([], wanted)
    if parts:
        ids = spark.read.parquet(*[f"{path}/documents/{v.folder}" for v in parts])
        newest = ids.groupBy("document_id").agg(F.max("version").alias("version"))
        if newer is not None:
            out = shaped(newer.join(newest, ["document_id", "version"]))
        if whole is not None:
            whole = whole.join(newest, "document_id", "left_anti")
    return out if whole is None else shaped(whole).unionByName(out)


def compact(spark: SparkSession, path: str, schema: str | StructType) -> None:
    """Write the whole table as a version of its own, ordered by document so that a reader of few documents skips files.
    Tombstones end here. What was before stays readable until ``expire``."""
    there = versions(spark, path, complete=False)
    if not there:
        return
    number = there[-1].number + 1
    rows = read(spark, path, schema).repartitionByRange("document_id").sortWithinPartitions("document_id")
    _write(spark, path, Version(number, True, "compacted"), rows, rows.select("document_id"))


def expire(spark: SparkSession, path: str) -> int:
    """Delete the versions before the newest whole one, and its rows that no complete version names; returns how many.
    No reader may still use them."""
    standing = {v.folder for v in _standing(spark, path)}
    gone = 0
    for kind in ("documents", "rows"):
        system, folder = _file_system(spark, f"{path}/{kind}")
        if not system.exists(folder):
            continue
        for status in system.listStatus(folder):
            if status.getPath().getName() not in standing:
                system.delete(status.getPath(), True)
                gone += 1
    return gone
