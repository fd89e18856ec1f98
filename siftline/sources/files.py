"""File scans: text with an encoding cascade, delimited files, change signatures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx, vocab
from ..operators import grids, records

# Encodings in the order they are tried.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1251", "latin-1")


def scan_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, file_type, modified, length, content of every file below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return with_names(files)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, file_type, modified, length: as ``scan_files``, without reading a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return with_names(files.select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))).drop("content")


def with_names(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)\z", 1)
    return files.select("path", name.alias("name"), tx.file_type(name).alias("file_type"),
                        F.col("modificationTime").alias("modified"), "length", "content")


def decode(files: DataFrame) -> DataFrame:
    """Adds text, encoding and error. A file that cannot be decoded becomes a row with an
    error; it does not stop the others."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, names, errors = [], [], []
            for raw in batch["content"]:
                text = name = error = None
                for encoding in ENCODINGS:
                    try:
                        text, name = bytes(raw).decode(encoding), encoding
                        break
                    except (UnicodeDecodeError, TypeError) as problem:
                        error = str(problem)[:200]
                texts.append(text)
                names.append(name)
                errors.append(None if text is not None else error)
            yield batch.drop(columns="content").assign(text=texts, encoding=names, error=errors)

    kept = files.select("path", "name", "file_type", "content")
    return kept.mapInPandas(run, "path string, name string, file_type string, text string, encoding string, error string")


def delimited_cells(decoded: DataFrame) -> DataFrame:
    """Cells of decoded delimited files; the delimiter is voted per file, quoted fields may hold line breaks."""
    lines = decoded.select(F.col("path").alias("doc"), F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("pos", "text"))
    return records.cells(lines, grids.delimiter_votes(lines))


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """A file whose layout is known: Spark's own reader, every column a string."""
    return spark.read.csv(path, sep=sep, header=header, inferSchema=False)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new or differ from the manifest (path, modified, length)."""
    return files.join(manifest.select("path", "modified", "length"), ["path", "modified", "length"], "left_anti")


def removed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.join(files.select("path"), "path", "left_anti")


def supported(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that can be parsed, the others)."""
    ok = F.col("file_type").isin(vocab.SUPPORTED_TYPES)
    return files.filter(ok), files.filter(~ok)
