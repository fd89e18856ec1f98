"""Registered queries and, beside each, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftline.session import spread

# Tables whose rows are costly to process; a single small file should use all cores.
TEXT_TABLES = {"documents", "pages", "conversations", "embeddings"}

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Name -> query, and name -> SQL where SQL can say the same."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        def keep(fn: Query) -> Query:
            key = name or fn.__name__
            self.queries[key] = fn
            if sql is not None:
                self.sql[key] = sql
            return fn

        return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows) if name in TEXT_TABLES else rows
