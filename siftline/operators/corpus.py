"""Corpus statistics and the term index.

A passage table has the columns

    corpus string   scope of the statistics (a project, or one value for everything)
    pid    long     passage id, its order breaks ties
    text   string

The index is one table that can be written once and reused by many jobs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..session import cut_lineage


LENGTH_ROW = ""


@dataclass(frozen=True)
class TermIndex:
    """Everything derives from one postings table (corpus, term, pid, dl, tf). Each
    passage also has a row with the empty term, which carries its length even if it has
    no token at all."""

    postings: DataFrame

    @property
    def terms(self) -> DataFrame:
        """corpus, term, df"""
        return (self.postings.filter(F.col("term") != LENGTH_ROW)
                .groupBy("corpus", "term").agg(F.count(F.lit(1)).alias("df")))

    @property
    def stats(self) -> DataFrame:
        """corpus, passages, avg_len; passages without tokens count."""
        return (self.postings.filter(F.col("term") == LENGTH_ROW)
                .groupBy("corpus").agg(F.count(F.lit(1)).alias("passages"), F.avg("dl").alias("avg_len")))


def count_terms(passages: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The postings of passages (corpus, pid, text), of all terms or only of ``wanted``
    (corpus, term).

    The text is tokenized once. Repeats of a term are counted inside the input task, and
    terms nobody asks for are dropped before the shuffle.
    """
    tokens = passages.select("corpus", "pid", tx.tokenize(F.col("text")).alias("_t")).select(
        "corpus", "pid", F.size("_t").alias("dl"),
        F.explode(F.concat(F.array(F.lit(LENGTH_ROW)), "_t")).alias("term"))
    if wanted is not None:
        keep = wanted.select("corpus", "term").unionByName(
            wanted.select("corpus", F.lit(LENGTH_ROW).alias("term"))).distinct()
        tokens = tokens.join(keep, ["corpus", "term"], "left_semi")
    return tokens.groupBy("corpus", "term", "pid", "dl").agg(F.count(F.lit(1)).alias("tf"))


def build_index(passages: DataFrame, wanted: DataFrame | None = None) -> TermIndex:
    return TermIndex(cut_lineage(count_terms(passages, wanted)))


def write_index(passages: DataFrame, path: str) -> None:
    """Postings laid out by term, so that a query reads few row groups. The range bounds
    include the passage id, because one term may fill many files."""
    (count_terms(passages).repartitionByRange("corpus", "term", "pid")
        .sortWithinPartitions("corpus", "term", "pid").write.mode("overwrite").parquet(path))


def read_index(spark: SparkSession, path: str) -> TermIndex:
    return TermIndex(spark.read.parquet(path))


def language_counts(passages: DataFrame) -> DataFrame:
    return (
        passages.groupBy("corpus", tx.detect_lang(F.col("text")).alias("lang"))
        .agg(F.count(F.lit(1)).alias("passages"))
    )
