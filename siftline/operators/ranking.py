"""Exact ranks and running totals over groups of any size.

A plain window puts a whole group into one task. Here a group is first divided into
buckets along its order; only per-bucket totals meet in one place, and each bucket is
then numbered on its own from the offset that the totals give it. The result equals
the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKET = 100_000


def running_total(df: DataFrame, keys: list[str], position: str, value: Column, out: str,
                  width: int = BUCKET) -> DataFrame:
    """Inclusive running sum of ``value`` by the integer column ``position``.

    Rows need distinct positions within a group. A bucket holds at most ``width``
    positions, and the totals window sees one row per bucket.
    """
    rows = df.withColumn("_v", value.cast("long")).withColumn("_b", F.floor(F.col(position) / width))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
        .select(*keys, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    )
    inside = W.partitionBy(*keys, "_b").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.join(offsets, [*keys, "_b"])
        .withColumn(out, F.sum("_v").over(inside) + F.col("_o"))
        .drop("_v", "_b", "_o")
    )


def ordinal(df: DataFrame, keys: list[str], position: str, out: str, width: int = BUCKET) -> DataFrame:
    """1-based number of a row in its group by ``position``."""
    return running_total(df, keys, position, F.lit(1), out, width)


def score_rank(df: DataFrame, keys: list[str], score: str, index: str, out: str,
               width: int = BUCKET) -> DataFrame:
    """1-based rank by score descending, then index ascending.

    Buckets are (score, index range). Scores are rounded values, so a group has a
    bounded number of them; a long tie (all zero scores, exact copies) is divided by
    index range.
    """
    rows = df.withColumn("_b", F.floor(F.col(index) / width))
    before = (W.partitionBy(*keys).orderBy(F.col(score).desc(), "_b")
              .rowsBetween(W.unboundedPreceding, -1))
    offsets = (
        rows.groupBy(*keys, score, "_b").agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, score, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    )
    inside = W.partitionBy(*keys, score, "_b").orderBy(index)
    # keys and score may be null: such rows form a group and come last in it
    named = offsets.select(*[F.col(c).alias(f"_j{i}") for i, c in enumerate([*keys, score, "_b"])], "_o")
    same = [F.col(c).eqNullSafe(F.col(f"_j{i}")) for i, c in enumerate([*keys, score, "_b"])]
    return (
        rows.join(named, same)
        .withColumn(out, F.row_number().over(inside) + F.col("_o"))
        .drop("_b", "_o", *[f"_j{i}" for i in range(len(same))])
    )


def top(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group. Spark keeps k rows per input task before
    the shuffle (WindowGroupLimit), so a hot group moves k rows per task."""
    position = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, position.cast("long")).filter(F.col(out) <= k)


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every group: the ordered form of dropDuplicates."""
    return top(df, keys, order, 1, "_first").drop("_first")
