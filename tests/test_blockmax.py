"""The block index against the index by terms."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siftline.operators import blockmax, bm25

from .test_pool import GOALS, PASSAGES, tables


def rows(df):
    return sorted(map(repr, df.select("query_id", "pid", "bm25", "rank", "terms").collect()))


@pytest.mark.parametrize("seed, k, tile, block", [(1, 6, 1 << 13, 64), (2, 2, 7, 2), (3, 1, 20, 3), (4, 50, 9, 1)])
def test_best_equals_index_by_terms(spark, tmp_path, seed, k, tile, block):
    passages, goals = tables(spark, seed)
    passages, goals = passages.where("corpus is not null"), goals.where("corpus is not null")
    blockmax.build(passages, tile, block).write.parquet(str(tmp_path / "index"))
    best, told = blockmax.search(blockmax.read(spark, str(tmp_path / "index")), goals, k)
    assert rows(best) == rows(bm25.best(bm25.match_passages(passages, goals), k))
    could, did = told.first()
    assert 0 < did <= could


def test_blocks_that_cannot_win_are_skipped(spark):
    """A rare word leads; its passages are short, so blocks of long passages with the common word stay unread."""
    rng = random.Random(4)
    texts = [(1, k, "needle common") for k in range(3)] + [(1, 10 + k, " ".join(["common"] + ["filler"] * rng.randint(5, 300))) for k in range(2000)]
    passages = spark.createDataFrame([(str(c), p, t) for c, p, t in texts], "corpus string, pid long, text string").coalesce(1)
    goals = spark.createDataFrame([(1, "1", "needle common")], "query_id long, corpus string, text string")
    best, told = blockmax.search(blockmax.build(passages), goals, 3)
    assert [r["pid"] for r in best.orderBy("rank").collect()] == [0, 1, 2]
    could, did = told.first()
    assert could >= 2003 // 64 and did <= 2


def test_long_ties_and_small_corpora(spark):
    """Equal scores come out by id; rows of many corpora are not held for ever."""
    passages = spark.range(3000).select(F.concat(F.lit("c"), F.col("id") % 1000).alias("corpus"), F.col("id").alias("pid"), F.lit("same words here").alias("text")).coalesce(1)
    goals = spark.createDataFrame([(1, "c7", "same words"), (2, "c9", "words")], "query_id long, corpus string, text string")
    index = blockmax.build(passages, tile=4, block=2)
    assert index.count() >= 1000
    assert [(r["query_id"], r["pid"]) for r in blockmax.search(index, goals, 2)[0].orderBy("query_id", "rank").collect()] == [(1, 7), (1, 1007), (2, 9), (2, 1009)]


def test_empty_tables(spark):
    passages, goals = spark.createDataFrame([], PASSAGES), spark.createDataFrame([], GOALS)
    assert blockmax.search(blockmax.build(passages), spark.createDataFrame([(1, "a", "x y z", None)], GOALS))[0].count() == 0
    assert blockmax.search(blockmax.build(spark.createDataFrame([("a", 1, None, None, "s")], PASSAGES)), goals)[0].count() == 0


def test_rows_and_row_groups_are_bounded_by_tokens(spark, tmp_path):
    """Long passages make rows of fewer of them, and no row group holds many rows."""
    passages = spark.range(2500).coalesce(1).select(
        F.lit("a").alias("corpus"), F.col("id").alias("pid"), F.concat(F.lit("needle "), F.repeat(F.lit("filler "), 1000)).alias("text"))
    blockmax.write(passages, str(tmp_path / "index"))
    index = blockmax.read(spark, str(tmp_path / "index"))
    tokens = [r["n"] for r in index.select(F.aggregate("lengths", F.lit(0), lambda a, x: a + x).alias("n")).collect()]
    assert sum(tokens) == 2500 * 1001 and max(tokens) <= blockmax.TOKENS + blockmax.STEP * 1001
    groups = [f.metadata.row_group(i).num_rows for f in map(pq.ParquetFile, (tmp_path / "index").glob("*.parquet")) for i in range(f.metadata.num_row_groups)]
    assert sum(groups) == len(tokens) and max(groups) <= 4
    goals = spark.createDataFrame([(1, "a", "needle")], "query_id long, corpus string, text string")
    assert [r["pid"] for r in blockmax.search(index, goals, 3)[0].orderBy("rank").collect()] == [0, 1, 2]
