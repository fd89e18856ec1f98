"""Hybrid candidates by lists and counts, against the full ranks of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.operators import bm25, fusion, pool
from siftline.plans import retrieve

PASSAGES = "corpus string, pid long, text string, vector array<float>, source_key string"
GOALS = "query_id long, corpus string, text string, vector array<float>"


def tables(spark, seed, n=160, vectors=0.8):
    """Few words and few different vectors, so that scores tie; three languages of unequal size; corpora without
    vectors, without matches and without passages."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "rare", "omega"]
    russian = ["альфа", "бета", "гамма"]

    def text():
        kind = rng.random()
        if kind < 0.06:
            return rng.choice(["", "12 34", "--", None])
        return " ".join(rng.choices(russian if kind < 0.3 else words, k=rng.randint(1, 6)))

    def vector(share):
        return [float(rng.randint(-1, 2)) for _ in range(3)] if rng.random() < share else None

    passages = [(rng.choice(["a", "a", "b", "c", None]), 1000 - 3 * k if k % 2 else 5 * k, text(), None, f"s{k % 7}") for k in range(n)]
    passages = [(c, p, t, None if c == "c" else vector(vectors), s) for c, p, t, _, s in {r[1]: r for r in passages}.values()]
    goals = [(k, rng.choice(["a", "b", "c", "none", None]), text() if k % 5 else "nothing shared", vector(0.7)) for k in range(24)]
    return spark.createDataFrame(passages, PASSAGES).repartition(3), spark.createDataFrame(goals, GOALS)


def as_rows(df):
    columns = ["query_id", "pid", "lang", "bm25", "dense", "bm25_rank", "dense_rank", F.round("hybrid", 12).alias("hybrid"), "cand_idx", "source_key"]
    return sorted(map(tuple, df.select(columns).collect()), key=repr)


@pytest.mark.parametrize("seed, budget, quota, size", [(1, 24, 5, 128), (2, 4, 2, 1), (3, 1, 1, 1), (4, 7, 0, 1), (5, 3, 40, 1)])
def test_pool_equals_full_ranks(spark, seed, budget, quota, size):
    passages, goals = tables(spark, seed)
    whole = fusion.select_pool(retrieve.fused_pairs(passages, goals).withColumn("lang", F.coalesce("lang", F.lit("other"))), budget, quota)
    found = pool.candidates(passages, goals, budget, quota, size=size).join(passages.drop("text", "vector"), "pid")
    assert as_rows(fusion.select_pool(found, budget, quota)) == as_rows(whole)


def test_terms_are_those_of_the_index(spark):
    passages, goals = tables(spark, 6)
    match = bm25.match_passages(passages, goals)
    found = pool.candidates(passages, goals)
    want = bm25.explain(found.drop("terms"), match).select("query_id", "pid", "terms")
    assert sorted(map(repr, want.collect())) == sorted(map(repr, found.select("query_id", "pid", "terms").collect()))


def test_blocks_of_goals(spark, monkeypatch):
    passages, goals = tables(spark, 7)
    want = sorted(map(repr, pool.candidates(passages, goals, 3, 1).collect()))
    monkeypatch.setattr(pool, "LISTED", 1)
    monkeypatch.setattr(bm25, "BLOCK_TERMS", 3)
    assert sorted(map(repr, pool.candidates(passages, goals.limit(6), 3, 1).collect())) == [r for r in want if int(r.split("query_id=")[1].split(",")[0]) in {g["query_id"] for g in goals.limit(6).collect()}]


def test_tables_without_vectors_or_rows(spark):
    passages, goals = tables(spark, 8)
    plain = pool.candidates(passages.drop("vector"), goals.drop("vector"), 5, 2)
    assert plain.where("dense is not null or hybrid != bm25").count() == 0 and plain.count() > 0
    assert pool.candidates(passages.where("false"), goals).count() == 0
    assert pool.candidates(passages, goals.where("false")).count() == 0


def test_no_row_for_each_goal_and_passage_leaves_a_task(spark):
    """500 passages and 40 goals with lists of three: what is written has a few rows for each goal."""
    passages = spark.range(500).select(F.lit("a").alias("corpus"), F.col("id").alias("pid"), F.concat(F.lit("common word w"), F.col("id") % 7).alias("text")).coalesce(1)
    goals = spark.range(40).select(F.col("id").alias("query_id"), F.lit("a").alias("corpus"), F.concat(F.lit("common w"), F.col("id") % 7).alias("text"))
    written = []
    old = pool.cut_lineage
    pool.cut_lineage = lambda df: written.append(old(df)) or written[-1]
    try:
        assert pool.candidates(passages, goals, 2, 1, size=3).count() == 40 * 3
    finally:
        pool.cut_lineage = old
    assert sum(w.count() for w in written) < 500 + 40 * 3 * 3 + 20


def test_ahead_counts():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 4, (60, 3)) * [1, 1, 10]
    items = rng.integers(0, 5, (300, 3)) * [1, 1, 10]
    counter = pool.Ahead(*points.T)
    for part in np.array_split(items, 7):
        counter.add(*part.T)
    want = [sum(1 for g, k, p in items.tolist() if g == a and (k, p) < (b, c)) for a, b, c in points.tolist()]
    assert counter.result().tolist() == want


def test_scan_over_many_corpora(spark):
    """20 000 corpora of one passage: what is shipped follows the pairs of query and term, not corpora times terms."""
    n = 20_000
    passages = spark.range(n).select(F.concat(F.lit("c"), "id").alias("corpus"), F.col("id").alias("pid"), F.concat(F.lit("word w"), "id").alias("text"))
    goals = spark.range(n).select(F.col("id").alias("query_id"), F.concat(F.lit("c"), "id").alias("corpus"), F.concat(F.lit("w"), "id", F.lit(" other"), "id").alias("text"))
    sizes = []
    old = bm25.make_block

    def measured(*args):
        made = old(*args)
        sizes.append(sum(x.nbytes for x in vars(made[0]).values() if hasattr(x, "nbytes")))
        return made

    bm25.make_block = measured
    try:
        found = bm25.scan_best(passages, goals, 2)
        assert found.count() == n and found.where("query_id != pid").count() == 0
    finally:
        bm25.make_block = old
    assert sum(sizes) < 100 * n * 2


def test_asked_words_are_chosen_before_python(spark):
    rows = spark.createDataFrame([("c", 1, "en", ["iron", "x", "iron", "день"], [0.5]), (None, 2, "en", [], None)], "corpus string, pid long, lang string, tokens array<string>, vector array<double>")
    found = pool._asked(rows, {"iron", "день"})
    assert "Arrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.pid, r.dl, r.tokens, r.vector) for r in found.collect()) == [(1, 4, ["iron", "iron", "день"], [0.5]), (2, 0, [], None)]
    assert pool._asked(rows, set()).where("size(tokens) > 0").count() == 0
