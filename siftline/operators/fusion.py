"""Rank fusion, candidate pools, re-rank merging and per-source diversification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import vocab
from .ranking import score_rank, top


def fuse(pairs: DataFrame, k: int = vocab.RRF_K, bm25_weight: float = vocab.RRF_BM25_WEIGHT,
         dense_weight: float = vocab.RRF_DENSE_WEIGHT) -> DataFrame:
    """Reciprocal-rank fusion over all passages of a query, those with score 0 included.

    ``pairs``: query_id, pid, bm25, dense. A passage without a vector (dense null) gets
    no dense share; a query none of whose passages has one keeps the BM25 score itself.
    """
    by_bm25 = score_rank(pairs, ["query_id"], "bm25", "pid", "bm25_rank")
    by_both = score_rank(
        by_bm25.withColumn("_d", F.coalesce("dense", F.lit(-9.0))), ["query_id"], "_d", "pid", "_dr")
    with_dense = by_both.withColumn("dense_rank", F.when(F.col("dense").isNotNull(), F.col("_dr"))).drop("_d", "_dr")
    has_dense = pairs.groupBy("query_id").agg((F.count("dense") > 0).alias("dense_on"))
    share = F.lit(bm25_weight) / (F.lit(k) + F.col("bm25_rank"))
    dense_share = F.coalesce(F.lit(dense_weight) / (F.lit(k) + F.col("dense_rank")), F.lit(0.0))
    return with_dense.join(has_dense, "query_id").withColumn(
        "hybrid", F.when(F.col("dense_on"), share + dense_share).otherwise(F.col("bm25"))
    )


def select_pool(scored: DataFrame, budget: int = vocab.POOL_BUDGET,
                min_per_lang: int = vocab.POOL_MIN_PER_LANG) -> DataFrame:
    """At most ``budget`` candidates per query with a quota for every language.

    The quota rows come first, language by language in the order of each language's best
    row, then the best of the rest. Only the best ``budget + 1`` rows of each language
    can matter; they are picked before the shuffle, so the windows below see a few rows
    per query. Adds ``cand_idx`` (0-based, by score).
    """
    best_first = [F.col("hybrid").desc(), F.col("pid")]
    by_query = W.partitionBy("query_id")
    rows = top(scored, ["query_id", "lang"], best_first, max(budget + 1, min_per_lang), "_lr")
    in_quota = F.col("_lr") <= min_per_lang
    rank = F.row_number().over(by_query.orderBy(*best_first))
    rows = rows.withColumn("_r", rank)
    lang_first = F.min(F.when(in_quota, F.col("_r"))).over(W.partitionBy("query_id", "lang"))
    rows = rows.withColumn("_lf", lang_first)
    order = [in_quota.desc(), F.when(in_quota, F.col("_lf")).otherwise(F.col("_r")), F.col("_r")]
    rows = rows.withColumn("_pos", F.row_number().over(by_query.orderBy(*order)))
    # A pool that takes everything keeps plain score order.
    kept = rows.withColumn("_n", F.count(F.lit(1)).over(by_query)).filter(F.col("_pos") <= budget)
    tie = F.when(F.col("_n") <= budget, F.col("_r")).otherwise(F.col("_pos"))
    kept = kept.withColumn("cand_idx", F.row_number().over(by_query.orderBy(F.col("hybrid").desc(), tie)) - 1)
    return kept.drop("_lr", "_r", "_lf", "_pos", "_n").withColumn("cand_idx", F.col("cand_idx").cast("long"))


def merge_rerank(pool: DataFrame, responses: DataFrame) -> DataFrame:
    """Put a provider's scores (query_id, cand_idx, pos, score) on the pool.

    Indexes outside the pool are ignored, candidates the provider did not return are
    dropped and its order is kept. A query without any valid response keeps its pool
    order and hybrid scores. Adds rerank, score, pos, reranked.
    """
    answers = responses.select(
        "query_id", "cand_idx", F.col("pos").alias("_p"), F.col("score").alias("rerank"),
        F.lit(True).alias("_hit"))
    joined = pool.join(answers, ["query_id", "cand_idx"], "left")
    answered = F.coalesce(F.max("_hit").over(W.partitionBy("query_id")), F.lit(False))
    merged = (
        joined.withColumn("reranked", answered)
        .filter(F.col("_hit") | ~F.col("reranked"))
        .withColumn("_p", F.coalesce("_p", "cand_idx"))
    )
    pos = F.row_number().over(W.partitionBy("query_id").orderBy("_p", "cand_idx"))
    final = F.coalesce("rerank", F.round("hybrid", 6))
    return merged.withColumn("score", final).withColumn("pos", pos.cast("long")).drop("_p", "_hit")


def diversify(ranked: DataFrame, source: str = "source_key", top_k: int = vocab.TOP_K,
              per_source: int = vocab.PER_SOURCE, order: Column | None = None) -> DataFrame:
    """At most ``per_source`` rows per source in the current order, then the first ``top_k``."""
    order = F.col("pos") if order is None else order
    capped = top(ranked, ["query_id", source], [order], per_source, "_s").drop("_s")
    return top(capped, ["query_id"], [order], top_k, "final_rank")


def score_bars(items: DataFrame, keys: list[str], score: str = "score", floor: float = 0.0001) -> DataFrame:
    """Score as a share of the best score of its run."""
    best = items.groupBy(*keys).agg(F.greatest(F.max(score), F.lit(floor)).alias("_m"))
    return items.join(best, keys).withColumn("bar", F.coalesce(F.col(score), F.lit(0.0)) / F.col("_m")).drop("_m")
