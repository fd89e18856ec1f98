"""Hybrid retrieval for a table of goals, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx, vocab
from ..operators import bm25, dense, fusion, pool
from ..session import cut_lineage


def fused_pairs(passages: DataFrame, queries: DataFrame, match: bm25.Match | None = None) -> DataFrame:
    """Every query with the passages of its corpus: BM25, cosine, both ranks, hybrid.

    passages: corpus, pid, text, vector (may be null) and any other columns
    queries:  query_id, corpus, text, vector (may be null)
    """
    scored = bm25.score(bm25.match_passages(passages, queries) if match is None else match)
    has_vectors = "vector" in passages.columns and "vector" in queries.columns
    goal = queries.select("query_id", "corpus", *(
        [F.col("vector").alias("_qv"), dense.norm(F.col("vector")).alias("_qn")] if has_vectors else []))
    rows = passages.withColumn("lang", tx.detect_lang(F.col("text")))
    if has_vectors:
        rows = rows.withColumn("_pn", dense.norm(F.col("vector")))
    pairs = rows.drop("text").join(goal, "corpus")
    if has_vectors:
        cosine = dense.cosine(F.col("_qv"), F.col("vector"), F.col("_qn"), F.col("_pn"))
        pairs = pairs.withColumn("dense", cosine).drop("_qv", "_qn", "_pn", "vector")
    else:
        pairs = pairs.withColumn("dense", F.lit(None).cast("double"))
    pairs = (
        pairs.join(scored, ["query_id", "pid"], "left")
        .withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    )
    # The ranks need three passes over these narrow rows; the scoring runs once.
    return fusion.fuse(cut_lineage(pairs))


def candidate_pool(passages: DataFrame, queries: DataFrame, budget: int = vocab.POOL_BUDGET,
                   min_per_lang: int = vocab.POOL_MIN_PER_LANG) -> DataFrame:
    """At most ``budget`` candidates per query with all scores and matched terms. No goal is
    compared with its passages outside a task, see ``operators.pool``."""
    found = pool.candidates(passages, queries, budget, min_per_lang)
    others = [c for c in passages.columns if c not in ("text", "vector")]
    rows = cut_lineage(found).join(passages.select(others), "pid")
    return cut_lineage(fusion.select_pool(rows, budget, min_per_lang))


def retrieve(passages: DataFrame, queries: DataFrame, responses: DataFrame | None = None,
             top_k: int = vocab.TOP_K, budget: int = vocab.POOL_BUDGET,
             min_per_lang: int = vocab.POOL_MIN_PER_LANG,
             per_source: int = vocab.PER_SOURCE) -> tuple[DataFrame, DataFrame]:
    """(items, stages). ``items`` has one row per kept passage with all component scores,
    ``stages`` one row per query: passages, candidates, dense, fusion, reranked and
    languages. ``responses`` are re-rank scores (query_id, cand_idx, pos, score)."""
    spark = passages.sparkSession
    if responses is None:
        responses = spark.createDataFrame([], "query_id long, cand_idx long, pos long, score double")
    chosen = candidate_pool(passages, queries, budget, min_per_lang)
    merged = fusion.merge_rerank(chosen, responses)
    items = fusion.diversify(merged, top_k=top_k, per_source=per_source)
    return items, stage_log(passages, queries, chosen, merged)


def stage_log(passages: DataFrame, queries: DataFrame, chosen: DataFrame, merged: DataFrame) -> DataFrame:
    """Audit counts. Languages are counted per corpus before the queries join, so their
    cost does not grow with the number of queries."""
    vector = F.count("vector") if "vector" in passages.columns else F.lit(0)
    per_lang = (
        passages.groupBy("corpus", tx.detect_lang(F.col("text")).alias("lang"))
        .agg(F.count(F.lit(1)).alias("passages"), vector.alias("vectors"))
    )
    per_corpus = per_lang.groupBy("corpus").agg(
        F.sum("passages").alias("passages"), F.sum("vectors").alias("vectors"),
        F.array_sort(F.collect_list(F.struct("lang", "passages"))).alias("languages"),
    )
    with_vector = F.col("vector").isNotNull() if "vector" in queries.columns else F.lit(False)
    outcome = chosen.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates")).join(
        merged.groupBy("query_id").agg(F.max("reranked").alias("reranked")), "query_id")
    dense_on = F.col("_qv") & (F.col("vectors") > 0)
    return (
        queries.select("query_id", "corpus", with_vector.alias("_qv"))
        .join(per_corpus, "corpus").join(outcome, "query_id")
        .select("query_id", "passages", "candidates", dense_on.alias("dense"),
                F.when(dense_on, "rrf").otherwise("bm25").alias("fusion"), "reranked", "languages")
    )
