"""Dense similarity of queries and passages.

Vectors arrive as a column. A query is compared with the passages of its own corpus:
an equi-join on the corpus, so every passage meets only its own queries.
"""

from __future__ import annotations

import decimal
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

QUERY_BLOCK_BYTES = 64 << 20
TILE = 1024


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, x: acc + x,
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(query: Column, passage: Column, query_norm: Column | None = None,
           passage_norm: Column | None = None) -> Column:
    """Four-digit cosine; a zero query counts as unit length, passages get 1e-9 of slack."""
    qn = norm(query) if query_norm is None else query_norm
    pn = norm(passage) if passage_norm is None else passage_norm
    unit = F.when(qn == 0, F.lit(1.0)).otherwise(qn)
    return F.round(_dot(query, passage) / unit / (pn + F.lit(1e-9)), 4)


def nearest(passages: DataFrame, queries: DataFrame, k: int,
            block_bytes: int = QUERY_BLOCK_BYTES, tile: int = TILE) -> DataFrame:
    """The ``k`` nearest passages (pid, vector) of every query (query_id, vector) of one
    corpus: query_id, pid, dense.

    Queries are read in order in blocks of ``block_bytes`` at most, a pass over the passages
    for each; in a task ``tile`` queries at a time are multiplied with as many passages, and
    only the k best of the task are kept, so neither a table nor a matrix of all pairs
    exists anywhere. Rows without a vector take no part; a vector of another length than the
    first query's is an error.
    """
    parts: list[DataFrame] = []
    block: list[tuple[int, list[float]]] = []
    for row in queries.where("query_id is not null and vector is not null").select("query_id", "vector").toLocalIterator(prefetchPartitions=False):
        block.append((row["query_id"], row["vector"]))
        if 8 * len(block) * max(1, len(row["vector"])) >= block_bytes:
            parts.append(_nearest_block(passages, block, k, tile))
            block = []
    if block or not parts:
        parts.append(_nearest_block(passages, block, k, tile))
    out = functools.reduce(DataFrame.unionByName, parts)
    from .ranking import top

    return top(out, ["query_id"], [F.col("dense").desc(), F.col("pid")], k, "dense_rank")


def half_up(x: np.ndarray) -> np.ndarray:
    """Four digits, half away from zero, as ``cosine`` rounds: by the shortest decimal form of a number."""
    scaled = np.abs(x) * 1e4
    low = np.floor(scaled)
    near = np.abs(scaled - low - 0.5) < 1e-6
    out = np.sign(x) * np.where(scaled - low >= 0.5, low + 1, low) / 1e4
    for place in zip(*np.nonzero(near)):
        out[place] = float(decimal.Decimal(repr(float(x[place]))).quantize(decimal.Decimal("0.0001"), decimal.ROUND_HALF_UP))
    return out


def _nearest_block(passages: DataFrame, block: list[tuple[int, list[float]]], k: int, tile: int) -> DataFrame:
    if len({len(v) for _, v in block}) > 1:
        raise ValueError("query vectors differ in length")
    ids = np.array([i for i, _ in block], np.int64)
    matrix = np.array([v for _, v in block], np.float64).reshape(len(ids), -1)
    if len(ids):
        lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = matrix / np.where(lengths == 0, 1.0, lengths)
    shipped = passages.sparkSession.sparkContext.broadcast((ids, matrix))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, unit = shipped.value
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for start in range(0, len(batch) if len(query_ids) else 0, tile):
                part = batch.iloc[start: start + tile]
                if any(len(v) != unit.shape[1] for v in part["vector"]):
                    raise ValueError("a passage vector differs in length from the queries")
                vectors = np.array(part["vector"].tolist(), dtype=np.float64)
                vectors = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9)
                pids = part["pid"].to_numpy(dtype=np.int64)
                for q in range(0, len(unit), tile):
                    scores = half_up(unit[q: q + tile] @ vectors.T)
                    ids_wide = np.broadcast_to(pids, scores.shape)
                    if q in kept:
                        scores, ids_wide = np.hstack([kept[q][0], scores]), np.hstack([kept[q][1], ids_wide])
                    order = np.lexsort((ids_wide, -scores), axis=1)[:, :k]
                    kept[q] = (np.take_along_axis(scores, order, 1), np.take_along_axis(ids_wide, order, 1))
        for q, (scores, pids) in kept.items():
            yield pd.DataFrame({
                "query_id": np.repeat(query_ids[q: q + tile], scores.shape[1]),
                "pid": pids.ravel(),
                "dense": scores.ravel() + 0.0,
            })

    return (passages.where("pid is not null and vector is not null").select("pid", "vector")
            .mapInPandas(best, "query_id long, pid long, dense double"))
