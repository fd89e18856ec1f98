"""A kept BM25 index in blocks that tell the most they can add, searched block by block.

A row of the index holds up to about ``TILE`` passages or ``TOKENS`` tokens of one corpus, ordered by length and cut
into blocks of ``BLOCK`` passages. For each term it has the postings, and for each term and block the largest frequency and the smallest length:
no passage of the block gets more from the term than such a passage would. Rows are made inside the input tasks, so the
index is built without a shuffle, is written once and serves any number of searches.

A search sums, for each query and block, what its terms can add at most. The most promising block of each query is
scored first; then only those blocks that can still beat the query's k-th best score so far.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx, vocab
from . import bm25
from .dense import half_up
from .ranking import top

TILE, BLOCK = 1 << 13, 64
#: Tokens from which on a row is closed, and passages that are taken out of a batch at once.
TOKENS, STEP = 1 << 19, 256
#: Rows are long, so a row group holds few of them: tasks write and read a row group as a whole.
LAYOUT = {"parquet.block.row.count.limit": 4}
_COLUMNS = ("pids array<long>, lengths array<int>, words array<string>, first array<int>, rows array<int>, tfs array<int>, "
            "block_first array<int>, blocks array<int>, most_tf array<int>, least_length array<int>")
_ARRAYS = [c.split()[0] for c in _COLUMNS.split(", ")]


def _row(corpus, pid: np.ndarray, tokens: pa.ListArray, block: int) -> dict:
    """One row of the index."""
    sizes = np.diff(tokens.offsets.to_numpy())
    order = np.lexsort((pid, sizes))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    flat = tokens.flatten()
    coded = flat.dictionary_encode()
    by_name = pc.array_sort_indices(coded.dictionary).to_numpy() if len(flat) else np.zeros(0, np.int64)
    number = np.empty(len(by_name), np.int64)
    number[by_name] = np.arange(len(by_name))
    word = number[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
    n, length = len(pid), sizes[order]
    key, tf = np.unique(word * n + np.repeat(place, sizes), return_counts=True)
    word, row = key // n, key % n
    many = -(-n // block)
    in_block = word * many + row // block
    begin = np.flatnonzero(np.r_[True, in_block[1:] != in_block[:-1]]) if len(key) else np.zeros(0, np.int64)
    return {
        "corpus": corpus, "pids": pid[order], "lengths": length, "words": coded.dictionary.take(pa.array(by_name)) if len(flat) else pa.array([], pa.string()),
        "first": np.searchsorted(word, np.arange(len(by_name) + 1)), "rows": row, "tfs": tf,
        "block_first": np.searchsorted(word[begin], np.arange(len(by_name) + 1)), "blocks": row[begin] // block,
        "most_tf": np.maximum.reduceat(tf, begin) if len(key) else tf, "least_length": np.minimum.reduceat(length[row], begin) if len(key) else row}


def build(passages: DataFrame, tile: int = TILE, block: int = BLOCK, most: int = TOKENS) -> DataFrame:
    """The index of passages (corpus, pid, text): corpus, block (passages in one) and the arrays of each row, to be written
    with the options in ``LAYOUT``."""
    step = min(tile, STEP)
    kind = passages.schema["corpus"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        sizes: dict = {}  # passages and tokens of what is held

        def told(corpus) -> pa.RecordBatch:
            parts = held.pop(corpus)
            sizes.pop(corpus)
            found = _row(corpus, np.concatenate([p for p, _ in parts]), pa.concat_arrays([t for _, t in parts]), block)
            arrays = [pa.array([found["corpus"]], type_), pa.array([block], pa.int32())]
            for name, field in zip(_ARRAYS, _COLUMNS.split(", ")):
                item = {"array<long>": pa.int64(), "array<int>": pa.int32(), "array<string>": pa.string()}[field.split()[1]]
                value = found[name] if isinstance(found[name], pa.Array) else pa.array(found[name].astype(np.int64)).cast(item)
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value))
            return pa.RecordBatch.from_arrays(arrays, names=["corpus", "block", *_ARRAYS])

        for batch in (whole.slice(at, step) for whole in batches for at in range(0, len(whole), step)):
            type_ = batch.column("corpus").type
            coded = batch.column("corpus").dictionary_encode()
            index = pc.fill_null(coded.indices, -1).to_numpy()
            for code in np.unique(index):
                corpus = coded.dictionary[int(code)].as_py() if code >= 0 else None
                rows = pa.array(np.flatnonzero(index == code))
                pid, tokens = batch.column("pid").take(rows).to_numpy(), batch.column("tokens").take(rows)
                held.setdefault(corpus, []).append((pid, tokens))
                passages, words = sizes.get(corpus, (0, 0))
                sizes[corpus] = passages + len(pid), words + len(tokens.flatten())
                if sizes[corpus][0] >= tile or sizes[corpus][1] >= most:
                    yield told(corpus)
            # rows of many small corpora are not held for ever
            if sum(n for n, _ in sizes.values()) >= 8 * tile or sum(n for _, n in sizes.values()) >= 8 * most:
                for corpus in list(held):
                    yield told(corpus)
        for corpus in list(held):
            yield told(corpus)

    tokens = passages.where("pid is not null").select("corpus", F.col("pid").cast("long").alias("pid"), tx.tokenize(F.coalesce("text", F.lit(""))).alias("tokens"))
    return tokens.mapInArrow(make, f"corpus {kind}, block int, {_COLUMNS}")


def write(passages: DataFrame, path: str) -> None:
    build(passages).write.mode("overwrite").options(**LAYOUT).parquet(path)


def _list(batch: pa.RecordBatch, name: str, row: int) -> pa.Array:
    column = batch.column(name)
    at = column.offsets[row].as_py()
    return column.values.slice(at, column.offsets[row + 1].as_py() - at)


def _statistics(index: DataFrame, words: pa.Array, corpora: dict, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``bm25``'s, from the numbers of postings in the index."""
    shipped = index.sparkSession.sparkContext.broadcast((words, corpora, keys))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, corpora, keys = shipped.value
        df, totals = np.zeros(len(keys), np.int64), np.zeros((len(corpora), 2), np.int64)
        for batch in batches:
            corpus = bm25._numbers(batch, corpora)
            for row in np.flatnonzero(corpus >= 0):
                lengths = _list(batch, "lengths", row).to_numpy()
                totals[corpus[row]] += (len(lengths), lengths.sum())
                place = pc.fill_null(pc.index_in(_list(batch, "words", row), value_set=words), -1).to_numpy()
                known = np.flatnonzero(place >= 0)
                at = bm25._places(keys, corpus[row] * len(words) + place[known])
                df[at[at >= 0]] += np.diff(_list(batch, "first", row).to_numpy())[known[at >= 0]]
        full, some = np.flatnonzero(df), np.flatnonzero(totals[:, 0])
        yield pa.RecordBatch.from_pydict({"kind": np.r_[np.zeros(len(full), np.int64), np.ones(len(some), np.int64)], "number": np.r_[full, some],
                                          "n": np.r_[df[full], totals[some, 0]], "length": np.r_[np.zeros(len(full), np.int64), totals[some, 1]]})

    return bm25.gathered(index.select("corpus", "lengths", "words", "first").mapInArrow(count, bm25.STATISTICS), len(keys), len(corpora))


class _Kept:
    """The k best rows of each query."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.query, self.pid, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.why: np.ndarray = np.zeros(0, object)
        self.least = np.zeros(queries)

    def add(self, query: np.ndarray, pid: np.ndarray, score: np.ndarray, why: np.ndarray) -> None:
        query, pid, score, why = (np.r_[a, b] for a, b in ((self.query, query), (self.pid, pid), (self.score, score), (self.why, why)))
        order = np.lexsort((pid, -score, query))
        query, pid, score, why = query[order], pid[order], score[order], why[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        self.least[query[rank == self.k - 1]] = score[rank == self.k - 1]
        self.query, self.pid, self.score, self.why = (x[rank < self.k] for x in (query, pid, score, why))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _search(shipped: Broadcast, k: int, shown: int, k1: float, b: float):
    """The k best rows of each query in a task; a row without a query tells how many blocks a search could have
    scored (pid) and how many it did (bm25)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: bm25.Block = shipped.value
        kept = _Kept(len(own.queries), k)
        could = did = 0
        for batch in batches:
            corpus = own.numbers(batch)
            for r in np.flatnonzero(corpus >= 0):
                c, avg, size = int(corpus[r]), own.avg_len[corpus[r]], batch.column("block")[int(r)].as_py()
                words = _list(batch, "words", r)
                place = pc.fill_null(pc.index_in(words, value_set=own.words), -1).to_numpy()
                known = np.flatnonzero(place >= 0)
                at = bm25._places(own.keys, c * len(own.words) + place[known])
                known, at = known[at >= 0], at[at >= 0]
                if not len(known) or not avg > 0:
                    continue
                pids, lengths, first, rows, tfs, bfirst, blocks, most, least = (_list(batch, n, r).to_numpy() for n in _ARRAYS if n != "words")

                def gain(tf, dl):
                    return tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * dl / avg))

                # a term's entries of queries, crossed with its blocks
                entries = own.offsets[at + 1] - own.offsets[at]
                term = np.repeat(np.arange(len(known)), entries)
                entry = _spread(own.offsets[at], entries)
                many = -(-len(pids) // size)
                span = (bfirst[known + 1] - bfirst[known])[term]
                cell = _spread(bfirst[known][term], span)
                query = np.repeat(own.query[entry], span)
                pair, of = np.unique(query * np.int64(many) + blocks[cell], return_inverse=True)
                bound = np.bincount(of, np.repeat(own.weight[entry], span) * gain(most[cell], least[cell]), len(pair)) + 1e-4
                asked = pair // many
                could += len(pair)
                postings = np.repeat(np.arange(len(first) - 1), np.diff(first)) * np.int64(len(pids) + 1) + rows
                order = np.lexsort((-bound, asked))
                leading = np.zeros(len(pair), bool)
                leading[order[np.r_[True, asked[order][1:] != asked[order][:-1]]]] = True
                for chosen in (leading, ~leading):
                    chosen = chosen & (bound >= kept.least[asked])
                    if not chosen.any():
                        continue
                    did += int(chosen.sum())
                    wanted = np.flatnonzero(chosen[of])
                    # the postings of each chosen (query, term, block): rows of a term ascend, so a block is a range
                    t, blk = np.repeat(term, span)[wanted], blocks[cell[wanted]]
                    key = known[t] * np.int64(len(pids) + 1)
                    low, high = np.searchsorted(postings, key + blk * size), np.searchsorted(postings, key + np.minimum((blk + 1) * size, len(pids)))
                    hit = _spread(low, high - low)
                    q, w = np.repeat(query[wanted], high - low), np.repeat(np.repeat(entry, span)[wanted], high - low)
                    name = np.repeat(place[known][t], high - low)
                    part = own.weight[w] * gain(tfs[hit], lengths[rows[hit]])
                    both, where = np.unique(q * np.int64(len(pids)) + rows[hit], return_inverse=True)
                    in_order = np.lexsort((name, where))
                    score = half_up(np.bincount(where[in_order], part[in_order], len(both))[None])[0]
                    q_of, pid = both // len(pids), pids[both % len(pids)]
                    good = np.flatnonzero(score >= kept.least[q_of])
                    edges = np.searchsorted(where[in_order], np.arange(len(both) + 1))
                    # the terms are told of rows that can stay only
                    ranked = good[np.lexsort((pid[good], -score[good], q_of[good]))]
                    ranked = ranked[np.arange(len(ranked)) - np.searchsorted(q_of[ranked], q_of[ranked]) < k]
                    why = np.empty(len(ranked), object)
                    for i, x in enumerate(ranked):
                        mine = in_order[edges[x]: edges[x + 1]]
                        why[i] = [n for _, n in sorted((-float(part[j]), own.words[int(name[j])].as_py()) for j in mine)[:shown]]
                    kept.add(q_of[ranked], pid[ranked], score[ranked], why)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*own.queries[kept.query].tolist(), None], pa.int64()), pa.array([*kept.pid.tolist(), could], pa.int64()),
             pa.array([*kept.score.tolist(), float(did)], pa.float64()), pa.array([*kept.why, None], pa.list_(pa.string()))],
            names=["query_id", "pid", "bm25", "terms"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = vocab.TOP_K, shown: int = 6, k1: float = vocab.BM25_K1, b: float = vocab.BM25_B) -> tuple[DataFrame, DataFrame]:
    """(best, blocks). ``best``: query_id, pid, bm25, rank, terms of the k best passages of each query (query_id, corpus,
    text), as ``bm25.best`` gives them; ``blocks``: how many blocks could have been scored and how many were.

    Queries come to the driver in blocks of ``bm25.BLOCK_TERMS`` terms (or one query), each of which reads the index
    twice. Rows of corpora that nobody asks for are not read further than their name.
    """
    sc, parts = index.sparkSession.sparkContext, []

    def solve(rows: list[tuple]) -> None:
        block, wanted = bm25.make_block(index, rows, _statistics)
        parts.append(wanted.mapInArrow(_search(sc.broadcast(block), k, shown, k1, b), "query_id long, pid long, bm25 double, terms array<string>"))

    for rows in bm25.query_blocks(queries):
        solve(rows)
    found = functools.reduce(DataFrame.unionByName, parts)
    best = top(found.where("query_id is not null"), ["query_id"], [F.col("bm25").desc(), F.col("pid")], k)
    return best, found.where("query_id is null").agg(F.sum("pid").alias("blocks"), F.sum("bm25").cast("long").alias("scored"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
