"""Okapi BM25 for tables of queries (query_id, corpus, text).

Two routes give the same scores: ``match_index`` joins query terms to stored postings,
``match_passages`` scans the passages and keeps only tokens that some query asks for
before anything is shuffled.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx, vocab
from .corpus import TermIndex, build_index
from ..session import cut_lineage
from .dense import half_up
from .ranking import top

# Query terms that are searched for together, and passages that are scored together.
BLOCK_TERMS, TILE = 1 << 18, 1 << 12
STATISTICS = "kind long, number long, n long, length long"


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms of every query."""
    return queries.select(
        "query_id", "corpus", F.explode(F.array_distinct(tx.tokenize(F.col("text")))).alias("term")
    )


def idf(passages: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (passages - df + 0.5) / (df + 0.5))


def gain(tf: Column, dl: Column, avg_len: Column, k1: float, b: float) -> Column:
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avg_len)
    return tf * F.lit(k1 + 1) / (tf + norm)


@dataclass(frozen=True)
class Match:
    """Query terms against an index."""

    terms: DataFrame
    index: TermIndex
    k1: float = vocab.BM25_K1
    b: float = vocab.BM25_B

    def parts(self, pids: DataFrame | None = None) -> DataFrame:
        """query_id, pid, term, part: what each matched term adds; for all passages or
        only for those in ``pids`` (pid)."""
        weighted = (
            self.terms.join(self.index.terms, ["corpus", "term"])
            .join(self.index.stats.filter(F.col("avg_len") > 0), "corpus")
            .select("corpus", "term", "query_id", "avg_len", idf(F.col("passages"), F.col("df")).alias("idf"))
        )
        postings = self.index.postings
        if pids is not None:
            postings = postings.join(pids.select("pid"), "pid", "left_semi")
        part = F.col("idf") * gain(F.col("tf"), F.col("dl"), F.col("avg_len"), self.k1, self.b)
        return postings.join(weighted, ["corpus", "term"]).select("query_id", "pid", "term", part.alias("part"))


def score(match: Match) -> DataFrame:
    """query_id, pid, bm25 (four digits)."""
    return match.parts().groupBy("query_id", "pid").agg(F.round(F.sum("part"), 4).alias("bm25"))


def explain(rows: DataFrame, match: Match, shown: int = 6) -> DataFrame:
    """Adds terms: the matched terms that add most to each of these (query_id, pid) rows.
    Done for rows that were picked, so terms are never collected for all matches."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("part")).alias("k"), F.col("term"))))
    reasons = (
        match.parts(rows).join(rows.select("query_id", "pid"), ["query_id", "pid"], "left_semi")
        .groupBy("query_id", "pid").agg(ordered.alias("_t"))
        .select("query_id", "pid", F.transform(F.slice("_t", 1, shown), lambda s: s["term"]).alias("terms"))
    )
    none = F.array().cast("array<string>")
    return rows.join(reasons, ["query_id", "pid"], "left").withColumn("terms", F.coalesce("terms", none))


def match_index(index: TermIndex, queries: DataFrame, k1: float = vocab.BM25_K1, b: float = vocab.BM25_B) -> Match:
    return Match(query_terms(queries), index, k1, b)


def match_passages(passages: DataFrame, queries: DataFrame, k1: float = vocab.BM25_K1, b: float = vocab.BM25_B) -> Match:
    terms = query_terms(queries)
    return Match(terms, build_index(passages, terms), k1, b)


def best(match: Match, k: int = vocab.TOP_K) -> DataFrame:
    """The k best passages of every query with their terms."""
    found = cut_lineage(top(score(match), ["query_id"], [F.col("bm25").desc(), F.col("pid")], k))
    return explain(found, match)


# ---- scan: nothing but statistics and winners leaves a task ----

@dataclass(frozen=True)
class Block:
    """Queries that are searched together: their terms, and for each (corpus, term) that one
    of them asks for, which queries have it and with which weight."""

    words: pa.Array  # different terms
    corpora: dict  # corpus -> number
    queries: np.ndarray  # query ids
    keys: np.ndarray  # corpus * words + term, sorted
    offsets: np.ndarray  # of each key in the next two
    query: np.ndarray
    weight: np.ndarray
    avg_len: np.ndarray  # of each corpus
    query_corpus: np.ndarray

    def numbers(self, batch: pa.RecordBatch) -> np.ndarray:
        """The number of each row's corpus, -1 for those nobody asks for."""
        return _numbers(batch, self.corpora)


def _numbers(batch: pa.RecordBatch, corpora: dict) -> np.ndarray:
    coded = batch.column("corpus").dictionary_encode()
    known = np.array([*(corpora.get(c, -1) for c in coded.dictionary.to_pylist()), corpora.get(None, -1)], np.int64)
    return known[pc.fill_null(coded.indices, len(known) - 1).to_numpy()]


def _places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each of ``wanted`` stands in ``keys``, -1 if nowhere."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _tokens(passages: DataFrame) -> DataFrame:
    return passages.select("corpus", "pid", tx.tokenize(F.col("text")).alias("tokens"))


def _postings(batch: pa.RecordBatch, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and frequency of every wanted word in the rows of a batch, and all lengths (in the column dl, if other
    words were left out before)."""
    lists = batch.column("tokens")
    flat = lists.flatten()
    sizes = np.diff(lists.offsets.to_numpy())
    coded = flat.dictionary_encode()
    place = pc.fill_null(pc.index_in(coded.dictionary, value_set=words), -1).to_numpy()
    word = place[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    wanted = word >= 0
    key, tf = np.unique(row[wanted] * np.int64(max(len(words), 1)) + word[wanted], return_counts=True)
    lengths = batch.column("dl").to_numpy() if "dl" in batch.schema.names else sizes
    return key // max(len(words), 1), key % max(len(words), 1), tf, lengths


def _statistics(tokens: DataFrame, words: pa.Array, corpora: dict, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document frequency of each key; passages and length of each corpus. Summed per task first; what comes to the
    driver is no longer than the keys and corpora."""
    shipped = tokens.sparkSession.sparkContext.broadcast((words, corpora, keys))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, corpora, keys = shipped.value
        df, totals = np.zeros(len(keys), np.int64), np.zeros((len(corpora), 2), np.int64)
        for batch in batches:
            row, word, _, sizes = _postings(batch, words)
            corpus = _numbers(batch, corpora)
            known = corpus >= 0
            totals[:, 0] += np.bincount(corpus[known], minlength=len(totals))
            totals[:, 1] += np.bincount(corpus[known], sizes[known], len(totals)).astype(np.int64)
            at = _places(keys, corpus[row] * len(words) + word)
            df += np.bincount(at[at >= 0], minlength=len(df))
        full, some = np.flatnonzero(df), np.flatnonzero(totals[:, 0])
        yield pa.RecordBatch.from_pydict({"kind": np.r_[np.zeros(len(full), np.int64), np.ones(len(some), np.int64)], "number": np.r_[full, some],
                                          "n": np.r_[df[full], totals[some, 0]], "length": np.r_[np.zeros(len(full), np.int64), totals[some, 1]]})

    return gathered(tokens.mapInArrow(count, STATISTICS), len(keys), len(corpora))


def gathered(found: DataFrame, keys: int, corpora: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of what the tasks have counted."""
    table = found.groupBy("kind", "number").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).toArrow()
    kind, number, n, length = (table[c].to_numpy() for c in ("kind", "number", "n", "length"))
    df, totals = np.zeros(keys, np.int64), np.zeros((corpora, 2), np.int64)
    df[number[kind == 0]] = n[kind == 0]
    totals[number[kind == 1]] = np.stack([n, length], axis=1)[kind == 1]
    return df, totals


def make_block(tokens: DataFrame, rows: list[tuple], statistics=_statistics) -> tuple[Block, DataFrame]:
    """The block of some queries (query_id, corpus, different terms), and the rows of ``tokens`` (corpus, tokens, ...; or
    what ``statistics`` reads) that it can meet. Its size follows the (query, term) pairs, however many corpora and terms there are."""
    words = sorted({t for _, _, ts in rows for t in ts})
    names = sorted({c for _, c, _ in rows}, key=repr)
    number, corpora, array = {w: i for i, w in enumerate(words)}, {c: i for i, c in enumerate(names)}, pa.array(words, pa.string())
    wanted = tokens.where(F.col("corpus").isin(names)) if len(names) <= 1000 and None not in corpora else tokens
    corpus = np.array([corpora[c] for _, c, _ in rows], np.int64)
    query = np.repeat(np.arange(len(rows)), [len(ts) for _, _, ts in rows])
    pairs = corpus[query] * len(words) + np.array([number[t] for _, _, ts in rows for t in ts], np.int64)
    order = np.argsort(pairs, kind="stable")
    keys, first = np.unique(pairs[order], return_index=True)
    df, totals = statistics(wanted, array, corpora, keys)
    # a term that no passage has gives nobody a weight
    of = keys // max(len(words), 1)
    weight = np.array([math.log(1.0 + (total - n + 0.5) / (n + 0.5)) if n else 0.0 for total, n in zip(totals[of, 0].tolist(), df.tolist())])
    offsets = np.r_[first, len(order)]
    avg_len = totals[:, 1] / np.maximum(totals[:, 0], 1)
    return Block(array, corpora, np.array([r[0] for r in rows], np.int64), keys, offsets, query[order], np.repeat(weight, np.diff(offsets)), avg_len, corpus), wanted


def matches(own: Block, batch: pa.RecordBatch, k1: float, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query, row, term and what it adds, for every term that a query of the block shares with a row of its corpus."""
    row, word, tf, sizes = _postings(batch, own.words)
    corpus = own.numbers(batch)[row]
    place = np.where(corpus >= 0, _places(own.keys, corpus * len(own.words) + word), -1)
    known = place >= 0
    row, word, tf, corpus, place = row[known], word[known], tf[known], corpus[known], place[known]
    avg = own.avg_len[corpus]
    gains = tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * sizes[row] / np.where(avg > 0, avg, 1.0)))
    count = own.offsets[place + 1] - own.offsets[place]
    ends = np.cumsum(count)
    index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(own.offsets[place] - (ends - count), count)
    return own.query[index], np.repeat(row, count), np.repeat(word, count), own.weight[index] * np.repeat(gains, count)


def _winners(block, k: int, shown: int, k1: float, b: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kept = block.value, {}
        for whole in batches:
            for start in range(0, len(whole), TILE):
                batch = whole.slice(start, TILE)
                query, row, word, part = matches(own, batch, k1, b)
                pair, place = np.unique(query * np.int64(TILE) + row, return_inverse=True)
                score = half_up(np.bincount(place, part, minlength=len(pair))[None])[0]
                pid = batch.column("pid").to_numpy()[pair % TILE]
                order = np.lexsort((pid, -score, pair // TILE))
                first = np.r_[True, np.diff((pair // TILE)[order]) > 0] if len(order) else np.zeros(0, bool)
                rank = np.arange(len(order)) - np.repeat(np.flatnonzero(first), np.diff(np.r_[np.flatnonzero(first), len(order)]))
                by_pair = np.argsort(place, kind="stable")
                edges = np.searchsorted(place[by_pair], np.arange(len(pair) + 1))
                for i in order[rank < k]:
                    q = int(pair[i] // TILE)
                    best_ = kept.setdefault(q, [])
                    if len(best_) == k and (-score[i], pid[i]) >= best_[-1][:2]:
                        continue
                    mine = by_pair[edges[i]: edges[i + 1]]
                    names = sorted((-float(part[j]), own.words[int(word[j])].as_py()) for j in mine)
                    best_.append((-score[i], int(pid[i]), [w for _, w in names[:shown]]))
                    best_.sort(key=lambda x: x[:2])
                    del best_[k:]
        rows = [(int(own.queries[q]), pid, -s, terms) for q, found in kept.items() for s, pid, terms in found]
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.list_(pa.string()))],
            names=["query_id", "pid", "bm25", "terms"])

    return run


def scan_best(passages: DataFrame, queries: DataFrame, k: int = vocab.TOP_K, shown: int = 6,
              k1: float = vocab.BM25_K1, b: float = vocab.BM25_B) -> DataFrame:
    """As ``best`` of ``match_passages``: query_id, pid, bm25, rank, terms, in two scans.

    The first sums document frequencies and lengths of the wanted terms inside each task;
    the second scores every passage inside its task and keeps the k best of each query, so
    no row per query, passage and term exists outside a task. Queries go along in blocks of
    ``BLOCK_TERMS`` terms (or one query); more of them take more scans.
    """
    tokens, parts = _tokens(passages), []
    sc = passages.sparkSession.sparkContext

    def search(rows: list[tuple]) -> DataFrame:
        block, wanted = make_block(tokens, rows)
        return wanted.mapInArrow(_winners(sc.broadcast(block), k, shown, k1, b), "query_id long, pid long, bm25 double, terms array<string>")

    for rows in query_blocks(queries):
        parts.append(search(rows))
    return top(functools.reduce(DataFrame.unionByName, parts), ["query_id"], [F.col("bm25").desc(), F.col("pid")], k)


def query_blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    """Queries with a term as (query_id, corpus, terms), in blocks of ``BLOCK_TERMS`` terms or one query; one block at
    least, if an empty one."""
    rows, size, told = [], 0, False
    for r in queries.select("query_id", "corpus", F.array_distinct(tx.tokenize(F.col("text"))).alias("t")).where("size(t) > 0").toLocalIterator():
        rows.append((r["query_id"], r["corpus"], r["t"]))
        size += len(r["t"])
        if size >= BLOCK_TERMS:
            yield rows
            rows, size, told = [], 0, True
    if rows or not told:
        yield rows
