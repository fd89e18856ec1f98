"""Hybrid candidates of many goals without a table of goals and passages: a threshold algorithm over two ranked lists.

The hybrid score of a passage falls with its BM25 rank and its cosine rank among all passages of the goal's corpus. One
scan of the texts leaves the goals' terms of each passage; all else reads those. A first pass keeps, for each goal and language, the ``size`` best passages by either score, and the passages with the smallest
ids, which lead those that share no term with the goal. A passage in neither list lies behind both, so its score has a
bound. A second pass looks up the scores of what was listed, a third one counts in each task how many passages lie
ahead of them: that gives their exact ranks. If the best of them beat the bound the goal is decided; the others go on
with longer lists. What leaves a task are lists and counts, never a row for each goal and passage.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx, vocab
from ..session import cut_lineage
from . import bm25
from .dense import half_up
from .ranking import top

#: Length of the first lists, and how many times longer those of undecided goals become.
SIZE, GROWTH = 128, 4
#: Goals of a block times the length of their lists; bytes of their vectors.
LISTED, VECTOR_BYTES = 1 << 18, 64 << 20
LANGS = ("en", "other", "ru")
#: Scores have four digits and are compared as integers.
UNIT = 10_000
_TOP = 1 << 32
_SCHEMA = pa.schema([("query_id", pa.int64()), ("pid", pa.int64()), ("lang", pa.string()), ("bm25", pa.float64()), ("dense", pa.float64()),
                     ("bm25_rank", pa.int64()), ("dense_rank", pa.int64()), ("hybrid", pa.float64()), ("terms", pa.list_(pa.string()))])


@dataclass(frozen=True)
class _Goals:
    terms: bm25.Block
    vectors: np.ndarray  # of unit length
    has_vector: np.ndarray
    of_corpus: list[np.ndarray]  # the goals of each corpus


def _matched(own: _Goals, batch: pa.RecordBatch, k1: float, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """goal, row and BM25 (integer) of every pair that shares a term, and what each term adds."""
    goal, row, word, part = bm25.matches(own.terms, batch, k1, b)
    pair, place = np.unique(goal * np.int64(len(batch)) + row, return_inverse=True)
    score = np.rint(half_up(np.bincount(place, part, minlength=len(pair))[None])[0] * UNIT).astype(np.int64)
    return pair // len(batch), pair % len(batch), score, (place, word, part)


def _cosines(own: _Goals, batch: pa.RecordBatch, corpus: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """goal, row and cosine (integer) of the pairs that have both vectors, a part of the goals at a time."""
    column = batch.column("vector")
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    if not valid.any() or not own.has_vector.any():
        return
    lists = column.filter(pa.array(valid))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (np.diff(lists.offsets.to_numpy()) != own.vectors.shape[1]).any():
        raise ValueError("a passage vector differs in length from the goals'")
    vectors = flat.reshape(len(lists), -1)
    vectors = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9)
    rows = np.flatnonzero(valid)
    for c in np.unique(corpus[rows][corpus[rows] >= 0]):
        here = np.flatnonzero(corpus[rows] == c)
        goals = own.of_corpus[c]
        goals = goals[own.has_vector[goals]]
        for start in range(0, len(goals), 256):
            some = goals[start: start + 256]
            score = np.rint(half_up(own.vectors[some] @ vectors[here].T) * UNIT).astype(np.int64)
            yield np.repeat(some, len(here)), np.tile(rows[here], len(some)), score.ravel()


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, len(whole), bm25.TILE):
            yield whole.slice(start, bm25.TILE)


class _Best:
    """The ``size`` best of each group by score, then id."""

    def __init__(self, groups: int, size: int) -> None:
        self.size = size
        self.least = np.full(groups, np.iinfo(np.int64).min)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held, self.limit = 0, 1 << 17

    def add(self, group: np.ndarray, score: np.ndarray, pid: np.ndarray) -> None:
        good = score >= self.least[group]
        self.parts.append((group[good], score[good], pid[good]))
        self.held += int(good.sum())
        if self.held > self.limit:
            self.parts = [self.result()]
            self.held = kept = len(self.parts[0][0])
            self.limit = max(1 << 17, kept + max(kept // 4, 1 << 16))  # so many more come before the next time

    def result(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return (np.zeros(0, np.int64),) * 3
        group, score, pid = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((pid, -score, group))
        group, score, pid = group[order], score[order], pid[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
        last = rank == self.size - 1
        self.least[group[last]] = score[last]
        kept = rank < self.size
        return group[kept], score[kept], pid[kept]


def _asked(rows: DataFrame, words: set[str]) -> DataFrame:
    """Rows with the wanted words as tokens and the number of all tokens as dl; a few other tokens stay, which have the
    checksum of a wanted one. Done before the rows go to Python, whose memory would follow whole texts else."""
    size = 1 << min(max(8 * len(words), 1024).bit_length(), 20)
    marks = bytearray(size)
    for word in words:
        marks[zlib.crc32(word.encode()) & (size - 1)] = 1
    kept = F.filter("tokens", lambda t: F.substring(
        F.lit(bytes(marks)), F.crc32(t.cast("binary")).bitwiseAND(F.lit(size - 1)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01"))
    return rows.select("corpus", "pid", "lang", F.size("tokens").cast("long").alias("dl"), kept.alias("tokens"), "vector")


def _lists(shipped: Broadcast, size: int, k1: float, b: float):
    """kind 0 and 1: the lists by BM25 and cosine (of: goal); 2: the smallest ids (of: corpus); 3: passages (score) and
    vectors (pid) of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = shipped.value, len(LANGS)
        goals, corpora = len(own.terms.queries), len(own.terms.corpora)
        best = [_Best(goals * n, size), _Best(goals * n, size), _Best(corpora * n, size)]
        counts = np.zeros((2, corpora * n), np.int64)
        for batch in _tiles(batches):
            corpus, pid = own.terms.numbers(batch), batch.column("pid").to_numpy()
            lang = np.searchsorted(LANGS, batch.column("lang").to_numpy(zero_copy_only=False).astype(str))
            goal, row, score, _ = _matched(own, batch, k1, b)
            some = score > 0
            best[0].add((goal * n + lang[row])[some], score[some], pid[row][some])
            for goal, row, score in _cosines(own, batch, corpus):
                best[1].add(goal * n + lang[row], score, pid[row])
            known = corpus >= 0
            group = (corpus * n + lang)[known]
            best[2].add(group, np.zeros(len(group), np.int64), pid[known])
            counts[0] += np.bincount(group, minlength=corpora * n)
            counts[1] += np.bincount(group, batch.column("vector").is_valid().to_numpy(zero_copy_only=False)[known], corpora * n).astype(np.int64)
        pa.default_memory_pool().release_unused()
        for kind, (group, score, pid) in enumerate(x.result() for x in best):
            yield pa.RecordBatch.from_pydict({"kind": np.full(len(group), kind), "of": group // n, "lang": group % n, "score": score, "pid": pid})
        full = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_pydict({"kind": np.full(len(full), 3), "of": full // n, "lang": full % n, "score": counts[0][full], "pid": counts[1][full]})

    return run


def _lookup(shipped: Broadcast, wanted: Broadcast, shown: int, k1: float, b: float):
    """Both scores and the leading terms of the listed pairs (goal, pid, in this order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (goals, pids) = shipped.value, wanted.value
        different = np.unique(pids)
        keys = goals * np.int64(len(different)) + np.searchsorted(different, pids)
        for batch in _tiles(batches):
            corpus, pid = own.terms.numbers(batch), batch.column("pid").to_numpy()
            place = np.minimum(np.searchsorted(different, pid), len(different) - 1)
            known = different[place] == pid

            def listed(goal, row):
                key = goal * np.int64(len(different)) + place[row]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                return np.where(known[row] & (keys[at] == key), at, -1)

            goal, row, score, (part_of, word, part) = _matched(own, batch, k1, b)
            at = listed(goal, row)
            order = np.argsort(part_of, kind="stable")
            edges = np.searchsorted(part_of[order], np.arange(len(goal) + 1))
            good = np.flatnonzero(at >= 0)
            names = [[t for _, t in sorted((-float(part[j]), own.terms.words[int(word[j])].as_py()) for j in order[edges[i]: edges[i + 1]])[:shown]] for i in good]
            yield pa.RecordBatch.from_arrays([pa.array(at[good]), pa.array(score[good]), pa.nulls(len(good), pa.int64()), pa.array(names, pa.list_(pa.string()))],
                                             names=["pair", "bm25", "dense", "terms"])
            for goal, row, score in _cosines(own, batch, corpus):
                at = listed(goal, row)
                good = at >= 0
                yield pa.RecordBatch.from_arrays([pa.array(at[good]), pa.nulls(int(good.sum()), pa.int64()), pa.array(score[good]), pa.nulls(int(good.sum()), pa.list_(pa.string()))],
                                                 names=["pair", "bm25", "dense", "terms"])

    return run


class Ahead:
    """Counts, for points of a group, how many items of the group lie ahead of them by key (ascending, 0 to 2^32), then
    id. A point is no item ahead of itself."""

    def __init__(self, group: np.ndarray, key: np.ndarray, pid: np.ndarray) -> None:
        self.ids = np.unique(pid)
        self.order = np.lexsort((pid, key, group))
        both = self._both(group, key)[self.order]
        self.kinds, place = np.unique(both, return_inverse=True)
        self.points = (place.astype(np.int64) << 32) | np.searchsorted(self.ids, pid[self.order], "right")
        self.groups = group[self.order]
        self.steps = np.zeros(len(group) + 1, np.int64)

    @staticmethod
    def _both(group: np.ndarray, key: np.ndarray) -> np.ndarray:
        return (group.astype(np.int64) << 33) | key

    def add(self, group: np.ndarray, key: np.ndarray, pid: np.ndarray) -> None:
        both = self._both(group, key)
        kind = np.searchsorted(self.kinds, both)
        same = np.zeros(len(both), bool)
        inside = kind < len(self.kinds)
        same[inside] = self.kinds[kind[inside]] == both[inside]
        first = np.searchsorted(self.points, (kind.astype(np.int64) << 32) | np.where(same, np.searchsorted(self.ids, pid, "right"), 0), "right")
        end = np.searchsorted(self.groups, group, "right")
        self.steps += np.bincount(first, minlength=len(self.steps))
        self.steps -= np.bincount(end, minlength=len(self.steps))

    def result(self) -> np.ndarray:
        out = np.zeros(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.steps)[:-1]
        return out


def _ahead(shipped: Broadcast, points: Broadcast, k1: float, b: float):
    """kind 0 to 3: how many passages lie ahead of the points of ``points[kind]``; 4: how many match a goal.

    Points: pairs that match by BM25; by cosine; pairs that don't match, of which those that match are counted, by id;
    and ids of a corpus, of which all passages are counted, by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        counters = [Ahead(*x) for x in points.value]
        matches = np.zeros(len(own.terms.queries), np.int64)
        for batch in _tiles(batches):
            corpus, pid = own.terms.numbers(batch), batch.column("pid").to_numpy()
            goal, row, score, _ = _matched(own, batch, k1, b)
            goal, row, score = goal[score > 0], row[score > 0], score[score > 0]
            counters[0].add(goal, _TOP - score, pid[row])
            counters[2].add(goal, np.zeros_like(score), pid[row])
            matches += np.bincount(goal, minlength=len(matches))
            for goal, row, score in _cosines(own, batch, corpus):
                counters[1].add(goal, 2 * UNIT - score, pid[row])
            known = corpus >= 0
            counters[3].add(corpus[known], np.zeros(int(known.sum()), np.int64), pid[known])
        for kind, found in enumerate([*(c.result() for c in counters), matches]):
            full = np.flatnonzero(found)
            yield pa.RecordBatch.from_pydict({"kind": np.full(len(full), kind), "point": full, "n": found[full]})

    return run


def _decided(goal: np.ndarray, lang: np.ndarray, hybrid: np.ndarray, ranks: np.ndarray, totals: np.ndarray, size: int, budget: int,
             quota: int, weights: tuple[float, float], k: int, goals: int) -> np.ndarray:
    """For each goal whether no passage outside the lists can be in its pool. ranks: (pairs, 2), -1 without a cosine;
    totals: (goals, languages, 2) passages and vectors."""
    n = len(LANGS)
    bound, short = np.zeros(goals), np.zeros(goals, bool)
    for code in range(n):
        mine = lang == code
        listed = np.bincount(goal[mine], minlength=goals)
        share = np.zeros(goals)
        for side in (0, 1):
            own = mine & (ranks[:, side] > 0)
            order = np.lexsort((ranks[own, side], goal[own]))
            rank, of = ranks[own, side][order], goal[own][order]
            first = np.searchsorted(of, np.arange(goals))
            there = np.searchsorted(of, np.arange(goals), "right") - first
            open_ = there < totals[:, code, side]
            share[open_] += weights[side] / (k + rank[first[open_] + size - 1] + 1)
        share[listed >= totals[:, code, 0]] = 0.0
        order = np.lexsort((-hybrid[mine], goal[mine]))
        score, of = hybrid[mine][order], goal[mine][order]
        place = np.searchsorted(of, np.arange(goals)) + np.minimum(quota, listed) - 1
        full = (listed > 0) & (share > 0)
        short[full] |= score[place[full]] <= share[full]
        bound = np.maximum(bound, share)
    order = np.lexsort((-hybrid, goal))
    score, of = hybrid[order], goal[order]
    first = np.searchsorted(of, np.arange(goals))
    there = np.searchsorted(of, np.arange(goals), "right") - first
    enough = there > budget
    limit = np.full(goals, -np.inf)
    limit[enough] = score[first[enough] + budget]
    return ~short & ((bound == 0) | (limit > bound))


def candidates(passages: DataFrame, queries: DataFrame, budget: int = vocab.POOL_BUDGET, min_per_lang: int = vocab.POOL_MIN_PER_LANG,
               k: int = vocab.RRF_K, weights: tuple[float, float] = (vocab.RRF_BM25_WEIGHT, vocab.RRF_DENSE_WEIGHT), size: int = SIZE,
               shown: int = 6, k1: float = vocab.BM25_K1, b: float = vocab.BM25_B) -> DataFrame:
    """query_id, pid, lang, bm25, dense, bm25_rank, dense_rank, hybrid and terms of every row that can be in a goal's
    pool: its ``budget`` + 1 best ones and the ``min_per_lang`` best of each language, with their exact ranks.

    passages: corpus, pid, text, vector (may be null); queries: query_id, corpus, text, vector (may be null). A goal
    without a vector, or without passages that have one, is ranked by BM25 alone. Goals come to the driver in blocks of
    bounded size, each of which takes a few scans.
    """
    size = max(size, budget + 1, min_per_lang)
    spark = passages.sparkSession
    vector = F.col("vector").cast("array<double>") if "vector" in passages.columns else F.lit(None).cast("array<double>")
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = passages.where("pid is not null and corpus is not null").select(
        "corpus", "pid", tx.detect_lang(whole).alias("lang"), tx.tokenize(whole).alias("tokens"), vector.alias("vector"))
    own_vector = F.col("vector").cast("array<double>") if "vector" in queries.columns else F.lit(None).cast("array<double>")
    asked = queries.where("query_id is not null and corpus is not null").select(
        "query_id", "corpus", F.array_distinct(tx.tokenize(whole)).alias("t"), own_vector.alias("v"))
    parts: list[DataFrame] = []
    block: list[tuple] = []
    terms = bytes_ = 0

    def solve(goals: list[tuple], length: int) -> None:
        while goals:
            step = max(1, LISTED // length)
            left: list[tuple] = []
            for start in range(0, len(goals), step):
                found, undecided = _solve(spark, rows, goals[start: start + step], length, budget, min_per_lang, k, weights, shown, k1, b)
                parts.append(spark.createDataFrame(found))
                left += undecided
            goals, length = left, length * GROWTH

    for row in asked.toLocalIterator():
        block.append((row["query_id"], row["corpus"], row["t"], row["v"]))
        terms, bytes_ = terms + len(row["t"]), bytes_ + 8 * len(row["v"] or ())
        if terms >= bm25.BLOCK_TERMS or bytes_ >= VECTOR_BYTES or len(block) * size >= LISTED:
            solve(block, size)
            block, terms, bytes_ = [], 0, 0
    solve(block, size)
    return functools.reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame(_SCHEMA.empty_table())


def _solve(spark: SparkSession, rows: DataFrame, goals: list[tuple], size: int, budget: int, quota: int, k: int,
           weights: tuple[float, float], shown: int, k1: float, b: float) -> tuple[pa.Table, list[tuple]]:
    """The rows of the decided goals of a block, and the other goals."""
    names = {g[1] for g in goals}
    own = rows.where(F.col("corpus").isin(list(names))) if len(names) <= 1000 else rows
    short = cut_lineage(_asked(own, {t for g in goals for t in g[2]}))
    block, wanted = bm25.make_block(short, [g[:3] for g in goals])
    dims = {len(g[3]) for g in goals if g[3] is not None}
    if len(dims) > 1:
        raise ValueError("goal vectors differ in length")
    has = np.array([g[3] is not None for g in goals])
    vectors = np.array([g[3] if g[3] is not None else [0.0] * max(dims, default=0) for g in goals], np.float64).reshape(len(goals), -1)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True) if vectors.size else np.ones((len(goals), 1))
    vectors = vectors / np.where(lengths == 0, 1.0, lengths)
    of_corpus = [np.flatnonzero(block.query_corpus == c) for c in range(len(block.corpora))]
    shipped = spark.sparkContext.broadcast(_Goals(block, vectors, has, of_corpus))
    n = len(LANGS)

    found = cut_lineage(wanted.mapInArrow(_lists(shipped, size, k1, b), "kind long, of long, lang long, score long, pid long"))
    lists = top(found.where("kind < 3"), ["kind", "of", "lang"], [F.col("score").desc(), F.col("pid")], size).drop("rank").toArrow()
    kind, of, lang, score, pid = (lists[c].to_numpy() for c in ("kind", "of", "lang", "score", "pid"))
    sums = found.where("kind = 3").groupBy("of", "lang").agg(F.sum("score").alias("passages"), F.sum("pid").alias("vectors")).toArrow()
    per_corpus = np.zeros((len(block.corpora), n, 2), np.int64)
    per_corpus[sums["of"].to_numpy(), sums["lang"].to_numpy()] = np.stack([sums["passages"].to_numpy(), sums["vectors"].to_numpy()], axis=1)
    totals = per_corpus[block.query_corpus]
    totals[~has, :, 1] = 0

    # the pairs: what is listed, and the smallest ids where fewer than ``size`` passages of a language match
    matching = np.bincount(of[kind == 0] * n + lang[kind == 0], minlength=len(goals) * n)
    fill = np.flatnonzero(kind == 2)
    fill = fill[np.argsort(of[fill] * n + lang[fill], kind="stable")]
    places = of[fill] * n + lang[fill]
    lacking = np.flatnonzero(matching < size)
    wanted_fill = block.query_corpus[lacking // n] * n + lacking % n
    begin, end = np.searchsorted(places, wanted_fill), np.searchsorted(places, wanted_fill, "right")
    index = np.concatenate([fill[s:e] for s, e in zip(begin, end)]) if len(lacking) else np.zeros(0, np.int64)
    goal = np.r_[of[kind < 2], np.repeat(lacking // n, end - begin)]
    pids, langs = np.r_[pid[kind < 2], pid[index]], np.r_[lang[kind < 2], lang[index]]
    order = np.lexsort((pids, goal))
    goal, pids, langs = goal[order], pids[order], langs[order]
    once = np.r_[True, (goal[1:] != goal[:-1]) | (pids[1:] != pids[:-1])] if len(goal) else np.zeros(0, bool)
    goal, pids, langs = goal[once], pids[once], langs[once]
    if not len(goal):
        return _SCHEMA.empty_table(), []

    looked = spark.sparkContext.broadcast((goal, pids))
    some = spark.createDataFrame(pa.table({"pid": np.unique(pids)}))
    scores = wanted.join(some, "pid", "left_semi").select(*wanted.columns).mapInArrow(_lookup(shipped, looked, shown, k1, b), "pair long, bm25 long, dense long, terms array<string>").toArrow()
    at = scores["pair"].to_numpy()
    by_term, cosine, terms = np.zeros(len(goal), np.int64), np.full(len(goal), np.iinfo(np.int64).min), [[] for _ in goal]
    matched = scores["bm25"].is_valid().to_numpy()
    by_term[at[matched]] = scores["bm25"].filter(pa.array(matched)).to_numpy()
    cosine[at[~matched]] = scores["dense"].filter(pa.array(~matched)).to_numpy()
    for place, names in zip(at[matched], scores["terms"].filter(pa.array(matched)).to_pylist()):
        terms[place] = names

    # ranks: how many passages lie ahead. A score of zero and no match are the same.
    hit, near = by_term > 0, cosine != np.iinfo(np.int64).min
    corpus = block.query_corpus[goal]
    ids, id_of = np.unique(np.stack([corpus[~hit], pids[~hit]], axis=1), axis=0, return_inverse=True) if (~hit).any() else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    points = [(goal[hit], _TOP - by_term[hit], pids[hit]), (goal[near], 2 * UNIT - cosine[near], pids[near]),
              (goal[~hit], np.zeros(int((~hit).sum()), np.int64), pids[~hit]), (ids[:, 0], np.zeros(len(ids), np.int64), ids[:, 1])]
    counted = wanted.mapInArrow(_ahead(shipped, spark.sparkContext.broadcast(points), k1, b), "kind long, point long, n long").groupBy("kind", "point").agg(F.sum("n").alias("n")).toArrow()
    kinds, point, number = (counted[c].to_numpy() for c in ("kind", "point", "n"))
    ahead = [np.zeros(len(x[0]), np.int64) for x in points] + [np.zeros(len(goals), np.int64)]
    for place, out in enumerate(ahead):
        out[point[kinds == place]] = number[kinds == place]
    ranks = np.full((len(goal), 2), -1)
    ranks[hit, 0] = ahead[0] + 1
    ranks[~hit, 0] = ahead[4][goal[~hit]] + ahead[3][id_of.ravel()] - ahead[2] + 1
    ranks[near, 1] = ahead[1] + 1
    fused = totals[:, :, 1].sum(axis=1) > 0
    score = half_up((by_term / UNIT)[None])[0]
    hybrid = np.where(fused[goal], weights[0] / (k + ranks[:, 0]) + np.where(near, weights[1] / (k + ranks[:, 1]), 0.0), score)
    done = _decided(goal, langs, hybrid, ranks, totals, size, budget, quota, weights, k, len(goals)) | ~fused

    # what can be in a pool
    order = np.lexsort((pids, -hybrid, goal))
    rank = np.arange(len(goal)) - np.searchsorted(goal[order], goal[order])
    by_lang = np.lexsort((pids, -hybrid, langs, goal))
    group = (goal * n + langs)[by_lang]
    rank_in_lang = np.arange(len(goal)) - np.searchsorted(group, group)
    kept = np.zeros(len(goal), bool)
    kept[order[rank <= budget]] = True
    kept[by_lang[rank_in_lang < quota]] = True
    kept &= done[goal]
    at = np.flatnonzero(kept)
    table = pa.Table.from_arrays([
        pa.array(block.queries[goal[at]]), pa.array(pids[at]), pa.array([LANGS[x] for x in langs[at]], pa.string()), pa.array(score[at]),
        pa.array(cosine[at] / UNIT, mask=~near[at]), pa.array(ranks[at, 0]), pa.array(ranks[at, 1], mask=~near[at]), pa.array(hybrid[at]),
        pa.array([terms[x] for x in at], pa.list_(pa.string()))], schema=_SCHEMA)
    return table, [g for g, d in zip(goals, done) if not d]
