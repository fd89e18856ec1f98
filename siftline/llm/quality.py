"""Quality rules: word statistics and n-gram perplexity.

The language model is a character model of order ``ORDER`` with modified Kneser-Ney smoothing, one per language, over
code points as they are. Spark counts the longest n-grams of the whole corpus, once for each document that has them
(what one document repeats is no evidence of the language), and from them by one grouping a level the continuation
counts of the shorter ones, the discounts, and the shares and back-off weights of all n-grams. Nothing of it passes the
driver, and the model grows with the corpus.

An n-gram of ``ORDER`` symbols that stands in fewer than ``LEAST_DOCUMENTS`` documents, and a shorter one that is seen
after one symbol only and ends no longer n-gram that is kept, is left to back-off, with all its mass: a document's own
inventions don't make it likely. The model is kept as arrays sorted by a 64-bit hash of language, level and n-gram, in
files of a range of hashes each. Documents are scored with one range at a time in memory: a task looks up the different
n-grams of ``GROUP_BYTES`` of text, range after range. (Two n-grams are confused if their hashes are equal, about once
in 2 ** 64 pairs.)

A document is rejected if its log perplexity is out of the band of its language, by the whole model or by its level of
one symbol less: the median of the language, less ``BELOW`` or plus ``ABOVE`` robust standard deviations (1.4826 times
the median absolute deviation, at least ``NARROWEST``). That shorter level weighs an n-gram by the different symbols
before it, so marks that follow everything look too likely there.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.bitpack import _filesystem
from siftline.llm.shared import blocks, joined_bytes, keep, mixed, ragged, segment_sums
from siftline.llm.words import windows, word_hashes, word_spans

ORDER = 4
LEAST_DOCUMENTS = 2
#: Bits of a symbol: 0 is the edge of a text, otherwise the code point plus one.
BITS = 21
SYMBOLS = 0x110001
#: Of the labelled sf0.1 documents these lose 8 of 3243 good ones and keep 56 of 291 bad ones.
BELOW, ABOVE = 5.0, 10.5
NARROWEST = 0.02
#: Entries of the model in a file; ranges that a Python worker remembers; text whose n-grams are looked up together.
RANGE = 1 << 20
REMEMBERED = 8
GROUP_BYTES = 8 << 20
#: Text whose n-grams are in memory by position.
BLOCK = 1 << 20
#: N-grams that a counting task gathers before it hands them on.
GATHERED = 1 << 20
#: Tables of one row a language are sent to all tasks up to this many rows, and joined by shuffles beyond.
FEW = 50_000
MIN_WORDS = 50
WINDOW = 3
_MARKS = np.zeros(256, bool)
_MARKS[list(b"#*$%&|<>")] = True


# ---- n-grams

def grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of all texts (symbols before the last three, last three) and the n + 1 offsets of the texts. A text
    has order - 1 edges before and one behind it, so it has one n-gram for each code point and one more."""
    pad = "\n" * (order - 1)
    joined = pad + ("\n" + pad).join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.cumsum(lengths + order - 1) - (lengths + order - 1)
    codes[ragged(starts, np.full(len(texts), order - 1))] = 0
    codes[starts + lengths + order - 2] = 0
    places = ragged(starts, lengths)
    head, tail = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    for back in range(order):
        own = codes[places + (order - 1 - back)]
        if back < 3:
            tail |= own << (BITS * back)
        else:
            head |= own << (BITS * (back - 3))
    return head, tail, np.r_[0, np.cumsum(lengths)]


def _mask(symbols: int) -> int:
    return (1 << BITS * max(symbols, 0)) - 1


def _last(head, tail, n: int):
    """The last ``n`` symbols (numbers or columns)."""
    return (head * 0, _anded(tail, _mask(n))) if n <= 3 else (_anded(head, _mask(n - 3)), tail)


def _anded(x, mask: int):
    return x.bitwiseAND(mask) if isinstance(x, Column) else x & mask


def _before(head, tail):
    """All symbols but the last (numbers or columns)."""
    if isinstance(head, Column):
        return F.shiftright(head, BITS), F.shiftright(tail, BITS).bitwiseOR(F.shiftleft(head.bitwiseAND(_mask(1)), 2 * BITS))
    return head >> BITS, tail >> BITS | (head & _mask(1)) << 2 * BITS


@functools.lru_cache(maxsize=10_000)
def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _named(seeds: np.ndarray, kind: np.ndarray | int, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The hash of an entry; ``kind`` is twice its level, and one more for a back-off weight."""
    with np.errstate(over="ignore"):
        first = mixed(seeds + np.asarray(kind).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return mixed(mixed(first + head.astype(np.uint64)) * np.uint64(3) + tail.astype(np.uint64)).view(np.int64)


# ---- the model

def _rows(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*[F.col(c).cast("long").alias(c) for c in more], F.col("text").cast("string").alias("text"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, head, tail, n): the documents that have each n-gram, over all rows of ``docs`` (text, lang); null lang is
    a language of its own, the empty one."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> None:
            key, lang, head, tail, n = (np.concatenate(column) for column in zip(*held))
            by = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
            own = by[first]
            held[:] = [(key[own], lang[own], head[own], tail[own], np.add.reduceat(n[by], first))]

        def told() -> Iterator[pa.RecordBatch]:
            _, lang, head, tail, n = held[0]
            for at in range(0, len(lang), 1 << 16):
                part = slice(at, at + (1 << 16))
                langs = pa.DictionaryArray.from_arrays(pa.array(lang[part].astype(np.int32)), pa.array(names)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([langs, *(pa.array(x[part]) for x in (head, tail, n))], names=["lang", "head", "tail", "n"])
            held.clear()

        waiting = 0
        for block in blocks(batches, "text", BLOCK):
            head, tail, offsets = grams([t or "" for t in block.column("text").to_pylist()], order)
            places = {lang: i for i, lang in enumerate(names)}
            row_lang = np.array([places.setdefault(lang, len(places)) for lang in block.column("lang").to_pylist()], np.int64)
            names = list(places)
            sizes = np.diff(offsets)
            lang, doc = np.repeat(row_lang, sizes), np.repeat(np.arange(len(sizes)), sizes)
            key = _named(np.repeat(np.array([_seed(x) for x in names], np.uint64)[row_lang], sizes), 0, head, tail)
            by = np.argsort(key, kind="stable")
            new = np.r_[True, key[by][1:] != key[by][:-1]]
            first = np.flatnonzero(new)
            seen = (new | np.r_[True, doc[by][1:] != doc[by][:-1]]).astype(np.int64)
            own = by[first]
            held.append((key[own], lang[own], head[own], tail[own], np.add.reduceat(seen, first)))
            waiting += len(own)
            if waiting > GATHERED:
                merged()
                waiting = len(held[0][0])
                if waiting > GATHERED // 2:
                    yield from told()
                    names, waiting = [], 0
        if held:
            merged()
            yield from told()

    counted = _rows(docs).mapInArrow(count, "lang string, head long, tail long, n long")
    return counted.groupBy("lang", "head", "tail").agg(F.sum("n").alias("n"))


def _few(df: DataFrame) -> DataFrame:
    """``df`` (kept, one row a language) sent to all tasks if its size allows."""
    return F.broadcast(df) if df.count() <= FEW else df


def _discounts(level: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) by the numbers of n-grams that are seen once to four times."""
    t = {k: F.col(f"t{k}") for k in (1, 2, 3, 4)}
    y = F.when(t[1] + t[2] > 0, t[1] / (t[1] + 2 * t[2])).otherwise(0.5)
    d = [F.when(t[k] > 0, k - (k + 1) * y * t[k + 1] / t[k]).otherwise(0.5 * k) for k in (1, 2, 3)]
    d = [F.least(F.greatest(x, F.lit(0.05)), F.lit(0.95 if k == 1 else float(k))) for k, x in enumerate(d, 1)]
    return level.groupBy("lang").agg(*[F.sum((F.col("n") == k).cast("double")).alias(f"t{k}") for k in t]).select(
        "lang", *[x.alias(f"d{k}") for k, x in enumerate(d, 1)])


def entries(counts: DataFrame, order: int = ORDER, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, kind, head, tail, value): of every n-gram that is kept its share (count less discount, over the total of
    its context), and of every context the weight that is left for shorter n-grams if it is less than one."""
    level = keep(counts.withColumn("held", F.col("n") >= least_documents))
    parts = []
    for n in range(order, 0, -1):
        if n < order:
            head, tail = _last(F.col("head"), F.col("tail"), n)
            level = keep(level.groupBy("lang", head.alias("head"), tail.alias("tail"))
                         .agg(F.count(F.lit(1)).alias("n"), F.max("held").alias("held"))
                         .withColumn("held", F.col("held") | (F.col("n") >= 2) | F.lit(n == 1)))
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        head, tail = _before(F.col("head"), F.col("tail"))
        rows = (level.join(_few(keep(_discounts(level))), "lang").withColumn("cut", F.when(F.col("held"), cut).otherwise(F.col("n")))
                .withColumn("before_head", head).withColumn("before_tail", tail))
        # a context has at most as many n-grams as there are symbols
        of = Window.partitionBy("lang", "before_head", "before_tail")
        rows = rows.select(
            "*", F.sum("n").over(of).alias("total"), F.sum(F.col("cut").cast("decimal(30,12)")).over(of).cast("double").alias("left"),
            F.row_number().over(of.orderBy("head", "tail")).alias("nth"))
        both = F.array(
            F.when(F.col("held"), F.struct(F.lit(2 * n).alias("kind"), F.col("head").alias("head"), F.col("tail").alias("tail"),
                                           ((F.col("n") - F.col("cut")) / F.col("total")).alias("value"))),
            F.when((F.col("nth") == 1) & (F.col("left") < F.col("total")),
                   F.struct(F.lit(2 * n + 1).alias("kind"), F.col("before_head").alias("head"), F.col("before_tail").alias("tail"),
                            (F.col("left") / F.col("total")).alias("value"))))
        parts.append(rows.select("lang", F.explode(both).alias("e")).where("e is not null").select("lang", "e.*"))
    return functools.reduce(DataFrame.unionAll, parts)


@dataclass(frozen=True)
class Model:
    """A model as files of sorted hash arrays."""

    files: list[str]
    order: int = ORDER

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The values of entries (sorted ``hashes``), NaN where there is none; one range is in use at a time."""
        out = np.full(len(hashes), np.nan)
        for file in self.files if len(hashes) else []:
            held, values = _range(file)
            if not len(held):
                continue
            low, high = np.searchsorted(hashes, held[0]), np.searchsorted(hashes, held[-1], "right")
            at = np.searchsorted(held, hashes[low:high])
            out[low:high] = np.where(held[at] == hashes[low:high], values[at], out[low:high])
        return out

    def log_probability(self, seeds: np.ndarray, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural logarithm of the probability of the last symbol of each n-gram after the others, by the whole model
        and by its level of one symbol less; NaN for languages without a model."""
        wanted, back = [], []
        for n in range(self.order, 0, -1):
            own = _last(head, tail, n)
            name, first, inverse = np.unique(_named(seeds, 2 * n, *own), return_index=True, return_inverse=True)
            seeds, head, tail = seeds[first], own[0][first], own[1][first]
            wanted += [name, _named(seeds, 2 * n + 1, *_before(head, tail))]
            back.append(inverse)
        names, inverse = np.unique(np.concatenate(wanted), return_inverse=True)
        found = np.split(self.find(names)[inverse], np.cumsum([len(x) for x in wanted])[:-1])
        # from single symbols up; a language without a model has no weight of the empty context
        shorter = np.where(np.isnan(found[-1]), np.nan, 1.0 / SYMBOLS)
        for k in range(self.order - 1, -1, -1):
            last = shorter
            weight = np.where(np.isnan(found[2 * k + 1]), 1.0, found[2 * k + 1])
            shorter = (np.nan_to_num(found[2 * k]) + weight * shorter)[back[k]]
        return np.log(shorter), np.log(np.broadcast_to(last, len(found[0]) if self.order > 1 else len(last))[back[0]])


@functools.lru_cache(maxsize=REMEMBERED)
def _range(file: str) -> tuple[np.ndarray, np.ndarray]:
    system, path = _filesystem(file)
    table = pq.read_table(path, filesystem=system, columns=["hash", "value"])
    return table["hash"].to_numpy(), table["value"].to_numpy()


def fit_model(counts: DataFrame, order: int = ORDER, least_documents: int = LEAST_DOCUMENTS) -> Model:
    """The model of all languages of ``counts``, written to the shared folder."""

    def name(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, head, tail = (batch.column(c).to_numpy() for c in ("kind", "head", "tail"))
            langs = batch.column("lang").dictionary_encode()
            seeds = np.array([_seed(x) for x in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(_named(seeds, kind, head, tail)), batch.column("value")], names=["hash", "value"])

    named = keep(entries(counts, order, least_documents).mapInArrow(name, "hash long, value double"))
    ranges = max(1, -(-named.count() // RANGE))
    return Model(sorted(keep(named.repartitionByRange(ranges, "hash").sortWithinPartitions("hash")).inputFiles()), order)


# ---- word statistics

def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each whole text."""
    data, offsets = joined_bytes(texts)
    starts, ends, words = word_spans(data, offsets)
    n_words = np.diff(words)
    first = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    word_chars = segment_sums(first[ends] - first[starts], words, np.int64)
    symbols = np.r_[0, np.cumsum(_MARKS[data])]
    hashes = word_hashes(data, starts, ends)
    # 3-word windows, each with its text, found twice or more in that text
    repeated = np.zeros(len(starts) + 1, np.int64)
    grams_ = windows(hashes, WINDOW)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    if len(grams_):
        inside = owner[: len(grams_)] == owner[WINDOW - 1:]
        at = np.flatnonzero(inside)
        order = at[np.lexsort((grams_[at], owner[at]))]
        same = (grams_[order][1:] == grams_[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        twice = order[np.r_[same, False] | np.r_[False, same]] if len(order) else order
        repeated[twice] += 1
        np.subtract.at(repeated, twice + WINDOW, 1)
    covered = np.cumsum(repeated[:-1]) > 0
    # lines with a word, equal to an earlier line of the text
    line_ends = np.union1d(np.flatnonzero(data == 10), offsets[1:])
    line_starts = np.r_[0, line_ends[:-1] + (line_ends[:-1] < len(data)) * (data[np.minimum(line_ends[:-1], max(len(data) - 1, 0))] == 10)] if len(line_ends) and len(data) else line_ends
    n_dup = np.zeros(len(n_words), np.int64)
    if len(starts):
        has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        line_starts, line_ends = line_starts[has_word], line_ends[has_word]
        whole = word_hashes(data, line_starts, line_ends)
        of = np.searchsorted(offsets, line_starts, "right") - 1
        order = np.lexsort((whole, of))
        again = (whole[order][1:] == whole[order][:-1]) & (of[order][1:] == of[order][:-1])
        n_dup = np.bincount(of[order][1:][again], minlength=len(n_words))
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
            "n_dup_lines": n_dup, "n_repeat_words": segment_sums(covered, words, np.int64)}


_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, the word statistics, log_ppl and log_ppl_short (by the level below; both null where ``model``
    lacks the language) of every row."""
    schema = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in _STATS) + ", log_ppl double, log_ppl_short double"

    def scored(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        names, seeds, heads, tails = (np.concatenate([g[k] for g in group]) for k in range(4))
        _, first, inverse = np.unique(names, return_index=True, return_inverse=True)
        logs = [x[inverse] for x in model.log_probability(seeds[first], heads[first], tails[first])]
        at = 0
        for own, _, _, _, places, offsets, columns in group:
            ppl = [pa.array(-segment_sums(x[at: at + len(own)][places], offsets) / np.diff(offsets), from_pandas=True) for x in logs]
            at += len(own)
            yield pa.RecordBatch.from_arrays([*columns, *ppl], names=["doc_id", "lang", *_STATS, "log_ppl", "log_ppl_short"])

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        size = 0
        for block in blocks(batches, "text", BLOCK):
            texts = block.column("text")
            head, tail, offsets = grams([t or "" for t in texts.to_pylist()], model.order)
            seeds = np.repeat(np.array([_seed(x) for x in block.column("lang").to_pylist()], np.uint64), np.diff(offsets))
            name, first, places = np.unique(_named(seeds, 0, head, tail), return_index=True, return_inverse=True)
            stats = statistics(texts)
            columns = [block.column("doc_id"), block.column("lang"), *(pa.array(stats[c].astype(np.int64)) for c in _STATS)]
            group.append((name, seeds[first], head[first], tail[first], places.astype(np.int32), offsets, columns))
            size += int(offsets[-1])
            if size >= GROUP_BYTES:
                yield from scored(group)
                group, size = [], 0
        if group:
            yield from scored(group)

    return _rows(docs, "doc_id").select("doc_id", "text", "lang").mapInArrow(each, schema)


def bands(sound: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """(lang, log_ppl_low, log_ppl_high, log_ppl_short_low, log_ppl_short_high) by the documents ``sound`` (lang,
    log_ppl, log_ppl_short)."""
    def half(x: Column) -> Column:
        return F.percentile_approx(x, 0.5, 10000)

    both = ["log_ppl", "log_ppl_short"]
    middle = _few(keep(sound.groupBy("lang").agg(*[half(F.col(c)).alias(f"{c}_mid") for c in both])))
    spread = sound.join(middle, "lang").groupBy("lang", *[f"{c}_mid" for c in both]).agg(
        *[F.greatest(1.4826 * half(F.abs(F.col(c) - F.col(f"{c}_mid"))), F.lit(NARROWEST)).alias(f"{c}_width") for c in both])
    return spread.select("lang", *[x for c in both for x in (
        (F.col(f"{c}_mid") - below * F.col(f"{c}_width")).alias(f"{c}_low"), (F.col(f"{c}_mid") + above * F.col(f"{c}_width")).alias(f"{c}_high"))])


def judge(docs: DataFrame, below: float = BELOW, above: float = ABOVE, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_ppl, log_ppl_short
    of every row of ``docs`` (doc_id, text, lang).

    base_failed: fewer than ``min_words`` words, or more than half of the words in repeated windows. kept: not
    base_failed and within both bands of the language. The bands of a language are taken from its documents that pass
    the base rules. Null text has no word and fails; null lang is a language of its own; rows with equal ids are
    judged each for themselves.
    """
    model = fit_model(count_grams(docs))
    measured = keep(measure(docs, model).withColumn(
        "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))
    edges = _few(keep(bands(measured.where("not base_failed"), below, above)))
    inside = F.coalesce(F.col("log_ppl").between(F.col("log_ppl_low"), F.col("log_ppl_high"))
                        & F.col("log_ppl_short").between(F.col("log_ppl_short_low"), F.col("log_ppl_short_high")), F.lit(False))
    return measured.join(edges, "lang", "left").select(
        "doc_id", *_STATS, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "log_ppl", "log_ppl_short")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word statistics and verdict of every document."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
