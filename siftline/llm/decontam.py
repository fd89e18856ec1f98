"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of ASCII letters, digits and characters beyond ASCII, in lower case. One pass over the corpus counts in
how many documents each n-gram of the test items occurs. An item's seeds are its n-grams that are not much more
frequent than its own median n-gram, and the rarest of every ``NEAR`` neighbours, so each part of an item has a seed
however often the whole item was leaked. An item of fewer words than
a seed is sought as a whole, in documents that have no other words. In a second pass the seeds join passages to items, and each passage around
the joined seeds is aligned with the item by words. The score is that of the best local alignment divided by that of
the item with itself: 1 for an exact copy, less for an edited or partial one. An item counts as found by its score, or
by a part that is long and close enough to be no accident, however small a part of the item it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.shared import blocks, joined_bytes, ragged, whole_texts
from siftline.llm.words import PLAIN, windows, word_hashes, word_spans

SEED_WORDS = 3
NEAR = 4
#: An n-gram in more than so many times the documents of the item's median n-gram is not rare.
COMMON = 4
MATCH, MISMATCH, GAP = 2, -1, 1
THRESHOLD = 0.5
#: An alignment that is worth so many equal words, at that share of what equal words of its length are worth, is a copy too.
RUN_WORDS, RUN_IDENTITY = 13, 0.8
#: Items are searched in blocks of so many words at most (or one item); a block is broadcast.
BLOCK_WORDS = 1 << 20
#: Cells of one alignment step.
CELLS = 1 << 18


@dataclass
class Items:
    """A block of test items: words as hashes, n-grams as numbers into a sorted list."""

    ids: list
    words: np.ndarray
    offsets: np.ndarray
    grams: np.ndarray  # sorted, different
    gram_place: np.ndarray  # of each n-gram of each item, in the order of the items
    gram_item: np.ndarray
    gram_at: np.ndarray  # word of the item at which it begins
    table: np.ndarray  # which hash prefixes occur


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(whole_texts(texts))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = joined_bytes(_lowered(texts))
    starts, ends, words = word_spans(data, offsets, PLAIN)
    return word_hashes(data, starts, ends), words, starts, ends, data


def _table(grams: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 22, bool)
    table[grams >> np.uint64(42)] = True
    return table


def _grams(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of texts in order, and how many each text has: a text of fewer than ``SEED_WORDS`` words is one."""
    sizes = np.diff(offsets)
    counts = np.where(sizes >= SEED_WORDS, sizes - SEED_WORDS + 1, np.minimum(sizes, 1))
    at = ragged(offsets[:-1], counts)
    out = np.zeros(len(at), np.uint64)
    whole = np.repeat(sizes, counts)
    long_ = whole >= SEED_WORDS
    out[long_] = windows(hashes, SEED_WORDS)[at[long_]]
    for size in range(1, SEED_WORDS):
        short = whole == size
        out[short] = windows(hashes, size)[at[short]] ^ np.uint64(size)
    return out, counts


def make_items(ids: list, texts: list[str]) -> Items:
    hashes, offsets, *_ = _words(pa.array(texts, pa.large_string()))
    own, counts = _grams(hashes, offsets)
    at = ragged(offsets[:-1], counts)
    grams, place = np.unique(own, return_inverse=True)
    return Items(ids, hashes, offsets, grams, place, np.repeat(np.arange(len(ids)), counts),
                 at - np.repeat(offsets[:-1], counts), _table(grams))


def item_blocks(items: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[Items]:
    """All items, read in order, in blocks of bounded size. Items without words (null included) are found nowhere."""
    ids, texts, size = [], [], 0
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    for row in rows.toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"]) // 2 + 1
        if size >= limit:
            yield make_items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield make_items(ids, texts)


def _hits(hashes: np.ndarray, offsets: np.ndarray, grams: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where n-grams of the texts are among ``grams``: text, word, place in ``grams``."""
    own, counts = _grams(hashes, offsets)
    if not len(own) or not len(grams):
        return (np.zeros(0, np.int64),) * 3
    here = np.flatnonzero(table[own >> np.uint64(42)])
    place = np.minimum(np.searchsorted(grams, own[here]), len(grams) - 1)
    found = grams[place] == own[here]
    here, place = here[found], place[found]
    first = np.r_[0, np.cumsum(counts)]
    text = np.searchsorted(first, here, "right") - 1
    return text, offsets[text] + here - first[text], place


def document_counts(docs: DataFrame, items: Items) -> np.ndarray:
    """In how many documents each n-gram of the items occurs."""
    shared = docs.sparkSession.sparkContext.broadcast((items.grams, items.table))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, table = shared.value
        total = np.zeros(len(grams), np.int64)
        for block in blocks(batches, "text"):
            hashes, offsets, *_ = _words(block.column("text"))
            text, _, place = _hits(hashes, offsets, grams, table)
            total += np.bincount(np.unique(text * len(grams) + place) % max(len(grams), 1), minlength=len(grams))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": full, "n": total[full]})

    table = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(items.grams), np.int64)
    out[table["gram"].to_numpy()] = table["n"].to_numpy()
    return out


def choose_seeds(items: Items, counts: np.ndarray) -> np.ndarray:
    """Which n-grams of the items are seeds."""
    chosen = np.zeros(len(items.gram_place), bool)
    edges = np.searchsorted(items.gram_item, np.arange(len(items.ids) + 1))
    for low, high in zip(edges[:-1], edges[1:]):
        if high == low:
            continue
        own = counts[items.gram_place[low:high]]
        chosen[low:high] = own <= COMMON * max(float(np.median(own)), 1.0)
        for start in range(0, max(high - low - NEAR, 0) + 1):
            part = slice(low + start, min(low + start + NEAR, high))
            if not chosen[part].any():
                chosen[low + start + int(own[start: start + NEAR].argmin())] = True
    return chosen


def align(passages: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of each row of ``passages`` with the same row of ``items`` (word numbers, negative beyond the
    end): the best score, and the last passage word and item word of an alignment with it."""
    n, width = passages.shape
    rise = (GAP * np.arange(width)).astype(np.int32)
    row = np.zeros((n, width), np.int32)
    best, at, item_at = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(items.shape[1]):
        gain = np.where((passages == items[:, k: k + 1]) & (passages >= 0), MATCH, MISMATCH).astype(np.int32)
        gain[:, 1:] += row[:, :-1]
        new = np.maximum(np.maximum(gain, row - GAP), 0)
        row = np.maximum.accumulate(new + rise, axis=1) - rise
        top = row.argmax(axis=1)
        score = row[np.arange(n), top]
        better = score > best
        best[better], at[better], item_at[better] = score[better], top[better], k
    return best, at, item_at


def _padded(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, back: bool = False) -> np.ndarray:
    """Rows of words from each start on, or back from it, filled up with -1."""
    width = int(lengths.max())
    step = np.arange(width)
    out = np.full((len(starts), width), -1, np.int64)
    inside = step < lengths[:, None]
    index = starts[:, None] + (-step if back else step)
    out[inside] = words[index[inside]]
    return out


@dataclass
class Seeds:
    items: Items
    grams: np.ndarray
    table: np.ndarray
    owner_offsets: np.ndarray  # of each gram in the next two
    owner_item: np.ndarray
    owner_at: np.ndarray
    vocabulary: np.ndarray  # sorted word hashes of the items
    item_words: np.ndarray  # numbers into it

    @staticmethod
    def make(items: Items, counts: np.ndarray) -> Seeds:
        chosen = np.flatnonzero(choose_seeds(items, counts))
        order = chosen[np.argsort(items.gram_place[chosen], kind="stable")]
        place = items.gram_place[order]
        kept, first = np.unique(place, return_index=True)
        vocabulary, numbers = np.unique(items.words, return_inverse=True)
        return Seeds(items, items.grams[kept], _table(items.grams[kept]), np.r_[first, len(order)],
                     items.gram_item[order], items.gram_at[order], vocabulary, numbers)

    def matches(self, texts: pa.Array, threshold: float) -> dict[str, np.ndarray]:
        """text, item (numbers), score, start and end (bytes of all texts one after another) of the best alignment
        of each text and item that is found: by a score of at least ``threshold`` or by a long part."""
        hashes, offsets, starts, ends, data = _words(texts)
        text, at, gram = _hits(hashes, offsets, self.grams, self.table)
        none = {k: np.zeros(0, np.int64) for k in ("text", "item", "start", "end")} | {"score": np.zeros(0)}
        if not len(text):
            return none
        count = np.diff(self.owner_offsets)[gram]
        index = ragged(self.owner_offsets[:-1][gram], count)
        text, at = np.repeat(text, count), np.repeat(at, count)
        item, inner = self.owner_item[index], self.owner_at[index]
        size = np.diff(self.items.offsets)[item]
        # the passage in which an alignment through the seed can lie, with room for as many gaps as could pay
        low = np.maximum(at - inner * (1 + MATCH // GAP), offsets[text])
        high = np.minimum(at + (size - inner) * (1 + MATCH // GAP), offsets[text + 1])
        order = np.lexsort((low, item, text))
        text, item, low, high = text[order], item[order], low[order], high[order]
        key = np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])]
        # passages of one text and item that overlap become one
        group = np.cumsum(key) - 1
        span = int(offsets[-1]) + 1
        reach = np.maximum.accumulate(high + group * span) - group * span
        new = key | np.r_[True, low[1:] > reach[:-1]]
        first = np.flatnonzero(new)
        text, item, low = text[first], item[first], low[first]
        high = np.maximum.reduceat(high, first)
        numbers = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        numbers = np.where(self.vocabulary[numbers] == hashes, numbers, -2)
        own, item_start, item_size = self.item_words, self.items.offsets[item], np.diff(self.items.offsets)[item]
        score, accepted = np.zeros(len(text)), np.zeros(len(text), bool)
        start, end = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        by_length = np.argsort(high - low, kind="stable")[::-1]
        done = 0
        while done < len(by_length):
            n = max(1, CELLS // int(high[by_length[done]] - low[by_length[done]]))
            part = by_length[done: done + n]
            done += n
            best, last, item_last = align(_padded(numbers, low[part], (high - low)[part]), _padded(own, item_start[part], item_size[part]))
            score[part] = best / (MATCH * item_size[part])
            good = np.flatnonzero((score[part] >= threshold) | (best >= MATCH * RUN_WORDS))
            if len(good):
                chosen, last, item_last = part[good], last[good], item_last[good]
                _, back, _ = align(_padded(numbers, low[chosen] + last, last + 1, True), _padded(own, item_start[chosen] + item_last, item_last + 1, True))
                end[chosen] = ends[low[chosen] + last]
                start[chosen] = starts[low[chosen] + last - back]
                accepted[chosen] = (score[chosen] >= threshold) | (best[good] >= RUN_IDENTITY * MATCH * (back + 1))
        good = np.flatnonzero(accepted)
        # the best passage of each text and item, the first of equals
        good = good[np.lexsort((start[good], -score[good], item[good], text[good]))]
        once = np.r_[True, (text[good][1:] != text[good][:-1]) | (item[good][1:] != item[good][:-1])] if len(good) else good
        good = good[once] if len(good) else good
        return {"text": text[good], "item": item[good], "score": score[good], "start": start[good], "end": end[good]}


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, start and end (characters of the lower-cased text) for every document of ``docs``
    (doc_id, text) and item of ``items`` (item_id, text) whose best alignment scores ``threshold`` or more, or is worth
    ``RUN_WORDS`` equal words at ``RUN_IDENTITY``.

    Null and empty texts match nothing; equal items and repeated rows match each for themselves; other columns are
    not read. Items come to the driver in blocks of bounded size, with two passes over ``docs`` for each block.
    """
    schema = "doc_id long, item_id long, score double, start long, end long"

    def search(shared) -> Callable:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = shared.value
            for block in blocks(batches, "text"):
                found = seeds.matches(block.column("text"), threshold)
                if not len(found["text"]):
                    continue
                data, offsets = joined_bytes(_lowered(block.column("text")))
                chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                base = chars[offsets[found["text"]]]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": block.column("doc_id").take(pa.array(found["text"])),
                    "item_id": pa.array([seeds.items.ids[i] for i in found["item"]], pa.int64()),
                    "score": found["score"], "start": chars[found["start"]] - base, "end": chars[found["end"]] - base})

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(Seeds.make(block, document_counts(rows, block)))
        part = rows.mapInArrow(search(shared), schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""

    def clean(shared) -> Callable:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, "text"):
                leaked = np.zeros(len(block), bool)
                leaked[shared.value.matches(block.column("text"), threshold)["text"]] = True
                yield block.filter(pa.array(~leaked))

        return run

    for block in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(Seeds.make(block, document_counts(docs, block)))
        docs = docs.mapInArrow(clean(shared), docs.schema)
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
