"""SimHash near-duplicates by covering anchors.

Fingerprints that differ in at most ``THRESHOLD`` bits are linked. The bits are cut into blocks with a threshold each,
such that the thresholds plus one sum to more than the overall threshold: two linked fingerprints are within the
threshold of at least one block. In a block the anchors are the words of a covering code: the (23, 12) Golay code,
which covers every 23-bit word within 3 bits by exactly one code word, followed by the other bits of the block as they
are (radius 0). A fingerprint's home is its nearest anchor. It is sent to every anchor within the covering radius plus
the block's threshold (counted for both parts of the block: what exceeds the radius of a part may sum to the
threshold), so any fingerprint within the threshold of it finds it at its own home. Fingerprints are compared per
anchor; all texts with one fingerprint take part once.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.components import components
from siftline.llm.shared import blocks, keep, ragged

THRESHOLD = 4
SHINGLE = 4
SEED = 42
#: (bits, threshold) of each block; each has at least 23 bits.
LAYOUT = ((28, 2), (36, 1))
#: At most so many homes and so many visitors of one anchor meet in one comparison.
TILE = 2048
_RADIUS = 3


# ---- the code

@functools.lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Syndrome of every 23-bit word (as tables of its low 12 and high 11 bits, xor-ed), and for each excess 0, 1, 2
    over the radius the error patterns by syndrome (patterns, offsets): at excess 0 the one of at most 3 bits, at
    excess e those of 3 + e bits."""
    generator = 0b101011100011

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= generator << (bit - 11)
        return word

    single = np.array([remainder(1 << k) for k in range(23)], np.int64)
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for k in range(12):
        low[np.arange(1 << 12) >> k & 1 == 1] ^= single[k]
    for k in range(11):
        high[np.arange(1 << 11) >> k & 1 == 1] ^= single[12 + k]
    levels = []
    for sizes in (range(_RADIUS + 1), (4,), (5,)):
        chosen = [c for size in sizes for c in itertools.combinations(range(23), size)]
        patterns = np.array([sum(1 << k for k in c) for c in chosen], np.int64)
        syndrome = low[patterns & 0xFFF] ^ high[patterns >> 12]
        order = np.argsort(syndrome, kind="stable")
        levels.append((patterns[order], np.searchsorted(syndrome[order], np.arange((1 << 11) + 1))))
    return low, high, levels


def anchors(words: np.ndarray, bits: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All anchors to which block values of ``bits`` bits are sent: index into ``words``, anchor, is it the home."""
    if bits < 23 or not 0 <= threshold <= 2:
        raise ValueError("a block needs at least 23 bits and a threshold of at most 2")
    low, high, levels = _golay()
    words = words.astype(np.int64)
    head, tail = words & 0x7FFFFF, words >> 23
    syndrome = low[head & 0xFFF] ^ high[head >> 12]
    index, anchor, home = [], [], []
    for excess in range(threshold + 1):
        patterns, offsets = levels[excess]
        count = offsets[syndrome + 1] - offsets[syndrome]
        at = np.repeat(np.arange(len(words)), count)
        code = head[at] ^ patterns[ragged(offsets[syndrome], count)]
        for flips in range(threshold - excess + 1):
            for chosen in itertools.combinations(range(bits - 23), flips):
                index.append(at)
                anchor.append(code | (tail[at] ^ sum(1 << k for k in chosen)) << 23)
                home.append(np.full(len(at), excess == flips == 0))
    return np.concatenate(index), np.concatenate(anchor), np.concatenate(home)


# ---- fingerprints

_A_TO_Z = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def text_fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text; 0 without words."""
    words = text.translate(_A_TO_Z).split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        line = b" ".join(words)
        ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
        parts = [line[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends[shingle - 1:])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, SEED) for p in parts], "<u8")
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start: start + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text) and fingerprint (long, the 64 bits) of every row."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            found = [text_fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in block.column("text")]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("text_key"), pa.array(np.array(found, np.uint64).view(np.int64))],
                names=["doc_id", "text_key", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, text_key long, fingerprint long")


# ---- links

def _send(layout) -> callable:
    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 4096):
                own = batch.column("fingerprint").slice(start, 4096).to_numpy()
                shift = 0
                for block, (bits, threshold) in enumerate(layout):
                    words = (own.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
                    shift += bits
                    index, anchor, home = anchors(words, bits, threshold)
                    yield pa.RecordBatch.from_pydict(
                        {"anchor": anchor | block << 48, "fingerprint": own[index], "home": home})

    return send


def _forest(homes: np.ndarray, visitors: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between homes and visitors, as few as connect the same fingerprints: a home is linked to one visitor of
    each group that it joins to its own."""
    both, place = np.unique(np.concatenate([homes, visitors]), return_inverse=True)
    place_h, place_v = place[: len(homes)], place[len(homes):]
    group = np.arange(len(both))
    a, b = [], []
    for h, at in zip(homes, place_h):
        near = place_v[np.bitwise_count(visitors ^ h) <= threshold]
        others, first = np.unique(group[near], return_index=True)
        new = others != group[at]
        if new.any():
            to = near[first[new]]
            a.append(np.full(len(to), at))
            b.append(to)
            group[np.isin(group, others[new])] = group[at]
    if not a:
        return both[:0], both[:0]
    return both[np.concatenate(a)], both[np.concatenate(b)]


def links(prints: DataFrame, threshold: int = THRESHOLD, layout=LAYOUT, tile: int = TILE) -> DataFrame:
    """Links (a, b) between different fingerprints of ``prints`` (fingerprint long, each once) that connect the same
    fingerprints as all pairs that differ in at most ``threshold`` bits.

    An anchor with more than ``tile`` homes is cut into tiles of about that many homes and as many parts of its
    visitors, and every two are compared apart; how many tiles such anchors have is a table of its own, small as each
    of its rows stands for many fingerprints.
    """
    if sum(bits for bits, _ in layout) != 64 or sum(t + 1 for _, t in layout) <= threshold:
        raise ValueError("the blocks must have 64 bits and thresholds that cover the overall threshold")
    schema = "anchor long, fingerprint long, home boolean"
    crowded = keep(prints.mapInArrow(_send([(bits, 0) for bits, _ in layout]), schema).groupBy("anchor")
                   .agg(F.ceil(F.count("*") / tile).alias("tiles")).where("tiles > 1"))
    met = prints.mapInArrow(_send(layout), schema).join(crowded, "anchor", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("tiles"))
    sides = met.withColumn("side", F.explode(F.when(F.col("home"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    tiled = sides.withColumn("own", own).withColumn("other", every)
    dealt = tiled.select(
        F.when(F.col("side"), F.xxhash64("anchor", "own", "other")).otherwise(F.xxhash64("anchor", "other", "own")).alias("unit"),
        "fingerprint", F.col("side").alias("home"))
    n = max(2, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def told(parts) -> pa.RecordBatch:
            unit, prints_, home = (np.concatenate(c) for c in zip(*parts))
            cuts = np.flatnonzero(unit[1:] != unit[:-1]) + 1
            found = [np.zeros((2, 0), np.int64)]
            for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(unit)]):
                own, is_home = prints_[s:e], home[s:e]
                homes, visitors = own[is_home], own[~is_home]
                if len(homes) == 1:
                    near = visitors[np.bitwise_count(visitors ^ homes[0]) <= threshold]
                    near = near[near != homes[0]]
                    if len(near):
                        found.append(np.stack([np.full(len(near), homes[0]), near]).view(np.int64))
                elif len(homes):
                    found.append(np.stack(_forest(homes, visitors, threshold)).view(np.int64))
            a, b = np.concatenate(found, axis=1)
            return pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

        for batch in batches:
            part = (batch.column("unit").to_numpy(), batch.column("fingerprint").to_numpy().view(np.uint64), batch.column("home").to_numpy(zero_copy_only=False))
            if not len(part[0]):
                continue
            last = int(np.searchsorted(part[0], part[0][-1], "left"))
            if last:
                yield told([*held, tuple(x[:last] for x in part)])
                held = []
            held.append(tuple(x[last:] for x in part))
        if held:
            yield told(held)

    pairs = dealt.repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(compare, "a long, b long")
    return pairs.distinct()


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE, layout=LAYOUT) -> DataFrame:
    """doc_id, text_key, fingerprint (16 hex digits) and component_id (the smallest doc_id that links reach, itself
    included) of every row of ``docs`` (doc_id, text).

    Null and empty texts have fingerprint zero, which is linked like any other. A null doc_id is never the smallest
    unless all are null. Repeated rows each get their row. Other columns are not read. Copies share one fingerprint
    and stay out of the comparison.
    """
    rows = keep(fingerprints(docs, shingle))
    prints = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("smallest"))
    edges = keep(links(prints.select("fingerprint"), threshold, layout))
    labels = components(edges)
    placed = prints.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    smallest = placed.groupBy("root").agg(F.min("smallest").alias("component_id"))
    of_print = placed.select("fingerprint", "root").join(smallest, "root").select("fingerprint", "component_id")
    return rows.join(of_print, "fingerprint").select(
        "doc_id", "text_key", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the one with the component's smallest doc_id (for a
    component of null ids, the one with the smallest text key); of rows equal in id and text one stays."""
    best = found.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best"), F.count("*").alias("_"))
    chosen = best.select(F.col("best.doc_id").alias("id"), F.col("best.text_key").alias("key"))
    times = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("times"))
    marked = chosen.join(times, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))).select("id", "key", "times")
    # the user's columns travel as one, so their names clash with nothing
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("text_of"))
    kept = own.join(marked, F.col("doc").eqNullSafe(F.col("id")) & (F.col("text_of") == F.col("key")))
    once, repeated = kept.where("times = 1"), kept.where("times > 1").dropDuplicates(["id", "key"])
    return once.select("row.*").unionAll(repeated.select("row.*"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
