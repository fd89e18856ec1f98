"""How the word use of sources diverges, over the terms that enough documents of a language have.

Which terms those are is found by iceberg prefix refinement. A level looks at the first bytes of every term, four bytes
at first and four times as many at each further level; a term that is no longer than that is complete there. It counts
in how many documents of a language each prefix occurs and discards those below the threshold. Complete terms that are
left are settled; the next level extends only the other prefixes that are left, until none is. Then only the settled
terms are counted by source. What is left of a level is known to the next one as a bitmap of hashes of bounded size; a
full bitmap or two terms with one hash let too much through, never too little, and the counts of whole terms decide in
the end.

Sources of a language are compared in pairs of tiles of about ``TILE`` sources. A task holds some terms of one pair of
tiles, in the order of the term, and keeps only the sums of the pairs. Terms that neither tile has are not read: their
share is the same for all of them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.llm.shared import blocks, joined_bytes, keep, mixed, ragged
from siftline.llm.words import word_spans

#: Documents of its language that a term needs; ranks of the terms that are told for a group.
LEAST, TOP = 3, 200
SCALE = 1_000_000_000
#: Bytes of the first level's prefixes, and how many times as many each further level has.
FIRST, FACTOR = 4, 4
#: The bitmap has at least and at most 2 ** so many bits, 32 for each prefix in between.
BITS = (20, 30)
#: Sources of a tile; terms of a task.
TILE, TERMS = 64, 1 << 13
#: Entries that a task gathers before it passes them on.
GATHERED = 1 << 20
#: Bytes of text in a block of the last pass.
COUNTED_BYTES = 8 << 20
_CHUNK = 1 << 12
#: Counts below this have a product with ``SCALE`` of 64 bits.
_NARROW = 9 * 10**9
# Fixed value: bytes of terms are ASCII letters and all bytes of other characters.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


# ---- terms of a block

def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, start and length of every term, and the number of its text."""
    data, offsets = joined_bytes(texts)
    data = _LOWER[data]
    starts, ends, words = word_spans(data, offsets, _LETTER)
    return data, starts, ends - starts, np.repeat(np.arange(len(offsets) - 1), np.diff(words))


def _prefix_keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int, seeds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the language's seed and the first ``size`` bytes of each term; other for a complete term than
    for the same bytes of a longer one."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))  # the eight bytes from each byte on
    with np.errstate(over="ignore"):
        keys = mixed(seeds + np.minimum(lengths, size + 1).astype(np.uint64))
        left = np.minimum(lengths, size)
        at = np.arange(len(starts))
        for k in range(0, size, 8):
            at = at[left[at] > k]
            if not len(at):
                break
            part = eight[starts[at] + k] & _MASKS[np.minimum(left[at] - k, 8)]
            keys[at] = mixed(keys[at] * np.uint64(0x9E3779B97F4A7C15) + part)
    return keys


def _seeds(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    return np.array([xxhash.xxh64_intdigest(x) for x in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]


def _in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _per_key(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where one entry of each key stands, in how many texts the key occurs and how often; ``docs`` ascends."""
    order = np.argsort(keys, kind="stable")
    own, doc = keys[order], docs[order]
    new = np.r_[True, own[1:] != own[:-1]]
    first = np.flatnonzero(new)
    other = new | np.r_[True, doc[1:] != doc[:-1]]
    return order[first], np.add.reduceat(other, first, dtype=np.int64), np.diff(np.r_[first, len(own)])


# ---- the levels

def _level(docs: DataFrame, size: int, before: int, bitmap: Broadcast | None, least: int) -> DataFrame:
    """key, docs and open (do longer terms begin so) of the prefixes of ``size`` bytes that enough documents have, of terms
    that are longer than ``before`` bytes and have those in the bitmap."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            keys, number, more = (np.concatenate(x) for x in zip(*held))
            own, place = np.unique(keys, return_inverse=True)
            longer = np.zeros(len(own), bool)
            longer[place[more]] = True
            return own, np.bincount(place, number, len(own)).astype(np.int64), longer

        def told(keys: np.ndarray, number: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": keys.view(np.int64), "docs": number, "open": more})

        entries = 0
        for block in blocks(batches, "text"):
            data, starts, lengths, doc = _terms(block.column("text"))
            if before:
                longer = lengths > before
                starts, lengths, doc = starts[longer], lengths[longer], doc[longer]
            seeds = _seeds(block.column("lang"))[doc]
            if bitmap is not None:
                left = _in_bitmap(bitmap.value, _prefix_keys(data, starts, lengths, before, seeds))
                starts, lengths, doc, seeds = starts[left], lengths[left], doc[left], seeds[left]
            if not len(starts):
                continue
            keys = _prefix_keys(data, starts, lengths, size, seeds)
            at, number, _ = _per_key(keys, doc)
            held.append((keys[at], number, lengths[at] > size))
            entries += len(at)
            if entries > GATHERED:
                held = [merged()]
                entries = len(held[0][0])
                if entries > GATHERED // 2:
                    yield told(*held[0])
                    held, entries = [], 0
        if held:
            yield told(*merged())

    rows = docs.select("lang", "text").mapInArrow(count, "key long, docs long, open boolean")
    return rows.groupBy("key").agg(F.sum("docs").alias("docs"), F.max("open").alias("open")).where(F.col("docs") >= least)


def _bitmap(keys: DataFrame, count: int, bits: tuple[int, int]) -> np.ndarray:
    """A bit for each key; built by Spark in parts, so the driver gathers no more than the bitmap."""
    size = min(max((32 * count).bit_length(), bits[0]), bits[1])
    place = (F.col("key").bitwiseAND((1 << size) - 1) + 1).alias("place")
    parts = keys.select(place).groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(1 << (size - 3), np.uint8)
    for row in parts.toLocalIterator():
        part = np.frombuffer(row["bits"], np.uint8)[: len(out)]
        out[(row["part"] - 1) * len(part):][: len(part)] = part
    return out


def refined(docs: DataFrame, least: int = LEAST, first: int = FIRST, factor: int = FACTOR, bits: tuple[int, int] = BITS) -> tuple[int, Broadcast]:
    """Bytes of the last level's prefixes, and the bitmap of the terms that all levels together have settled."""
    spark = docs.sparkSession
    size, before, bitmap, settled = first, 0, None, []
    while True:
        left = keep(_level(docs, size, before, bitmap, least))
        settled.append(left.where("not open"))
        extended = left.where("open")
        if not (count := extended.count()):
            break
        bitmap = spark.sparkContext.broadcast(_bitmap(extended, count, bits))
        size, before = size * factor, size
    every = functools.reduce(DataFrame.unionAll, settled)
    return size, spark.sparkContext.broadcast(_bitmap(every, every.count(), bits))


def _stated(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _counted(docs: DataFrame, least: int, **options) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, docs, n) of the settled terms, and (lang, term, lang_n) of those that enough documents have."""
    docs = _stated(docs)
    size, bitmap = refined(docs, least, **options)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", COUNTED_BYTES):
            data, starts, lengths, doc = _terms(block.column("text"))
            left = _in_bitmap(bitmap.value, _prefix_keys(data, starts, lengths, size, _seeds(block.column("lang"))[doc]))
            starts, lengths, doc = starts[left], lengths[left], doc[left]
            if not len(starts):
                continue
            words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.r_[0, np.cumsum(lengths)]), pa.py_buffer(data[ragged(starts, lengths)])])
            coded = words.dictionary_encode()
            term = coded.indices.to_numpy().astype(np.int64)
            lang, source = block.column("lang").dictionary_encode(), block.column("source").dictionary_encode()
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            at, number, times = _per_key(group[doc] * len(coded.dictionary) + term, doc)
            yield pa.RecordBatch.from_arrays(
                [block.column("lang").take(pa.array(doc[at])), block.column("source").take(pa.array(doc[at])),
                 coded.dictionary.take(pa.array(term[at])).cast(pa.string()), pa.array(number), pa.array(times)],
                names=["lang", "source", "term", "docs", "n"])

    found = docs.mapInArrow(count, "lang string, source string, term string, docs long, n long")
    # a block's rows are sums already, and few of them meet again in its task
    dealt = found.repartition(max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "lang", "source", "term")
    counts = keep(dealt.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least)
    return counts, keep(kept.drop("docs"))


def term_counts(docs: DataFrame, least: int = LEAST, **options) -> DataFrame:
    """lang, source, term, n (occurrences in the group) and lang_n (in the language) of the terms that at least
    ``least`` documents of the language have, for every group of ``docs`` (lang, source, text) in which they occur."""
    counts, kept = _counted(docs, least, **options)
    return counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n")


# ---- divergence

def _share(n: Column) -> Column:
    """The smoothed share of a term with ``n`` of ``total`` occurrences among ``terms`` terms, in parts of a billion."""
    whole = F.greatest(F.col("total") + F.col("terms"), F.lit(1))
    wide = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return 1 + F.when(n < _NARROW, F.call_function("div", (n + 1) * F.lit(SCALE).cast("long"), whole)).otherwise(
        F.call_function("div", wide, whole.cast("decimal(20,0)")))


def _gain(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


class _Unit:
    """The sums of one pair of tiles over some of the terms."""

    def __init__(self, first: bool, same: bool) -> None:
        self.first = first  # of all units of these tiles: it has the share of the terms that neither tile has
        self.same = same  # a tile with itself: its sources come once, as side 0
        self.names: tuple[list, list] = ([], [])
        self.zero: tuple[list, list] = ([], [])
        self.lang, self.terms = "", 0

    def add_source(self, lang: str, side: int, source: str, zero: int, terms: int) -> None:
        self.lang, self.terms = lang, terms
        self.names[side].append(source)
        self.zero[side].append(zero)

    def start(self) -> None:
        if self.same:
            self.names, self.zero = (self.names[0],) * 2, (self.zero[0],) * 2
        self.none = [np.array(z, np.int64) for z in self.zero]
        self.forth = np.zeros((len(self.none[0]), len(self.none[1])), np.int64)
        self.back = np.zeros_like(self.forth)
        self.seen = 0

    def add(self, term: np.ndarray, side: np.ndarray, slot: np.ndarray, p: np.ndarray) -> None:
        """Rows of whole terms; ``term`` numbers them from 0 on."""
        for low in range(0, int(term[-1]) + 1 if len(term) else 0, _CHUNK):
            begin, end = np.searchsorted(term, (low, low + _CHUNK))
            own = slice(int(begin), int(end))
            both = [np.tile(z, (int(term[own][-1]) - low + 1, 1)) for z in self.none]
            for k in (0, 1):
                mine = side[own] == k
                both[k][term[own][mine] - low, slot[own][mine]] = p[own][mine]
            a, b = both if not self.same else (both[0],) * 2
            self.seen += len(a)
            for k in range(a.shape[1]):
                gap = a[:, k: k + 1] - b
                gap *= gap
                self.forth[k] += (gap // b).sum(axis=0)
                if not self.same:
                    self.back[k] += (gap // a[:, k: k + 1]).sum(axis=0)

    def result(self) -> dict[str, list]:
        a, b = self.none
        gap = (a[:, None] - b) ** 2 if self.terms else np.zeros_like(self.forth)
        times = (self.terms if self.first else 0) - self.seen
        forth = self.forth + times * (gap // np.maximum(b, 1))
        back = self.back + times * (gap // np.maximum(a, 1)[:, None])
        i, j = np.indices(forth.shape).reshape(2, -1)
        if self.same:
            i, j = i[i != j], j[i != j]
        one, two = np.array(self.names[0], object), np.array(self.names[1], object)
        out = {"source": one[i], "item": two[j], "value": forth[i, j]}
        if not self.same:
            out = {"source": np.r_[out["source"], two[j]], "item": np.r_[out["item"], one[i]], "value": np.r_[out["value"], back[i, j]]}
        return {"lang": [self.lang] * len(out["value"])} | out


def _pair_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the pairs of each unit. Its first rows, without a term, are the sources of its tiles; the rows of terms
    follow in the order of the term. Of these no more is held than a batch and the rows of one term."""
    unit, where, held = None, None, None

    def full(table: pa.Table, last: bool) -> pa.Table | None:
        """Add the terms that are whole; what is left belongs to a term that may go on."""
        if not table.num_rows:
            return None
        term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        end = len(term) if last else int(np.searchsorted(term, term[-1]))
        unit.add(term[:end], *(table.column(c).to_numpy()[:end] for c in ("side", "slot", "p")))
        return table.slice(end)

    def closed() -> Iterator[pa.RecordBatch]:
        if unit is not None:
            if held is not None:
                full(held, True)
            found = unit.result()
            if len(found["value"]):
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k == "value" else pa.string()) for k, v in found.items()})

    keys = ("lang", "one", "two", "part")
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        term = batch.column("term").is_valid().to_numpy(zero_copy_only=False)
        change = np.zeros(len(batch), bool)
        for column in columns:
            change[1:] |= np.fromiter((x != y for x, y in zip(column[1:], column)), bool, max(len(batch) - 1, 0))
        for begin, end in zip(np.r_[0, np.flatnonzero(change)], np.r_[np.flatnonzero(change), len(batch)]):
            if begin == end:
                continue
            here = tuple(c[begin] for c in columns)
            if here != where:
                yield from closed()
                unit, where, held = _Unit(here[3] == 0, here[1] == here[2]), here, None
            own = batch.slice(int(begin), int(end - begin))
            heads = int((~term[begin:end]).sum())
            for row in own.slice(0, heads).to_pylist():
                unit.add_source(row["lang"], row["side"], row["source"], row["p"], row["terms"])
            if heads or not hasattr(unit, "seen"):
                unit.start()
            rest = pa.Table.from_batches([own.slice(heads).select(["term", "side", "slot", "p"])])
            held = full(rest if held is None else pa.concat_tables([held, rest]), False)
    yield from closed()


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, source, item (another source) and value of every pair of ``groups`` (lang, source, total, terms), from the
    shares p of ``shares`` (lang, source, term, p)."""
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    place = Window.partitionBy("lang", "tile").orderBy("source")
    placed = keep(groups.join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles"))).withColumn("slot", F.row_number().over(place) - 1)
                  .withColumn("parts", F.greatest(F.ceil(F.col("terms") / TERMS), F.lit(1))).withColumn("zero", _share(F.lit(0))))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
    # a row goes to every pair of tiles that has its own
    one, two = F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two")
    sides = F.when(F.col("tile") <= F.col("other"), 0).otherwise(1).alias("side")
    heads = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(
        "*", other).select("lang", one, two, "part", F.lit(None).cast("string").alias("term"), sides, "slot", F.col("zero").alias("p"), "source", "terms")
    rows = shares.join(placed, ["lang", "source"]).withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts"))).select(
        "*", other).select("lang", one, two, "part", "term", sides, "slot", "p", F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("terms"))
    unit = ["lang", "one", "two", "part"]
    dealt = heads.unionAll(rows).repartition(max(2, int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *unit)
    sums = dealt.sortWithinPartitions(*unit, F.asc_nulls_first("term"), "side", "slot").mapInArrow(_pair_sums, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, **options) -> DataFrame:
    """lang, source, part, item, value and rank for every group (lang, source) of ``docs`` (lang, source, text): how far
    its word use lies from each other source of the language (part pair), and by which terms it differs most from the
    whole language (part term, the ``top`` first of them).

    Null is the empty string in all three columns. Groups without terms take part; a language without kept terms has
    pairs of value 0; one with a single source has no pairs. Every row of ``docs`` is a document, repeated rows too;
    other columns are not read; an empty table gives none.
    """
    every, kept = _counted(docs, least, **options)
    counts = keep(every.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("long")
    groups = keep(_stated(docs).select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("total", none).alias("total"), F.coalesce("terms", none).alias("terms"), F.coalesce("lang_total", none).alias("lang_total")))
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"))).withColumn("total", F.col("lang_total")).withColumn("q", _share(F.col("lang_n")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gain("p", "q").alias("value"))
    pairs = _pairs(groups, shares.select("lang", "source", "term", "p")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = F.row_number().over(order).alias("rank")
    return pairs.select("*", rank).unionAll(terms.select("*", rank).where(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and its most typical terms."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
words AS (SELECT k, lang, source, unnest(regexp_extract_all(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
grps AS (SELECT lang, source, coalesce(total, 0)::HUGEINT AS total, coalesce(v, 0)::HUGEINT AS v FROM (SELECT DISTINCT lang, source FROM docs)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source) USING (lang, source) LEFT JOIN (SELECT lang, v FROM langs) USING (lang)),
dense AS (SELECT lang, source, term, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS p
  FROM grps JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::HUGEINT AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN dense x ON x.lang = a.lang AND x.source = a.source LEFT JOIN dense y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
typical AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM (
  SELECT c.lang, c.source, c.term, 1 + (1000000000::HUGEINT * (n + 1)) // (g.total + g.v) AS p, 1 + (1000000000::HUGEINT * (lang_n + 1)) // (l.total + l.v) AS q
  FROM counts c JOIN kept USING (lang, term) JOIN grps g ON g.lang = c.lang AND g.source = c.source JOIN langs l ON l.lang = c.lang) WHERE p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM typical)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM ranked) WHERE part = 'pair' OR rank <= 200
"""
