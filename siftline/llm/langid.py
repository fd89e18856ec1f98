"""Language identification: multinomial naive Bayes over hashed character n-grams.

Spark counts (language, bucket) over all learning rows; the log-probability matrix, buckets x languages, is broadcast
(its size is fixed by ``BUCKETS`` and bounded by ``MAX_LANGUAGES``), and texts are scored in blocks with numpy: the
rows of the matrix for all n-grams of a block are gathered and summed per text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.shared import blocks, remainder, segment_sums

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: More learned languages than this are an error, as the matrix goes to every executor.
MAX_LANGUAGES = 1024
UNKNOWN = "und"
_FACTORS = np.array([2654435761, 2246822519, 3266489917], np.uint32)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-case letter, 0 for all that is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            table[code] = ord(char.lower()[0])
    return table


def gram_buckets(texts: list[str], buckets: int = BUCKETS) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order, the buckets of all n-grams with a letter and the offsets of the texts in them; and which texts
    have a letter. Letters are lower-cased; anything else is a blank. The blank before a text and after it counts
    as part of it, so words at its ends look like words within."""
    joined = "\n" + "\n".join(texts) + "\n"
    codes = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.cumsum(lengths) - lengths  # of the blank before each text
    found = []
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    for n in ORDERS:
        size = max(len(codes) - n + 1, 0)
        value = np.zeros(size, np.uint32)
        full = np.zeros(size, bool)
        for k in range(n):
            part = codes[k: k + size]
            full |= part > 0
            value = value * np.uint32(0x01000193) + part * _FACTORS[k] + np.uint32(n)
        value = (value ^ (value >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        # an n-gram belongs to the text in which it starts; those that go on in the next text are left out
        last = starts + lengths + 2 - n
        inside = np.zeros(size + 1, np.int32)
        np.add.at(inside, np.minimum(starts, size), 1)
        np.add.at(inside, np.clip(np.maximum(last, starts), 0, size), -1)
        full &= np.cumsum(inside[:-1]) > 0
        at = np.flatnonzero(full)
        found.append((value[at] >> shift, np.searchsorted(at, np.r_[starts, size])))
    return found, np.diff(found[0][1]) > 0


@dataclass
class LanguageModel:
    languages: list[str]
    prior: np.ndarray  # languages
    matrix: np.ndarray  # buckets x languages, log probabilities less their mean over the languages


def train(docs: DataFrame, buckets: int = BUCKETS) -> LanguageModel:
    """Learn from all rows of ``docs`` (text, lang) whose lang is not null. Without such rows there is no language
    and every prediction is ``und``."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, counts in sums.items():
                full = np.flatnonzero(counts)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * (len(full) + 1), "bucket": np.r_[-1, full],
                                                  "n": np.r_[rows[lang], counts[full]]})
            sums.clear()
            rows.clear()

        for block in blocks(batches, "text"):
            langs = np.array(block.column("lang").to_pylist(), object)
            found, _ = gram_buckets([t or "" for t in block.column("text").to_pylist()], buckets)
            for lang in set(langs):
                own = langs == lang
                for grams, offsets in found:
                    sums[lang] = sums.get(lang, 0) + np.bincount(grams[np.repeat(own, np.diff(offsets))], minlength=buckets)
                rows[lang] = rows.get(lang, 0) + int(own.sum())
            if len(sums) > 64:
                yield from told()
        yield from told()

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null")
    table = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    grouped = table.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("counts"))
    found = grouped.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((len(found), buckets))
    weight = np.zeros(len(found))
    for k, row in enumerate(found):
        for bucket, n in row["counts"]:
            if bucket < 0:
                weight[k] = n
            else:
                counts[k, bucket] = n
    smooth = counts + 0.5
    logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if len(found) else smooth
    prior = np.log(weight / weight.sum()) if len(found) else weight
    matrix = (logs - logs.mean(axis=0)).T if len(found) else np.zeros((buckets, 0))
    return LanguageModel([r["lang"] for r in found], prior, np.ascontiguousarray(matrix, np.float32))


def score_texts(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior probability for each text. Each letter is seen once per order, so the
    sum of the log probabilities is divided by the number of orders."""
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    found, lettered = gram_buckets(texts, len(model.matrix))
    total = sum(segment_sums(model.matrix[grams], offsets) for grams, offsets in found) / len(ORDERS) + model.prior
    total -= total.max(axis=1, keepdims=True)
    best = total.argmax(axis=1)
    share = 1 / np.exp(total).sum(axis=1)
    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
    return names, np.where(lettered, np.clip(share, 0, 1), 0.0)


def predicted(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """A struct (lang_pred, score) for a text column: ``und`` and 0 for null or a text without a letter."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            texts = [t or "" for t in series]
            parts, size, own = [], 0, []
            for t in texts:
                own.append(t)
                size += len(t)
                if size > 1 << 20:
                    parts.append(score_texts(shared.value, own))
                    size, own = 0, []
            if own or not parts:
                parts.append(score_texts(shared.value, own) if own else ([], np.zeros(0)))
            yield pd.DataFrame({"lang_pred": [x for p in parts for x in p[0]], "score": np.concatenate([p[1] for p in parts])})

    return predict(text.cast("string"))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of every row; only doc_id and text are read, null text is ``und`` with score 0,
    repeated rows each get their row."""
    rows = docs.select("doc_id", predicted(docs.sparkSession, model, F.col("text")).alias("found"))
    return rows.select("doc_id", "found.lang_pred", "found.score")


def learning_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: crc32 of the id modulo 3 is not 1."""
    return docs.where(remainder("doc_id", 3) != 1)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a third of the documents is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(learning_rows(docs)))
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
