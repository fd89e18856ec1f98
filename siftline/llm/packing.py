"""Packing by power-of-two decomposition.

The ids of a document (with its end id) are cut into as many pieces of ``longest`` ids as fit and one piece for every
bit set in the rest, longest first. A piece is a training sequence of its own: no sequence crosses documents, none is
padded, and a batch is drawn from one bucket of equal lengths (column ``length``; ``write_buckets`` stores them apart).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.bpe import encoder, tokenizer_path
from siftline.llm.shared import blocks, ragged

LONGEST = 4096
_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def binary_pieces(sizes: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of these sizes: the document, start and length of every piece, in order."""
    if longest & (longest - 1) or longest < 1:
        raise ValueError("the longest piece must be a power of two")
    bits = 1 << np.arange(longest.bit_length() - 2, -1, -1, dtype=np.int64)
    whole, rest = sizes // longest, sizes % longest
    small = (rest[:, None] & bits) > 0
    counts = whole + small.sum(axis=1)
    document = np.repeat(np.arange(len(sizes)), counts)
    rank = ragged(np.zeros(len(sizes), np.int64), counts)
    length = np.full(len(document), longest, np.int64)
    length[rank >= whole[document]] = np.broadcast_to(bits, small.shape)[small]
    ends = np.cumsum(length)
    first = np.cumsum(sizes) - sizes
    return document, ends - length - first[document], length


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, longest: int = LONGEST) -> DataFrame:
    """Every piece of whole ``docs`` (doc_id, text): doc_id, start, length, ids (little-endian 32-bit), doc_tokens,
    sequence_id, offset.

    Null and empty texts are the end id alone; repeated rows and ids are packed each for themselves; other columns
    are not read. A sequence id is the task's number and a counter in the task, so nothing is shuffled.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 36
        for block in blocks(batches, "text"):
            ids, offsets = encoder(tokenizer).encode(block.column("text"))
            ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
            sizes = np.diff(offsets) + 1
            document, start, length = binary_pieces(sizes, longest)
            places = np.r_[0, np.cumsum(length) * 4]
            yield pa.RecordBatch.from_arrays([
                block.column("doc_id").take(pa.array(document)),
                pa.array(start), pa.array(length),
                pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(places.astype("<i8").tobytes()), pa.py_buffer(ids.tobytes())]).cast(pa.binary()),
                pa.array(sizes[document]), pa.array(serial + np.arange(len(length))), pa.array(np.zeros(len(length), np.int64)),
            ], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            serial += len(length)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, _SCHEMA)


def write_buckets(pieces: DataFrame, folder: str) -> None:
    """Store the sequences with one folder for each length."""
    pieces.write.partitionBy("length").parquet(folder)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens: one row per piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(pack_documents(docs, tokenizer_path("word_bpe_49k.json")))
