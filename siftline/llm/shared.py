"""Helpers of the training-data operators: Arrow blocks of bounded size, row keys, intermediate tables."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.session import cut_lineage

BLOCK_BYTES = 2 << 20


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    return cut_lineage(df)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names`` lengthened until no column of ``df`` has them (Spark does not tell upper from lower case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def remainder(id_column: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % by


def give_back() -> None:
    """Free memory of this process goes to the system. A worker serves one task after another, and the allocators would
    keep what the hungriest of them needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, dealt again so that a block holds about ``limit`` bytes
    of ``text`` (or one row, if that row alone is longer). Free memory is given back before the first and after the last."""
    give_back()
    for batch in batches:
        column = batch.column(text)
        size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for start, end in zip(np.r_[0, cuts], np.r_[cuts, len(part)]):
            if end > start:
                yield batch.slice(int(start), int(end - start))
    give_back()


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after another, and the n + 1 offsets of the texts; null is empty."""
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset: filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]: offsets[-1]], offsets - offsets[0]


def whole_texts(texts: pa.Array) -> pa.Array:
    """The texts as large strings without nulls (null is empty) and without an offset into a longer array, which some
    of Arrow's string functions don't respect."""
    data, offsets = joined_bytes(texts)
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every (start, length), one after another."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def segment_sums(values: np.ndarray, offsets: np.ndarray, dtype=np.float64) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets (0 where they are equal), along the first axis."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0, dtype=dtype)
    return out
