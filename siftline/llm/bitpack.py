"""Token ids in fixed-width bit-packed shards.

A shard file is: magic ``SLBP0002``; then little-endian 64-bit integers ``bits``, ``block`` (ids per block),
``documents``, ``ids``, ``part`` and ``shard`` (its place among all files: files are read in the order of these two); then
the document ids, and for each document a byte that is 0 if its id is null; then ``documents`` + 1 offsets of the
documents in the ids; then one offset in bytes for each block; then the packed ids. A block starts at a byte, so any
block can be read alone: block b holds ids [b * block, (b + 1) * block), the id at place p of it in the bits
[p * bits, (p + 1) * bits), lowest bit first. The files tell all there is to know; a manifest only names them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.bpe import encoder, tokenizer_path, vocabulary_size
from siftline.llm.shared import blocks, keep
from siftline.session import shared_folder

MAGIC = b"SLBP0002"
BLOCK = 4096
SHARD_IDS = 4 << 20


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2 ** bits, ``bits`` bits each."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def shard_bytes(documents: list[bytes], bits: int, block: int = BLOCK, doc_ids: list[int | None] | None = None, part: int = 0, shard: int = 0) -> bytes:
    """A shard of documents given as little-endian 32-bit ids."""
    doc_ids = [None] * len(documents) if doc_ids is None else doc_ids
    ids = np.frombuffer(b"".join(documents), "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    sizes = np.fromiter((len(d) // 4 for d in documents), np.int64, len(documents))
    packed = [pack(ids[at: at + block], bits) for at in range(0, len(ids), block)]
    places = np.cumsum([0, *map(len, packed)])[: len(packed)]
    head = np.array([bits, block, len(documents), len(ids), part, shard], "<i8").tobytes()
    names = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is not None for d in doc_ids], np.uint8).tobytes()
    return b"".join([MAGIC, head, names, np.r_[0, np.cumsum(sizes)].astype("<i8").tobytes(), places.astype("<i8").tobytes(), *packed])


class Shard:
    """Random access to an open shard file: only the blocks that hold the wanted ids are read."""

    def __init__(self, file) -> None:
        self.file = file
        if file.read(8) != MAGIC:
            raise ValueError("not a shard")
        self.bits, self.block, self.documents, self.ids, self.part, self.shard = (int(x) for x in np.frombuffer(file.read(48), "<i8"))
        names = np.frombuffer(file.read(8 * self.documents), "<i8")
        self.doc_ids = pa.array(names, pa.int64(), mask=np.frombuffer(file.read(self.documents), np.uint8) == 0)
        self.offsets = np.frombuffer(file.read(8 * (self.documents + 1)), "<i8")
        n = -(-self.ids // self.block)
        self.places = np.frombuffer(file.read(8 * n), "<i8")
        self.base = 56 + 9 * self.documents + 8 * (self.documents + 1 + n)

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end) of the shard."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        self.file.seek(self.base + int(self.places[first]))
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.ids - b * self.block)
            parts.append(unpack(self.file.read(-(-n * self.bits // 8)), self.bits, n))
        return np.concatenate(parts)[start - first * self.block: end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.offsets[i]), int(self.offsets[i + 1]))


def _filesystem(folder: str):
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def shard_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 1,
                 shard_ids: int = SHARD_IDS, partitions: int | None = None) -> DataFrame:
    """Encode whole ``docs`` (doc_id, text; null text is empty), append ``end_id`` to each document and write the
    ids below ``folder`` in ascending order of doc_id (null ids first, ties by text).

    Returns the manifest, one row per file in the order of the ids: path, part, shard, documents, ids, start (ids in
    all files before it). A file gets a new name at every attempt and only the manifest of the attempts that
    succeeded counts, so a lost executor leaves at most files that nothing reads. Ties of one id (a third of all
    rows, say) are spread over tasks by their text, and equal rows by a random number. An empty table gives no file.
    """
    bits = max(1, (max(vocabulary_size(tokenizer), (end_id or 0) + 1) - 1).bit_length())
    tail = np.array([] if end_id is None else [end_id], "<u4").tobytes()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        part, shard, size, rows, ids = TaskContext.get().partitionId(), 0, 0, [], []

        def flush() -> pa.RecordBatch:
            path = f"{root}/{part:07d}-{shard:05d}-{uuid.uuid4().hex}.slbp"
            with system.open_output_stream(path) as out:
                out.write(shard_bytes(rows, bits, doc_ids=ids, part=part, shard=shard))
            return pa.RecordBatch.from_pydict(
                {"path": [path], "part": pa.array([part], pa.int64()), "shard": pa.array([shard], pa.int64()),
                 "documents": pa.array([len(rows)], pa.int64()), "ids": pa.array([size // 4], pa.int64())})

        for block in blocks(batches, "text", 8 << 20):
            flat, offsets = encoder(tokenizer).encode(block.column("text"))
            for doc_id, low, high in zip(block.column("doc_id").to_pylist(), offsets[:-1], offsets[1:]):
                rows.append(flat[low:high].tobytes() + tail)
                ids.append(doc_id)
                size += len(rows[-1])
                if size >= 4 * shard_ids:
                    yield flush()
                    shard, size, rows, ids = shard + 1, 0, [], []
        if rows:
            yield flush()

    spark = docs.sparkSession
    n = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tied = F.xxhash64("text")
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
               .repartitionByRange(n, F.col("doc_id"), tied, F.rand(7)).sortWithinPartitions("doc_id", tied))
    written = keep(ordered.mapInArrow(write, "path string, part long, shard long, documents long, ids long"))
    return _placed(written)


def _placed(files: DataFrame) -> DataFrame:
    """``files`` (part, shard, ids, ...) with start, the ids in all files before."""
    totals = files.groupBy("part").agg(F.sum("ids").alias("part_ids"))
    before = totals.select("part", (F.sum("part_ids").over(Window.orderBy("part")) - F.col("part_ids")).alias("part_start"))
    within = Window.partitionBy("part").orderBy("shard")
    return files.join(before, "part").withColumn("start", F.col("part_start") + F.sum("ids").over(within) - F.col("ids")).drop("part_start")


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document in the files of a manifest, of which only the paths are read; ids are
    little-endian 32-bit integers. A first pass reads the files' heads, from which follows where each file starts."""

    def heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column("path").to_pylist():
                system, path = _filesystem(name)
                with system.open_input_file(path) as file:
                    if file.read(8) != MAGIC:
                        raise ValueError("not a shard")
                    found.append([int(x) for x in np.frombuffer(file.read(48), "<i8")[3:]])
            ids, part, shard = (pa.array([x[k] for x in found], pa.int64()) for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("path"), part, shard, ids], names=["path", "part", "shard", "ids"])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = _filesystem(row["path"])
                with system.open_input_file(path) as file:
                    shard = Shard(file)
                    step = 0
                    while step < shard.documents:
                        limit = int(shard.offsets[step]) + (1 << 18)
                        stop = max(step + 1, int(np.searchsorted(shard.offsets, limit, "right")) - 1)
                        low = int(shard.offsets[step])
                        ids = shard.read(low, int(shard.offsets[stop])).astype("<u4")
                        own = [ids[int(shard.offsets[i]) - low: int(shard.offsets[i + 1]) - low].tobytes() for i in range(step, stop)]
                        yield pa.RecordBatch.from_pydict(
                            {"doc_id": shard.doc_ids.slice(step, stop - step),
                             "start": pa.array(shard.offsets[step:stop] + row["start"], pa.int64()),
                             "ids": pa.array(own, pa.binary())})
                        step = stop

    n = max(2, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    files = manifest.select("path").repartition(n, F.xxhash64("path")).mapInArrow(heads, "path string, part long, shard long, ids long")
    dealt = _placed(keep(files)).select("path", "start").repartition(n, F.xxhash64("path"))
    return dealt.mapInArrow(read, "doc_id long, start long, ids binary")


def op7_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents with end id 1, read the files back: doc_id, start, n_tokens, ids_crc32."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_shards(docs, shard_folder(spark), tokenizer_path("word_bpe_49k.json"))
    return read_documents(manifest).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
