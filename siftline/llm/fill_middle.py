"""Fill-in-the-middle texts by displacement scatter.

Two cuts, drawn from a hash of the document's id, part a text into prefix, middle and suffix. Most texts are then
written with a marker before each part: prefix, suffix, middle ("psm") or suffix, prefix, middle ("spm"); some stay as
they are ("plain"), among them all that contain a marker themselves.

A block of texts is one array of bytes. The cuts are found by a running count of the code points. Every part of every
text moves by one distance, so a difference array holds at each part's first byte by how much further it goes than the
part before; its cumulative sum is the displacement of every byte, and one numpy scatter writes all bytes of all outputs.
The way back needs the outputs and forms only: markers stand once in an output that is not plain, they tell where the
parts lie, and a gather with the same displacements restores the texts. Long blocks are scattered in slices, so the
displacements never need much memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.shared import blocks, joined_bytes, ragged

#: Of 100 texts so many are changed, and of 100 changed ones so many put the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
SEED = 1
# The marker before each part, and the order of the parts (0 prefix, 1 middle, 2 suffix) in each form.
MARKERS = (b"<P>", b"<M>", b"<S>")
ORDER = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
FORMS = ("plain", "psm", "spm")
PLAIN, PSM, SPM = range(3)
_MARK = len(MARKERS[0])
#: Bytes that are scattered at once.
SLICE = 1 << 20


def _marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every marker that lies in one text: byte where it begins, number of the part, number of the text."""
    at = np.flatnonzero(data[: max(len(data) - 2, 0)] == MARKERS[0][0])
    at = at[data[at + 2] == MARKERS[0][2]]
    letter = np.full(256, -1, np.int64)
    letter[[m[1] for m in MARKERS]] = range(3)
    part = letter[data[at + 1]]
    at, part = at[part >= 0], part[part >= 0]
    text = np.searchsorted(offsets, at, "right") - 1
    inside = at + _MARK <= offsets[text + 1]
    return at[inside], part[inside], text[inside]


def _moved(source: np.ndarray, target: np.ndarray, starts: np.ndarray, lengths: np.ndarray, goals: np.ndarray, back: bool) -> None:
    """Move parts of ``source`` (in order, without gaps between them) to their goals in ``target``; back: from their goals
    in ``source`` to where they lie in ``target``."""
    full = lengths > 0
    starts, goals = starts[full], goals[full]
    total = int(lengths.sum())
    step = np.diff(goals - starts, prepend=0)  # the difference array, at the parts' first bytes
    low, base = 0, 0
    for begin in range(0, total, SLICE):
        end = min(begin + SLICE, total)
        high = int(np.searchsorted(starts, end))
        shift = np.zeros(end - begin, np.int64)
        shift[starts[low:high] - begin] = step[low:high]
        shift[0] += base
        np.cumsum(shift, out=shift)
        base, low = int(shift[-1]), high
        shift += np.arange(begin, end)
        if back:
            target[begin:end] = source[shift]
        else:
            target[shift] = source[begin:end]


def _layout(form: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the parts (n, 3) of each text begin in the outputs; where the markers do; the offsets of the outputs.
    Plain texts are all prefix and have no marker."""
    marked = form != PLAIN
    size = lengths.sum(axis=1) + 3 * _MARK * marked
    offsets = np.r_[0, np.cumsum(size)]
    goals, marks = np.zeros_like(lengths), np.zeros_like(lengths)
    goals[:, 0] = offsets[:-1]
    for name, order in ORDER.items():
        own = form == FORMS.index(name)
        at = offsets[:-1][own]
        for part in order:
            marks[own, part] = at
            goals[own, part] = at + _MARK
            at = at + _MARK + lengths[own, part]
    return goals, marks, offsets


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data)])


def transform(texts: pa.Array, draws: np.ndarray) -> dict[str, np.ndarray | pa.Array]:
    """The outputs of all texts (null is empty) for four draws (unsigned 32-bit) each: n, form, prefix_chars,
    middle_chars and output."""
    data, offsets = joined_bytes(texts)
    first = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of every code point
    chars = np.searchsorted(first, offsets)
    n = np.diff(chars)
    cuts = np.sort(draws[:, :2].astype(np.int64) % (n + 1)[:, None], axis=1)
    form = np.where(draws[:, 3] % 100 < SUFFIX_FIRST, SPM, PSM)
    form[(n == 0) | (draws[:, 2] % 100 >= CHANGED)] = PLAIN
    form[_marks(data, offsets)[2]] = PLAIN
    ends = np.r_[first, len(data)]
    cut = ends[chars[:-1, None] + cuts]
    cut[form == PLAIN] = offsets[1:][form == PLAIN, None]
    edges = np.c_[offsets[:-1], cut, offsets[1:]]
    lengths = np.diff(edges, axis=1)
    goals, marks, out = _layout(form, lengths)
    target = np.empty(int(out[-1]), np.uint8)
    _moved(data, target, edges[:, :3].ravel(), lengths.ravel(), goals.ravel(), False)
    for part, marker in enumerate(MARKERS):
        target[marks[form != PLAIN, part][:, None] + np.arange(_MARK)] = np.frombuffer(marker, np.uint8)
    return {"n": n, "form": form, "prefix_chars": cuts[:, 0], "middle_chars": cuts[:, 1] - cuts[:, 0], "output": _strings(target, out)}


def restored(outputs: pa.Array, form: np.ndarray) -> pa.Array:
    """The texts that ``transform`` has changed, from its outputs and forms (numbers into ``FORMS``)."""
    data, offsets = joined_bytes(outputs)
    at, part, text = _marks(data, offsets)
    own = form[text] != PLAIN
    marks = np.zeros((len(form), 3), np.int64)
    marks[text[own], part[own]] = at[own]
    marked = form != PLAIN
    if not (np.bincount(text[own], minlength=len(form))[marked] == 3).all():
        raise ValueError("an output that is not plain has each marker once")
    goals = np.where(marked[:, None], marks + _MARK, offsets[:-1, None])
    ends = np.zeros_like(goals)
    ends[~marked, 0] = offsets[1:][~marked]
    ends[~marked, 1:] = goals[~marked, 1:]
    for name, order in ORDER.items():
        rows = form == FORMS.index(name)
        for part_, after in zip(order, [*order[1:], None]):
            ends[rows, part_] = offsets[1:][rows] if after is None else marks[rows, after]
    lengths = ends - goals
    back = np.r_[0, np.cumsum(lengths.sum(axis=1))]
    starts = np.cumsum(lengths.ravel()) - lengths.ravel()
    target = np.empty(int(back[-1]), np.uint8)
    _moved(data, target, starts, lengths.ravel(), goals.ravel(), True)
    return _strings(target, back)


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars and middle_chars (code points, null if plain) and output of every
    row of ``docs`` (doc_id, text).

    Null and empty texts stay plain and empty; a null id counts as the empty text; repeated rows each give a row;
    other columns are not read. The draws depend on the id and ``seed`` alone, so a task that runs again gives the same.
    """

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            draws = np.stack([block.column(f"draw_{k}").to_numpy() for k in range(4)], axis=1)
            found = transform(block.column("text"), draws)
            plain = found["form"] == PLAIN
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(found["n"]), pa.array(FORMS).take(pa.array(found["form"])),
                 pa.array(found["prefix_chars"], mask=plain), pa.array(found["middle_chars"], mask=plain), found["output"].cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = rows.withColumn("digest", digest).select("doc_id", "text", *[
        F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"draw_{k}") for k in range(4)])
    return rows.mapInArrow(each, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(found: DataFrame) -> DataFrame:
    """``found`` (form, output, ...) with the column text, rebuilt from form and output alone."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "output"):
            form = np.array([FORMS.index(f) for f in block.column("form").to_pylist()], np.int64)
            yield block.append_column("text", restored(block.column("output"), form).cast(pa.string()))

    return found.mapInArrow(each, found.drop("text").schema.add("text", "string"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and cuts of every document, and digests of its output and of the text rebuilt from that."""
    found = restore(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                        F.sha2(F.col("text").cast("binary"), 256).alias("restored_sha256"))


OP11_SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id) AS h FROM documents),
draws AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
  n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 AS stays,
  ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 AS suffix_first FROM texts),
parts AS (SELECT *, CASE WHEN stays THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
  substr(x, 1, least(a, b)) AS p, substr(x, least(a, b) + 1, abs(a - b)) AS m, substr(x, greatest(a, b) + 1) AS s FROM draws)
SELECT doc_id, n, form, CASE WHEN NOT stays THEN least(a, b) END AS prefix_chars, CASE WHEN NOT stays THEN abs(a - b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM parts
"""
