"""Token counts of sections, from one encoding of the whole document.

Sections are character ranges of a text. Every token of the whole text has a character span; spans and sections are
joined by overlap, and a token that crosses a boundary goes to one section by ``rule``:

* ``largest``: the section that holds most of its characters, the earlier one if equal;
* ``first``: the section that holds the first of its characters that lies in any section;
* ``last``: likewise the last.

A token of which no character is in a section counts under the null section.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.bpe import encoder, tokenizer_path
from siftline.llm.shared import blocks, joined_bytes, ragged

RULES = ("largest", "first", "last")
FIELD = 500
_SCHEMA = "doc_id long, section long, section_start long, section_end long, n_tokens long, doc_tokens long"


def line_ranges(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of all lines in the characters of all texts one after another, and the n + 1 offsets of the texts in the
    lines. A line holds its line feed and never goes on in the next text."""
    data, offsets = joined_bytes(texts)
    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    ends = np.union1d(np.flatnonzero(data == 10) + 1, offsets[1:])
    ends = ends[ends > 0]
    return chars[np.stack([np.r_[0, ends[:-1]], ends], axis=1)] if len(ends) else np.zeros((0, 2), np.int64), np.searchsorted(ends, offsets, "right")


def field_ranges(chars: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of ``width`` characters (the last of a text may be shorter) in the characters of all texts one after
    another, and the n + 1 offsets of the texts in them; ``chars``: the n + 1 offsets of the texts in the characters."""
    counts = -(-np.diff(chars) // width)
    start = np.repeat(chars[:-1], counts) + width * ragged(np.zeros(len(counts), np.int64), counts)
    return np.stack([start, np.minimum(start + width, np.repeat(chars[1:], counts))], axis=1), np.r_[0, np.cumsum(counts)].astype(np.int64)


def attribute(start: np.ndarray, end: np.ndarray, sections: np.ndarray, rule: str = "largest") -> np.ndarray:
    """The section (row of ``sections``: disjoint ranges in order) of each token span, -1 for none."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if not len(sections) or not len(start):
        return np.full(len(start), -1, np.int64)
    low = np.searchsorted(sections[:, 1], start, "right")
    high = np.searchsorted(sections[:, 0], end, "left") - 1
    out = np.where(low <= high, low if rule != "last" else high, -1)
    if rule == "largest":
        crossing = np.flatnonzero(high > low)
        token = np.repeat(crossing, high[crossing] - low[crossing] + 1)
        section = ragged(low[crossing], high[crossing] - low[crossing] + 1)
        shared = np.minimum(end[token], sections[section, 1]) - np.maximum(start[token], sections[section, 0])
        order = np.lexsort((section, -shared, token))
        first = order[np.r_[True, token[order][1:] != token[order][:-1]]] if len(order) else order
        out[token[first]] = section[first]
    return out


def section_token_counts(docs: DataFrame, tokenizer: str, rule: str = "largest", width: int | None = None) -> DataFrame:
    """Tokens of each section of each document: doc_id, section (from 0), section_start, section_end, n_tokens,
    doc_tokens. ``docs`` has doc_id, text and, if wanted, ``sections`` (array of structs of start and end, disjoint
    character ranges of the text); without it the sections are the lines, or fields of ``width`` characters, if that is
    given. Edges of fields fall anywhere, also inside words, and there the rule decides.

    Sections without tokens have 0; characters outside all sections give a row with null section if they hold tokens.
    Null and empty texts without sections give no row. Repeated rows count each for themselves; other columns are
    not read. Nothing is shuffled and each text is encoded once.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    given = "sections" in docs.columns and width is None

    def ranges_of(block: pa.RecordBatch, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if width is not None:
            return field_ranges(chars, width)
        if not given:
            return line_ranges(block.column("text"))
        own = [sorted((x["start"] + at, x["end"] + at) for x in row or [] if x) for row, at in zip(block.column("sections").to_pylist(), chars.tolist())]
        return np.array([x for row in own for x in row], np.int64).reshape(-1, 2), np.r_[0, np.cumsum([len(row) for row in own])].astype(np.int64)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 8 << 20):
            start, end, tokens, chars = encoder(tokenizer).encode_spans(block.column("text"))
            ranges, sections = ranges_of(block, chars)
            place = attribute(start, end, ranges, rule)
            counts = np.bincount(place[place >= 0], minlength=len(ranges))
            owner = np.repeat(np.arange(len(block)), np.diff(tokens))
            stray = np.bincount(owner[place < 0], minlength=len(block))
            whole = np.diff(tokens)
            of_section = np.repeat(np.arange(len(block)), np.diff(sections))
            rest = np.flatnonzero(stray)
            ids, none = block.column("doc_id"), pa.nulls(len(rest), pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([ids.take(pa.array(of_section)), ids.take(pa.array(rest))]),
                pa.concat_arrays([pa.array(np.arange(len(ranges)) - sections[of_section]), none]),
                pa.concat_arrays([pa.array(ranges[:, 0] - chars[of_section]), none]),
                pa.concat_arrays([pa.array(ranges[:, 1] - chars[of_section]), none]),
                pa.array(np.r_[counts, stray[rest]]), pa.array(np.r_[whole[of_section], whole[rest]]),
            ], names=[f.split()[0] for f in _SCHEMA.split(", ")])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if given:
        columns.append(F.expr("transform(sections, x -> named_struct('start', cast(x.start as long), 'end', cast(x.end as long)))").alias("sections"))
    return docs.select(*columns).mapInArrow(count, _SCHEMA)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every field of ``FIELD`` characters of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return section_token_counts(docs, tokenizer_path("word_bpe_49k.json"), width=FIELD)
