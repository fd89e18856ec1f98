"""From the sources of a project to passages that ``retrieve`` takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..operators import chunks
from ..operators.ranking import ordinal

#: Bits of a passage number for the source in its project and for the passage in its source.
SOURCE_BITS, CHUNK_BITS = 24, 20


def project_sources(manual: DataFrame | None = None, documents: DataFrame | None = None, library: DataFrame | None = None) -> DataFrame:
    """project_id, source_kind, source_id, source_key, place, title, content of everything a
    project may cite: manual sources (project_id, source_id, position, title, content), then
    parsed documents (project_id, document_id, position, title, raw_text, parse_status),
    then library rows (project_id, source_id, position, title, content)."""
    parts = []
    for order, (kind, rows) in enumerate((("source", manual), ("document", documents), ("library", library))):
        if rows is None:
            continue
        if kind == "document":
            rows = rows.where("parse_status = 'parsed'").withColumnRenamed("document_id", "source_id").withColumn("content", F.col("raw_text"))
        parts.append(rows.select(
            F.col("project_id").cast("long").alias("project_id"), F.lit(kind).alias("source_kind"), F.col("source_id").cast("string").alias("source_id"),
            F.concat_ws(":", F.lit(kind), F.col("source_id").cast("string")).alias("source_key"),
            (F.lit(order << 40) + F.col("position").cast("long")).alias("place"),
            tx.text_or_empty(F.col("title")).alias("title"), tx.text_or_empty(F.col("content")).alias("content")))
    if not parts:
        raise ValueError("no sources given")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def project_passages(sources: DataFrame, document_chunks: DataFrame) -> DataFrame:
    """corpus (the project), pid, source_key, chunk, text, page_ref, section_title of
    ``project_sources`` with the chunks (document_id, chunk_index, section_title, page_ref,
    text) of parsed documents. A pid holds project, source and chunk, so it is unique and
    sorts like the project's list of sources; a project id from 2^19 on, or more than 2^24
    sources or 2^20 chunks of a source, end the job with an error. A document whose content
    and chunks are blank yields nothing."""
    kept = sources.where((F.col("source_kind") != "document") | (F.trim("content") != "")).unionByName(
        sources.where((F.col("source_kind") == "document") & (F.trim("content") == "")).join(
            document_chunks.select(F.col("document_id").cast("string").alias("source_id")).distinct(), "source_id", "left_semi"))
    numbered = ordinal(kept, ["project_id"], "place", "_n", width=1 << 40)
    own = document_chunks.withColumn("document_id", F.col("document_id").cast("string"))
    # a document can belong to one project only, so kind and id name a source of the others with its project
    keyed = numbered.withColumn("_key", F.when(F.col("source_kind") == "document", F.col("source_id")).otherwise(
        F.concat_ws("/", F.col("project_id").cast("string"), "source_id")))
    passages = chunks.assemble_passages(keyed.select("source_kind", F.col("_key").alias("source_id"), "title", "content"), own)
    back = keyed.select("source_kind", F.col("_key").alias("source_id"), "project_id", "source_key", "_n")
    # a number that does not fit would be another passage's
    fits = F.col("project_id").between(0, (1 << (63 - SOURCE_BITS - CHUNK_BITS)) - 1) & (F.col("_n") < 1 << SOURCE_BITS) & (F.col("chunk") < 1 << CHUNK_BITS)
    number = F.shiftleft(F.col("project_id"), SOURCE_BITS + CHUNK_BITS) + F.shiftleft(F.col("_n"), CHUNK_BITS) + F.col("chunk")
    error = F.raise_error(F.concat(F.lit("no passage number for project "), F.col("project_id").cast("string"))).cast("long")
    pid = F.when(fits, number).otherwise(error)
    return passages.join(back, ["source_kind", "source_id"]).select(
        F.col("project_id").alias("corpus"), pid.alias("pid"), "source_key", "chunk", "text", "page_ref", "section_title")
