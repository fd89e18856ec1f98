"""Sections from pages, styled paragraphs and headed text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from .ranking import ordinal, running_total


def page_sections(pages: DataFrame) -> DataFrame:
    """pages (document_id, page, text) -> one section per page that has text."""
    body = tx.clean_text(F.col("text"))
    return pages.select(
        "document_id", F.col("page").alias("section_order"),
        F.concat(F.lit("Page "), F.col("page").cast("string")).alias("title"), body.alias("text"),
        F.col("page").alias("page_from"), F.col("page").alias("page_to"),
    ).filter(F.col("text") != "")


def pages_without_text(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """A warning for every document that gave no section."""
    return documents.select("document_id").join(sections, "document_id", "left_anti").withColumn(
        "warning", F.lit("No extractable text found. Scanned PDF/OCR is not supported in MVP."))


def headed_sections(lines: DataFrame, default_title: str, title: Column | None = None) -> DataFrame:
    """lines (document_id, pos, text, is_heading) -> sections.

    A heading closes the section before it. Sections without text are dropped and the
    rest is numbered from 1. The running count of headings is bucketed, so a document of
    any length is spread over tasks.
    """
    numbered = running_total(lines, ["document_id"], "pos", F.col("is_heading").cast("int"), "island")
    named = F.max_by(F.when(F.col("is_heading"), F.col("text") if title is None else title),
                     F.when(F.col("is_heading"), F.col("pos")))
    body = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("pos", "text")))),
            lambda s: s["text"]),
        "\n")
    grouped = numbered.groupBy("document_id", "island").agg(
        F.coalesce(named, F.lit(default_title)).alias("title"), tx.clean_text(body).alias("text"))
    kept = grouped.filter(F.col("text") != "")
    return ordinal(kept, ["document_id"], "island", "section_order").select(
        "document_id", "section_order", "title", "text")


def paragraph_sections(paragraphs: DataFrame) -> DataFrame:
    """paragraphs (document_id, pos, style, text); styles that start with 'heading' open sections."""
    clean = paragraphs.withColumn("text", tx.clean_text(F.col("text"))).filter(F.col("text") != "")
    heading = F.lower(tx.text_or_empty(F.col("style"))).startswith("heading")
    return headed_sections(clean.select("document_id", "pos", "text", heading.alias("is_heading")), "Document")


def looks_like_heading(line: Column) -> Column:
    """A '#' line, a numbered line, or up to ten words without a final stop, half of
    which start with a capital."""
    # The line is stripped, so its words are one more than its gaps.
    count = F.regexp_count(line, F.lit(rf"{tx.SPACE}+")) + 1
    capitals = F.regexp_count(line, F.lit(rf"(?:^|{tx.SPACE})\p{{Lu}}"))
    wordy = (~line.endswith(".")) & (count <= 10) & (capitals >= F.greatest(F.lit(1), F.floor(count / 2)))
    return (line != "") & (F.length(line) <= 120) & (
        line.startswith("#") | line.rlike(r"^\d+(\.\d+)*\s+\S+") | wordy)


def text_sections(documents: DataFrame) -> DataFrame:
    """documents (document_id, text) -> sections.

    A document is one row, so nothing is shuffled: heading lines are marked inside the
    text, the marked text is split at the marks, and what remains is exploded.
    """
    mark, end = "\x01", "\x02"
    clean = F.translate(tx.clean_text(F.col("text")), mark + end, "")

    def marked(line):
        title = tx.strip(F.regexp_replace(line, r"^#+", ""))
        return F.when(looks_like_heading(line), F.concat(F.lit(mark), title, F.lit(end))).otherwise(line)

    lines = F.transform(F.split(clean, tx.LINE_END), lambda line: tx.let(tx.strip(line), marked))
    pieces = F.split(F.array_join(lines, "\n"), mark)

    def section(piece):
        cut = F.instr(piece, end)
        return F.struct(
            F.when(cut > 0, F.substring(piece, F.lit(1), cut - 1)).otherwise("Text").alias("title"),
            tx.clean_text(F.substring(piece, cut + 1, F.length(piece))).alias("text"))

    kept = F.filter(F.transform(pieces, section), lambda s: s["text"] != "")
    return documents.select("document_id", F.posexplode(kept).alias("_i", "s")).select(
        "document_id", (F.col("_i") + 1).cast("long").alias("section_order"), "s.title", "s.text")
