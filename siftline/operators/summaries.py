"""Document metadata and the sampled text that stands for a whole document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from .ranking import first_row, ordinal


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def enrich(text: Column, title: Column | None = None, authors: Column | None = None,
           source_type: Column | None = None, keywords: Column | None = None,
           organization: Column | None = None, year_values: tuple[Column, ...] = ()) -> Column:
    """Metadata struct; what is not given is derived from the text."""
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    names = empty if authors is None else F.filter(F.transform(authors, tx.strip), lambda x: x != "")
    return F.struct(
        F.coalesce(_some(title) if title is not None else none, tx.first_meaningful_line(text)).alias("title"),
        names.alias("authors"),
        tx.extract_year(*year_values, text).alias("year"),
        (source_type if source_type is not None else none).alias("source_type"),
        tx.detect_language(text).alias("language"),
        (tx.split_names(keywords) if keywords is not None else empty).alias("keywords"),
        (organization if organization is not None else none).alias("organization"),
        tx.references(text).alias("references"),
    )


def summary_with_fallbacks(text: Column, titles: Column, is_dataset: Column, sheets: Column,
                           table_count: Column, chunk_count: Column, first_section: Column,
                           table_blocks: Column) -> Column:
    """Sentences of the text; else a description of a data file; else the first section;
    else the first table block that says more than the title."""
    details = F.concat_ws(
        ", ",
        F.when(F.size(sheets) > 0, F.concat(F.lit("листы: "), F.array_join(F.slice(sheets, 1, 3), ", "))),
        F.when(table_count > 0, F.concat(F.lit("таблиц: "), table_count.cast("string"))),
        F.when(chunk_count > 0, F.concat(F.lit("фрагментов: "), chunk_count.cast("string"))))
    prefix = "Табличный файл с извлечёнными данными"
    dataset = F.when(is_dataset, tx.trim_at_word(
        F.when(details != "", F.concat(F.lit(prefix + "; "), details, F.lit("."))).otherwise(F.lit(prefix))))

    def good(fragment):
        return F.when(fragment.isNotNull() & ~tx.title_only(fragment, titles), tx.trim_at_word(fragment))

    blocks = F.filter(F.transform(table_blocks, lambda b: good(tx.summary_fragment(b))), lambda b: b.isNotNull())
    return F.coalesce(tx.heuristic_summary(text, titles), dataset,
                      good(tx.summary_fragment(first_section)), F.get(blocks, F.lit(0)))


def summary_blocks(parts: DataFrame, key_chars: int | None = None) -> DataFrame:
    """parts (document_id, pos, title, text) -> distinct blocks, numbered from 1.

    A block gets its title in front unless its first 220 characters hold it already; two
    blocks with the same letters and digits (of their first ``key_chars`` characters, if
    the caller says so) count once.
    """
    body = tx.collapse(F.col("text"))
    letters = F.length(F.regexp_replace(body, r"[^\p{L}]", ""))
    title = tx.collapse(F.col("title"))
    opening = tx.summary_key(F.substring(body, 1, 220))
    block = F.when((title != "") & ~opening.contains(tx.summary_key(title)),
                   tx.collapse(F.concat_ws(" ", title, body))).otherwise(body)
    blocks = parts.filter((F.length(body) >= 40) | (letters >= 12)).select(
        "document_id", "pos", block.alias("block"))
    keyed = blocks.withColumn("_key", tx.summary_key(F.col("block") if key_chars is None else F.substring("block", 1, key_chars))).filter(F.col("_key") != "")
    unique = first_row(keyed, ["document_id", "_key"], [F.col("pos")]).drop("_key")
    return ordinal(unique, ["document_id"], "pos", "number")


def sample_text(blocks: DataFrame, limit: int = 18000) -> DataFrame:
    """The first two, the middle and the last two blocks within a character budget.

    At most five blocks per document are collected; each may use an equal share of what
    is left, between 180 and 900 characters.
    """
    size = blocks.groupBy("document_id").agg(F.count(F.lit(1)).alias("_n"))
    n, i = F.col("_n"), F.col("number")
    chosen = (n <= 5) | i.isin(1, 2) | (i == F.floor(n / 2) + 1) | (i >= n - 1)
    picked = (
        blocks.join(size, "document_id").filter(chosen).groupBy("document_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "block"))), lambda s: s["block"]).alias("b"))
    )
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.size("b").alias("slots"),
                     F.lit(False).alias("full"))

    def add(state, block):
        left = F.lit(limit) - state["used"]
        full = state["full"] | (left < 120)
        share = F.least(F.lit(900), F.greatest(F.lit(180), F.floor(left / state["slots"]).cast("int")))

        def grown(piece):
            text = F.when(state["text"] == "", piece).otherwise(F.concat(state["text"], F.lit("\n\n"), piece))
            return F.struct(
                F.when(full, state["text"]).otherwise(text).alias("text"),
                F.when(full, state["used"]).otherwise(state["used"] + F.length(piece) + 2).alias("used"),
                F.when(full, state["slots"]).otherwise(F.greatest(state["slots"] - 1, F.lit(1))).alias("slots"),
                full.alias("full"))

        return tx.let(tx.head_tail(block, share), grown)

    return picked.select("document_id", F.aggregate("b", start, add)["text"].alias("sample"))
