"""A drop folder: text and delimited files become sections, tables and chunks as they arrive or change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import catalog, chunks, grids, sections
from ..session import cut_lineage
from ..sources import files as fs, versions

_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
MANIFEST = "document_id string, modified timestamp, length long"
LOG = "document_id string, status string, warnings array<string>, error string"
#: Types whose bytes are parsed here. Pages, paragraphs and cells of other types come in as tables.
PARSED = ("txt", "csv")
#: Rows of a table that its chunk shows.
SAMPLE_ROWS = 3


def delimited_tables(decoded: DataFrame) -> DataFrame:
    """document_id, table_order, name, sheet_name, columns, row_count, sample of decoded
    delimited files (path, name, text); files without a value give no row."""
    grid = grids.trim_grid(fs.delimited_cells(decoded))
    flags = grids.header_flags(grid)
    heads = grids.headers(grid, flags)
    names = heads.groupBy("doc").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col", "header"))), lambda s: s["header"]).alias("columns"))
    rows = grids.row_maps(grid, flags, heads, cap=SAMPLE_ROWS)
    sample = rows.groupBy("doc").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("row", grids.json_row(F.col("values")).alias("json")))), lambda s: s["json"]).alias("sample"))
    none = F.array().cast("array<string>")
    return (
        decoded.select(F.col("path").alias("doc"), "name").join(flags.select("doc", "height", "has_header"), "doc")
        .join(names, "doc").join(sample, "doc", "left")
        .select(F.col("doc").alias("document_id"), F.lit(1).alias("table_order"), "name", F.lit(None).cast("string").alias("sheet_name"),
                "columns", (F.col("height") - F.col("has_header").cast("int")).cast("long").alias("row_count"),
                F.coalesce("sample", none).alias("sample")))


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, log) of files (path, name, file_type, content); used by batch and stream.
    A type that has no parser is logged ``unsupported``, never ``parsed``."""
    decoded = cut_lineage(fs.decode(files.filter(F.col("file_type").isin(*PARSED))))
    good = decoded.filter(F.col("error").isNull())
    texts = good.filter(F.col("file_type") == "txt").select(F.col("path").alias("document_id"), "text")
    tables = cut_lineage(delimited_tables(good.filter(F.col("file_type") == "csv")))
    about = tables.select(
        "document_id", F.lit(1).cast("long").alias("section_order"), F.col("name").alias("title"),
        F.format_string("CSV '%s' contains %d data rows and %d columns.", "name", "row_count", F.size("columns")).alias("text"))
    found = sections.text_sections(texts).unionByName(about).select(
        "*", F.lit(None).cast("int").alias("page_from"), F.lit(None).cast("int").alias("page_to"))
    empty = decoded.join(tables.select(F.col("document_id").alias("path"), F.lit(True).alias("_rows")), "path", "left")
    blank = (F.when((F.col("file_type") == "txt") & (F.trim("text") == ""), F.array(F.lit("TXT contains no extractable text")))
             .when((F.col("file_type") == "csv") & F.col("_rows").isNull(), F.array(F.lit("CSV contains no rows"))))
    outcome = empty.select(F.col("path").alias("document_id"), blank.alias("warnings"), "error")
    kind = F.when(F.col("file_type").isin(*PARSED), F.col("file_type")).otherwise("none")
    log = catalog.parse_log(files.select(F.col("path").alias("document_id"), kind.alias("file_type")), outcome)
    return chunks.document_chunks(found, tables), log


def apply(files: DataFrame, target: str, token: str) -> None:
    """Parse ``files`` and replace what ``target`` holds of them: also chunks of which the
    new version has none. Only these files' rows are written; see ``sources.versions``."""
    rows, log = parse_files(files)
    parsed = files.select(F.col("path").alias("document_id"))
    versions.replace(rows, parsed, f"{target}/chunks", token)
    versions.replace(log, parsed, f"{target}/log", token)


def sync(spark: SparkSession, folder: str, target: str) -> int:
    """Bring ``target`` up to date with a folder: files that are new or whose size or time
    differ from the manifest are parsed again, chunks of removed files go. Only names,
    sizes and times of the other files are read. Returns the number of files it handled."""
    listed = cut_lineage(fs.list_files(spark, folder))
    known = versions.read(spark, f"{target}/manifest", MANIFEST)
    manifest = known.withColumnRenamed("document_id", "path")
    changed = cut_lineage(fs.changed_files(listed, manifest).select("path"))
    gone = cut_lineage(fs.removed_files(listed, manifest).select(F.col("path").alias("document_id")))
    number = changed.count() + gone.count()
    if number:
        # a sync that broke off is repeated as a whole: the manifest is written last
        token = f"sync-{max((v.number for v in versions.versions(spark, f'{target}/manifest')), default=0)}"
        apply(fs.scan_files(spark, folder).join(changed, "path", "left_semi"), target, token)
        for name in ("chunks", "log"):
            versions.replace(None, gone, f"{target}/{name}", token + "-gone")
        now = listed.join(changed, "path", "left_semi").select(F.col("path").alias("document_id"), "modified", "length")
        versions.replace(now, changed.select(F.col("path").alias("document_id")).union(gone), f"{target}/manifest", token)
    return number


def compact(spark: SparkSession, target: str) -> None:
    """Write chunks, log and manifest anew as whole tables and drop what they replace. Not while a reader or writer is
    at work."""
    chunk_schema = parse_files(fs.with_names(spark.createDataFrame([], _FILE_SCHEMA)))[0].schema
    for name, schema in (("chunks", chunk_schema), ("log", LOG), ("manifest", MANIFEST)):
        versions.compact(spark, f"{target}/{name}", schema)
        versions.expire(spark, f"{target}/{name}")


def start(spark: SparkSession, folder: str, target: str, checkpoint: str, **options) -> StreamingQuery:
    """Follow ``folder`` for new files. A replayed batch leaves one copy. The file source
    knows files by path; changed ones are found by ``sync``."""
    stream = spark.readStream.format("binaryFile").schema(_FILE_SCHEMA).options(**options).load(folder)

    def step(batch: DataFrame, number: int) -> None:
        apply(fs.with_names(batch), target, f"{checkpoint}-{number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
