"""Records that arrive in batches are added to a catalogue without duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import catalog

CATALOGUE = "project_id long, source_id long, title string, year int, reference string, content string"


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue so far. Batches are folders; a replayed batch replaces its own folder."""
    try:
        return spark.read.schema(CATALOGUE + ", batch long").parquet(path)
    except Exception as error:  # the first batch finds no folder
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], CATALOGUE + ", batch long")


def start(spark: SparkSession, records: DataFrame, path: str, checkpoint: str, max_import: int | None = None) -> StreamingQuery:
    """``records``: a stream of project_id, pos, title, year, reference, content."""
    def step(batch: DataFrame, number: int) -> None:
        known = read_catalogue(spark, path).filter(F.col("batch") != number)
        fresh = catalog.select_imports(batch, known, max_import)
        # Unique within a project without a counter shared by tasks.
        new_id = F.shiftleft(F.lit(number).cast("long"), 32) + F.col("import_rank")
        rows = fresh.select("project_id", new_id.alias("source_id"), "title", F.col("year").cast("int").alias("year"), "reference", "content")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
