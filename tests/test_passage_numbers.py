"""Passage numbers are unique or the job fails."""

import pytest

from siftline.plans import sources

CHUNKS = "document_id long, chunk_index int, section_title string, page_ref string, text string"


def _passages(spark, *projects):
    manual = spark.createDataFrame([(p, 7, 0, "title", "some content") for p in projects], "project_id long, source_id long, position long, title string, content string")
    return sources.project_passages(sources.project_sources(manual), spark.createDataFrame([], CHUNKS))


def test_numbers_are_unique(spark):
    pids = [r["pid"] for r in _passages(spark, 0, 1, (1 << 19) - 1).collect()]
    assert len(set(pids)) == len(pids) == 3 and min(pids) >= 0


def test_numbers_that_do_not_fit_fail(spark):
    with pytest.raises(Exception, match="no passage number for project"):
        _passages(spark, 1, (1 << 20) + 1).collect()
