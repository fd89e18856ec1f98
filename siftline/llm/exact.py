"""Exact duplicates by deterministic block naming, in DataFrame functions only.

A text, with A to Z in lower case, is cut into blocks of ``BLOCK`` bytes. The different blocks of the corpus are sorted
and numbered; the number is the name of a block. Then adjacent names of a document are paired, the different pairs are
sorted and numbered in the same way, and so on until each document has one name: two texts are equal if and only if
they end in the same level with the same name.

How the names are given: copies of a block are merged in the map tasks, what is left is dealt out by hash, sorted in
each part and numbered (part number, place in the part). Block contents are shuffled once, for that; a document carries
two 64-bit hashes of each block instead and gets the names by them. That is exact since it is verified: if two
different blocks of the corpus have the same two hashes, all starts anew with other hashes. From the first level on
there are pairs of integers only, half as many with each level. A name that very many blocks have makes a long run of
equal keys only in joins, where adaptive execution splits it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.shared import keep

BLOCK = 1024
#: Hashes tried before the work is given up; a second try is needed about once in 10^16 corpora of 100 TB.
TRIES = 8
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: str) -> Column:
    """``text`` with A to Z in lower case and nothing else changed; null is empty. Spark's ``lower`` does just that to
    texts of ASCII characters, and faster."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.when(F.length(whole) == F.octet_length(whole), F.lower(whole)).otherwise(F.translate(whole, _UPPER, _UPPER.lower()))


def block_hashes(content: Column, attempt: int) -> Column:
    """Two 64-bit hashes of a block, others for each attempt."""
    return F.struct(F.xxhash64(content, F.lit(2 * attempt)).alias("h1"), F.xxhash64(content, F.lit(2 * attempt + 1)).alias("h2"))


def _blocks(docs: DataFrame, size: int) -> DataFrame:
    """row_no, doc_id, text (all bytes, normalised), n, place and content for every block of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised("text").cast("binary").alias("text"))
    rows = texts.select("*", F.greatest(F.ceil(F.octet_length("text") / size), F.lit(1)).cast("int").alias("n"), F.monotonically_increasing_id().alias("row_no"))
    # an outer explode, as Spark would test the size of the array of an inner one, and read each text once more for it
    every = rows.select("*", F.explode_outer(F.sequence(F.lit(0), F.col("n") - 1)).alias("place"))
    return every.withColumn("content", F.substring("text", F.col("place") * size + 1, F.lit(size)))


def _numbered(distinct: DataFrame, *order: str) -> DataFrame:
    """``distinct`` with a number ``name`` for each row. Sorted, so a part that is computed again gives the same."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _first_names(docs: DataFrame, size: int, hashes: Callable[[Column, int], Column], tries: int) -> tuple[DataFrame, DataFrame]:
    """(row_no, doc_id, text_sha256) of every row, and (row_no, n, place, name) of every block."""
    blocks = _blocks(docs, size)
    for attempt in range(tries):
        key = hashes(F.col("content"), attempt)
        # written once, so a row keeps its number
        rows = keep(blocks.select("row_no", "doc_id", F.when(F.col("place") == 0, F.sha2("text", 256)).alias("text_sha256"), "n", "place", key.alias("key")))
        names = keep(_numbered(blocks.select("content").distinct(), "content").select(key.alias("key"), "name"))
        if names.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").isEmpty():
            return rows.where("place = 0").select("row_no", "doc_id", "text_sha256"), rows.join(names, "key").select("row_no", "n", "place", "name")
    raise RuntimeError(f"no collision-free hashes in {tries} tries")


def identities(docs: DataFrame, size: int = BLOCK, hashes: Callable[[Column, int], Column] = block_hashes, tries: int = TRIES) -> DataFrame:
    """row_no (a number of the row), doc_id, text_sha256 (lower-case hex, of the normalised text), level and name of
    every row of ``docs`` (doc_id, text): texts are equal if and only if level and name are.

    Null and empty texts are equal. Repeated rows and null ids each get their row; other columns are not read; an
    empty table gives none. There are as many levels as the longest text halves down to a block.
    """
    rows, current = _first_names(docs, size, hashes, tries)
    current, level, done = keep(current), 0, []
    while True:
        done.append(current.where("n = 1").select("row_no", F.lit(level).alias("level"), "name"))
        rest = current.where("n > 1")
        if rest.isEmpty():
            break
        even = F.col("place") % 2 == 0
        # the last name of an odd number has no partner
        pairs = rest.groupBy("row_no", "n", F.floor(F.col("place") / 2).cast("int").alias("half")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1).cast("long")).alias("b"))
        names = keep(_numbered(pairs.select("a", "b").distinct(), "a", "b"))
        current = keep(pairs.join(names, ["a", "b"]).select("row_no", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.col("half").alias("place"), "name"))
        level += 1
    return rows.join(functools.reduce(DataFrame.unionAll, done), "row_no")


def exact_duplicates(docs: DataFrame, size: int = BLOCK, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs`` (doc_id, text).

    Of equal texts the row with the largest doc_id stays (a null id counts as smaller than any); of rows equal in id
    and text one stays. See ``identities`` for nulls and other cases.
    """
    members = keep(identities(docs, size, **options))
    # written, so that the join deals out both sides itself and a very large group can be split
    groups = keep(members.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row_no")).alias("best"), F.count("*").alias("group_size")))
    return members.join(groups, ["level", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.row_no") == F.col("row_no")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, size: int = BLOCK, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stay = exact_duplicates(docs, size, **options).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("key"))
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), F.sha2(normalised("text").cast("binary"), 256).alias("sha"))
    met = own.join(stay, F.col("doc").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("key")))
    # only rows with a twin of the same id and text are dealt out by it; of those one is left
    twins = own.groupBy("doc", "sha").agg(F.count("*").alias("times")).where("times > 1").select(F.col("doc").alias("twin_doc"), F.col("sha").alias("twin_sha"))
    marked = met.join(twins, F.col("doc").eqNullSafe(F.col("twin_doc")) & (F.col("sha") == F.col("twin_sha")), "left")
    once = marked.where("twin_sha is null").select("row")
    first = marked.where("twin_sha is not null").groupBy("doc", "sha").agg(F.first("row").alias("row")).select("row")
    return once.unionAll(first).select("row.*")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and fate of every document among its exact copies."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = f"""
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS x FROM documents),
groups AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM texts JOIN groups USING (x)
"""
