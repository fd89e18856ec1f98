"""Records of delimited text: quoted fields may hold delimiters, quotes and line breaks.

Whether a line begins inside a quoted field depends on all lines before it. So that a file is split in parallel, a line
is taken as a function from the state in which it begins to the state in which it ends. Only lines with a quote change
anything. Their functions are composed for parts of ``PART`` lines, then the parts of a file one after another, which
gives the state at the head of each part; within a part a window does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage

PART = 200
_QUOTE = '"'


def _pieces(text: Column, mark: Column) -> Column:
    return F.split(text, F.concat(F.lit(r"\Q"), mark, F.lit(r"\E")), F.lit(-1))


def _blank(text: Column) -> Column:
    return F.trim(text) == ""


def _scan(text: Column, mark: Column, inside: bool, fields: bool) -> Column:
    """Read a text from quote to quote. The result is a struct: inside (does it end inside a quoted field) and, if
    ``fields``, done and current: the fields before the last one, and that. A quote opens a field if nothing but blanks
    stands before it, two quotes inside a field stand for one, any other quote is text."""
    text_type = "array<string>"
    start = F.struct(
        F.lit(inside).alias("inside"), F.lit(False).alias("closed"), F.lit(not inside).alias("blank"),
        F.array().cast(text_type).alias("done"), F.lit("").alias("current"))

    def step(acc: Column, x: Column) -> Column:
        part, last = x["part"], x["last"]
        pieces = _pieces(part, mark)
        many = F.size(pieces) > 1
        tail = F.element_at(pieces, -1)
        # the text before this quote, read outside a quoted field
        again = ~acc["inside"] & acc["closed"] & (part == "") & ~last
        blank = F.when(many, _blank(tail)).otherwise(acc["blank"] & ~acc["closed"] & _blank(part))
        opens = ~acc["inside"] & ~again & blank & ~last
        plain = ~acc["inside"] & ~again & ~opens & ~last
        joined = F.concat(acc["current"], F.element_at(pieces, 1))
        done = acc["done"] if not fields else F.when(acc["inside"] | ~many, acc["done"]).otherwise(
            F.concat(acc["done"], F.array(joined), F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))))
        text_now = F.when(acc["inside"] | ~many, F.concat(acc["current"], part)).otherwise(tail)
        current = F.lit("") if not fields else (
            F.when(again, F.concat(acc["current"], F.lit(_QUOTE))).when(opens, F.lit("")).when(plain, F.concat(text_now, F.lit(_QUOTE))).otherwise(text_now))
        return F.struct(
            F.when(last, acc["inside"]).otherwise(again | opens).alias("inside"),
            (acc["inside"] & ~last).alias("closed"), F.when(last, acc["blank"]).otherwise(F.lit(False)).alias("blank"), done.alias("done"), current.alias("current"))

    parts = F.split(text, _QUOTE, -1)
    marked = F.transform(parts, lambda p, i: F.struct(p.alias("part"), (i == F.size(parts) - 1).alias("last")))
    return F.aggregate(marked, start, step)


def fields(text: Column, mark: Column) -> Column:
    """The fields of a whole record. Without a quote this is a split."""
    read = _scan(text, mark, False, True)
    return F.when(F.contains(text, F.lit(_QUOTE)), F.concat(read["done"], F.array(read["current"]))).otherwise(_pieces(text, mark))


def _composed(states: Column, inside: Column) -> Column:
    return F.aggregate(states, inside, lambda now, s: F.when(now, s["inner"]).otherwise(s["outer"]))


def records(lines: DataFrame, votes: DataFrame, part: int = PART) -> DataFrame:
    """lines (doc, pos, text) -> doc, pos (of the first line), text, mark: a row for each record, its lines joined by line
    feeds. A field that is never closed goes on to the end of the text."""
    rows = lines.join(votes, "doc")
    quoted = rows.filter(F.contains("text", F.lit(_QUOTE))).select(
        "doc", "pos", F.floor(F.col("pos") / part).alias("part"),
        _scan(F.col("text"), F.col("mark"), False, False)["inside"].alias("outer"), _scan(F.col("text"), F.col("mark"), True, False)["inside"].alias("inner"))
    quoted = cut_lineage(quoted)
    # texts in which no line ends inside a field have a record for each line
    broken = quoted.filter("outer").select("doc").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("pos", "outer", "inner")))
    parts = quoted.join(broken, "doc", "left_semi").groupBy("doc", "part").agg(ordered.alias("s")).select(
        "doc", "part", _composed(F.col("s"), F.lit(False)).alias("outer"), _composed(F.col("s"), F.lit(True)).alias("inner"))
    # the state at the head of each part, of those that have quotes
    listed = parts.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("part", "outer", "inner"))).alias("p"))
    heads = F.aggregate(
        "p", F.struct(F.lit(False).alias("now"), F.array().cast("array<struct<part:bigint,after:boolean>>").alias("out")),
        lambda a, s: F.struct(
            F.when(a["now"], s["inner"]).otherwise(s["outer"]).alias("now"),
            F.concat(a["out"], F.array(F.struct(s["part"].alias("part"), F.when(a["now"], s["inner"]).otherwise(s["outer"]).alias("after")))).alias("out")))
    after = listed.select("doc", F.explode(heads["out"]).alias("h")).select("doc", F.col("h.part").alias("part"), F.col("h.after").alias("after"))
    split = cut_lineage(rows.join(broken, "doc", "left_semi").withColumn("part", F.floor(F.col("pos") / part)))
    every = split.groupBy("doc", "part").agg(F.count(F.lit(1)).alias("n")).join(after, ["doc", "part"], "left")
    by_doc = W.partitionBy("doc").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    begin = every.select("doc", "part", F.coalesce(F.last("after", True).over(by_doc), F.lit(False)).alias("begins"))
    in_part = W.partitionBy("doc", "part").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    # inside a part a line's function is known, so its end follows from the lines before it
    own = split.join(quoted.select("doc", "pos", "outer", "inner"), ["doc", "pos"], "left").join(begin, ["doc", "part"])
    so_far = F.collect_list(F.when(F.col("outer").isNotNull(), F.struct("outer", "inner"))).over(in_part)
    stated = own.withColumn("inside", _composed(so_far, F.col("begins")))
    first = F.max(F.when(~F.col("inside"), F.col("pos")))
    carried = stated.groupBy("doc", "part").agg(first.alias("f")).select("doc", "part", F.last("f", True).over(by_doc).alias("carried"))
    upto = W.partitionBy("doc", "part").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    numbered = stated.withColumn("own", F.max(F.when(~F.col("inside"), F.col("pos"))).over(upto)).join(carried, ["doc", "part"]).withColumn(
        "record", F.coalesce("own", "carried"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "\n")
    joined = numbered.groupBy("doc", F.col("record").alias("pos"), "mark").agg(text.alias("text"))
    alone = rows.join(broken, "doc", "left_anti")
    return alone.select("doc", "pos", "text", "mark").unionByName(joined.select("doc", "pos", "text", "mark"))


def cells(lines: DataFrame, votes: DataFrame, part: int = PART) -> DataFrame:
    """The cells (doc, sheet, row, col, value, type) of delimited text."""
    found = records(lines, votes, part)
    return found.select("doc", F.lit("").alias("sheet"), F.col("pos").cast("long").alias("row"), F.posexplode(fields(F.col("text"), F.col("mark"))).alias("col", "value")).select(
        "doc", "sheet", "row", (F.col("col") + 1).alias("col"), "value", F.lit("string").alias("type"))
