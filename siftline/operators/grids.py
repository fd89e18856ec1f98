"""Cell tables: (doc, sheet, row, col, value, type) in, headers and row maps out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as tx
from ..session import cut_lineage
from .ranking import BUCKET, top

_SHEET = ["doc", "sheet"]


def delimiter_votes(lines: DataFrame, marks: str = ",;|\t") -> DataFrame:
    """lines (doc, pos, text) -> doc, mark: the delimiter on most lines (then the most
    frequent one, then the first of ``marks``); a comma where none occurs. Counting is a
    map-side aggregate, so a file of any length votes in parallel."""
    votes = lines.select("doc", F.explode(F.array(*[
        F.struct(F.lit(-i).alias("prio"), F.lit(m).alias("mark"),
                 F.regexp_count("text", F.lit("[" + ("\\" + m if m == "|" else m) + "]")).alias("n"))
        for i, m in enumerate(marks)])).alias("v")).select("doc", "v.*")
    tally = votes.groupBy("doc", "prio", "mark").agg(
        F.count_if(F.col("n") > 0).alias("hit"), F.sum("n").alias("n"))
    best = tally.groupBy("doc").agg(
        F.max_by("mark", F.struct("hit", "n", "prio")).alias("mark"), F.max("hit").alias("hit"))
    return best.select("doc", F.when(F.col("hit") > 0, F.col("mark")).otherwise(",").alias("mark"))


def split_lines(lines: DataFrame, votes: DataFrame) -> DataFrame:
    """Cells of delimited lines. Delimiters between double quotes do not count, and the
    quotes of a quoted field are removed."""
    mark = F.col("mark")
    outside = F.transform(
        F.split(F.col("text"), '"'),
        lambda part, i: F.when(i % 2 == 0, F.replace(part, mark, F.lit("\x01"))).otherwise(part))
    fields = F.split(F.array_join(outside, '"'), "\x01")
    value = F.regexp_replace(F.regexp_replace("_v", r'(?s)^\s*"(.*)"\s*\z', "$1"), '""', '"')
    return (
        lines.join(votes, "doc")
        .select("doc", F.lit("").alias("sheet"), F.col("pos").cast("long").alias("row"),
                F.posexplode(fields).alias("col", "_v"))
        .select("doc", "sheet", "row", (F.col("col") + 1).alias("col"), value.alias("value"),
                F.lit("string").alias("type"))
    )


def trim_grid(cells: DataFrame, span: int = BUCKET) -> DataFrame:
    """Blank strings become null, rows without a value go, rows are renumbered from 1 and
    every sheet knows its width and height. Null cells are not stored; a missing cell
    inside the width is null.

    Cells meet once, by sheet and ``span`` positions: rows are numbered inside a part, and what
    comes before a part follows from the numbers of rows of the parts, however long a sheet is.
    """
    filled = (
        cells.withColumn("value", tx.cell_value(F.col("value")))
        .filter(F.col("value").isNotNull() & F.col("doc").isNotNull() & F.col("sheet").isNotNull())
        .withColumn("_b", F.floor(F.col("row") / span))
    )
    inside = W.partitionBy(*_SHEET, "_b").orderBy("row")
    numbered = cut_lineage(filled.withColumn("_n", F.dense_rank().over(inside)))
    parts = numbered.groupBy(*_SHEET, "_b").agg(F.max("_n").cast("long").alias("_rows"), F.max("col").alias("_w"))
    # cells without a row widen their sheet and take its first number, but are left out by the join and the height
    placed = F.when(F.col("_b").isNotNull(), F.col("_rows"))
    sheet = W.partitionBy(*_SHEET)
    before = F.sum("_rows").over(sheet.orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    sizes = parts.select(
        *_SHEET, "_b", F.coalesce(before, F.lit(0)).alias("_o"), F.max("_w").over(sheet).alias("width"), F.coalesce(F.sum(placed).over(sheet), F.lit(0)).alias("height"))
    # Header detection, naming and row building all read the grid.
    return cut_lineage(
        numbered.join(cut_lineage(sizes), [*_SHEET, "_b"])
        .withColumn("row", F.col("_n") + F.col("_o"))
        .select(*_SHEET, "row", *[c for c in cells.columns if c not in (*_SHEET, "row")], "width", "height")
    )


def header_flags(grid: DataFrame, mode: str = "guess") -> DataFrame:
    """doc, sheet, width, height, has_header. ``guess``: the first row is a header if at
    least half (rounded down, but one) of its values are strings; ``always``/``never``."""
    strings, count = F.count_if(F.col("type") == "string"), F.count(F.lit(1))
    guess = strings >= F.greatest(F.lit(1), F.floor(count / 2))
    flag = {"guess": guess, "always": F.max(F.lit(True)), "never": F.max(F.lit(False))}[mode]
    # written, so that who joins the cells with them knows their size before the cells are read
    return cut_lineage(grid.filter(F.col("row") == 1).groupBy(*_SHEET).agg(
        F.max("width").alias("width"), F.max("height").alias("height"), flag.alias("has_header")))


def headers(grid: DataFrame, flags: DataFrame) -> DataFrame:
    """doc, sheet, col, header. Unnamed columns are 'Column i'; the k-th repeat of a name
    (any case) becomes 'name k'. Windows run over the columns of one sheet only."""
    first = grid.filter(F.col("row") == 1).select(*_SHEET, "col", "value")
    slots = flags.select(*_SHEET, "has_header", F.explode(F.sequence(F.lit(1), F.col("width"))).alias("col"))
    plain = F.concat(F.lit("Column "), F.col("col").cast("string"))
    name = F.when(F.col("has_header"), F.coalesce("value", plain)).otherwise(plain)
    named = slots.join(first, [*_SHEET, "col"], "left").withColumn("_h", name)
    repeat = F.row_number().over(W.partitionBy(*_SHEET, F.lower("_h")).orderBy("col"))
    return named.withColumn("_k", repeat).select(
        *_SHEET, "col",
        F.when(F.col("_k") == 1, F.col("_h")).otherwise(F.concat_ws(" ", "_h", F.col("_k").cast("string"))).alias("header"))


def column_types(grid: DataFrame, flags: DataFrame) -> DataFrame:
    """doc, sheet, col, type of every column by all its data values: integer, decimal, date or string; null if it has none.
    Each type holds if it holds for all values, so parts of a column of any length are judged apart and merged."""
    rows = grid.drop("width", "height").join(flags.select(*_SHEET, F.col("has_header").cast("int").alias("_skip")), _SHEET)
    whole, number, date = (tx.is_integer(F.col("value")), tx.is_decimal(F.col("value")), tx.is_date(F.col("value")))
    found = rows.filter(F.col("row") > F.col("_skip")).groupBy(*_SHEET, "col").agg(
        F.bool_and(whole).alias("_i"), F.bool_and(number).alias("_n"), F.bool_and(date).alias("_d"))
    slots = flags.select(*_SHEET, F.explode(F.sequence(F.lit(1), F.col("width"))).alias("col"))
    kind = F.when(F.col("_i"), "integer").when(F.col("_n"), "decimal").when(F.col("_d"), "date").when(F.col("_d").isNotNull(), "string")
    return cut_lineage(slots.join(found, [*_SHEET, "col"], "left").select(*_SHEET, "col", kind.alias("type")))


def coerced(grid: DataFrame, types: DataFrame) -> DataFrame:
    """The cells with ``json``, the value as JSON text by the type of its column: numbers as numbers, dates in ISO form."""
    return grid.drop("type").join(types, [*_SHEET, "col"]).withColumn("json", tx.cell_json(F.col("value"), F.col("type")))


def row_maps(grid: DataFrame, flags: DataFrame, heads: DataFrame, cap: int | None = None) -> DataFrame:
    """doc, sheet, row (1-based data row), values map<header,value>; the first ``cap``
    data rows of a sheet, if it is given. Where two columns end up with the same header, the last wins."""
    data = grid.drop("width", "height").join(
        flags.select(*_SHEET, F.col("has_header").cast("int").alias("_skip")), _SHEET)
    data = data.withColumn("row", F.col("row") - F.col("_skip")).filter(F.col("row") >= 1)
    if cap is not None:
        data = data.filter(F.col("row") <= cap)
    rows = data.select(*_SHEET, "row").distinct()
    names = heads.groupBy(*_SHEET, "header").agg(F.max("col").alias("col"))
    named = data.join(names, [*_SHEET, "col"])
    values = F.map_from_entries(F.array_sort(F.collect_list(F.struct("header", "value"))))
    found = named.groupBy(*_SHEET, "row").agg(values.alias("_m"))
    keys = names.groupBy(*_SHEET).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col", "header"))), lambda s: s["header"]).alias("_names"))
    full = F.map_from_arrays("_names", F.transform("_names", lambda h: F.try_element_at(F.col("_m"), h)))
    empty = F.create_map().cast("map<string,string>")
    return (
        rows.join(found, [*_SHEET, "row"], "left").join(keys, _SHEET)
        .withColumn("_m", F.coalesce("_m", empty))
        .select(*_SHEET, "row", full.alias("values"))
    )


def cap_warnings(flags: DataFrame, cap: int, message: Column) -> DataFrame:
    """row_count after the cap, data_range before it, and a warning where rows were left out."""
    data_rows = F.col("height") - F.col("has_header").cast("int")
    return flags.select(
        *_SHEET, F.least(data_rows, F.lit(cap)).alias("row_count"),
        F.format_string("R1C1:R%dC%d", F.col("height"), F.col("width")).alias("data_range"),
        F.when(data_rows > cap, message).alias("warning"))


def table_samples(rows: DataFrame, keys: list[str], row: str = "row") -> DataFrame:
    """First, middle and last row of every table (all rows of a table of three or fewer)."""
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    middle = F.floor(F.col("_n") / 2) + 1
    return rows.join(size, keys).filter(
        (F.col("_n") <= 3) | F.col(row).isin(1) | (F.col(row) == middle) | (F.col(row) == F.col("_n"))).drop("_n")


def first_rows(rows: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    return top(rows, keys, [F.col("row")], k, "_k").drop("_k")


def table_summary(name: Column, row_count: Column, classification: Column, columns: Column,
                  samples: Column) -> Column:
    """'Table n. Rows: r. Type: c. Columns: a, b. Sample rows: Row 1: a=1; b=2 | ...'.
    ``samples`` is array<struct<row, values map>> in row order."""
    shown = F.slice(F.filter(F.transform(columns, tx.strip), lambda c: c != ""), 1, 6)
    label = F.coalesce(F.nullif(tx.collapse(name), F.lit("")), F.lit("data"))
    head = F.concat_ws(
        ". ", F.concat(F.lit("Table "), label), F.concat(F.lit("Rows: "), row_count.cast("string")),
        F.when(tx.collapse(classification) != "", F.concat(F.lit("Type: "), tx.collapse(classification))),
        F.when(F.size(shown) > 0, F.concat(F.lit("Columns: "), F.array_join(shown, ", "))))

    def line(s):
        cells = F.filter(
            F.transform(shown, lambda c: F.struct(c.alias("c"), tx.collapse(F.try_element_at(s["values"], c)).alias("v"))),
            lambda x: x["v"] != "")
        text = F.array_join(F.transform(cells, lambda x: F.concat_ws("=", x["c"], x["v"])), "; ")
        return F.when(F.size(cells) > 0, F.concat(F.lit("Row "), s["row"].cast("string"), F.lit(": "), text))

    lines = F.filter(F.transform(samples, line), lambda x: x.isNotNull())
    return F.when(F.size(lines) > 0, F.concat(head, F.lit(". Sample rows: "), F.array_join(lines, " | "))).otherwise(head)


def json_row(values: Column) -> Column:
    """A row map as JSON text with a blank after ',' and ':'."""
    def scalar(v):
        text = F.to_json(F.array(v), {"ignoreNullFields": "false"})
        return F.substring(text, F.lit(2), F.length(text) - 2)

    pairs = F.transform(F.map_entries(values), lambda e: F.concat_ws(": ", scalar(e["key"]), scalar(e["value"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
