"""Delimited text, cell grids, sections and sampled tables."""

from pyspark.sql import functions as F

from siftline.operators import chunks, grids, records, sections, summaries
from . import Registry, table
from .texts import _SECTION_SQL
from .sqltext import collapse, letters, summary_key

registry = Registry()


def _lines(spark, folder):
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return docs.withColumn("text", F.translate("text", '"', ""))


_LINES = """
ln AS (SELECT doc_id AS doc, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos,
              replace(unnest(string_split(text, chr(10))), '"', '') AS text FROM documents),
marks AS (SELECT * FROM (VALUES (',', 0), (';', -1), ('|', -2), (chr(9), -3)) m(mark, prio)),
tally AS (SELECT doc, mark, prio, count(*) FILTER (WHERE contains(text, mark)) AS hit,
                 sum(length(text) - length(replace(text, mark, ''))) AS n FROM ln, marks GROUP BY ALL),
vote AS (SELECT doc, CASE WHEN hit > 0 THEN mark ELSE ',' END AS mark FROM (
           SELECT *, row_number() OVER (PARTITION BY doc ORDER BY hit DESC, n DESC, prio DESC) AS r FROM tally) WHERE r = 1),
cell AS (SELECT doc, pos, generate_subscripts(string_split(text, mark), 1) AS col,
                nullif(trim(unnest(string_split(text, mark))), '') AS value FROM ln JOIN vote USING (doc)),
full_ AS (SELECT * FROM cell WHERE value IS NOT NULL),
grid AS (SELECT doc, dense_rank() OVER (PARTITION BY doc ORDER BY pos) AS row, col, value,
                max(col) OVER (PARTITION BY doc) AS width FROM full_),
size AS (SELECT doc, max(row) AS height, max(width) AS width FROM grid GROUP BY doc),
flag AS (SELECT doc, count(*) FILTER (WHERE try_cast(value AS DOUBLE) IS NULL) >= greatest(1, count(*) // 2) AS has_header
         FROM grid WHERE row = 1 GROUP BY doc),
slot AS (SELECT doc, has_header, unnest(range(1, width + 1)) AS col FROM flag JOIN size USING (doc)),
head0 AS (SELECT s.doc, s.col, CASE WHEN has_header THEN coalesce(g.value, 'Column ' || s.col) ELSE 'Column ' || s.col END AS h
          FROM slot s LEFT JOIN grid g ON g.doc = s.doc AND g.col = s.col AND g.row = 1),
head AS (SELECT doc, col, h || CASE WHEN k = 1 THEN '' ELSE ' ' || k END AS header FROM (
           SELECT *, row_number() OVER (PARTITION BY doc, lower(h) ORDER BY col) AS k FROM head0))
"""


@registry.add(f"WITH {_LINES} SELECT doc, mark FROM vote")
def delimiter_votes(spark, folder):
    return grids.delimiter_votes(_lines(spark, folder))


def _grid(spark, folder):
    lines = _lines(spark, folder)
    cells = grids.split_lines(lines, grids.delimiter_votes(lines))
    number = F.col("value").try_cast("double").isNotNull()
    return grids.trim_grid(cells.withColumn("type", F.when(number, "number").otherwise("string")))


@registry.add(f"""WITH {_LINES}
SELECT doc, max(height) AS height, max(size.width) AS width, count(*) AS filled,
       md5(string_agg(row || ':' || col || '=' || value, '|' ORDER BY row, col)) AS body
FROM grid JOIN size USING (doc) GROUP BY doc""")
def grid_trim(spark, folder):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "value"))),
                                    lambda s: F.concat(s["row"], F.lit(":"), s["col"], F.lit("="), s["value"])), "|")
    return _grid(spark, folder).groupBy("doc").agg(
        F.max("height").alias("height"), F.max("width").cast("long").alias("width"),
        F.count(F.lit(1)).alias("filled"), F.md5(text).alias("body"))


@registry.add(f"WITH {_LINES} SELECT doc, CAST(col AS BIGINT) AS col, header, has_header FROM head JOIN flag USING (doc)")
def grid_headers(spark, folder):
    grid = _grid(spark, folder)
    flags = grids.header_flags(grid)
    heads = grids.headers(grid, flags)
    return heads.join(flags.select("doc", "has_header"), "doc").select(
        "doc", F.col("col").cast("long").alias("col"), "header", "has_header")


@registry.add(f"""WITH {_LINES},
last AS (SELECT doc, header, max(col) AS col FROM head GROUP BY ALL),
data AS (SELECT g.doc, g.row - CASE WHEN has_header THEN 1 ELSE 0 END AS row, g.col, g.value
         FROM grid g JOIN flag USING (doc))
SELECT d.doc, d.row, count(l.header) AS cells,
       md5(coalesce(string_agg(l.header || '=' || d.value, '|' ORDER BY l.header), '')) AS body
FROM data d LEFT JOIN last l ON l.doc = d.doc AND l.col = d.col
WHERE d.row >= 1 GROUP BY ALL""")
def grid_rows(spark, folder):
    grid = _grid(spark, folder)
    flags = grids.header_flags(grid)
    rows = grids.row_maps(grid, flags, grids.headers(grid, flags))
    filled = F.filter(F.array_sort(F.map_entries("values")), lambda e: e["value"].isNotNull())
    return rows.select(
        "doc", "row", F.size(filled).cast("long").alias("cells"),
        F.md5(F.array_join(F.transform(filled, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")).alias("body"))


@registry.add(f"""WITH {_LINES}
SELECT doc, least(height - CASE WHEN has_header THEN 1 ELSE 0 END, 3) AS row_count,
       'R1C1:R' || height || 'C' || width AS data_range,
       CASE WHEN height - CASE WHEN has_header THEN 1 ELSE 0 END > 3 THEN doc || ' was truncated to 3 rows' END AS warning
FROM size JOIN flag USING (doc)""")
def grid_row_cap(spark, folder):
    """The row cap of a parsed table is a feature; here it is 3 so that it acts."""
    flags = grids.header_flags(_grid(spark, folder))
    note = F.concat(F.col("doc").cast("string"), F.lit(" was truncated to 3 rows"))
    return grids.cap_warnings(flags, 3, note).drop("sheet")


@registry.add(f"""
WITH c AS (SELECT conv_id, turn, role, trim(text) AS text FROM conversations WHERE trim(text) <> ''),
i AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c),
s AS (SELECT conv_id, island, coalesce(max(text) FILTER (WHERE role = 'user'), 'Document') AS title,
             string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role <> 'user') AS text FROM i GROUP BY ALL)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY island) AS section_order, title, md5(text) AS body
FROM s WHERE text IS NOT NULL""")
def sections_from_turns(spark, folder):
    return _turn_sections(spark, folder).select(
        F.col("document_id").alias("conv_id"), "section_order", "title", F.md5("text").alias("body"))


def _turn_sections(spark, folder):
    style = F.when(F.col("role") == "user", "Heading 1").otherwise("Normal")
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("document_id"), F.col("turn").alias("pos"), style.alias("style"), "text")
    return sections.paragraph_sections(turns)


@registry.add("""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(trim(text, chr(10) || ' '), chr(10)), 1) AS pos,
                  trim(unnest(string_split(trim(text, chr(10) || ' '), chr(10)))) AS t FROM documents),
w AS (SELECT *, list_filter(string_split(t, ' '), lambda x: x <> '') AS ws FROM l),
h AS (SELECT doc_id, pos, t, t <> '' AND length(t) <= 120 AND (starts_with(t, '#') OR regexp_matches(t, '^\\d+(\\.\\d+)*\\s+\\S+')
        OR (NOT ends_with(t, '.') AND len(ws) BETWEEN 1 AND 10
            AND len(list_filter(ws, lambda x: regexp_matches(x, '^\\p{Lu}'))) >= greatest(1, len(ws) // 2))) AS hd FROM w),
i AS (SELECT *, sum(CASE WHEN hd THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM h),
s AS (SELECT doc_id, island, coalesce(max(trim(ltrim(t, '#'))) FILTER (WHERE hd), 'Text') AS title,
             trim(string_agg(t, chr(10) ORDER BY pos) FILTER (WHERE NOT hd), chr(10) || ' ') AS text FROM i GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) AS section_order, title, md5(text) AS body
FROM s WHERE text <> ''""")
def sections_from_lines(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return sections.text_sections(docs).select(
        F.col("document_id").alias("doc_id"), "section_order", "title", F.md5("text").alias("body"))


@registry.add("""
SELECT doc, page, 'Page ' || page AS title, page AS page_from, length(t) AS n_chars FROM (
  SELECT page_id // 10 AS doc, page_id % 10 + 1 AS page,
         regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM pages) WHERE t <> ''""")
def page_sections(spark, folder):
    pages = table(spark, folder, "pages").select(
        F.floor(F.col("page_id") / 10).alias("document_id"), (F.col("page_id") % 10 + 1).alias("page"),
        F.regexp_replace("html", "<[^>]+>", "").alias("text"))
    out = sections.page_sections(pages)
    return out.select(F.col("document_id").alias("doc"), F.col("section_order").alias("page"), "title", "page_from",
                      F.length("text").cast("long").alias("n_chars"))


def _turn_rows(spark, folder):
    values = F.create_map(F.lit("role"), F.col("role"), F.lit("text"), F.col("text"))
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("row"), values.alias("values"))


_SAMPLE = """
n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
s AS (SELECT c.conv_id, c.turn + 1 AS row, role, text, n FROM conversations c JOIN n USING (conv_id)
      WHERE n <= 3 OR c.turn IN (0, n // 2, n - 1))
"""


@registry.add(f"WITH {_SAMPLE} SELECT conv_id AS doc, row FROM s")
def table_samples(spark, folder):
    return grids.table_samples(_turn_rows(spark, folder), ["doc"]).select("doc", "row")


@registry.add(f"""WITH {_SAMPLE}
SELECT conv_id AS doc, md5('Table turns. Rows: ' || max(n) || '. Type: results. Columns: role, text. Sample rows: ' ||
   string_agg('Row ' || row || ': role=' || role || '; text=' || {collapse('text')}, ' | ' ORDER BY row)) AS summary
FROM s GROUP BY conv_id""")
def table_summaries(spark, folder):
    rows = _turn_rows(spark, folder)
    picked = grids.table_samples(rows, ["doc"]).groupBy("doc").agg(
        F.array_sort(F.collect_list(F.struct("row", F.map_entries("values").alias("e")))).alias("s"))
    samples = F.transform("s", lambda s: F.struct(s["row"].alias("row"), F.map_from_entries(s["e"]).alias("values")))
    size = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    text = grids.table_summary(F.lit("turns"), F.col("n"), F.lit("results"), F.array(F.lit("role"), F.lit("text")), samples)
    return picked.join(size, "doc").select("doc", F.md5(text).alias("summary"))


@registry.add("WITH RECURSIVE " + registry.sql["sections_from_turns"].split("SELECT conv_id, row_number()")[0].replace("WITH", "", 1) + """,
documents AS (SELECT conv_id * 1000000 + island AS doc_id, text FROM s WHERE text IS NOT NULL),
""" + _SECTION_SQL.replace("WITH RECURSIVE", "", 1) + """,
u AS (SELECT doc_id, seq, 0 AS s, c FROM packed UNION ALL SELECT doc_id, seq, s, trim(substr(x, s + 1, e - s)) AS c FROM l),
tab AS (SELECT conv_id, count(*) AS n,
          string_agg('{"turn": "' || turn || '", "role": "' || role || '"}', ', ' ORDER BY turn) FILTER (WHERE turn < 3) AS rows
        FROM conversations GROUP BY conv_id),
j AS (SELECT doc_id // 1000000 AS conv_id, 'text' AS kind, c AS text, doc_id AS o, seq, s FROM u
      UNION ALL SELECT conv_id, 'table_summary',
             'Table turns has ' || n || ' rows and columns: turn, role. Sample rows: [' || rows || ']', conv_id * 1000000 + 999999, 0, 0 FROM tab)
SELECT conv_id, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) - 1 AS last_index,
       md5(string_agg(text, '|' ORDER BY o, seq, s)) AS in_order, max(text) FILTER (WHERE kind = 'table_summary') AS table_text FROM j GROUP BY conv_id""")
def document_chunks(spark, folder):
    """Section chunks and the table summary of every conversation."""
    secs = _turn_sections(spark, folder).select(
        "*", F.lit(None).cast("int").alias("page_from"), F.lit(None).cast("int").alias("page_to"))
    row = F.create_map(F.lit("turn"), F.col("turn").cast("string"), F.lit("role"), F.col("role"))
    turns = table(spark, folder, "conversations").select(F.col("conv_id").alias("document_id"), "turn", grids.json_row(row).alias("j"))
    sample = F.transform(F.array_sort(F.collect_list(F.when(F.col("turn") < 3, F.struct("turn", "j")))), lambda s: s["j"])
    tabs = turns.groupBy("document_id").agg(F.count(F.lit(1)).alias("row_count"), sample.alias("sample")).select(
        "document_id", F.lit(1).alias("table_order"), F.lit("turns").alias("name"), F.lit("turns").alias("sheet_name"),
        F.array(F.lit("turn"), F.lit("role")).alias("columns"), "row_count", "sample")
    out = chunks.document_chunks(secs, tabs)
    placed = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c["text"])
    return out.groupBy(F.col("document_id").alias("conv_id")).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"), F.max("chunk_index").alias("last_index"),
        F.md5(F.array_join(placed, "|")).alias("in_order"),
        F.max(F.when(F.col("kind") == "table_summary", F.col("text"))).alias("table_text"))


@registry.add(f"""
WITH RECURSIVE b0 AS (SELECT conv_id, turn, role, {collapse('text')} AS t FROM conversations),
b1 AS (SELECT conv_id, turn, CASE WHEN contains({summary_key('substr(t, 1, 220)')}, {summary_key('role')}) THEN t ELSE role || ' ' || t END AS blk
       FROM b0 WHERE length(t) >= 40 OR {letters('t')} >= 12),
b2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, {summary_key('blk')} ORDER BY turn) AS d FROM b1
       WHERE {summary_key('blk')} <> ''),
b3 AS (SELECT conv_id, blk, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM b2 WHERE d = 1),
b4 AS (SELECT conv_id, blk, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS k, least(n, 5) AS slots FROM b3
       WHERE n <= 5 OR i IN (1, 2, n // 2 + 1, n - 1, n)),
f AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, '' AS text, CAST(0 AS BIGINT) AS used, max(slots) AS slots FROM b4 GROUP BY conv_id
  UNION ALL
  SELECT conv_id, k, CASE WHEN text = '' THEN p ELSE text || chr(10) || chr(10) || p END, used + length(p) + 2, greatest(slots - 1, 1) FROM (
    SELECT conv_id, k, text, used, slots, CASE WHEN length(blk) <= lim THEN blk
      ELSE rtrim(substr(blk, 1, greatest(CAST(floor(lim * 0.6) AS BIGINT), 120)), ' ,;:-') || ' ... ' ||
           ltrim(right(blk, greatest(lim - greatest(CAST(floor(lim * 0.6) AS BIGINT), 120) - 5, 80)), ' ,;:-') END AS p
    FROM (SELECT f.conv_id, b4.k, f.text, f.used, f.slots, b4.blk, least(900, greatest(180, (2000 - f.used) // f.slots)) AS lim
          FROM f JOIN b4 ON b4.conv_id = f.conv_id AND b4.k = f.k + 1 WHERE 2000 - f.used >= 120)))
SELECT conv_id, length(text) AS n_chars, md5(text) AS body FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1""")
def summary_samples(spark, folder):
    parts = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("document_id"), F.col("turn").alias("pos"), F.col("role").alias("title"), "text")
    out = summaries.sample_text(summaries.summary_blocks(parts), 2000)
    return out.select(F.col("document_id").alias("conv_id"), F.length("sample").cast("long").alias("n_chars"),
                      F.md5("sample").alias("body"))


def _typed(spark, folder):
    """Order lines as delimited text: whole numbers, decimals, days, words and mixed columns."""
    rows = table(spark, folder, "lineitem").withColumn("day", F.date_format("l_shipdate", "dd.MM.yyyy"))
    doc = F.col("l_suppkey") % 40
    columns = [F.col("l_orderkey").cast("string"), F.format_string("%.2f", F.col("l_extendedprice")), F.col("day"), F.col("l_returnflag"),
               F.when(F.col("l_linenumber") == 1, F.col("day")).otherwise(F.col("l_linenumber").cast("string"))]
    cells = rows.select(doc.alias("doc"), F.lit("").alias("sheet"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"),
                        F.posexplode(F.array(*columns)).alias("col", "value"))
    return grids.trim_grid(cells.select("doc", "sheet", "row", (F.col("col") + 1).alias("col"), "value", F.lit("string").alias("type")))


@registry.add("""
WITH r AS (SELECT l_suppkey % 40 AS doc, * FROM lineitem), k AS (SELECT doc, min(l_orderkey * 8 + l_linenumber) AS head FROM r GROUP BY doc),
d AS (SELECT r.* FROM r JOIN k ON r.doc = k.doc WHERE l_orderkey * 8 + l_linenumber > head)
SELECT doc, 1 AS col, 'integer' AS type, count(*) AS cells, sum(l_orderkey)::DOUBLE AS total FROM d GROUP BY doc
UNION ALL SELECT doc, 2, 'decimal', count(*), round(sum(round(l_extendedprice, 2)), 2) FROM d GROUP BY doc
UNION ALL SELECT doc, 3, 'date', count(*), sum(year(l_shipdate))::DOUBLE FROM d GROUP BY doc
UNION ALL SELECT doc, 4, 'string', count(*), NULL FROM d GROUP BY doc
UNION ALL SELECT doc, 5, CASE WHEN count(*) FILTER (WHERE l_linenumber = 1) = 0 THEN 'integer' WHEN count(*) FILTER (WHERE l_linenumber <> 1) = 0 THEN 'date' ELSE 'string' END,
  count(*), CASE WHEN count(*) FILTER (WHERE l_linenumber = 1) = 0 THEN sum(l_linenumber)::DOUBLE END FROM d GROUP BY doc""")
def column_types(spark, folder):
    grid = _typed(spark, folder)
    flags = grids.header_flags(grid, "always")
    types = grids.column_types(grid, flags)
    cells = grids.coerced(grid, types).filter(F.col("row") > 1)
    number = F.when(F.col("type") == "date", F.substring("json", 2, 4)).when(F.col("type") != "string", F.col("json")).cast("double")
    total = F.sum(number)
    return cells.groupBy("doc", "col", "type").agg(F.count(F.lit(1)).alias("cells"), F.when(F.col("type") == "decimal", F.round(total, 2)).otherwise(total).alias("total"))


@registry.add()
def delimited_records(spark, folder):
    """Records, fields and line breaks inside fields of every document, read as delimited text with its quotes."""
    lines = table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    found = records.records(lines, grids.delimiter_votes(lines)).withColumn("f", records.fields(F.col("text"), F.col("mark")))
    return found.groupBy("doc").agg(F.count(F.lit(1)).alias("records"), F.sum(F.size("f")).alias("fields"), F.sum(F.regexp_count("text", F.lit("\n"))).alias("breaks"))
